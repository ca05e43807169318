"""Header rows of grids: (file, sheet, row_no, cells array<string>) to one header row per sheet.

Every rule looks at a bounded number of leading rows, so those are filtered out first and one aggregate per sheet
decides. Only counts, never the cells of a whole sheet, are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import text as tx

SHEET = ("file", "sheet")


def filled(cells: Column | str) -> Column:
    """Number of cells that aren't blank."""
    return F.size(F.filter(tx.col(cells), lambda c: ~tx.is_blank(c)))


def texty(cells: Column | str) -> Column:
    """Number of cells with a letter."""
    return F.size(F.filter(tx.col(cells), lambda c: F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))))


def first_row_or_reason(grid: DataFrame) -> DataFrame:
    """file, sheet, reason: null where row 1 is a header, else the first reason why it isn't."""
    rows = grid.withColumn("n", filled("cells"))
    sheet = rows.groupBy(*SHEET).agg(
        F.min(F.when(F.col("n") > 0, F.col("row_no"))).alias("first"),
        F.min_by("cells", "row_no").alias("cells"),
        F.count_if((F.col("n") > 0) & (F.col("row_no") > 1)).alias("data"),
    )
    n = filled("cells")
    long = F.exists("cells", lambda c: F.coalesce(F.length(c) > 120, F.lit(False)))
    reason = (
        F.when(F.col("first").isNull(), "the sheet is empty")
        .when(F.col("first") != 1, F.concat(F.lit("the first filled row is row "), F.col("first").cast("string")))
        .when(n < 2, "row 1 has fewer than 2 filled cells")
        .when((texty("cells") < 2) | (texty("cells") < 0.6 * n), "row 1 is mostly not text")
        .when(long, "row 1 has a cell of over 120 characters")
        .when(F.col("data") == 0, "no data below row 1")
    )
    return sheet.select(*SHEET, reason.alias("reason"))


def by_keyword(grid: DataFrame, keyword: str = "employeename", scan: int = 30) -> DataFrame:
    """Of the first rows with a cell whose key starts with the keyword and 2 filled cells: the widest, the lower on ties."""
    hit = F.exists("cells", lambda c: F.coalesce(tx.key_compact(c).startswith(keyword), F.lit(False)))
    rows = grid.filter(F.col("row_no") <= scan).withColumn("n", filled("cells")).filter(hit & (F.col("n") >= 2))
    return rows.groupBy(*SHEET).agg(F.max_by("row_no", F.struct("n", "row_no")).alias("header_row"))


def by_targets(grid: DataFrame, targets: tuple[str, ...], least: int = 2, scan: int = 25) -> DataFrame:
    """Of the first rows the one with most of the targets, the earliest on ties."""
    keys = F.transform("cells", lambda c: F.coalesce(tx.key_compact(c), F.lit("")))
    n = F.size(F.array_intersect(keys, F.array(*[F.lit(t) for t in targets])))
    rows = grid.filter(F.col("row_no") <= scan).withColumn("n", n).filter(F.col("n") >= least)
    return rows.groupBy(*SHEET).agg(F.max_by("row_no", F.struct("n", -F.col("row_no"))).alias("header_row"), F.max("n").alias("matched"))


#: What counts as a number in a header cell, thousands separators aside.
NUMERIC = r"^[+-]?([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def by_score(grid: DataFrame, scan: int = 40, ahead: int = 40, least: float = 0.55, slack: float = 0.06) -> DataFrame:
    """file, sheet, header_row: of the first `scan` filled rows the earliest that scores within `slack` of the best one; the
    first filled row where none scores `least`. Sheets without a filled row have no result.

    A row's score is .45 of the columns filled below it that it labels, .20 of its cells that are no number, .15 of
    distinct ones, .10 of cells up to 60 characters and .10 of cells that stand over filled columns. A column is filled
    below a row if two of the next `ahead` rows have it, or one where at most two follow.

    A sheet sends scan + ahead rows at most, as one number for each cell, to one row, and a single fold from the last row
    to the first keeps the number of filled cells of each column in the window.
    """
    place = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_no"))
    values = F.transform(F.filter("cells", lambda c: ~tx.is_blank(c)), lambda c: tx.strip(c))
    rows = grid.filter(F.exists("cells", lambda c: ~tx.is_blank(c))).withColumn("place", place).filter(F.col("place") <= scan + ahead).withColumn("values", values)
    number = lambda keep: F.size(F.filter("values", keep)).alias
    mask = F.transform("cells", lambda c: (~tx.is_blank(c)).cast("int"))
    measured = F.struct(
        F.col("place"),
        F.col("row_no"),
        mask.alias("mask"),
        F.size("values").alias("n"),
        number(lambda v: ~F.regexp_replace(v, ",", "").rlike(NUMERIC))("textual"),
        F.size(F.array_distinct(F.transform("values", lambda v: F.lower(v)))).alias("distinct"),
        number(lambda v: F.length(v) <= 60)("short"),
    )
    sheets = rows.groupBy(*SHEET).agg(F.array_sort(F.collect_list(measured)).alias("rows"))
    plus = lambda a, b, sign: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + sign * F.coalesce(y, F.lit(0)))
    # A bound value is computed once, however often its function reads it.
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def scored(state, i):
        row, below = F.get(F.col("rows"), i), F.least(F.size("rows") - 1 - i, F.lit(ahead))
        least_filled = F.when(below <= 2, 1).otherwise(2)
        hits = F.zip_with(row["mask"], state["filled"], lambda a, k: F.coalesce((a == 1) & (k >= least_filled), F.lit(False)))
        counts = F.struct(F.size(F.filter(state["filled"], lambda k: k >= least_filled)).alias("used"), F.size(F.filter(hits, lambda x: x)).alias("both"), row["n"].alias("n"), row["textual"].alias("textual"), row["distinct"].alias("distinct"), row["short"].alias("short"), row["row_no"].alias("row_no"))

        def score(c):
            n = c["n"]
            value = (c["both"] / c["used"]) * 0.45 + (c["textual"] / n) * 0.20 + (c["distinct"] / n) * 0.15 + (c["short"] / n) * 0.10 + (1 - (n - c["both"]) / n) * 0.10
            return F.when(c["used"] > 0, F.struct(value.alias("score"), c["row_no"].alias("row_no")))

        after = F.coalesce(F.get(F.col("rows"), i + ahead)["mask"], F.array().cast("array<int>"))
        return F.struct(
            plus(plus(state["filled"], row["mask"], 1), after, -1).alias("filled"),
            F.when((i < scan) & (below > 0), F.concat(state["scores"], F.array_compact(F.array(bound(counts, score))))).otherwise(state["scores"]).alias("scores"),
        )

    start = F.struct(F.array().cast("array<int>").alias("filled"), F.array().cast("array<struct<score:double,row_no:int>>").alias("scores"))
    upward = F.reverse(F.sequence(F.lit(0), F.size("rows") - 1))
    found = sheets.withColumn("scores", F.aggregate(upward, start, scored, lambda s: s["scores"]))
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    near = F.array_min(F.transform(F.filter("scores", lambda s: s["score"] >= F.col("top") - slack), lambda s: s["row_no"]))
    return found.withColumn("top", top).select(*SHEET, F.when(F.col("top") >= least, near).otherwise(F.get("rows", F.lit(0))["row_no"]).alias("header_row"))


def first_filled(grid: DataFrame) -> DataFrame:
    """The first row that isn't blank."""
    return grid.filter(filled("cells") > 0).groupBy(*SHEET).agg(F.min("row_no").alias("header_row"))


def cleaned_names(headers: DataFrame, style: str = "underscore") -> DataFrame:
    """file, sheet, pos, name of (file, sheet, cells): blanks named by position, repeats numbered.

    style: 'underscore' (x_2), 'paren' (x (2)) or 'dot' (x.1); blank is Column_<pos> or, for 'paren', Column <letter>.
    """
    named = headers.select(*SHEET, F.posexplode("cells").alias("pos", "raw"))
    blank = F.concat(F.lit("Column "), tx.column_letter(F.col("pos") + 1)) if style == "paren" else F.concat(F.lit("Column_"), (F.col("pos") + 1).cast("string"))
    named = named.withColumn("base", F.when(tx.is_blank("raw"), blank).otherwise(F.substring(tx.squeeze("raw"), 1, 120)))
    k = F.row_number().over(Window.partitionBy(*SHEET, F.lower("base")).orderBy("pos"))
    suffix = {"underscore": F.concat(F.lit("_"), k.cast("string")), "paren": F.concat(F.lit(" ("), k.cast("string"), F.lit(")")), "dot": F.concat(F.lit("."), (k - 1).cast("string"))}[style]
    return named.select(*SHEET, "pos", F.when(k > 1, F.concat("base", suffix)).otherwise(F.col("base")).alias("name"))


def without_repeated_headers(grid: DataFrame, header: str = "header_row") -> DataFrame:
    """Rows below each sheet's header row that aren't the header again: equal cells by normalised key, trailing blanks aside.

    grid has the header's row number as a column. One row per sheet is joined back, so no sheet is gathered.
    """
    signature = F.regexp_replace(F.array_join(F.transform("cells", lambda c: F.coalesce(tx.key_words(c), F.lit(""))), "\x1f"), "\x1f+$", "")
    signed = grid.withColumn("__signature", signature)
    heads = signed.filter(F.col("row_no") == F.col(header)).groupBy(*SHEET).agg(F.min("__signature").alias("__head"))
    kept = signed.filter(F.col("row_no") > F.col(header)).join(heads, list(SHEET), "left")
    return kept.filter(~F.col("__signature").eqNullSafe(F.col("__head"))).select(*grid.columns)
