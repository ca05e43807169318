"""Lines, blocks, columns and gutters of positioned words: (page keys, x0, x1, top, bottom, text).

Line rules fold over a page's words in order of height inside one expression, without Python. A page bounds the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_lines(words: DataFrame, page: list[str], y: str = "top", x: str = "x0", step: float = 3.0, tie: list[str] | None = None) -> DataFrame:
    """Lines of equal bround(y / step) * step, words joined by x: page keys, line_y, n_words, text."""
    line = (F.bround(F.col(y) / step) * step).alias("line_y")
    order = F.struct(x, *(tie or []), "text")
    return words.groupBy(*page, line).agg(F.count("*").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda w: w["text"]), " ").alias("text"))


def _fold(ys: Column, step) -> Column:
    """Line number of each of the ascending heights: step(state, y) gives the next (line, a, b) state."""
    empty = F.lit(None).cast("struct<line:int,a:double,b:double>")
    start = F.struct(empty.alias("at"), F.array().cast("array<int>").alias("lines"))

    def add(state, y):
        at = step(state["at"], y)
        return F.struct(at.alias("at"), F.concat(state["lines"], F.array(at["line"])).alias("lines"))

    return F.aggregate(ys, start, add)["lines"]


def _state(line, a, b) -> Column:
    return F.struct(line.cast("int").alias("line"), a.cast("double").alias("a"), b.cast("double").alias("b"))


def anchor_lines(ys: Column, tolerance: float | Column) -> Column:
    """A new line starts when a height is further than the tolerance from the line's first one."""

    def step(at, y):
        new = F.coalesce(y - at["a"] > tolerance, F.lit(True))
        return F.when(new, _state(F.coalesce(at["line"] + 1, F.lit(0)), y, F.lit(0))).otherwise(_state(at["line"], at["a"], F.lit(0)))

    return _fold(ys, step)


def mean_lines(ys: Column, tolerance: float | Column) -> Column:
    """A new line starts when a height is further than the tolerance from the mean of the line so far."""

    def step(at, y):
        new = F.coalesce(y - at["a"] / at["b"] > tolerance, F.lit(True))
        return F.when(new, _state(F.coalesce(at["line"] + 1, F.lit(0)), y, F.lit(1))).otherwise(_state(at["line"], at["a"] + y, at["b"] + 1))

    return _fold(ys, step)


def first_fit_lines(ys: Column, tolerance: float | Column) -> Column:
    """The first line, in order of their making, whose first height is within the tolerance; else a new one. Heights may be
    in any order."""

    def add(state, y):
        hit = F.array_position(F.transform(state["firsts"], lambda f: F.abs(f - y) <= tolerance), True)
        new = hit == 0
        firsts = F.when(new, F.concat(state["firsts"], F.array(y.cast("double")))).otherwise(state["firsts"])
        at = F.when(new, F.size(state["firsts"])).otherwise(hit.cast("int") - 1)
        return F.struct(firsts.alias("firsts"), F.concat(state["lines"], F.array(at)).alias("lines"))

    start = F.struct(F.array().cast("array<double>").alias("firsts"), F.array().cast("array<int>").alias("lines"))
    return F.aggregate(ys, start, add)["lines"]


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def page_lines(words: DataFrame, page: list[str], rule: str = "anchor", tolerance: float | None = None) -> DataFrame:
    """page keys, line_no, top, text and words (by x) of every line. Without a tolerance: max(1.5, share * median height)."""
    sorted_words = F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "bottom", "text"))).alias("ws")
    pages = words.groupBy(*page).agg(sorted_words)
    height = upper_median(F.transform("ws", lambda w: w["bottom"] - w["top"]))
    limit = F.lit(tolerance) if tolerance is not None else F.greatest(F.lit(1.5), F.lit(0.4 if rule == "anchor" else 0.5) * height)
    ys = F.transform("ws", lambda w: w["top"])
    pages = pages.withColumn("limit", limit).withColumn("lines", {"anchor": anchor_lines, "mean": mean_lines, "first_fit": first_fit_lines}[rule](ys, F.col("limit")))
    each = pages.select(*page, F.explode(F.arrays_zip("ws", "lines")).alias("z")).select(*page, F.col("z.lines").alias("line_no"), F.col("z.ws.x0").alias("x0"), F.col("z.ws.x1").alias("x1"), F.col("z.ws.top").alias("top"), F.col("z.ws.text").alias("text"))
    lined = each.groupBy(*page, "line_no").agg(F.min("top").alias("top"), F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("words"))
    return lined.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def blocks_by_gap(df: DataFrame, partition: list[str], order: list[str], gap: Column) -> DataFrame:
    """df with block (from 0): a new one where `gap` holds between a row and the one before. `gap` may use prev_<order[0]>."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn(f"prev_{order[0]}", F.lag(order[0]).over(w)).withColumn("__new", F.coalesce(gap, F.lit(False)).cast("int"))
    return marked.withColumn("block", F.sum("__new").over(w).cast("int")).drop("__new", f"prev_{order[0]}")


def blocks_by_marker(df: DataFrame, partition: list[str], order: list[str], marker: Column) -> DataFrame:
    """df with block: number of marker rows up to this one; rows before the first are block 0."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("block", F.sum(F.coalesce(marker, F.lit(False)).cast("int")).over(w).cast("int"))


def look_ahead(df: DataFrame, partition: list[str], order: list[str], value: str, n: int) -> Column:
    """First of the next n values that isn't blank."""
    w = Window.partitionBy(*partition).orderBy(*order)
    following = [F.lead(value, i).over(w) for i in range(1, n + 1)]
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in following])


def gutters(words: DataFrame, page: list[str], low: float, high: float, step: float = 1.0) -> DataFrame:
    """Widest run of empty bins between low and high of each page, the first on ties: page keys, start, width (bins).

    Occupied bins are distinct per page; gaps lie between neighbours, so empty bins are never generated.
    """
    first, last = F.floor(F.lit(low) / step), F.floor(F.lit(high) / step)
    bins = words.select(*page, F.explode(F.sequence(F.floor(F.col("x0") / step), F.greatest(F.floor(F.col("x1") / step), F.floor(F.col("x0") / step)))).alias("bin")).filter((F.col("bin") >= first) & (F.col("bin") < last)).distinct()
    edges = words.select(*page).distinct().select(*page, F.explode(F.array(first - 1, last)).alias("bin"))
    w = Window.partitionBy(*page).orderBy("bin")
    runs = bins.unionByName(edges).withColumn("next", F.lead("bin").over(w)).withColumn("width", F.col("next") - F.col("bin") - 1)
    best = runs.filter("width > 0").groupBy(*page).agg(F.max_by(F.struct((F.col("bin") + 1).alias("start"), "width"), F.struct("width", -F.col("bin"))).alias("g"))
    return best.select(*page, F.col("g.start").alias("start"), F.col("g.width").alias("width"))


def column_clusters(words: DataFrame, page: list[str], gap: float) -> DataFrame:
    """Columns of words whose x gap to what lies left is at most `gap`: page keys, cluster, x_left, x_right, n_words."""
    w = Window.partitionBy(*page).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = words.withColumn("__new", F.coalesce(F.col("x0") - reach > gap, F.lit(False)).cast("int"))
    return marked.withColumn("cluster", F.sum("__new").over(w).cast("int")).groupBy(*page, "cluster").agg(F.min("x0").alias("x_left"), F.max("x1").alias("x_right"), F.count("*").alias("n_words"))


def header_bands(lines: DataFrame, page: list[str], captions: dict[str, tuple[str, ...]], margin: float = 2.0) -> DataFrame:
    """page keys and bands array<struct<key,left,right>> of the first line that holds every caption, in any order.

    A band reaches from its caption (0 for the first) to the next one, each less the margin.
    """
    def left(spellings: tuple[str, ...]) -> Column:
        return F.array_min(F.transform(F.filter("words", lambda w: F.upper(w["text"]).isin(*spellings)), lambda w: w["x0"]))

    found = F.array(*[F.struct(left(spellings).alias("x"), F.lit(key).alias("key")) for key, spellings in captions.items()])
    heads = lines.withColumn("c", F.array_sort(found)).filter(~F.exists("c", lambda c: c["x"].isNull()))
    top = heads.groupBy(*page).agg(F.min_by("c", "line_no").alias("c"), F.min("line_no").alias("header_line"))
    n = len(captions)
    band = lambda c, i: F.struct(c["key"].alias("key"), F.when(i == 0, 0.0).otherwise(c["x"] - margin).alias("left"), F.when(i == n - 1, float("inf")).otherwise(F.get(F.col("c"), i + 1)["x"] - margin).alias("right"))
    return top.select(*page, "header_line", F.transform("c", band).alias("bands"))


def banded(lines: DataFrame, bands: DataFrame, page: list[str], keys: list[str]) -> DataFrame:
    """Lines below the header line with one text column per band."""
    rows = lines.join(bands, page).filter("line_no > header_line")

    def cell(key: str) -> Column:
        band = F.get(F.filter("bands", lambda b: b["key"] == key), F.lit(0))
        return F.array_join(F.transform(F.filter("words", lambda w: (w["x0"] >= band["left"]) & (w["x0"] < band["right"])), lambda w: w["text"]), " ")

    return rows.select(*page, "line_no", *[cell(k).alias(k) for k in keys])


def measures(words: DataFrame, page: list[str]) -> DataFrame:
    """page keys, height (upper median of the words'), char_width (upper median) and gap (upper median between distinct tops)."""
    size = F.struct((F.col("bottom") - F.col("top")).alias("h"), ((F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))).alias("c"))
    got = words.groupBy(*page).agg(F.collect_list(size).alias("s"), F.array_sort(F.collect_set("top")).alias("tops"))
    gaps = F.transform(F.slice("tops", F.lit(2), F.greatest(F.size("tops") - 1, F.lit(0))), lambda y, i: y - F.get("tops", i))
    return got.select(*page, upper_median(F.transform("s", lambda x: x["h"])).alias("height"), upper_median(F.transform("s", lambda x: x["c"])).alias("char_width"), upper_median(gaps).alias("gap"))
