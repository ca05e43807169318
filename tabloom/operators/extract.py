"""Typed records from lines of positioned words, one function per layout rule.

Lines come from lines.page_lines: page keys, line_no, top, text, words array<struct<x0,x1,text>>. A page bounds every
array and window; pages spread over the cluster. Only rules that are sequential by nature (greedy pairing, carry of an
open record over pages) are grouped-map Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.operators import dedupe
from tabloom.operators import lines as ln

FILE, PAGE = ["file"], ["file", "page"]


def _over(*order: str) -> Window:
    return Window.partitionBy(*PAGE).orderBy(*(order or ("line_no",)))


def surrounding(column: str, before: int, after: int) -> Column:
    """The column's values over some lines around this one, in order."""
    w = _over()
    return F.array_compact(F.array(*[F.lead(column, i).over(w) if i else F.col(column) for i in range(-before, after + 1)]))


# Report lines with an id, an SSN and a name ------------------------------------------------------------------------


def split_sides(text: Column) -> Column:
    """struct(before, ssn, after) of a line, ssn null where it has none."""
    ssn = tx.find_ssn(text)
    at = F.position(F.coalesce(ssn, F.lit("\x00")), tx.fold(text))
    return F.struct(F.trim(F.when(at > 1, F.substring(tx.fold(text), F.lit(1), at - 1)).otherwise("")).alias("before"), ssn.alias("ssn"), F.trim(F.when(at > 0, F.substr(tx.fold(text), at + F.length(ssn))).otherwise("")).alias("after"))


#: Words that end a name on a report line.
STOP_WORDS = ("ACADEMIC", "COURSE", "CREDITS", "FULL", "GPA", "HALF", "HOURS", "PART", "PROGRAM", "REMEDIAL", "STATUS", "TIME", "TOTAL", "TERM", "WITHDRAWN")


def trimmed_name(text: Column) -> Column:
    """Words up to the first stop word, digit or colon; suffixes stay; '' if what is left is no name."""
    words = F.filter(F.split(tx.strip_honorific(text), " "), lambda w: w != "")
    bad = F.transform(words, lambda w: (F.upper(w).isin(*STOP_WORDS) | w.rlike("[0-9:]")) & ~F.upper(F.regexp_replace(w, r"\.", "")).isin(*tx.SUFFIXES))
    first = F.array_position(bad, True)
    kept = F.array_join(F.when(first > 0, F.slice(words, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0)))).otherwise(words), " ")
    return F.when(tx.looks_like_name(kept), kept).otherwise("")


def id_lines(lines: DataFrame) -> DataFrame:
    """Records of lines with an SSN: the id is the first loose id token, the name on whichever side has one, and the
    address what follows in the line or on the next two, where it looks like one."""
    sides = lines.withColumn("s", split_sides(F.col("text"))).withColumn("next", surrounding("text", 0, 2))
    tokens = F.split(F.concat_ws(" ", "s.before", "s.after"), " ")
    ident = F.get(F.filter(tokens, lambda t: t.rlike(r"^[0-9A-Z\-]{5,12}$") & tx.looks_like_part_id(t)), F.lit(0))
    without_id = lambda side: F.array_join(F.filter(F.split(side, " "), lambda t: F.coalesce(t != ident, F.lit(True))), " ")
    left, right = trimmed_name(without_id(F.col("s.before"))), trimmed_name(without_id(F.col("s.after")))
    tail = F.regexp_extract(F.col("s.after"), r"([0-9]+\s+\S.*)$", 1)
    below = F.filter(F.slice("next", 2, 2), lambda x: tx.looks_like_address(x) & tx.find_ssn(x).isNull())
    address = F.when(tx.looks_like_address(tail), tail).otherwise(F.array_join(below, ", "))
    found = sides.filter("s.ssn is not null").select(*PAGE, "line_no", ident.alias("student_id"), tx.norm_ssn("s.ssn").alias("ssn"), F.when(left != "", left).otherwise(right).alias("name"), address.alias("address"), F.when(tx.looks_like_address(tail), "same line").when(F.size(below) > 0, "below").otherwise("").alias("address_source"))
    notes = F.array_compact(F.array(F.when(F.col("name") == "", "no name"), F.when(F.col("student_id").isNull(), "no id"), F.when(F.col("ssn").contains("X"), "masked")))
    return found.withColumn("notes", F.array_join(notes, "; "))


def banded_rows(lines: DataFrame, captions: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per line below the captions, one column per band; a line without an id continues the row above it.

    Pages without captions use the last page's that had them.
    """
    bands = ln.header_bands(lines, PAGE, captions)
    pages = lines.select(*PAGE).distinct().join(bands, PAGE, "left")
    w = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    inherited = pages.select(*PAGE, F.coalesce("header_line", F.lit(-1)).alias("header_line"), F.last("bands", ignorenulls=True).over(w).alias("bands")).filter("bands is not null")
    keys = list(captions)
    rows = ln.banded(lines, inherited, PAGE, keys)
    anchor = F.last(F.when(F.col(keys[0]) != "", F.col("line_no")), ignorenulls=True).over(_over().rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("anchor", anchor).filter("anchor is not null").groupBy(*PAGE, "anchor")
    text = lambda k: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", k))), lambda s: s[k]), " "))
    return joined.agg(*[F.regexp_replace(text(k), " +", " ").alias(k) for k in keys]).withColumnRenamed("anchor", "line_no")


# Label blocks ------------------------------------------------------------------------------------------------------


def labelled_blocks(lines: DataFrame, labels: tuple[str, ...], gap: float) -> DataFrame:
    """A record per block of lines (a gap in height starts a new one): one column per label, '' where it is missing."""
    blocks = ln.blocks_by_gap(lines, PAGE, ["top"], F.col("top") - F.col("prev_top") > gap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n")
    whole = blocks.groupBy(*PAGE, "block").agg(text.alias("text"))
    names = [label.lower().replace(" ", "_") for label in labels]
    return whole.select(*PAGE, "block", *[tx.label_value("text", label, labels).alias(n) for label, n in zip(labels, names)])


def joined_record(held: dict | None, row: dict, first: bool, fields: list[str], identity: tuple[str, ...]) -> dict | None:
    """`held`, the open record of a file, joined with `row`, or None if the row is a record of its own.

    The first row of the page after the held record's joins it if no field has two values. A row without any identity
    field is a fragment and joins whatever record is open; one with identity joins only a record that lacks some.
    """
    if held is None or not first or row["page"] != held["page"] + 1:
        return None
    fragment = not any(row[f] for f in identity)
    if not fragment and all(held[f] for f in identity):
        return None
    if any(held[f] and row[f] and held[f] != row[f] for f in fields):
        return None
    return {**held, **{f: held[f] or row[f] for f in fields}, "page": row["page"]}


def carried_over_pages(records: DataFrame, fields: list[str], order: list[str], identity: tuple[str, ...] | None = None) -> DataFrame:
    """Records over any number of pages as one, by `joined_record`; page is that on which a record begins. All fields are
    identity unless some are named.

    Sequential by file, so each file's records go to one group, of which one record is held at a time.
    """
    schema = records.schema

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        held, begun, previous = None, None, None
        for row in pdf.sort_values(order).to_dict("records"):
            joined = joined_record(held, row, row["page"] != previous, fields, identity or tuple(fields))
            if joined is None:
                out += [{**held, "page": begun}] if held else []
                held, begun = row, row["page"]
            else:
                held = joined
            previous = row["page"]
        out += [{**held, "page": begun}] if held else []
        return pd.DataFrame(out, columns=schema.names)

    return records.groupBy("file").applyInPandas(merge, schema)


# Forms -------------------------------------------------------------------------------------------------------------


def boxed_forms(lines: DataFrame, number_caption: str, name_caption: str, keys: list[str] | None = None) -> DataFrame:
    """W-2-like boxes, a row for each name caption: its number is that of the nearest number caption of the page that no
    name above has taken, by height and then by x (OCR repaired if need be), the name the first line below the name caption,
    the address the lines up to the first city line, eight at most. A number without a name caption is a row without name.

    A number is looked for on its caption's line, then below, then above, two lines each way.
    """
    keys = keys or PAGE
    w = Window.partitionBy(*keys).orderBy("line_no")
    near = F.array_compact(F.array(*[F.lead("text", i).over(w) if i else F.col("text") for i in (0, 1, 2, -1, -2)]))
    found = lambda texts: F.get(F.filter(F.transform(texts, lambda t: F.regexp_extract(t, tx.SSN_STRICT, 0)), lambda t: t != ""), F.lit(0))
    number = F.coalesce(found(near), found(F.transform(near, lambda t: tx.repaired_digits(t))))
    below = F.array_compact(F.array(*[F.lead("text", i).over(w) for i in range(1, 9)]))
    has = lambda caption: F.upper("text").contains(caption.upper())
    at = F.coalesce(F.get(F.transform(F.col("words"), lambda x: x["x0"]), F.lit(0)), F.lit(0.0)).cast("double")
    marked = lines.select(*keys, "line_no", F.col("top").cast("double").alias("top"), at.alias("x"), F.when(has(number_caption), F.coalesce(number, F.lit(""))).alias("ssn"), F.when(has(name_caption), below).alias("below"))
    captions = marked.filter("ssn is not null or below is not null")
    pages = captions.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("ssn").isNotNull(), F.struct("line_no", "top", "x", "ssn")))).alias("numbers"),
        F.array_sort(F.collect_list(F.when(F.col("below").isNotNull(), F.struct("line_no", "top", "x", "below")))).alias("names"),
    )
    # A page's captions are a handful: one fold gives each name its number.
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("picks"))

    def pick(state, name):
        free = F.filter(F.transform("numbers", lambda n, i: F.struct(F.abs(n["top"] - name["top"]).alias("dy"), F.abs(n["x"] - name["x"]).alias("dx"), i.alias("i"))), lambda c: ~F.array_contains(state["used"], c["i"]))
        best = F.array_min(free)["i"]
        return F.struct(F.when(best.isNotNull(), F.concat(state["used"], F.array(best))).otherwise(state["used"]).alias("used"), F.concat(state["picks"], F.array(best)).alias("picks"))

    taken = pages.withColumn("s", F.aggregate("names", start, pick))
    own = F.transform("names", lambda n, i: F.struct(n["line_no"].alias("line_no"), F.get("numbers", F.get(F.col("s.picks"), i))["ssn"].alias("ssn"), n["below"].alias("below")))
    rest = F.transform(F.filter("numbers", lambda n, i: ~F.array_contains("s.used", i) & (n["ssn"] != "")), lambda n: F.struct(n["line_no"].alias("line_no"), n["ssn"].alias("ssn"), F.array().cast("array<string>").alias("below")))
    forms = taken.select(*keys, F.explode(F.concat(own, rest)).alias("f")).select(*keys, "f.*")
    stop = F.array_position(F.transform("below", lambda x: tx.squeeze(x).rlike(tx.CSZ)), True).cast("int")
    body = F.slice("below", F.lit(1), F.when(stop > 0, stop).otherwise(1))
    return forms.select(*keys, "line_no", F.coalesce("ssn", F.lit("")).alias("ssn"), tx.squeeze(F.coalesce(F.get(body, F.lit(0)), F.lit(""))).alias("name"), tx.address_parts(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))).alias("address"))


def grid_cells(words: DataFrame, caption: str, width: float, share: float = 0.5, tolerance: float = 3.0) -> DataFrame:
    """words with cell: 'Single', or by rows of captions (Top and Bottom, or Row1, Row2, ... of three or more), cut midway
    between these, and Left or Right of share * width in rows with two captions or more.

    The bounds of a page are a few numbers, joined to its words.
    """
    rows = ln.page_lines(words, PAGE, "anchor", tolerance).withColumnRenamed("top", "y")
    counted = rows.withColumn("n", F.regexp_count(tx.squeeze("text"), F.lit(f"(?i){caption}"))).filter("n > 0")
    pages = counted.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("rows"), F.sum("n").alias("captions"))
    middle = (F.col("top") + F.col("bottom")) / 2
    at = F.size(F.filter(F.transform("rows", lambda r, i: (r["y"] + F.get("rows", i + 1)["y"]) / 2), lambda y: y <= middle))
    several = F.size("rows")
    label = F.when(several == 1, "").when(several == 2, F.when(at == 0, "Top").otherwise("Bottom")).otherwise(F.concat(F.lit("Row"), (at + 1).cast("string")))
    side = F.when(F.get("rows", at)["n"] >= 2, F.when((F.col("x0") + F.col("x1")) / 2 < share * width, "Left").otherwise("Right")).otherwise("")
    cell = F.when(F.coalesce(F.col("captions"), F.lit(0)) <= 1, "Single").otherwise(F.coalesce(F.nullif(F.concat(label, side), F.lit("")), F.lit("Single")))
    return words.join(pages, PAGE, "left").withColumn("cell", cell).drop("rows", "captions")


def wage_list(lines: DataFrame) -> DataFrame:
    """Number and name of each line that begins with a number, on pages where two such lines have a line of two or more groups
    of digits, and nothing else, among the next three. A caption line above with M.I. and LAST parts the name by x."""
    w = _over()
    wages = lambda c: c.rlike(r"^[0-9]+( [0-9]+)+$")
    text = tx.squeeze("text")
    number = F.regexp_extract(tx.fold(text), r"^([0-9][0-9 \-]{8,})", 1)
    digits = F.regexp_replace(number, "[^0-9]", "")
    ssn = F.when((F.length(digits) == 9) & ~wages(text), F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)))
    ahead = F.exists(F.array(*[F.lead(text, i).over(w) for i in (1, 2, 3)]), lambda t: F.coalesce(wages(t), F.lit(False)))
    above = F.when(F.lag(F.upper(text)).over(w).rlike(r"E\.\s*EMPLOYEE\s+NAME"), F.lag("words").over(w))
    rows = lines.withColumn("ssn", ssn).withColumn("above", above).withColumn("hits", F.sum(F.when(ssn.isNotNull() & ahead, 1).otherwise(0)).over(Window.partitionBy(*PAGE)))
    token = lambda x: F.upper(F.regexp_replace(x["text"], r"^[().,]+|[().,]+$", ""))
    left = lambda keep: F.get(F.transform(F.filter("above", keep), lambda x: x["x0"]), F.lit(0))
    centre = lambda x: (x["x0"] + x["x1"]) / 2
    found = rows.filter("hits >= 2 and ssn is not null").withColumn("own", F.filter("words", lambda x: ~x["text"].rlike(r"^[0-9\-]+$"))).withColumn("mi_x", left(lambda x: token(x).rlike(r"^M\.?I$"))).withColumn("last_x", left(lambda x: token(x).startswith("LAST")))
    last = lambda x: F.coalesce(centre(x) >= F.col("last_x"), F.lit(False))
    middle = lambda x: F.coalesce(centre(x) >= F.col("mi_x"), F.lit(False))
    part = lambda keep: F.array_join(F.transform(F.filter("own", keep), lambda x: x["text"]), " ")
    plain = tx.split_plain_name(part(lambda x: F.lit(True)))
    bound = F.col("mi_x").isNotNull() | F.col("last_x").isNotNull()
    return found.filter(F.size("own") > 0).select(*PAGE, "line_no", "ssn", F.when(bound, part(lambda x: ~last(x) & ~middle(x))).otherwise(plain["first"]).alias("first"), F.when(bound, part(lambda x: ~last(x) & middle(x))).otherwise(plain["middle"]).alias("middle"), F.when(bound, part(last)).otherwise(plain["last"]).alias("last"))


def wage_pages(words: DataFrame, width: float, number_caption: str = "social security number", name_caption: str = "first name", tolerance: float = 3.0) -> DataFrame:
    """file, page, cell, ssn, name of every page of wage statements: pages with number captions by grid cells and boxes, others
    as a list."""
    cells = grid_cells(words, tx.quoted(number_caption), width, tolerance=tolerance)
    keys = [*PAGE, "cell"]
    boxes = boxed_forms(ln.page_lines(cells, keys, "anchor", tolerance), number_caption, name_caption, keys)
    lines = ln.page_lines(words, PAGE, "anchor", tolerance)
    captioned = lines.filter(F.upper("text").contains(number_caption.upper())).select(*PAGE).distinct()
    listed = wage_list(lines).join(captioned, PAGE, "left_anti")
    return boxes.select(*keys, "ssn", "name").unionByName(listed.select(*PAGE, F.lit("List").alias("cell"), "ssn", F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("first", "middle", "last")]).alias("name")))


def panes(words: DataFrame, width: float, bins: int = 200) -> DataFrame:
    """words with pane 0 or 1: left or right of the page's widest gutter within 30 to 70 % of its width."""
    step = width / bins
    gutter = ln.gutters(words, PAGE, 0.3 * width, 0.7 * width, step).filter(F.col("width") >= max(1, bins // 100)).select(*PAGE, ((F.col("start") + F.col("width") / 2) * step).alias("cut"))
    return words.join(gutter, PAGE, "left").withColumn("pane", F.when(F.col("x0") >= F.col("cut"), 1).otherwise(0)).drop("cut")


def partner_forms(lines: DataFrame) -> DataFrame:
    """Partner statements: type of entity, tax number by ladder in the four lines from its caption, name and address."""
    block = ln.blocks_by_marker(lines, PAGE, ["line_no"], F.upper("text").rlike("PARTNER.S (IDENTIFYING|SSN|TIN)")).filter("block > 0")
    texts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    whole = block.groupBy(*PAGE, "block").agg(F.transform(texts, lambda s: s["text"]).alias("t"))
    text = F.array_join("t", "\n")
    entity = F.trim(F.regexp_extract(text, r"(?i)type of entity[^?\n]*\?\s*([^\n]+)", 1))
    at = F.array_position(F.transform("t", lambda x: F.upper(x).contains("NAME, ADDRESS")), True).cast("int")
    body = F.when(at > 0, F.slice("t", at + 1, F.lit(6))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(body, lambda x: tx.squeeze(x).rlike(tx.CSZ)), True).cast("int")
    body = F.slice(body, F.lit(1), F.when(stop > 0, stop).otherwise(F.lit(1)))
    found = whole.select(*PAGE, "block", entity.alias("entity_type"), tx.tin(F.array_join(F.slice("t", 1, 4), " "), entity).alias("tin"), tx.squeeze(F.coalesce(F.get(body, F.lit(0)), F.lit(""))).alias("name"), tx.address_parts(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))).alias("address"))
    named = F.when(tx.looks_like_entity("name"), F.struct(F.col("name").alias("last"), F.lit("").alias("first"), F.lit("").alias("middle"), F.lit("").alias("suffix"))).otherwise(tx.split_comma_name("name"))
    return found.withColumn("parts", named)


def unique_people(records: DataFrame, order: list[str]) -> DataFrame:
    """First record of each SSN of a file, else of each name; nameless ones all stay."""
    return dedupe.keep_first(records, dedupe.key_ladder(("file", "ssn"), ("file", "name")), order)


# Lists and tables --------------------------------------------------------------------------------------------------


def status_list(lines: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Name, file number and status: the status line, the name before it, `File:` on it or the next three lines."""
    ahead = F.array_join(surrounding("text", 0, 3), "\n")
    status = F.regexp_extract(F.upper("text"), r"\b(" + "|".join(statuses) + r")\b", 1)
    number = F.regexp_extract(ahead, r"(?i)File\s*[:#]\s*([A-Za-z0-9\-]+)", 1)
    name = F.trim(F.regexp_extract("text", r"(?i)^(.*?)\s*\b(?:" + "|".join(statuses) + r")\b", 1))
    return lines.select(*PAGE, "line_no", name.alias("name"), F.when(number == "", "NOT FOUND").otherwise(number).alias("file_number"), tx.status_text(status).alias("status"), status.alias("raw")).filter("raw <> ''").drop("raw")


def academic_records(lines: DataFrame) -> DataFrame:
    """A record per line with an SSN and the lines up to the next: program, GPA and progress from the trailer."""
    blocks = ln.blocks_by_marker(lines, FILE, ["page", "line_no"], F.col("text").rlike(tx.SSN_STRICT)).filter("block > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda s: s["text"]), "\n")
    whole = blocks.groupBy("file", "block").agg(text.alias("t"), F.min("page").alias("page"))
    take = lambda p: F.trim(F.regexp_extract("t", p, 1))
    head = F.substring_index("t", "\n", 1)
    return whole.select("file", "page", "block", F.regexp_extract(head, tx.SSN_STRICT, 0).alias("ssn"), trimmed_name(F.regexp_replace(head, tx.SSN_STRICT, "")).alias("name"), take(r"(?i)Program\s*:\s*([^\n]+?)(?=\s+GPA|\n|$)").alias("program"), take(r"(?i)GPA\s*:\s*([0-9.]+)").alias("gpa"), take(r"(?i)SAP\s*:\s*(\w+)").alias("sap"))


def course_row(text: Column) -> Column:
    """struct(head array of 5, title, tail array of 3) of a row of eight or more words; glyph-only words don't count."""
    words = F.filter(F.split(tx.squeeze(text), " "), lambda w: w.rlike("[A-Za-z0-9$]"))
    n = F.size(words)
    return F.when(n >= 8, F.struct(F.slice(words, 1, 5).alias("head"), F.array_join(F.slice(words, F.lit(6), F.greatest(n - 8, F.lit(0))), " ").alias("title"), F.slice(words, -3, 3).alias("tail")))


def gap_cells(words: Column, gap: float) -> Column:
    """Texts of runs of words (array<struct<x0,x1,text>>) that lie at most `gap` apart."""
    start = F.struct(F.array().cast("array<string>").alias("cells"), F.lit(None).cast("double").alias("end"))

    def add(s, w):
        new = F.coalesce(w["x0"].cast("double") - s["end"] > gap, F.lit(True))
        n = F.size(s["cells"])
        grown = F.concat(F.slice(s["cells"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", F.get(s["cells"], n - 1), w["text"])))
        return F.struct(F.when(new, F.concat(s["cells"], F.array(w["text"]))).otherwise(grown).alias("cells"), w["x1"].cast("double").alias("end"))

    return F.aggregate(words, start, add)["cells"]


def paired_rows(items: DataFrame, left: str = "id", right: str = "name") -> DataFrame:
    """(file, page, kind, y, text): each left item with the nearest unused right one within max(0.6 × median gap, 6).

    Greedy in order of height, so a page is one group.
    """

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.kind == k].sort_values(["y", "text"]).to_dict("records") for k in (left, right))
        gaps = sorted(y - x for x, y in zip([r["y"] for r in a], [r["y"] for r in a][1:]))
        tolerance = max(0.6 * gaps[len(gaps) // 2] if gaps else 0, 6)
        used: set[int] = set()
        out = []
        for r in a:
            near = min(((abs(s["y"] - r["y"]), i) for i, s in enumerate(b) if i not in used), default=(None, -1))
            fits = near[0] is not None and near[0] <= tolerance
            if fits:
                used.add(near[1])
            out.append((r["file"], r["page"], r["y"], r["text"], b[near[1]]["text"] if fits else ""))
        return pd.DataFrame(out, columns=["file", "page", "y", left, right])

    return items.groupBy(*PAGE).applyInPandas(pair, f"file string, page int, y double, {left} string, {right} string")


def payroll_list(lines: DataFrame) -> DataFrame:
    """SSN and two to four capitalised words on one line."""
    name = r"((?:[A-Z][A-Za-z'.\-]*\s+){1,3}[A-Z][A-Za-z'.\-]*)"
    text = F.col("text")
    found = F.coalesce(F.nullif(F.regexp_extract(text, tx.SSN_STRICT + r"\s+" + name, 1), F.lit("")), F.nullif(F.regexp_extract(text, name + r"\s+" + tx.SSN_STRICT, 1), F.lit("")))
    return lines.select(*PAGE, "line_no", F.nullif(F.regexp_extract(text, tx.SSN_STRICT, 0), F.lit("")).alias("ssn"), found.alias("name")).filter("ssn is not null and name is not null")


def explained(df: DataFrame, safe: tuple[str, ...] = ()) -> DataFrame:
    """A masked copy for diagnostics: all text as shapes, but for safe words."""
    return df.select(*[tx.mask_except(F.col(c), safe).alias(c) if t == "string" and c != "file" else F.col(c) for c, t in df.dtypes if not t.startswith("array")])


def cropped_text(words: DataFrame, left: float, right: float, tolerance: float = 3.0) -> DataFrame:
    """Lines of the words that start between two x positions."""
    return ln.page_lines(words.filter((F.col("x0") >= left) & (F.col("x0") < right)), PAGE, "anchor", tolerance)


def filled_from_fields(records: DataFrame, widgets: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Blank columns filled from form fields (file, page, field, value) whose normalised name holds an alias."""
    key = tx.key_compact("field")
    picks = []
    for column, names in aliases.items():
        hit = F.lit(False)
        for n in names:
            hit = hit | key.contains(n)
        picks.append(F.min_by(F.when(hit, tx.strip("value")), F.when(hit & ~tx.is_blank("value"), F.col("field"))).alias(f"__{column}"))
    side = widgets.groupBy(*PAGE).agg(*picks)
    joined = records.join(side, PAGE, "left")
    return joined.select(*[F.when(tx.is_blank(c), F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c) if c in aliases else F.col(c) for c in records.columns])


def merged_by_height(items: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """(file, page, kind, y, text) of kinds id and name as one ordered list per page: an id and a name within the
    tolerance are one row, the others stand alone. Sequential, so a page is one group."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.kind == k].sort_values(["y", "text"]).to_dict("records") for k in ("id", "name"))
        i = j = 0
        out = []
        while i < len(a) or j < len(b):
            x, y = a[i] if i < len(a) else None, b[j] if j < len(b) else None
            if x and y and abs(x["y"] - y["y"]) <= tolerance:
                out.append((x["file"], x["page"], min(x["y"], y["y"]), x["text"], y["text"]))
                i, j = i + 1, j + 1
            elif y is None or (x and x["y"] < y["y"]):
                out.append((x["file"], x["page"], x["y"], x["text"], ""))
                i += 1
            else:
                out.append((y["file"], y["page"], y["y"], "", y["text"]))
                j += 1
        return pd.DataFrame(out, columns=["file", "page", "y", "id", "name"])

    return items.groupBy(*PAGE).applyInPandas(merge, "file string, page int, y double, id string, name string")


def layouts(lines: DataFrame, phrases: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """Layout of each page: the one with most of its phrases on the page, at least `least`; first by name on ties, else null."""
    text = F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n"))
    pages = lines.groupBy(*PAGE).agg(text.alias("t"))
    score = lambda words: sum((F.col("t").contains(w.upper()).cast("int") for w in words), F.lit(0))
    scored = F.array_sort(F.array(*[F.struct((-score(w)).alias("n"), F.lit(k).alias("layout")) for k, w in phrases.items()]))
    best = F.get(scored, F.lit(0))
    return pages.select(*PAGE, F.when(-best["n"] >= least, best["layout"]).alias("layout"))
