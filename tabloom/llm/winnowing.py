"""Winnowing fingerprints with DataFrame functions only.

Words are hashed, runs of K words give rolling gram hashes, and each window of W grams keeps its least hash, the
rightmost one where several are least. Texts that share a run of K + W - 1 words share a fingerprint hash. Words say
little of texts of few characters and of scripts without spaces: where a text has at most SHORT code points, or more
than LONG_WORDS of them for each word, runs of CHARS code points are winnowed as well, and such texts that share a run of
CHARS + W - 1 code points share a hash of these. An edited text is no longer than its own, so both or neither are short. A kept
entry is one long: 40 bits of hash above 24 bits of (2 ** 24 - 1 - position), so that the least entry of a window is
the rightmost least hash; positions count grams modulo 2 ** 24.

Everything stays in the JVM: window minima come from doubling (pairs, fours, eights) with zip_with, not from a row per
word.

Defined results: null is the empty text; an empty text has an empty fingerprint, and two of these are alike (1); a text
of fewer than K words (or CHARS code points) is one gram, one of fewer than W grams one window; a doc_id may be of any type
that can be sorted; null ids come last, ordered by a hash of the text; equal ids are ordered by that hash; a very long
text is one row of arrays of 8 bytes a word; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import SPACES, groups, numbered, tie_place

K, W = 3, 8
CHARS, SHORT, LONG_WORDS = 5, 256, 32
_POSITIONS = (1 << 24) - 1
GROUP_BYTES, GROUPS = 8 << 20, 200_000


def _shifted(x, by: int, n: Column) -> Column:
    return F.slice(x, F.lit(by + 1), n)


def _none() -> Column:
    return F.array().cast("array<long>")


def entries(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, the kept word entries of column `text`, and `out`_chars, the kept character entries, by position."""
    one, letters = f"__{out}_1", f"__{out}_c"
    # Each step is a column of its own: it is read several times, so the optimizer keeps it apart.
    df = df.withColumn(one, F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w)))
    size = F.size(one)
    grams = _shifted(F.col(one), 0, size - (K - 1))
    for i in range(1, K):
        grams = F.zip_with(grams, _shifted(F.col(one), i, size - (K - 1)), lambda a, b: F.xxhash64(a, b))
    grams = F.when(size >= K, grams).when(size > 0, F.array(F.xxhash64(one))).otherwise(_none())
    n = F.length(text)
    fits = (n > 0) & ((n <= SHORT) | (n > LONG_WORDS * size))
    df = df.withColumn(letters, F.when(fits, F.filter(F.split(text, ""), lambda c: c != "")).otherwise(F.array().cast("array<string>")))
    m = F.size(letters)
    run = F.transform(F.sequence(F.lit(1), F.greatest(m - (CHARS - 1), F.lit(1))), lambda i: F.xxhash64(F.lit("c"), F.slice(F.col(letters), i, F.lit(CHARS))))
    df = _winnowed(df, grams, out)
    return _winnowed(df, F.when(m > 0, run).otherwise(_none()), f"{out}_chars").drop(one, letters)


def _winnowed(df: DataFrame, grams: Column, out: str) -> DataFrame:
    """df with `out`, the entries of the array `grams` that are the least of a window, by position."""
    two = f"__{out}_2"
    df = df.withColumn(two, F.transform(grams, lambda g, i: g.bitwiseAND(F.lit(~_POSITIONS)).bitwiseOR(F.lit(_POSITIONS) - i.bitwiseAND(F.lit(_POSITIONS)))))
    now, width = two, 1
    while width < W:
        step = min(width, W - width)
        fresh = f"__{out}_{width}m"
        n = F.size(now) - step
        df = df.withColumn(fresh, F.when(F.size(two) >= W, F.zip_with(_shifted(F.col(now), 0, n), _shifted(F.col(now), step, n), lambda a, b: F.least(a, b))).otherwise(F.col(now)))
        df = df.drop(now) if now != two else df
        now, width = fresh, width + step
    short = F.when(F.size(two) > 0, F.array(F.array_min(two))).otherwise(_none())
    df = df.withColumn(out, F.when(F.size(two) >= W, F.array_distinct(now)).otherwise(short))
    return df.drop(two, now)


def hashes(kept: str) -> Column:
    """The distinct hashes of the kept entries; hashes of words are even and those of characters odd."""
    of = lambda c, odd: F.transform(c, lambda x: F.shiftleft(F.shiftright(x, 24), 1) + odd)
    return F.array_distinct(F.concat(of(kept, 0), of(f"{kept}_chars", 1)))


def positions(kept: str) -> Column:
    return F.transform(kept, lambda x: F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS)))


def digest(kept: str) -> Column:
    """32 hex digits that stand for the whole fingerprint, positions included."""
    half = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(half(F.xxhash64(kept, f"{kept}_chars")), half(F.xxhash64(F.lit("w"), F.size(kept), kept, f"{kept}_chars")))


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, text, kept and kept_chars (entries), hashes and fingerprint of every document. No shuffle."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return entries(rows, "text", "kept").withColumn("hashes", hashes("kept")).withColumn("fingerprint", digest("kept"))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with next_<column>s of the following document by ascending doc_id; the first follows the last.

    Documents are dealt into ascending groups, and the first of each group is sent to the group before it too. The
    table of group starts has at most about GROUPS rows and is broadcast.
    """
    rows, key = numbered(rows, "doc_id")
    weight = F.octet_length("text") + 64
    plain = rows.select("doc_id", "text", *([key] if key != "doc_id" else []))
    total = plain.agg(F.sum(weight.cast("double"))).first()[0] or 1.0
    # At most about GROUPS groups, whose starts are broadcast; each is cut off from a task's memory by its own sort.
    group, tasks = groups(plain, key, weight, max(GROUP_BYTES, total / GROUPS), tie="text")
    order = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), tie_place("text").alias("place"), F.xxhash64("text").alias("tie"))
    starts = plain.groupBy(group.alias("grp")).agg(F.min(order()).alias("start"))
    everything = Window.orderBy("grp")
    ends = F.max("grp").over(Window.partitionBy(F.lit(1)))
    starts = starts.select(F.col("grp").alias("g"), "start", F.coalesce(F.lag("grp").over(everything), ends).alias("before"))
    placed = rows.withColumn("grp", group).join(F.broadcast(starts), F.col("grp") == F.col("g"))
    first = order().eqNullSafe(F.col("start"))
    places = F.when(first, F.array(F.struct(F.col("grp").alias("at"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("at"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("grp").alias("at"), F.lit(False).alias("extra"))))
    own = [c for c in rows.columns if c != "__rank"]
    sent = placed.select(*own, F.explode(places).alias("p")).select(*own, "p.at", "p.extra").repartition(tasks, "at")
    follow = Window.partitionBy("at").orderBy("extra", order())
    return sent.select(*own, "extra", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns]).filter(~F.col("extra")).drop("extra")


def edited_comparison(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and the next document's."""
    rows = with_next(fingerprinted(docs).select("doc_id", "text", "hashes", "fingerprint"), ["text", "hashes"])
    n = F.length("text")
    quarter = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "hashes", "fingerprint", "next_hashes")
    rows = entries(rows, "edited", "kept").withColumn("edited_hashes", hashes("kept"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", digest("kept").alias("edited_fingerprint"), likeness("hashes", "edited_hashes").alias("near_edited"), likeness("hashes", "next_hashes").alias("near_next"))
