"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact budgets.

Each source's documents stand in the order of a hash; a source's budget is its target rounded down. Budgets beyond the
source's size repeat whole epochs, and the rest is cut where the prefix sum reaches it, inside a document if need be.

A source may hold any share of the rows: its hash range is dealt into equal buckets, bucket sums are prefix-summed
(one row per bucket), and only documents of one bucket stand in one window.

Defined results: a null or empty text has size 0 and takes 0; a null source is the last source; a null doc_id is
hashed by its size alone with its row's text hash; rows with equal ids and texts may swap places, which leaves the
result as a multiset unchanged; targets of sources of size 0 are 0; other columns are ignored unless they are asked
for; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import checkpointed, word_count

#: No document repeats more often than this.
EPOCHS = 3
#: Documents of a bucket, about, and buckets at most: a source has one row for each in the prefix sums.
BUCKET_ROWS, BUCKETS = 2_000, 1_000_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from (source, size): sources by code point, null last, weigh in turn.

    Shares of the total stop at `epochs` times a source's size; what is above is shared again by weight. That ends
    where a level L gives every source min(cap, weight * L): with sources ordered by cap / weight, the first k are
    capped and L = (total - their caps) / (the other weights). One row per source is in the window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))).cast("int"))
    each = per.withColumn("weight", weight).withColumn("cap", (F.lit(epochs) * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # A source keeps weight * L while L, with the sources before it capped, lies under its ratio; the first such L is
    # that of all sources after it.
    leveled = each.withColumn("level", level).withColumn("place", F.row_number().over(order))
    final = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("place", "level"))).over(everything)
    return leveled.withColumn("final", final).select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final.level"), F.col("cap"))).alias("target"))


def _takes(rows: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, source, size, h) with source_size, target, epochs_taken, cut and taken."""
    buckets = max(1, min(BUCKETS, n // BUCKET_ROWS))
    placed = rows.withColumn("bucket", F.floor(F.col("h") * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("load"))
    ahead = F.coalesce(F.sum("load").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), ahead.alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "tie", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    joined = joined.join(chosen.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("ahead") - F.col("inside")))
    return joined.withColumn("epochs_taken", whole).withColumn("cut", cut).withColumn("taken", F.col("epochs_taken") * F.col("size") + F.col("cut"))


def _row_key() -> Column:
    """Equal for rows of equal id, source and text."""
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.hex(F.xxhash64("text")), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))


def _keyed(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    h = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 32))).otherwise(h)
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h"), F.substring(key, 9, 24).alias("tie"), *more)


def mixture(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; epochs_taken whole epochs and a cut of `cut` words."""
    rows = checkpointed(_keyed(docs, seed, _row_key().alias("row_key")))
    return _takes(rows, targets(rows, weights, epochs), rows.count()).select("doc_id", "size", "source_size", "target", "taken", "epochs_taken", "cut", "source", "row_key")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: a row for each whole epoch of a document and one, cut after `cut` words, for a part.

    Rows of equal id, source and text are one row that stands as often as all of them together.

    All columns of docs are returned, n_chars (where there is one) as of the cut text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    part = (F.col("cut") > 0) & (F.col("cut") < F.col("size"))
    # Repeated rows stand next to each other, so at most one of them is cut.
    decided = mixture(docs, weights, epochs, seed).groupBy("row_key").agg(F.sum(F.col("epochs_taken") + F.when((F.col("cut") > 0) & (F.col("cut") == F.col("size")), 1).otherwise(0)).cast("int").alias("times"), F.max(F.when(part, F.col("cut"))).alias("cut"))
    distinct = docs.select(_row_key().alias("row_key"), row.alias("row")).dropDuplicates(["row_key"])
    joined = distinct.join(decided.filter("times > 0 or cut is not null"), "row_key")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("times")), F.when(F.col("cut").isNotNull(), F.array("cut")).otherwise(F.array().cast("array<long>")))
    out = joined.select("row", F.explode(copies).alias("words"))
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(F.array_join(F.slice(F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.greatest(F.col("words"), F.lit(1)).cast("int")), " "))
    named = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
