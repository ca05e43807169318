"""Splitting outputs: fixed sizes, whole blocks, one per key; page chunks."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text as tx


def fixed_parts(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with part (from 1) and parts: runs of `size` rows in the given order.

    Positions come from a range-sorted frame: each partition's row count goes to the driver, one number per partition,
    and no row leaves its partition to be numbered.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % (1 << 33))
    from tabloom.sources.shared import stored

    kept = stored(ranged)
    counts = sorted((r["__p"], r["count"]) for r in kept.groupBy("__p").count().collect())
    ahead, starts = 0, []
    for p, n in counts:
        starts.append((p, ahead))
        ahead += n
    offset = F.lit(0).cast("long")
    if starts:
        offset = F.get(F.array(*[F.lit(dict(starts).get(p, 0)).cast("long") for p in range(max(dict(starts)) + 1)]), F.col("__p"))
    part = F.floor((offset + F.col("__i")) / size).cast("int") + 1
    return kept.withColumn("part", part).withColumn("parts", F.lit(-(-ahead // size))).drop("__p", "__i")


def whole_blocks(blocks: DataFrame, order: list[str], rows: str, limit: int) -> DataFrame:
    """blocks with chunk (from 1), first (row of the block, from 0), n (rows of the chunk) and part (from 1).

    No part holds more than `limit` rows and no block is broken, but for blocks over the limit, which are chunks of
    `limit` rows first. Of the plans with the fewest parts it is the one whose largest part is least.

    The plan depends on all chunks in order, so it is made in one task from one row per block (a source file), by prefix
    sums: a part that starts at a chunk ends at the last chunk whose prefix sum is within the capacity, found by search.
    """
    n = F.col(rows)
    pieces = F.when(n > 0, F.ceil(n / F.lit(limit))).otherwise(1).cast("int")
    chunked = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(1), pieces)))
    first = ((F.col("chunk") - 1) * F.lit(limit)).cast("long")
    chunked = chunked.withColumn("first", first).withColumn("n", F.least(n - first, F.lit(limit)).cast("long"))
    schema = T.StructType([*chunked.schema.fields, T.StructField("part", T.IntegerType())])
    by = [(c, "ascending") for c in [*order, "chunk"]]

    def planned(table: pa.Table) -> pa.Table:
        table = table.sort_by(by)
        ends = np.cumsum(table.column("n").to_numpy())

        def starts(capacity: int) -> list[int]:
            found = [0]
            while True:
                ahead = ends[found[-1] - 1] if found[-1] else 0
                following = max(int(np.searchsorted(ends, ahead + capacity, "right")), found[-1] + 1)
                if following >= len(ends):
                    return found
                found.append(following)

        fewest = len(starts(limit))
        low = int(table.column("n").to_numpy().max(initial=1))
        capacity = low + bisect_left(range(low, limit), True, key=lambda c: len(starts(c)) <= fewest)
        part = np.searchsorted(starts(capacity), np.arange(len(ends)), "right")
        return table.append_column("part", pa.array(part, pa.int32()))

    return chunked.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(lambda table: planned(table.drop_columns(["__all"])), schema)


def group_files(df: DataFrame, key: str) -> DataFrame:
    """Per key the safe file name, numbered where names differ only in case: key, n, file_name."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    safe = counts.withColumn("safe", tx.safe_file_name("key"))
    k = F.row_number().over(Window.partitionBy(F.lower("safe")).orderBy("key"))
    return safe.select("key", "n", F.when(k > 1, F.concat("safe", F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col("safe")).alias("file_name"))


def page_chunks(pages: Column | str, fixed: int | None = None, workers: int = 4, least: int = 25) -> Column:
    """array<struct<chunk, first, last>>: chunks of `fixed` pages, or about equal ones of at least `least` for some workers."""
    n = tx.col(pages)
    if fixed:
        chunks = F.ceil(n / fixed).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(chunks, F.lit(1))), lambda i: F.struct(i.alias("chunk"), ((i - 1) * fixed + 1).cast("long").alias("first"), F.least(i * fixed, n).cast("long").alias("last"))))
    chunks = F.greatest(F.lit(1), F.least(F.lit(workers), F.floor(n / least).cast("int")))
    base, more = F.floor(n / chunks).cast("long"), (n % chunks).cast("long")
    first = lambda i: (i - 1) * base + F.least(i - 1, more) + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), chunks), lambda i: F.struct(i.alias("chunk"), first(i).cast("long").alias("first"), (first(i + 1) - 1).cast("long").alias("last"))))
