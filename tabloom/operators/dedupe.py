"""De-duplication that keeps the first row of a key, and collapse of rows to ordered lists.

Keeping the first is an aggregate (min of the order with the row), so Spark combines before it shuffles and a hot key
costs one row per task. Rows whose key is null are never merged; they bypass the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as tx


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The row with the least order of each key; all rows with a null key."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("__key", key)
    first = keyed.filter("__key is not null").groupBy("__key").agg(F.min_by(row, F.struct(*order)).alias("row")).select("row.*")
    return first.unionByName(keyed.filter("__key is null").drop("__key"))


def composite_key(*columns: str) -> Column:
    """Normalised values of some columns; null if all are blank."""
    values = [F.coalesce(tx.normal_value(c), F.lit("")) for c in columns]
    return F.when(F.concat(*values) != "", F.concat_ws("\x1f", *values))


def key_ladder(*levels: tuple[str, ...]) -> Column:
    """The first level without a blank column decides; null if every level has one. The level is part of the key."""
    out = F.lit(None).cast("string")
    for i, level in reversed(list(enumerate(levels))):
        full = ~tx.is_blank(level[0])
        for c in level[1:]:
            full = full & ~tx.is_blank(c)
        out = F.when(full, F.concat_ws("\x1f", F.lit(str(i)), *[tx.normal_value(c) for c in level])).otherwise(out)
    return out


def collapse(df: DataFrame, name: str, values: list[str], order: list[str], separator: str = ":") -> DataFrame:
    """Per case-folded name: first spelling, and each value column's list, joined. The lists hold the distinct rows of
    values in order of first appearance, so they stay aligned; a row without any value is left out.

    Rows are first reduced to one per name and values; only distinct values of a name are gathered.
    """
    text = lambda c: F.coalesce(tx.strip(F.col(c).cast("string")), F.lit(""))
    at = F.struct(*order)
    own = df.withColumn("__values", F.struct(*[text(c).alias(c) for c in values])).filter(F.concat(*[text(c) for c in values]) != "")
    pairs = own.groupBy(F.lower(text(name)).alias("__key"), "__values").agg(F.min(at).alias("__at"), F.min_by(text(name), at).alias(name))
    rows = pairs.groupBy("__key").agg(F.min_by(name, "__at").alias(name), F.array_sort(F.collect_list(F.struct("__at", "__values"))).alias("__rows"))
    return rows.select(name, *[F.array_join(F.transform("__rows", lambda r: r["__values"][c]), separator).alias(c) for c in values])
