"""Lookups, fills, updates and band joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import text as tx


def lookup_names(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(name) against (stem, path): all paths whose lower-cased stem is the name, else the name less one extension.

    name, path and found ('exact', 'stripped' or 'not found'). One join on either key; exact hits win per name.
    """
    keys = wanted.select("name", F.explode(F.array_distinct(F.array(F.struct(F.lower(tx.strip("name")).alias("key"), F.lit(0).alias("level")), F.struct(F.lower(F.regexp_replace(tx.strip("name"), r"\.[^.]*$", "")).alias("key"), F.lit(1).alias("level"))))).alias("k")).select("name", "k.key", "k.level")
    hits = keys.join(files.select(F.lower("stem").alias("key"), "path"), "key")
    best = hits.groupBy("name").agg(F.min("level").alias("level"))
    found = hits.join(best, ["name", "level"]).select("name", "path", F.when(F.col("level") == 0, "exact").otherwise("stripped").alias("found"))
    missing = wanted.select("name").distinct().join(best, "name", "left_anti").select("name", F.lit(None).cast("string").alias("path"), F.lit("not found").alias("found"))
    return found.distinct().unionByName(missing)


def pick_by_priority(df: DataFrame, key: list[str], priority: Column, tie: list[str]) -> DataFrame:
    """One row per key: least priority, then tie. An aggregate, so hot keys combine before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*key).agg(F.min_by(row, F.struct(priority.alias("p"), *tie)).alias("row")).select("row.*")


def fill_from_donor(target: DataFrame, donor: DataFrame, keys: list[str], columns: list[str], order: list[str] | None = None, override: tuple[str, str, str] | None = None) -> DataFrame:
    """Blank columns of target filled from the donor row that matches on the first key, else the next; `filled_from` names the
    key or is null. Of donor rows with one key the first by `order` counts (else by their values), so no target row is
    repeated.

    override = (value, source, word): value and source go together, and where the donor's source holds the word, the
    target's doesn't and the donor has another value, the donor's value stands though the target has one.
    """
    more = [override[1]] if override and override[1] not in columns else []
    out, source = target, F.lit(None).cast("string")
    for i, key in enumerate(keys):
        named = donor.filter(~tx.is_blank(F.col(key).cast("string")))
        side = pick_by_priority(named, [key], F.lit(0), order or [*columns, *more]).select(F.col(key).alias(f"__k{i}"), *[F.col(c).alias(f"__{c}{i}") for c in [*columns, *more]], F.lit(True).alias(f"__hit{i}"))
        out = out.join(side, F.col(key) == F.col(f"__k{i}"), "left")
    for i, key in reversed(list(enumerate(keys))):
        source = F.when(F.col(f"__hit{i}"), key).otherwise(source)
    pick = {c: F.coalesce(*[F.when(F.col("filled_from") == key, F.col(f"__{c}{i}")) for i, key in enumerate(keys)]) for c in [*columns, *more]}
    out = out.withColumn("filled_from", source)
    new = {c: F.when(tx.is_blank(c), pick[c]).otherwise(F.col(c)) for c in columns}
    if override:
        value, origin, word = override
        borrowed = tx.is_blank(value) & ~tx.is_blank(pick[value])
        better = ~tx.is_blank(pick[value]) & F.coalesce(pick[origin].contains(word), F.lit(False)) & ~F.coalesce(F.col(origin).contains(word), F.lit(False)) & (pick[value] != F.col(value))
        new[value] = F.when(better, pick[value]).otherwise(new[value])
        new[origin] = F.when(better | borrowed, pick[origin]).otherwise(F.col(origin))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in target.columns], "filled_from")


def conditional_update(target: DataFrame, source: DataFrame, key: str, columns: list[str], when: str = "populated") -> DataFrame:
    """Left join on a unique key: populated target cells take the source's value (blank ones stay), or with
    when='blank' the other way round. Without a match nothing changes."""
    side = source.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(side, F.col(key) == F.col("__key"), "left")
    change = lambda c: F.col("__key").isNotNull() & (tx.is_blank(c) if when == "blank" else ~tx.is_blank(c))
    return joined.select(*[F.when(change(c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def band_of(x: Column, bands: list[tuple[str, float, float]]) -> Column:
    """Key of the first band with left <= x < right. Bands are a page's captions: a handful."""
    out = F.lit(None).cast("string")
    for key, left, right in reversed(bands):
        out = F.when((x >= left) & (x < right), key).otherwise(out)
    return out


def nearest_of(x: Column, centres: list[tuple[str, float]]) -> Column:
    """Key of the nearest centre, the first by name on ties."""
    return F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(k).alias("k")) for k, c in centres]))["k"]


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one reading that the other lacks, duplicates counted, with side 'a' or 'b'."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def unprocessed(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key isn't among the finished ones; a null key is never finished."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def without_listed(listed: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """List records without those that a form of the same document has; blank keys never match."""
    own = forms.filter(~tx.is_blank(keys[-1])).select(*keys).distinct()
    return listed.join(own, keys, "left_anti")


def carried(df: DataFrame, partition: list[str], order: list[str], column: str) -> Column:
    """Last value of a column that isn't null, up to this row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def zip_outer(a: Column, b: Column) -> Column:
    """Pairs of two arrays by position, null where one is shorter."""
    return F.arrays_zip(a.alias("a"), b.alias("b"))


def contained(df: DataFrame, partition: list[str], order: list[str], opens: Column, closes: Column, label: Column) -> DataFrame:
    """Rows between an opening event and the next closing or opening one, with `label` of the event that opened: `within`.

    Events are rows of df themselves; they are left out. One window over the partition's order, no join of ranges.
    """
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(opens, F.struct(F.lit(True).alias("open"), label.alias("label"))).when(closes, F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("label")))
    marked = df.withColumn("__event", event).withColumn("__last", F.last("__event", ignorenulls=True).over(w))
    return marked.filter(F.col("__event").isNull() & F.col("__last.open")).withColumn("within", F.col("__last.label")).drop("__event", "__last")
