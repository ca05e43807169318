"""Union of differing schemas: rows as maps until the column list is known, then one projection.

The only thing that reaches the driver is the list of distinct columns, which is metadata of the inputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as tx


def column_registry(columns: DataFrame, key: Column | None = None) -> DataFrame:
    """(name, ord) to key, display and ord: one row per key, spelled as first seen."""
    keyed = columns.withColumn("key", tx.key_squeezed("name") if key is None else key).filter("key <> ''")
    return keyed.groupBy("key").agg(F.min_by("name", "ord").alias("display"), F.min("ord").alias("ord"))


def by_name(frames: list[DataFrame], provenance: list[str] | None = None) -> DataFrame:
    """UNION ALL by normalised column name, missing cells '', columns in order of first appearance, all text.

    Of columns with one key in a frame the first counts. With provenance, Source comes last.
    """
    keys: dict[str, str] = {}
    for df in frames:
        for c in df.columns:
            keys.setdefault(" ".join(c.split()).lower(), c)
    out = []
    for i, df in enumerate(frames):
        own: dict[str, str] = {}
        for c in df.columns:
            own.setdefault(" ".join(c.split()).lower(), c)
        cells = [(F.coalesce(F.col(f"`{own[k]}`").cast("string"), F.lit("")) if k in own else F.lit("")).alias(name) for k, name in keys.items()]
        out.append(df.select(*cells, *([F.lit(provenance[i]).alias("Source")] if provenance else [])))
    return reduce(DataFrame.unionByName, out)


def by_position(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by position under the first frame's header: shorter rows end in '', longer ones get Extra columns."""
    width = max(len(df.columns) for df in frames)
    names = [*frames[0].columns, *[f"Extra_{i}" for i in range(len(frames[0].columns) + 1, width + 1)]]
    cells = lambda df: [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns] + [F.lit("")] * (width - len(df.columns))
    return reduce(DataFrame.union, [df.select(*[c.alias(n) for c, n in zip(cells(df), names)]) for df in frames])


def mismatch(found: list[str], expected: list[str]) -> dict[str, list[str]]:
    """Missing, extra and moved columns, names compared squeezed and without case."""
    norm = lambda names: [" ".join(n.split()).lower() for n in names]
    have, want = norm(found), norm(expected)
    return {
        "missing": [n for n, k in zip(expected, want) if k not in have],
        "extra": [n for n, k in zip(found, have) if k not in want],
        "moved": [n for n, k in zip(expected, want) if k in have and have.index(k) != want.index(k)],
    }


def realigned(df: DataFrame, expected: list[str], policy: str = "realign") -> DataFrame | None:
    """df under the expected columns, missing ones ''. warn keeps df as it is, skip gives None, stop raises."""
    found = mismatch(df.columns, expected)
    if any(found.values()):
        if policy == "stop":
            raise ValueError(f"columns differ: {found}")
        if policy == "skip":
            return None
        if policy == "warn":
            return df
    own = {" ".join(c.split()).lower(): c for c in reversed(df.columns)}
    pick = lambda n: own.get(" ".join(n.split()).lower())
    return df.select(*[(F.coalesce(F.col(f"`{pick(n)}`").cast("string"), F.lit("")) if pick(n) else F.lit("")).alias(n) for n in expected])


def first_filled(*columns: str) -> Column:
    """The first of several source columns that isn't blank, stripped."""
    return F.coalesce(*[F.nullif(tx.strip(c), F.lit("")) for c in columns])


def without_empty_columns(df: DataFrame, extra: list[str]) -> DataFrame:
    """df without those of the extra columns that are blank in every row. One aggregate of one row."""
    if not extra:
        return df
    used = df.agg(*[F.max((~tx.is_blank(f"`{c}`")).cast("int")).alias(str(i)) for i, c in enumerate(extra)]).first()
    return df.drop(*[c for i, c in enumerate(extra) if not used[i]])


def grid_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, sheet, row_no, cells) below each sheet's header row as map columns `values`, with provenance.

    Blank rows and rows that repeat the header are left out.
    """
    head = headers.join(grid, ["file", "sheet"]).filter(F.col("row_no") == F.col("header_row")).select("file", "sheet", "header_row", F.col("cells").alias("names"))
    norm = lambda a: F.transform(a, lambda c: F.coalesce(tx.key_words(c), F.lit("")))
    # One header per sheet: the join sends it to the sheet's rows.
    rows = grid.join(head, ["file", "sheet"]).filter("row_no > header_row")
    rows = rows.filter(F.exists("cells", lambda c: ~tx.is_blank(c)) & (norm("cells") != norm("names")))
    pairs = F.filter(F.arrays_zip("names", "cells"), lambda p: ~tx.is_blank(p["names"]) & ~tx.is_blank(p["cells"]))
    values = F.aggregate(pairs, F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"), lambda m, p: F.when(F.map_contains_key(m, tx.squeeze(p["names"])), m).otherwise(F.map_concat(m, F.create_map(tx.squeeze(p["names"]), p["cells"]))))
    return rows.select("file", "sheet", "row_no", values.alias("values"))


def projected(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of maps as one column per registered key, in order of the registry, provenance last."""
    columns = [(r["key"], r["display"]) for r in registry.orderBy("ord").collect()]
    norm = F.transform_keys("values", lambda k, _: tx.key_squeezed(k))
    return rows.withColumn("m", norm).select(*[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(d) for k, d in columns], F.col("file").alias("Source File"), F.col("sheet").alias("Source Sheet"), F.col("row_no").alias("Source Row"))
