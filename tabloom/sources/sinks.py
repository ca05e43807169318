"""Outputs: CSV as text, masked copies, files per key, load to a database table, file routing plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as tx


def write_csv(df: DataFrame, path: str, force_text: bool = False, masked: tuple[str, ...] = (), by: str | None = None, rows_per_file: int = 0) -> None:
    """All values quoted, CRLF; optionally ="…" so that spreadsheets keep text, masked numbers, a folder per key."""
    for c in df.columns:
        value = tx.safe_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
        value = tx.mask_ssn(value) if c in masked else value
        df = df.withColumn(c, F.concat(F.lit('="'), value, F.lit('"')) if force_text else value)
    if by:
        df = df.withColumn("file_name", tx.safe_file_name(by))
    writer = df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("lineSep", "\r\n").option("emptyValue", "")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy("file_name") if by else writer).csv(path)


def schema_match(columns: list[str], table: list[str], widths: dict[str, int] | None = None, longest: dict[str, int] | None = None) -> dict[str, object]:
    """Source to table columns by name without case; what is unmatched, what is missing, and which table columns (widths by
    name, none or -1 for unlimited) are too narrow for the longest text of their source column (see text_lengths)."""
    own = {c.lower(): c for c in table}
    pairs = {c: own[c.lower()] for c in columns if c.lower() in own}
    room = {c: (widths or {}).get(t, -1) for c, t in pairs.items()}
    narrow = [pairs[c] for c in pairs if 0 <= room[c] < (longest or {}).get(c, 0)]
    return {"map": pairs, "unmatched": [c for c in columns if c not in pairs], "missing": [c for c in table if c not in pairs.values()], "narrow": narrow}


def text_lengths(df: DataFrame) -> dict[str, int]:
    """Longest text of each column: one aggregate, one row to the driver."""
    if not df.columns:
        return {}
    row = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[i] or 0 for i, c in enumerate(df.columns)}


def load_table(df: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 1000) -> None:
    """Truncates and fills a database table with text; JDBC commits per partition, so load a staging table and swap."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.write.mode("overwrite").option("truncate", True).option("batchsize", batch).jdbc(url, table, properties=properties)


def routing_plan(found: DataFrame, target: str) -> DataFrame:
    """(name, path, found) of a lookup to src, dst and status for a copy step."""
    file = F.element_at(F.split("path", "/"), -1)
    return found.select(F.col("path").alias("src"), F.when(F.col("path").isNotNull(), F.concat(F.lit(target.rstrip("/") + "/"), file)).alias("dst"), F.when(F.col("path").isNull(), "not_found").otherwise("planned").alias("status"), "name")
