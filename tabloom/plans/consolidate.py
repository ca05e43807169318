"""A folder of workbooks and text files to one de-duplicated table, with its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.operators import dedupe, headers, union
from tabloom.sources.report import sheet_report
from tabloom.sources.shared import stored
from tabloom.sources.sheets import stored_cells

KEY = ("Person Number", "Patient Name", "Encounter Number", "Date of Service")


def combined(spark: SparkSession, folder: str, key: tuple[str, ...] = KEY) -> tuple[DataFrame, DataFrame]:
    """(rows, report). Row 1 must be a header; sheets with pivots or charts are skipped; columns of one canonical name
    coalesce; the first of rows with an equal normalised key stays, rows with a blank key all do."""
    cells = stored_cells(spark, folder)
    plain = cells.filter("error is null and not has_pivot and not has_chart and not is_chartsheet and row_no is not null")
    reasons = headers.first_row_or_reason(plain)
    good = reasons.filter("reason is null").select("file", "sheet", F.lit(1).alias("header_row"))
    rows = union.grid_rows(plain.select("file", "sheet", "row_no", "cells"), good)
    pairs = F.transform(F.map_entries("values"), lambda e: F.struct(F.coalesce(tx.canonical_header(e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    first = F.aggregate(pairs, F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.create_map(p["key"], p["value"]))))
    named = stored(rows.withColumn("values", first))
    columns = named.select(F.explode(F.map_keys("values")).alias("name"), F.struct(F.lower("file").alias("f"), "sheet", "row_no").alias("at"))
    registry = columns.groupBy("name").agg(F.min("at").alias("at"))
    order = F.when(F.col("name").isin(*key), 0).otherwise(1)
    listed = registry.select("name", F.struct(order, F.array_position(F.array(*[F.lit(k) for k in key]), F.col("name")), "at", "name").alias("ord"))
    table = union.projected(named, union.column_registry(listed))
    value = lambda c: F.coalesce(F.when(F.lit(c == "Date of Service"), tx.date_value(c)).otherwise(tx.normal_value(c)), F.lit(""))
    present = [k for k in key if k in table.columns]
    if not present:
        return table.drop("Source Row"), sheet_report(cells, reasons)
    joined = F.concat_ws("\x1f", *[value(k) for k in present])
    business = F.when(F.concat(*[value(k) for k in present]) != "", joined)
    ordered = table.withColumn("__at", F.struct(F.lower("Source File"), "Source Sheet", "Source Row"))
    return dedupe.keep_first(ordered, business, ["__at"]).drop("__at", "Source Row"), sheet_report(cells, reasons)


def merged(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """As-is append of all rows, blank ones too, as text. A row has as many columns as the widest row of all files, and the
    expected ones at least; those beyond are named Extra_<number>, so no cell is lost. Files that can't be read are in
    the report (see `sheet_report`)."""
    cells = stored_cells(spark, folder).filter("error is null and row_no is not null")
    # One number reaches the driver.
    width = max(len(expected), cells.agg(F.max(F.size("cells"))).first()[0] or 0)
    names = [*expected, *[f"Extra_{i}" for i in range(len(expected) + 1, width + 1)]]
    return cells.select("file", "sheet", "row_no", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)])


def sizes(cells: DataFrame) -> DataFrame:
    """file, sheet, declared (rows and columns that the sheet says it has, null if it doesn't), rows, columns, and width, the
    widest of all sheets."""
    per = cells.filter("error is null").groupBy("file", "sheet").agg(F.max("declared").alias("declared"), F.coalesce(F.max("row_no"), F.lit(0)).alias("rows"), F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("columns"))
    return per.crossJoin(F.broadcast(per.agg(F.max("columns").alias("width"))))
