"""Run reports: one row per file and sheet, with what was done and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as tx


def sheet_report(cells: DataFrame, reasons: DataFrame) -> DataFrame:
    """file, sheet, action (used, skipped, error), detail, rows."""
    per = cells.groupBy("file", "sheet").agg(
        F.count_if(F.exists("cells", lambda c: ~tx.is_blank(c))).alias("rows"), F.max("error").alias("error"), F.bool_or("has_pivot").alias("pivot"), F.bool_or("has_chart").alias("chart"), F.bool_or("is_chartsheet").alias("chartsheet")
    )
    r = reasons.select(F.col("file").alias("f"), F.col("sheet").alias("s"), "reason")
    joined = per.join(r, F.col("file").eqNullSafe(F.col("f")) & F.col("sheet").eqNullSafe(F.col("s")), "left")
    detail = F.coalesce("error", F.when(F.col("chartsheet"), "a chart sheet").when(F.col("pivot"), "holds a pivot table").when(F.col("chart"), "holds a chart"), "reason")
    action = F.when(F.col("error").isNotNull(), "error").when(detail.isNotNull(), "skipped").otherwise("used")
    return joined.select("file", "sheet", action.alias("action"), detail.alias("detail"), "rows")
