"""Reconciliation: what was expected against what was produced, two readings, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconciled(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """key, expected, produced, missing, complete per file; both sides are aggregated before they meet."""
    e = expected.groupBy(key).agg(F.count("*").alias("expected"))
    p = produced.groupBy(key).agg(F.count("*").alias("produced"))
    both = e.join(p, key, "left").withColumn("produced", F.coalesce("produced", F.lit(0).cast("long")))
    return both.withColumn("missing", F.greatest(F.col("expected") - F.col("produced"), F.lit(0).cast("long"))).withColumn("complete", F.col("produced") >= F.col("expected"))


def best_reading(readings: DataFrame, key: list[str], quality: list[str], method: str) -> DataFrame:
    """Per key the method of the best quality columns, compared in order; the least method name on ties."""
    best = F.max(F.struct(*quality)).alias("best")
    top = readings.groupBy(*key).agg(best)
    return readings.join(top, key).filter(F.struct(*quality) == F.col("best")).groupBy(*key).agg(F.min(method).alias(method))


def text_verdict(words: Column, readable: Column, dashes: Column) -> Column:
    """First thing that is wrong with a text, or 'ok'."""
    return F.when(words == 0, "no text").when(readable < 0.85, "unreadable").when(dashes > 0, "dash variant").when(words < 5, "short").otherwise("ok")


def per_file(rows: DataFrame, key: str, layout: str) -> DataFrame:
    """key, rows and layouts (the distinct ones in order) of each file."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(layout)), ", ").alias("layouts"))


def totals(files: DataFrame, key: str) -> DataFrame:
    """One row over the files of a run: files, rows, largest, layouts by file. One row per file is gathered."""
    each = F.array_sort(F.collect_list(F.struct(key, "layouts")))
    return files.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max("rows").alias("largest"), F.array_join(F.transform(each, lambda x: x["layouts"]), " | ").alias("layouts"))


def page_kinds(pages: DataFrame, key: str, text: str, by_ocr: str) -> DataFrame:
    """key, pages, native, ocr, empty: how many pages of a file have text of their own, text by OCR, or none."""
    some = F.coalesce(F.trim(text) != "", F.lit(False))
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(some & ~F.col(by_ocr)).alias("native"), F.count_if(some & F.col(by_ocr)).alias("ocr"), F.count_if(~some).alias("empty"))
