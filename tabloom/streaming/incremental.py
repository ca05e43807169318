"""Incremental runs as Structured Streaming.

Finished inputs are known to the checkpoint, so a run reads only new files; a file counts as done when its batch is
committed, not when its first row is out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabloom.operators.extract import joined_record
from tabloom.sources.sheets import SCHEMA, _decoded


def new_rows(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of the rows of all sheets of files that appear below a folder."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(_decoded, SCHEMA)


def run_once(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Appends what is new to Parquet and stops."""
    transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Blocks of events by time gap, each closed once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def carried(pages: DataFrame, fields: list[str], wait_ms: int | None = None, identity: tuple[str, ...] | None = None) -> DataFrame:
    """Records of pages that arrive in order of page, by file: the open record waits in state for the next page's first
    one and joins it as in `extract.joined_record`; page is that on which a record ends. With wait_ms a record without further pages leaves after that
    long, and the query runs on; without it the record stays in the state for the next run.
    """
    names = ["file", "page", *fields]
    kind = "file string, page int, " + ", ".join(f"{f} string" for f in fields)

    def step(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([held], columns=names)
            return
        held = dict(zip(names, state.get)) if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values("page", kind="stable")
        previous = held["page"] if held else None
        for row in rows[names].to_dict("records"):
            joined = joined_record(held, row, previous is None or row["page"] != previous, fields, identity or tuple(fields))
            out += [held] if joined is None and held else []
            held = dict(row) if joined is None else joined
            previous = row["page"]
        state.update(tuple(held[n] for n in names))
        if wait_ms:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=names)

    return pages.groupBy("file").applyInPandasWithState(step, kind, kind, "append", GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout)
