"""Large delimited text in pieces: many tasks parse one file, with the rows that `decode.delimited` gives.

Spark reads the lines; pieces of whole lines are stored once. What a piece holds depends on whether it begins inside a
quoted cell, so a piece with quotes is walked both ways, the driver follows each file from piece to piece (numbers only), and
a record that goes on in later pieces is completed with their beginnings.
"""

from __future__ import annotations

import codecs
import io
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources import decode
from tabloom.sources.shared import stored

#: Bytes of a piece's lines, a longer line aside.
PIECE = 1 << 19
#: Bytes of a file that give its kind and its separator: 65,536 characters and a mark.
HEAD = 4 * 65536 + 3
AT = ["uri", "start", "seq"]
_CUT = "uri string, start long, seq int, lines long, quotes boolean, zero boolean, utf8 boolean, cp1252 boolean, data binary"
_PLACED = "uri string, start long, seq int, id long, name string, sep string, encoding string, mark boolean, trim boolean, inside boolean, row long, owner long, open boolean"


class Large(NamedTuple):
    uri: str
    name: str
    head: bytes
    #: Whether a line end is its last byte.
    ended: bool


def ends(spark: SparkSession, uri: str) -> tuple[bytes, bytes]:
    """The first HEAD bytes and the last byte, read by Hadoop, so any store works."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(uri))
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stream = store.open(path)
    try:
        head = bytes(stream.readNBytes(HEAD))
        stream.seek(max(0, store.getFileStatus(path).getLen() - 1))
        return head, bytes(stream.readNBytes(1))
    finally:
        stream.close()


def _cut(most: int):
    """Lines of (uri, start of the split) to pieces of so many bytes."""
    names = [x.split()[0] for x in _CUT.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.bool_()] * 4, pa.binary()]

    def piece(at: tuple, seq: int, held: list[bytes]) -> pa.RecordBatch:
        data = b"\n".join(held) + b"\n"
        try:
            utf8 = bool(data.decode())
        except UnicodeDecodeError:
            utf8 = False
        lines = len(held) + data.count(b"\r") - data.count(b"\r\n")
        row = (*at, seq, lines, b'"' in data, b"\0" in data, utf8, not any(x in data for x in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d")), zlib.compress(data, 1))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, held, size = None, 0, [], 0
        for batch in batches:
            for uri, start, line in zip(*[c.to_pylist() for c in batch.columns]):
                if at != (uri, start) or size >= most:
                    if held:
                        yield piece(at, seq, held)
                    seq = seq + 1 if at == (uri, start) else 0
                    at, held, size = (uri, start), [], 0
                held.append(line)
                size += len(line) + 1
        if held:
            yield piece(at, seq, held)

    return cut


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Its rows, one at a time in Python."""
    return (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())


def _text(piece: dict) -> str:
    data = zlib.decompress(piece["data"])
    # Hadoop leaves a mark out, which is text in other encodings than UTF-8.
    data = codecs.BOM_UTF8 + data if piece["mark"] else data
    return (data[:-1] if piece["trim"] else data).decode(piece["encoding"])


def _reader(text: str, sep: str, inside: bool):
    """A text that begins inside a quoted cell is read with a quote before it: the first record is the rest of an earlier one."""
    return decode.records('"' + text if inside else text, sep)


def walked(text: str, sep: str, inside: bool) -> tuple[int, bool]:
    """Of whole lines: records that begin in them, and whether a quoted cell is open at the end."""
    n, last = 0, None
    for last in _reader(text + "S", sep, inside):
        n += 1
    closed = last == ["S"]
    return n - inside - closed, not closed


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in _each(batch):
            text = _text(p)
            row = (p["id"], *walked(text, p["sep"], False), *walked(text, p["sep"], True))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["id", "n", "q", "inside_n", "inside_q"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a piece adds to the record of an earlier one."""
    for batch in batches:
        for p in _each(batch):
            text = _text(p)
            reader = _reader(text, p["sep"], True)
            next(reader, None)
            lines = list(io.StringIO(text, newline=""))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (p["owner"], p["id"], "".join(lines[: reader.line_num]))], names=["owner", "id", "head"])


def _rows(schema: list[str], types: list[pa.DataType], most: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name: str, row: int, cells: list[list[str]]) -> pa.RecordBatch:
            n = len(cells)
            same = {"file": name, "sheet": "", "visibility": "visible", "has_pivot": False, "has_chart": False, "is_chartsheet": False, "protected": False}
            own = {"row_no": range(row, row + n), "cells": cells}
            return pa.RecordBatch.from_arrays([pa.array(own[k], t) if k in own else pa.repeat(pa.scalar(same.get(k), t), n) for k, t in zip(schema, types)], names=schema)

        for batch in batches:
            for p in _each(batch):
                reader = _reader(_text(p) + (p["tail"] or ""), p["sep"], p["inside"])
                if p["inside"]:
                    next(reader, None)
                row, cells = p["row"] + 1, []
                for record in reader:
                    cells.append(record)
                    if len(cells) >= most:
                        yield out(p["name"], row, cells)
                        row, cells = row + len(cells), []
                if cells:
                    yield out(p["name"], row, cells)

    return rows


def text_cells(lines: DataFrame, files: list[Large], schema: str, types: list[pa.DataType], most: int, size: int) -> DataFrame:
    """Rows of `schema` of all files. lines: value, of `files` only, read with \\n as the line end. most: rows of a batch; size: bytes of a piece."""
    spark, names = lines.sparkSession, [x.split()[0] for x in schema.split(", ")]
    cut = stored(lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")).mapInArrow(_cut(size), _CUT))
    found = defaultdict(list)
    for p in cut.drop("data").collect():
        found[p.uri].append(p)
    errors, placed = [], []
    for file in files:
        pieces = sorted(found[file.uri], key=lambda p: (p.start, p.seq))
        if any(p.zero for p in pieces):
            errors.append((file.name, "Unsupported: text: Unsupported: binary content"))
            continue
        encoding = "utf-8" if all(p.utf8 for p in pieces) else "cp1252" if all(p.cp1252 for p in pieces) else "latin-1"
        mark = file.head.startswith(codecs.BOM_UTF8) and encoding != "utf-8"
        sample = file.head if mark else file.head.removeprefix(codecs.BOM_UTF8)
        same = {"name": file.name, "sep": decode.separator(sample.decode(encoding, "ignore")[:65536]), "encoding": encoding, "inside": False, "row": 0, "owner": None, "open": False}
        for p in pieces:
            at = {"uri": p.uri, "start": p.start, "seq": p.seq, "id": len(placed), "mark": mark and p is pieces[0], "trim": not file.ended and p is pieces[-1]}
            placed.append((at | same, p))
    fields = [x.split()[0] for x in _PLACED.split(", ")]

    def joined(keep) -> DataFrame | None:
        rows = [tuple(x[k] for k in fields) for x, p in placed if keep(x, p)]
        return cut.drop("lines", "quotes", "zero", "utf8", "cp1252").join(F.broadcast(spark.createDataFrame(rows, _PLACED)), AT) if rows else None

    quoted = joined(lambda _, p: p.quotes)
    walks = {w.id: ((w.n, w.q), (w.inside_n, w.inside_q)) for w in quoted.mapInArrow(_walks, "id long, n long, q boolean, inside_n long, inside_q boolean").collect()} if quoted else {}
    uri, inside, row, owner = None, False, 0, None
    for x, p in placed:
        if x["uri"] != uri:
            uri, inside, row, owner = x["uri"], False, 0, None
        x |= {"inside": inside, "row": row, "owner": owner if inside else None}
        if inside:
            placed[owner][0]["open"] = True
        # Without a quote all lines are records, or all are in the open cell.
        n, inside = walks[x["id"]][inside] if p.quotes else (0, True) if inside else (p.lines, False)
        row, owner = row + n, x["id"] if n else owner
    parse = lambda df: df.mapInArrow(_rows(names, types, most), schema)
    closed, opened = joined(lambda x, _: not x["open"]), joined(lambda x, _: x["open"])
    out = [parse(closed.withColumn("tail", F.lit(None).cast("string")))] if closed else []
    if opened:
        heads = joined(lambda x, _: x["inside"]).mapInArrow(_heads, "owner long, id long, head string")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "head"))), lambda h: h["head"]), "")
        out.append(parse(opened.join(heads.groupBy(F.col("owner").alias("id")).agg(text.alias("tail")), "id")))
    if errors:
        bad = spark.createDataFrame(errors, "file string, error string")
        out.append(bad.select(*[F.col(k) if k in ("file", "error") else F.lit(None).cast(x.split()[1]).alias(k) for k, x in zip(names, schema.split(", "))]))
    return reduce(DataFrame.unionByName, out)
