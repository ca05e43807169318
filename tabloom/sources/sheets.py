"""Cells of files as DataFrames: file, sheet, visibility, row_no, cells, and flags of the sheet.

Files are listed and read by Spark (binaryFile), so any store works, and each is decoded where it is read; delimited text
of more than LARGE bytes is cut into pieces that many tasks parse (see `pieces`). A file that can't be read gives one row with
`error` instead of failing the job. The same rows come from the data source
`sheet_cells` for plain SQL use, whose `sheet` and `visibility` filters skip sheets before their rows are emitted.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from tabloom.sources import decode, pieces
from tabloom.sources.shared import stored

SCHEMA = "file string, sheet string, visibility string, row_no int, cells array<string>, has_pivot boolean, has_chart boolean, is_chartsheet boolean, protected boolean, declared string, error string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
EXTENSIONS = ("xlsx", "xlsm", "xltx", "xltm", "xls", "xlsb", "ods", "xml", "csv", "tsv", "txt", "htm", "html")
#: The same in any case, for Hadoop's globs.
_PATTERN = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in EXTENSIONS) + "}"
#: Rows of a batch sent back from Python.
BATCH = 10_000
#: Bytes from which on delimited text isn't read whole.
LARGE = 8 << 20


def file_rows(name: str, data: bytes) -> Iterator[tuple]:
    try:
        for s in decode.sheets(data):
            flags = (s.has_pivot, s.has_chart, s.is_chartsheet, s.protected, s.declared)
            if not s.rows:
                yield (name, s.name, s.visibility, None, None, *flags, None)
            for number, cells in s.rows:
                yield (name, s.name, s.visibility, number, cells, *flags, None)
    except Exception as e:  # one bad file is a row of the report, not a failed job
        yield (name, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1)):
            for row in file_rows(name.as_py(), data.as_buffer().to_pybytes()):
                rows.append(row)
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
    if rows:
        yield _batch(rows)


def _read(spark: SparkSession, kind: str, folder: str, recursive: bool = True, pattern: str | None = None, **_) -> DataFrame:
    return spark.read.format(kind).option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern or _PATTERN).load(folder)


def files(spark: SparkSession, folder: str, recursive: bool = True, pattern: str | None = None, own_outputs: str = "") -> DataFrame:
    """path, name, content and uri of input files; lock files (~$), dotfiles and own outputs are left out."""
    found = _read(spark, "binaryFile", folder, recursive, pattern)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    named = found.select("path", name.alias("name"), "length", "content", F.col("_metadata.file_path").alias("uri")).filter(~F.col("name").startswith("~$") & ~F.col("name").startswith("."))
    return named.filter(~F.lower("name").contains(own_outputs.lower())) if own_outputs else named


def skipped_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """name and reason of the files below a folder that `files` leaves out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("raw"))
    name = F.url_decode(F.regexp_replace("raw", r"\+", "%2B"))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    reason = F.when(F.col("name").startswith("~$"), "a lock file").when(F.col("name").startswith("."), "a hidden file").when(~suffix.isin(*EXTENSIONS), "no table format")
    return found.select(name.alias("name")).withColumn("reason", reason).filter("reason is not null")


def sheet_cells(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Rows of all sheets of all files below a folder."""
    small, large = _parts(spark, folder, **options)
    return small if large is None else small.unionByName(large)


def stored_cells(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The same rows, decoded once and kept in the shared folder; of large text its pieces are kept, not its cells."""
    small, large = _parts(spark, folder, **options)
    return stored(small) if large is None else stored(small).unionByName(large)


def _parts(spark: SparkSession, folder: str, **options) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the files that are read whole, and of large delimited text, if there is any."""
    found = files(spark, folder, **options)
    large = []
    for f in found.filter(F.col("length") > LARGE).select("uri", "name").collect():
        head, last = pieces.ends(spark, f.uri)
        # In UTF-16 a line end's bytes may be parts of other characters.
        if decode.sniff(head) == "text" and head[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            large.append(pieces.Large(f.uri, f.name, head, last == b"\n"))
    if not large:
        return found.select("name", "content").mapInArrow(_decoded, SCHEMA), None
    text = F.col("_metadata.file_path").isin([f.uri for f in large])
    # By the file's path, so that Spark leaves the large ones out before it reads them.
    small = found.filter(~F.col("uri").isin([f.uri for f in large])).select("name", "content").mapInArrow(_decoded, SCHEMA)
    return small, pieces.text_cells(_read(spark, "text", folder, **options).filter(text), large, SCHEMA, _TYPES, BATCH, pieces.PIECE)


def html_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of the tables in an HTML column, the key as file."""
    return df.select(F.col(key).cast("string").alias("name"), F.col(html).cast("binary").alias("content")).filter("content is not null").mapInArrow(_html, SCHEMA)


def _html(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, data in zip(batch.column(0), batch.column(1)):
            for s in decode.html_tables(data.as_buffer().to_pybytes()):
                rows += [(name.as_py(), s.name, s.visibility, n, cells, False, False, False, False, None, None) for n, cells in s.rows]
        yield _batch(rows)


def _store(uri: str):
    """pyarrow's file system and path of a folder, Hadoop's names of stores included."""
    from pyarrow import fs

    scheme, rest = re.match(r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(.*)", uri, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme or rest.startswith("/") else os.path.abspath(rest)
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SheetReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("sheet",), ("visibility",)):
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path.lower()) if f.is_file and not f.base_name.startswith(("~$", ".")) and f.extension.lower() in EXTENSIONS]

    def read(self, partition):
        store, _ = _store(self.folder)
        with store.open_input_stream(partition.path, compression=None) as f:
            data = f.read()
        rows: list[tuple] = []
        for row in file_rows(partition.path.rpartition("/")[2], data):
            if all(row[_NAMES.index(k)] == v for k, v in self.wanted.items()):
                rows.append(row)
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class SheetSource(DataSource):
    """After register(spark): spark.read.format("sheet_cells").load(folder)"""

    @classmethod
    def name(cls):
        return "sheet_cells"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SheetReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format sheet_cells known, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SheetSource)
