"""Deterministic sharded WARC writer and reader.

Records are range-dealt by page_id into shards of about `shard_bytes` of payload (boundaries come from exact sums, not
samples), ordered within each, and written as one gzip member per record. A file is closed once its compressed size
reaches `roll_bytes`. Record ids, dates, lengths and digests are regenerated from the content, so equal input gives
equal files whatever the cluster. Of records with equal payloads the one with the smallest page_id is a response and
the others revisit it.

Commit: a task writes under temporary names that no other attempt uses and returns a manifest row per file. The
manifest is stored first, then tasks give its files their final names, then `_SUCCESS` appears. A file that has its
final name already is left alone, so `commit` can be run again from the manifest after a crash. Files of lost attempts
are in no manifest and are removed.

Defined results: a null html is the empty payload; a page_id may be of any type that can be sorted, and comes back as
it was; a null one is never referred to unless the whole group has none; rows that repeat a page_id and payload are all
responses; a null url is written as urn:page:<id>; a payload longer than a shard is a shard of its own, so memory grows
with the longest payload; other columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabloom.llm.common import checkpointed, groups, join_hot, numbered, shared_dir, tie_place

SHARD_BYTES, ROLL_BYTES = 16 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard long, seq int, temporary string, name string, records long, bytes long, sha256 string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{payload_digest}'.encode()).digest()[:16], version=5)}>"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One compressed record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    name = digest(payload)
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{quote(str(page_id))}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, name)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{name}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", quote(str(page_id))))
    if refers_to is None:
        return record(headers, http + payload)
    return record([*headers, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, name)), ("X-Refers-To-Page", quote(str(refers_to)))], http)


def info_record(name: str, date: str = DATE) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: tabloom\r\nformat: WARC File Format 1.1\r\n")


#: Hadoop's names of stores, and those of the same stores here.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "file": "file"}


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, rest = re.match(r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(.*)", uri, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def _decided(sharded: DataFrame, least_revisit: int) -> DataFrame:
    """of (shard), id, sum, low: the records that revisit page `low`. A payload that many pages share, such as the empty
    one, meets no other page in a task: its one row is broadcast."""
    own = checkpointed(sharded.select("shard", "page_id", F.sha1("html").alias("sha1"), F.octet_length("html").alias("n")).filter(F.col("n") >= least_revisit).drop("n"))
    first = own.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("members")).filter("members > 1 and first is not null")
    joined = join_hot(own, checkpointed(first), "sha1", "members", own.count())
    return joined.filter("not page_id <=> first").select(F.col("shard").alias("of"), F.col("page_id").alias("id"), F.col("sha1").alias("sum"), F.col("first").alias("low")).distinct()


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_revisit: int = 0, date: str = DATE) -> DataFrame:
    """Writes all pages below `folder`, a URI that driver and executors share, and returns the stored manifest."""
    spark = pages.sparkSession
    rows, key = numbered(pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")), "page_id")
    shard, tasks = groups(rows, key, F.octet_length("html") + 512, shard_bytes, tie="html")
    sharded = rows.select(shard.alias("shard"), "page_id", "url", "html")
    decided = _decided(sharded, least_revisit)
    temporary = f"{folder}/_temporary"
    _, base = _store(temporary)

    def put(key: tuple, table: pa.Table, revisits: pa.Table) -> pa.Table:
        store, _ = _store(temporary)
        store.create_dir(base, recursive=True)
        table = table.sort_by([("page_id", "ascending"), ("tie", "ascending"), ("html", "ascending"), ("url", "ascending")])
        refers = {(a, b): c for a, b, c in zip(*(revisits.column(x).to_pylist() for x in ("id", "sum", "low")))}
        number, made, out = key[0].as_py(), [], None
        sink = sha = size = count = name = place = None

        def close():
            sink.close()
            made.append((number, len(made), place, name, count, size, sha.hexdigest()))

        for i in range(table.num_rows):
            if sink is None:
                name = f"{number:010d}-{len(made):05d}.warc.gz"
                place = f"{uuid.uuid4().hex}.warc.gz"
                sink, sha, size, count = store.open_output_stream(f"{base}/{place}", compression=None), hashlib.sha256(), 0, 0
                out = info_record(name, date)
                sink.write(out)
                sha.update(out)
                size += len(out)
            page, payload = table.column("page_id")[i].as_py(), table.column("html")[i].as_buffer().to_pybytes()
            refer = refers.get((page, hashlib.sha1(payload).hexdigest())) if refers else None
            out = page_record(page, table.column("url")[i].as_py(), payload, refer, date)
            sink.write(out)
            sha.update(out)
            size += len(out)
            count += 1
            if size >= roll_bytes:
                close()
                sink = None
        if sink is not None:
            close()
        return pa.table({f.split()[0]: pa.array([m[i] for m in made], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for i, f in enumerate(_MANIFEST.split(", "))})

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    dealt = sharded.withColumn("tie", tie_place("html")).repartition(tasks, "shard").groupBy("shard")
    parts = dealt.cogroup(decided.repartition(tasks, "of").groupBy("of")).applyInArrow(put, _MANIFEST)
    parts.write.mode("overwrite").parquet(f"{folder}/_manifest.parquet")
    return commit(spark, folder)


def commit(spark: SparkSession, folder: str) -> DataFrame:
    """Gives the files of a stored manifest their final names, removes what is in no manifest, marks success, and returns
    the manifest. May be repeated."""
    manifest = spark.read.parquet(f"{folder}/_manifest.parquet")
    store, root = _store(folder)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _store(folder)
        for batch in batches:
            for temporary, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made, final = own.get_file_info([f"{root}/_temporary/{temporary}", f"{root}/{name}"])
                if made.type == fs.FileType.File:
                    own.move(made.path, final.path)
                elif final.type != fs.FileType.File:
                    raise ValueError(f"{name} is in the manifest, but neither under its temporary nor its final name")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files = manifest.count()
    moved = manifest.select("temporary", "name").repartition(max(1, min(files // 4, 1000))).mapInArrow(named, "n long").agg(F.sum("n")).first()[0]
    if (moved or 0) != files:
        raise ValueError(f"{moved} of {files} files were named")
    if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")
    with store.open_output_stream(f"{root}/_SUCCESS") as f:
        f.write(b"")
    return manifest


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file; one record is in memory at a time."""
    pending, unzip, plain = b"", zlib.decompressobj(31), []
    while True:
        data = pending or stream.read(1 << 20)
        if not data:
            break
        plain.append(unzip.decompress(data))
        pending = unzip.unused_data
        if unzip.eof:
            reader = io.BytesIO(b"".join(plain))
            if not reader.readline().startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := reader.readline().rstrip(b"\r\n")):
                k, _, v = line.decode().partition(": ")
                headers[k] = v
            yield headers, reader.read(int(headers["Content-Length"]))
            unzip, plain = zlib.decompressobj(31), []


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of all pages, digests verified. Ids are
    longs unless another type is given."""
    _, root = _store(folder)
    id_type = id_type or T.LongType()
    kind = f"page_id {id_type.simpleString()}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type.simpleString()}, payload binary"
    ids = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([c.cast(ids) if i in (0, 4) else c for i, c in enumerate(columns)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                found, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if digest(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: block digest differs")
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (len(payload), digest(payload)) != (n, named):
                            raise ValueError(f"{name}: payload digest differs")
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                        found.append((page and unquote(page), n, named, headers["WARC-Type"], refers and unquote(refers), payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield batch_of(found)
                            found, held = [], 0
                yield batch_of(found)

    files = manifest.select("name")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(run, kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives into the shared folder and returns what is read back, without payloads."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(pages.sparkSession, folder, write(pages, folder), pages.schema["page_id"].dataType).drop("payload")
