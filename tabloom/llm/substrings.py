"""Exact removal of repeated word runs, found through difference-cover anchors.

A window is `WINDOW` consecutive words of one document; a window repeats if its words also start earlier in the corpus
(smaller doc_id, or the same document further left). Every word that a repeating window covers is removed.

Cover positions are word positions whose remainder modulo 13 is 0, 1, 3 or 9. Each difference modulo 13 occurs among
these, so two equal runs of 20 words have, at some offset below 13, a cover position in both, and the 8 words from
there (an anchor) are equal. So:

1. Documents are dealt into groups of about 4 MB, ascending by doc_id, and each group's anchors are hashed. A group
   sends each distinct anchor once, as sorted 32-bit remainders within one of many buckets; a bucket answers one bit
   per anchor: does another group have it?
2. Windows with an anchor that occurs twice are extended to their 20 words. A group sends each distinct window hash
   once (96 bits), and a bucket answers one bit: has an earlier group the window?
3. A window is removed if that bit is set or an equal window starts earlier in its own group.

No pair of occurrences is ever formed, so a passage that millions of documents share costs one entry for each group.
The text is shuffled once; all three steps read that exchange.

Defined results: null and empty texts have no words, no removed words and the digest of the empty string; a doc_id may
be of any type that can be sorted; documents with a null one come after all others, and among equal ids the order is that
of a hash of the texts (common.tie_place), then of the texts, so of repeated rows one stays whole; a text longer than a
group is a group of its own, so memory grows with the longest text; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import TASK_BYTES, covered, groups, mixed, numbered, released, tie_place, windows, word_hashes

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text of a group, and hashes of a bucket.
GROUP_BYTES, BUCKET_HASHES = 4 << 20, 1_000_000
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])


def _anchors(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of the group's anchors. Positions count from each document's start."""
    start, a = windows(h, bounds, ANCHOR, 0xA24BAED4963EE407)
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    at = _IN_COVER[(start - begin[start]) % PERIOD]
    return start[at], a[at]


def _bucketed(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets some ascending hashes fall into, and where each begins. A bucket is a range of hashes, named by its top bits."""
    own = (h >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.append(first, len(h))


def _packed(x: np.ndarray) -> bytes:
    """Ascending values as compressed differences."""
    return zlib.compress(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.frombuffer(zlib.decompress(x), np.uint8).reshape(size, -1).T.copy().view(kind).ravel(), dtype=kind)


_SENT = "bucket int, grp long, hashes binary, more binary"


def _sent(grp: int, h: np.ndarray, low: np.ndarray | None, wide: bool, bits: int) -> pa.Table:
    which, at = _bucketed(h, bits)
    rows = [(b, _packed(h[i:j] if wide else (h[i:j] >> np.uint64(8)).astype(np.uint64)), low[i:j].tobytes() if low is not None else b"") for b, i, j in zip(which.tolist(), at, at[1:])]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "grp": pa.array([grp] * len(rows), pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "more": pa.array([r[2] for r in rows], pa.binary())})


def _answered(earlier_only: bool):
    """Per group of a bucket: one bit for each hash, set if another (or only an earlier) group has it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("grp")
        hashes = [_unpacked(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = [len(x) for x in hashes]
        h = np.concatenate(hashes)
        if earlier_only:
            more = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("more").to_pylist()])
            order = np.lexsort((np.arange(len(h)), more, h))
            same = (h[order[1:]] == h[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
        else:
            order = np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
        flag = np.zeros(len(h), bool)
        flag[order[1:][same]] = True
        if not earlier_only:
            flag[order[:-1][same]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum(sizes)[:-1])]
        return released(pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())}))

    return run


_BITS = "grp long, bucket int, bits binary"


def _flags(answers: pa.Table, h: np.ndarray, bits: int) -> np.ndarray:
    """The answered bit of each of a group's ascending hashes."""
    which, at = _bucketed(h, bits)
    flag = np.zeros(len(h), bool)
    for k, packed in zip(np.searchsorted(which, answers.column("bucket").to_numpy()).tolist(), answers.column("bits").to_pylist()):
        flag[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8))[: at[k + 1] - at[k]]
    return flag


def _candidates(table: pa.Table, answers: pa.Table, bits: int):
    """Starts and both hashes of the windows that hold an anchor which occurs twice; the words' bounds."""
    h, bounds = word_hashes(table.column("text"))
    place, a = _anchors(h, bounds)
    distinct = np.unique(a)
    which = np.searchsorted(distinct, a)
    twice = _flags(answers, distinct, bits)[which] | (np.bincount(which, minlength=len(distinct)) > 1)[which]
    # The windows that start at most PERIOD - 1 words before such an anchor.
    near = covered(np.maximum(place[twice] - (PERIOD - 1), 0), PERIOD, len(h))
    start, w = windows(h, bounds, WINDOW)
    keep = near[start]
    start, w = start[keep], w[keep]
    _, other = windows(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), bounds, WINDOW, 0xDABA0B6EB09322E3)
    return start, w, (other[keep] >> np.uint64(32)).astype(np.uint32), bounds


def _first_of_each(w: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each distinct (w, low) pair's first occurrence, in the order of w and low; and each occurrence's pair."""
    order = np.lexsort((np.arange(len(w)), low, w))
    new = np.ones(len(w), bool)
    new[1:] = (w[order[1:]] != w[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    which = np.empty(len(w), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _marked(docs: DataFrame, finish, schema: str, doc_id: str, text: str, rest: bool = False) -> DataFrame:
    """What `finish` makes of each group's table, word bounds and mask of removed words; with `rest`, a struct of all columns goes along."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")] if rest else []
    rows, key = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *row), "doc_id")
    schema = schema.replace("KIND", docs.schema[doc_id].dataType.simpleString()) + (f", row {rows.schema['row'].dataType.simpleString()}" if rest else "")
    weight = F.octet_length("text") + 64
    grp, tasks = groups(rows, key, weight, GROUP_BYTES, tie="text")
    # A power of two: a bucket is named by top bits, and a group handles the buckets that its hashes fall into, no others.
    anchors = tasks * TASK_BYTES / 6 * len(COVER) / PERIOD
    bits = max(2, ceil(log2(max(1.0, anchors / BUCKET_HASHES))), ceil(log2(docs.sparkSession.sparkContext.defaultParallelism)))
    dealt = lambda df: df.repartition(tasks, "grp").groupBy("grp")
    grouped = rows.select(grp.alias("grp"), "doc_id", tie_place("text").alias("tie"), "text", *(["row"] if rest else []))

    def first(key: tuple, table: pa.Table) -> pa.Table:
        h, bounds = word_hashes(_ordered(table).column("text"))
        return released(_sent(key[0].as_py(), np.unique(_anchors(h, bounds)[1]), None, False, bits))

    def second(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, w, low, _ = _candidates(_ordered(table), answers, bits)
        one, _ = _first_of_each(w, low)
        return released(_sent(key[0].as_py(), w[one], low[one], True, bits))

    def third(key: tuple, table: pa.Table, answers: pa.Table, earlier: pa.Table) -> pa.Table:
        table = _ordered(table)
        start, w, low, bounds = _candidates(table, answers, bits)
        one, which = _first_of_each(w, low)
        again = np.ones(len(w), bool)
        again[one] = False
        gone = covered(start[again | _flags(earlier, w[one], bits)[which]], WINDOW, bounds[-1])
        return released(finish(table, bounds, gone))

    def last(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        late = np.asarray(answers.column("late").to_numpy(zero_copy_only=False), bool)
        return third(key, table, answers.filter(pa.array(~late)), answers.filter(pa.array(late)))

    asked = lambda df: df.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, (1 << bits) // 4), "bucket").groupBy("bucket")
    repeated = asked(dealt(grouped).applyInArrow(first, _SENT)).applyInArrow(_answered(False), _BITS)
    earlier = asked(dealt(grouped).cogroup(dealt(repeated)).applyInArrow(second, _SENT)).applyInArrow(_answered(True), _BITS)
    both = repeated.select("grp", "bucket", "bits", F.lit(False).alias("late")).union(earlier.select("grp", "bucket", "bits", F.lit(True).alias("late")))
    return dealt(grouped).cogroup(dealt(both)).applyInArrow(last, schema)


def _rows(table: pa.Table, bounds: np.ndarray, gone: np.ndarray) -> Iterator[tuple[str, int, int, bytes]]:
    for text, i, j in zip(table.column("text"), bounds, bounds[1:]):
        n = int(gone[i:j].sum())
        words = text.as_buffer().to_pybytes().split()
        yield text, int(j - i), n, b" ".join(compress(words, ~gone[i:j]) if n else words)


def removal_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the digest of the kept words joined by one space."""

    def finish(table: pa.Table, bounds: np.ndarray, gone: np.ndarray) -> pa.Table:
        found = [(n, m, hashlib.sha256(kept).hexdigest()) for _, n, m, kept in _rows(table, bounds, gone)]
        return pa.table({"doc_id": table.column("doc_id"), **{k: pa.array([r[i] for r in found], t) for i, (k, t) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())))}})

    return _marked(docs, finish, "doc_id KIND, n_words long, n_removed long, kept_sha256 string", doc_id, text)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rest: bool = False) -> DataFrame:
    """doc_id, text, n_removed and spans (first word, number of words) of what was removed; with `rest`, row has all other columns.

    A text that loses nothing stays as it is; otherwise it is the kept words joined by one space.
    """

    def finish(table: pa.Table, bounds: np.ndarray, gone: np.ndarray) -> pa.Table:
        texts, removed, spans = [], [], []
        for (text, _, n, kept), i, j in zip(_rows(table, bounds, gone), bounds, bounds[1:]):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[i:j].astype(np.int8), [0]])))
            texts.append(kept.decode() if n else text.as_py())
            removed.append(n)
            spans.append([{"first": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
        return pa.table({"doc_id": table.column("doc_id"), "text": pa.array(texts, pa.string()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))), **({"row": table.column("row")} if rest else {})})

    return _marked(docs, finish, "doc_id KIND, text string, n_removed long, spans array<struct<first:long,n:long>>", doc_id, text, rest)


def trimmed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with repeated runs removed from its text, and n_chars (where there is one) as of the new text."""
    found = without_repeats(docs, text=text, rest=True)
    changed = F.col("n_removed") > 0
    named = {text: F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return found.select(*[named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
