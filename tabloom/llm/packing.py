"""Packing by power-of-two decomposition.

A document's ids, with an end id, are cut into pieces of binary length: as many of the longest as fit, then one for
each set bit of what is left, longest first. Every piece is a sequence of its own, so no sequence crosses documents
and none needs padding; pieces of one length form a bucket from which batches are drawn.

Texts are independent and nothing is shuffled. Ids come from a `tokenizers` file; where that file is a byte-level BPE
whose ranks are its ids, the same vocabulary runs in tiktoken, about four times as fast, after both have agreed on
probe texts; texts with an added token's string, and texts with very long runs of white space, which overflow tiktoken's
regex engine, always go to `tokenizers`.

Defined results: null and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed one by
one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST, END = 2048, 1
#: White space in one run that tiktoken's regex engine is trusted with; it overflows between 500,000 and 1,000,000.
BLANK_RUN = 100_000
_BLANKS = re.compile(r"\s+")
#: A probe for both tokenizers: letters, marks, numbers, spaces, controls, other scripts, emoji.
_PROBES = ("", " ", "Hello  world's 123\n\n\tfoo_bar", "don't WE'LL\r\n  x", "Éé ñandú größe 東京 русский   ​́", "🙂🙂 a\x00b ٣٤ ½ ...!?", "a" * 300, " \n \t" * 30)


def _bytes_of_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies have for the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids, as `Tokenizer.from_file(path)` gives them without special tokens. A worker process makes one and keeps it."""
    by_library = lambda texts: [e.ids for e in _library(path).encode_batch(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    fast = _ranked(spec)
    try:
        if fast is None or [fast.encode_ordinary(x) for x in _PROBES] != by_library(list(_PROBES)):
            return by_library
    except Exception:  # a vocabulary that tiktoken can't run
        return by_library
    _library.cache_clear()  # read again if a text needs it
    added = [t["content"] for t in spec.get("added_tokens", [])]
    return lambda texts: [by_library([x])[0] if any(a in x for a in added) or _long_blank(x) else fast.encode_ordinary(x) for x in texts]


def _long_blank(text: str) -> bool:
    return len(text) > BLANK_RUN and any(m.end() - m.start() > BLANK_RUN for m in _BLANKS.finditer(text))


def _ranked(spec: dict):
    model = spec.get("model", {})
    if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    import tiktoken

    letters = _bytes_of_letters()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranked", pat_str=words, mergeable_ranks=ranks, special_tokens={})


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Binary lengths whose sum is n, longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def packed(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end: int = END, keep_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of length), sequence_id, offset; ids if kept.

    ids_crc32 is over the ids as little-endian 32-bit integers. sequence_id is unique and offset is 0, as a piece fills
    its sequence.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                at, start, size, crc, total, ids = [], [], [], [], [], []
                for row, found in enumerate(encode([x or "" for x in part.column(1).to_pylist()])):
                    found = np.append(np.array(found, np.uint32), np.uint32(end))
                    done = 0
                    for n in lengths(len(found), longest):
                        piece = found[done : done + n]
                        at.append(row)
                        start.append(done)
                        size.append(n)
                        crc.append(zlib.crc32(piece.astype("<u4").tobytes()))
                        total.append(len(found))
                        if keep_ids:
                            ids.append(piece.astype(np.int32))
                        done += n
                columns = {"doc_id": part.column(0).take(pa.array(at, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())}
                if keep_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, from which batches of equal sequences are read."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
