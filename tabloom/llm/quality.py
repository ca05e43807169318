"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger holds the measurements and one long whose bit i says that rule
i failed. Policies are versioned sets of rules applied to stored bits, and ablations are bitwise aggregates over the
distinct bit patterns, so neither reads a text again.

Defined results: a null or empty text has no words, lines or symbols and fails `few_words`; a null id stays null; rows
with equal ids are judged one by one; other columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import Words, chunks, covered, windows, mixed

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")
#: Words of a window that is looked for twice in a text.
REPEAT_WINDOW = 8
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules() -> list[Rule]:
    """Rule i sets bit i. New rules go at the end: stored ledgers stay valid."""
    n, lines = F.col("n_words"), F.col("n_lines")
    return [
        Rule("few_words", n < 20),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 30 * n),
        Rule("many_symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", (lines >= 4) & (100 * F.col("n_dup_lines") > 50 * lines)),
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 15 * n),
        Rule("stutter", 100 * F.col("n_stutter") > 30 * n),
    ]


#: Version to names of the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words", "stutter"),
}


def _measured(text: int, names: list[str]):
    """A function of batches that appends the measures of column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((len(MEASURES), batch.num_rows), np.int64)
            for first, last, data, offsets in chunks(batch.column(text)):
                found[:, first:last] = _measures(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=names)

    return run


def _measures(data: np.ndarray, offsets: np.ndarray) -> tuple:
    words = Words(data, offsets)
    counts = np.diff(words.bounds)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    hashes = words.hashes()
    start, h = windows(hashes, words.bounds, REPEAT_WINDOW)
    row = np.repeat(np.arange(len(counts)), counts)
    stutter = np.concatenate([[0, 0], np.cumsum((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))])[: len(row) + 1]
    h ^= mixed(row[start].astype(np.uint64))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    repeated = np.concatenate([[0], np.cumsum(covered(start[twice], REPEAT_WINDOW, len(row)))])
    lines = [[x for x in data[a:b].tobytes().split(b"\n") if x.strip()] for a, b in zip(offsets, offsets[1:])]
    return counts, sums(words.inside & ((data & 0xC0) != 0x80)), sums(_SYMBOL[data]), [len(x) for x in lines], [len(x) - len(set(x)) for x in lines], np.diff(repeated[words.bounds]), np.diff(stutter[words.bounds])


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of all rules. One pass, no shuffle."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(m, T.LongType()) for m in MEASURES]])
    return rows.mapInArrow(_measured(1, schema.names), schema).drop("text").withColumn("failed", _bits())


def kept_documents(docs: DataFrame, policy: str = "full-1", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that base-1 and the policy keep. One pass, no shuffle."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index(text)
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], *[T.StructField(m, T.LongType()) for m in MEASURES]])
    found = plain.mapInArrow(_measured(at, schema.names), schema).withColumn("failed", _bits())
    return found.filter(passes("base-1") & passes(policy)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mask(policy: str) -> int:
    names = [r.name for r in rules()]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def passes(policy: str) -> Column:
    """Whether the stored bits satisfy a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(stored: DataFrame, policy: str = "full-1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that stay if it is left out.

    Documents are first counted per bit pattern (128 patterns here, whatever the input); the rest is arithmetic on
    those rows.
    """
    patterns = stored.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = [r.name for r in rules()]
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit")) for x in POLICIES[policy]])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return patterns.select("bits", "n", each).groupBy(F.col("r.rule").alias("rule")).agg(count(hit).alias("n_failed"), count(alone).alias("n_only"), count((F.col("bits") == 0) | alone).alias("n_kept_without"))


def judged(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """The ledger with `base_failed` and `kept`, the verdicts of base-1 and of the policy."""
    return ledger(docs).withColumn("base_failed", ~passes("base-1")).withColumn("kept", passes("base-1") & passes(policy))
