"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant within r bits of each. Every distinct fingerprint is
expanded to all its variants within r bits, variants meet by value, and fingerprints that share one are linked: by the
triangle inequality they differ in at most 2r bits, and the distance is checked again all the same.

Shuffling 2081 variants a fingerprint would be most of the cost. Variants are dealt by their top b bits, so all of a
fingerprint's variants lie in 1 + b + C(b, 2) buckets. A fingerprint is sent once to each of these and expanded there,
which makes the same variants meet in the same task. Buckets that would get too many variants are split by a hash of
the variant. A task returns a spanning forest of its links, never all pairs of a group.

Buckets are as many as the fingerprints need, at any size, and of a hot fingerprint, node or component only its one row is
broadcast (common.join_hot), so none of them meets in one task.

`one_of_each` finds texts whose sets of WORDS-word shingles have a Jaccard similarity of SIMILARITY or more. One fingerprint
of 64 bits would need balls of radius 6 for these (a pair at 0.8 differs in 10 bits on average), so it takes TABLES
fingerprints of TABLE_BITS bits each, of distinct shingles, and balls of radius 1: a pair at 0.8 differs in 2 bits or less in
one table with a probability of 0.12, in some table with 0.95, and at 0.85 with 0.995. The variants of all tables meet as
above; colliding pairs are then verified over all TABLES * TABLE_BITS bits: their share that differs estimates the angle of
the two sets, and with the sets' sizes their similarity, with a standard error of 0.03 at 0.8. Texts of equal bits are one
node. Of texts that share a variant each is paired with the first and with its neighbour by number, so a group of n costs
2 n pairs for each variant, not n squared. The first FIRST_TABLES tables are met and verified before the others, and each text
is labelled with the least one within two links; the other tables give no pair of one label, as these are connected already:
the links found connect the same texts, but a group of copies isn't paired anew in each table.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id is never the
smallest one of a component unless all are null; repeated rows share a component; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Words, checkpointed, chunks, join_hot, mixed, released, windows

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
WORDS, SIMILARITY, TABLES, TABLE_BITS, FIRST_TABLES = 5, 0.8, 24, 32, 6
#: Variants that a task holds at once, of fingerprints and of tables' keys.
VARIANTS, KEY_VARIANTS = 3_000_000, 1_000_000
#: Heavy buckets that are broadcast, at 20 bytes each; if there are more, they are shuffled.
HEAVY = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all shingles of lower-cased (A-Z) words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashed = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashed), 1 << 16):
        ones += np.unpackbits(hashed[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """The id as text, if there is one, and a hash of the text: rows of one id with different texts are told apart."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("~"), F.hex(F.xxhash64(text)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key (the id and a hash of the text) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_buffer().to_pybytes(), shingle) if x.is_valid else 0 for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "row_key", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, row_key string, fp long")


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """By weight 0, 1, .. most: all masks of so many of the low bits."""
    found = [np.zeros(1, np.uint64)]
    for _ in range(most):
        ones = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        both = (found[-1][:, None] | ones[None, :])[(ones[None, :] > found[-1][:, None])]
        found.append(both)
    return found


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n nodes' components under edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly what distances of at most `radius` bits connect; distinct: fp, one row each."""
    half = radius // 2
    if radius % 2:
        raise ValueError("an even radius is needed: both halves of a pair expand alike")
    n = distinct.count() if n is None else n
    ball = sum(comb(BITS, i) for i in range(half + 1))
    top = min(BITS // 2, max(4, ceil(log2(max(1, n) * ball / VARIANTS + 1))))
    lower = BITS - top
    low_masks = _masks(lower, half)
    made_by = [sum(len(m) for m in low_masks[: half - w + 1]) for w in range(half + 1)]
    masks = np.concatenate(_masks(top, half)).astype(np.int64)

    head = F.shiftrightunsigned("fp", lower)
    sent = distinct.select("fp", F.explode(F.transform(F.lit(masks), lambda m: m.bitwiseXOR(head))).alias("bucket"))
    weight = F.bit_count(F.shiftrightunsigned("fp", lower).bitwiseXOR(F.col("bucket")))
    variants = F.get(F.lit(np.array(made_by, np.int64)), weight)
    heavy = checkpointed(sent.groupBy("bucket").agg(F.ceil(F.sum(variants) / F.lit(VARIANTS)).cast("int").alias("parts")).filter("parts > 1"))
    dealt = sent.join(F.broadcast(heavy) if heavy.count() <= HEAVY else heavy, "bucket", "left").select("bucket", "fp", F.coalesce("parts", F.lit(1)).alias("parts"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        fp = np.sort(table.column("fp").to_numpy().view(np.uint64))
        bucket, part, parts = np.uint64(key[0].as_py()), np.uint64(key[1].as_py()), np.uint64(table.column("parts")[0].as_py())
        away = np.bitwise_count((fp >> np.uint64(lower)) ^ bucket)
        rest = fp & np.uint64((1 << lower) - 1)
        values, owners = [], []
        for w in range(half + 1):
            own = np.flatnonzero(away == w)
            m = np.concatenate(low_masks[: half - w + 1])
            for i in range(0, len(own), max(1, VARIANTS // len(m))):
                who = own[i : i + max(1, VARIANTS // len(m))]
                v = (rest[who][:, None] ^ m[None, :]).ravel()
                o = np.repeat(who.astype(np.int32), len(m))
                if parts > 1:
                    mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % parts == part
                    v, o = v[mine], o[mine]
                values.append(v)
                owners.append(o)
        v, o = np.concatenate(values or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int32)])
        order = np.argsort(v)
        same = v[order[1:]] == v[order[:-1]]
        pairs = np.unique((o[order[:-1][same]].astype(np.int64) << 32) | o[order[1:][same]])
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        label = _forest(a[near], b[near], len(fp))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return released(pa.table({"a": fp[label[moved]].view(np.int64), "b": fp[moved].view(np.int64)}))

    return dealt.groupBy("bucket", "part").applyInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge: root is the smallest node it reaches.

    Large-star and small-star rounds; each round's edges go to a checkpoint, and only a count and a sum of hashes come
    to the driver.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
    was = state(now)
    while was[0]:
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).union(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.filter("v > u"), least, "u", "n", was[0]).select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        root = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(root, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(root.select("x", F.col("m").alias("y")))
        now = checkpointed(small.distinct())
        if (is_ := state(now)) == was:
            break
        was = is_
    return now.select(F.col("x").alias("node"), F.col("y").alias("root"))


def _lowest(nodes: DataFrame, node: str, found: DataFrame) -> DataFrame:
    """nodes (node, low, n) with the least `low` of each one's component."""
    rooted = checkpointed(nodes.join(found, nodes[node] == found.node, "left").select(nodes[node], "low", "n", F.coalesce("root", nodes[node]).alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("low"), F.count("*").alias("members"))
    return join_hot(rooted.select(node, "n", "root"), checkpointed(lowest), "root", "members", rooted.count())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, row_key, fingerprint (16 hex digits), component_id and representative, true for one row_key of each component.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    distinct = checkpointed(rows.groupBy("fp").agg(F.min(order).alias("low"), F.count("*").alias("n")))
    of = _lowest(distinct, "fp", components(links(distinct.select("fp"), radius, distinct.count())))
    of = of.select("fp", F.col("low.doc_id").alias("component_id"), F.col("low.row_key").alias("kept_key"), "n")
    return join_hot(rows, checkpointed(of), "fp", "n", rows.count()).select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("row_key") == F.col("kept_key")).alias("representative"))


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SALTS = mixed(np.arange(1, TABLES * TABLE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The majority bits of distinct shingle hashes, as TABLES * TABLE_BITS / 64 words."""
    found = np.zeros(len(_SALTS), np.uint64)
    if len(shingles):
        ones = np.zeros(64 * len(_SALTS), np.int64)
        for i in range(0, len(shingles), 1 << 14):
            part = mixed(shingles[i : i + (1 << 14), None] ^ _SALTS[None, :])
            ones += np.add.reduce(np.unpackbits(part.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
        found = np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)
    return found


def signatures(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, bits (the signature, binary) and size (distinct shingles; a text of fewer words is one shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, size = [], []
            for _, _, data, offsets in chunks(batch.column(2)):
                own = Words(_LOWER[data], offsets)
                h, bounds = own.hashes(), own.bounds
                start, found = windows(h, bounds, words)
                at = np.searchsorted(start, bounds)
                for a, b, i, j in zip(bounds, bounds[1:], at, at[1:]):
                    whole = found[i:j] if j > i else windows(h[a:b], np.array([0, b - a]), b - a)[1] if b > a else found[:0]
                    distinct = np.unique(whole)
                    bits.append(signature(distinct).tobytes())
                    size.append(len(distinct))
            yield released(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(size, pa.int64())], names=["doc_id", "row_key", "bits", "size"]))

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, row_key string, bits binary, size long")


def keyed(nodes: DataFrame, tables: range = range(TABLES)) -> DataFrame:
    """(key, node, root) for each of the tables of the nodes (node, root, bits): the table's number above its TABLE_BITS bits.
    A null root, which costs next to nothing in a shuffle, is the node itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TABLES).astype(np.int64)
            key = (bits | (np.arange(TABLES, dtype=np.int64) << TABLE_BITS)[None, :])[:, tables.start : tables.stop]
            each = pa.array(np.repeat(np.arange(len(batch)), len(tables)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column(0).take(each), batch.column(1).take(each)], names=["key", "node", "root"])

    return nodes.select("node", "root", "bits").mapInArrow(run, "key long, node long, root long")


def colliding(nodes: DataFrame, tables: range = range(TABLES)) -> DataFrame:
    """(a, b): pairs of nodes (node, root, bits) of different roots that share a variant within one bit in one of the tables.

    Nodes of one key are paired with the first of them, by an aggregate that combines before the shuffle; only distinct
    keys are expanded, so no task holds more than the keys that a bucket can have.
    """
    own = keyed(nodes, tables)
    firsts = checkpointed(own.groupBy("key").agg(F.min("node").alias("first"), F.min_by("root", "node").alias("first_root"), F.count("*").alias("n")))
    n = firsts.count()
    same = join_hot(own, firsts.filter("n > 1"), "key", "n", n).filter("coalesce(root, node) <> coalesce(first_root, first)").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return same.union(_ball_pairs(firsts.select("key", "first", "first_root"), n, len(tables)))


def _ball_pairs(keys: DataFrame, n: int, tables: int) -> DataFrame:
    """(a, b): the nodes of keys (key, first, first_root) of one table that share a variant, but not a root; each with the
    least and the next one."""
    parallel = keys.sparkSession.sparkContext.defaultParallelism
    top = min(TABLE_BITS // 2, max(2, ceil(log2(n * (TABLE_BITS + 1) / max(1, tables) / KEY_VARIANTS + 1))))
    low = TABLE_BITS - top

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.array([0, *(1 << b for b in range(top))], np.int64)
        for batch in batches:
            bucket = (batch.column(0).to_numpy() >> low)[:, None] ^ near[None, :]  # the table's number stands above and stays
            each = pa.array(np.repeat(np.arange(len(batch)), top + 1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), *(c.take(each) for c in batch.columns)], names=["bucket", "key", "node", "root"])

    def meet(name: tuple, table: pa.Table) -> pa.Table:
        by_node = np.argsort(table.column("node").to_numpy())  # a bucket is of one table, so it has a node once
        roots = pc.coalesce(table.column("root"), table.column("node"))
        node, key, root = (x.to_numpy()[by_node] for x in (table.column("node"), table.column("key"), roots))
        own, rest = (key >> low) == name[0].as_py(), key & ((1 << low) - 1)
        # A key of this bucket brings its variants in the lower bits; that of a bucket one bit away only itself.
        masks = np.array([0, *(1 << b for b in range(low))], np.int64)
        parts = max(1, -(-len(masks) * int(own.sum()) // KEY_VARIANTS))
        found = [np.zeros(0, np.int64)]
        for part in range(parts):  # variants by a hash, so that only some are held at once
            values, owners = [], []
            for these, flips in ((own, masks), (~own, masks[:1])):
                of, at = rest[these], np.flatnonzero(these).astype(np.int32)
                for i in range(0, len(of), 1 << 16):
                    v, o = (of[i : i + (1 << 16), None] ^ flips[None, :]).ravel(), np.repeat(at[i : i + (1 << 16)], len(flips))
                    if parts > 1:
                        mine = mixed(v.astype(np.uint64)) % np.uint64(parts) == np.uint64(part)
                        v, o = v[mine], o[mine]
                    values.append(v)
                    owners.append(o)
            v, o = np.concatenate(values), np.concatenate(owners).astype(np.int64)
            order = np.lexsort((o, v))
            v, o = v[order], o[order]
            new = np.append(True, v[1:] != v[:-1])
            again = np.flatnonzero(~new)
            first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
            a, b = np.concatenate([o[first[again]], o[again - 1]]), np.concatenate([o[again], o[again]])
            apart = root[a] != root[b]
            found.append(np.unique((a[apart] << 32) | b[apart]))
        both = np.unique(np.concatenate(found))
        return released(pa.table({"a": pa.array(node[both >> 32]), "b": pa.array(node[both & 0xFFFFFFFF])}))

    # About KEY_VARIANTS variants a task; a bucket is a group.
    tasks = max(parallel, n * (TABLE_BITS + 1) // KEY_VARIANTS)
    return keys.mapInArrow(dealt, "bucket long, key long, node long, root long").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long")


def similar(nodes: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of the pairs whose estimated similarity is at least `least`."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("bits").alias(f"{x}_bits"), F.col("size").alias(f"{x}_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, len(_SALTS)) for i in (2, 4))
            m, n = (batch.column(i).to_numpy().astype(float) for i in (3, 5))
            share = np.bitwise_count(x ^ y).sum(1) / (64 * len(_SALTS))
            both = np.minimum(np.cos(np.pi * share) * np.sqrt(m * n), np.minimum(m, n))
            keep = pa.array(both >= least * (m + n - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    distinct = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # A node in many pairs, such as the first of a large group, is hot on either side.
    total = distinct.count()
    with_side = lambda left, x: join_hot(left, checkpointed(side(x).join(distinct.groupBy(x).agg(F.count("*").alias("pairs")), x)), x, "pairs", total)
    both = with_side(checkpointed(with_side(distinct, "a")), "b")
    return both.select("a", "b", "a_bits", "a_size", "b_bits", "b_size").mapInArrow(run, "a long, b long")


def labels(edges: DataFrame) -> DataFrame:
    """(node, root): for every node with an edge (a, b) the least node within two edges; nodes of one root are connected."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("b"), F.least("a", "m").alias("root"), "n"))
    return join_hot(both, least, "b", "n", 2 * edges.count()).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))


def similar_links(nodes: DataFrame, least: float = SIMILARITY, first_tables: int = FIRST_TABLES) -> DataFrame:
    """(a, b): links that connect the nodes (node, bits, size) as all verified pairs of all tables do: those of the first
    tables, and of the others such that join nodes of different labels."""
    early = checkpointed(similar(nodes, colliding(nodes.withColumn("root", F.lit(None).cast("long")), range(first_tables)), least))
    rooted = checkpointed(nodes.join(labels(early).filter("root < node"), "node", "left").select("node", "root", "bits"))
    return early.union(similar(nodes, colliding(rooted, range(first_tables, TABLES)), least))


def similar_rows(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, row_key, component_id and representative of every row: components of texts whose similarity is at least `least`."""
    rows = checkpointed(signatures(docs, words).withColumn("node", F.xxhash64("bits", "size")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    nodes = checkpointed(rows.groupBy("node").agg(F.min(order).alias("low"), F.count("*").alias("n"), F.min("bits").alias("bits"), F.min("size").alias("size")))
    full = nodes.filter("size > 0").select("node", "bits", "size")
    of = _lowest(nodes.select("node", "low", "n"), "node", components(similar_links(full, least)))
    of = of.select(F.col("node"), F.col("low.doc_id").alias("component_id"), F.col("low.row_key").alias("kept_key"), "n")
    return join_hot(rows.select("doc_id", "row_key", "node"), checkpointed(of), "node", "n", rows.count()).select("doc_id", "row_key", "component_id", (F.col("row_key") == F.col("kept_key")).alias("representative"))


def one_of_each(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns as they are, without those whose component has a smaller doc_id; of repeated rows one."""
    kept = similar_rows(docs, words, least).filter("representative").select("row_key").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row_key().alias("row_key"), row.alias("row")).join(kept, "row_key", "left_semi")
    return rows.dropDuplicates(["row_key"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
