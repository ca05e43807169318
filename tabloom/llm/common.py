"""Shared pieces: word tables over Arrow buffers, rolling hashes, checkpoints, ordered id groups."""

from __future__ import annotations

import ctypes
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: U+0020 and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that numpy works on at once; its arrays take about 50 times as much.
CHUNK = 512 << 10

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_BYTE_VALUE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a single
    machine, and an error on a cluster, whose executors couldn't see it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tabloom-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@lru_cache(maxsize=1)
def _trim():
    """The C library's function that gives freed memory back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def released(table):
    """The table; what its task no longer needs goes back to the system, as workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
    return table


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    if len(cache.get(base, ())) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        cache[base] = np.cumprod(x)
    return cache[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of h[start:end] for every pair, from one prefix sum."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(base, len(h)), out=sums[1:])
    return mixed((sums[end] - sums[start]) * _powers(pow(base, -1, 1 << 64), len(h) + 1)[start] + (end - start).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, row after the last, bytes, offsets from 0): runs of rows of about `limit` bytes, one row at least."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n), data[offsets[row] : offsets[min(end, n)]], offsets[row : min(end, n) + 1] - offsets[row]
        row = min(end, n)


class Words:
    """The words of a run of rows: where each starts and ends, and at which word each row begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        inside = _WORD_BYTE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.data, self.inside = data, inside
        self.start = np.flatnonzero(inside & (~before | first[:n]))
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return _spans(_BYTE_VALUE[self.data], self.start, self.end, _BASE)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a column and the word at which each row begins."""
    hashes, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in chunks(column):
        words = Words(data, offsets)
        hashes.append(words.hashes())
        bounds.append(words.bounds[1:] + bounds[-1][-1])
    return np.concatenate(hashes), np.concatenate(bounds)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int, base: int = _WINDOW_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of `width` words that lies in one row."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
    return start, _spans(hashes, start, start + width, base)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `width` words from one of the starts."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0


#: Values of a tie, and bytes of text that a task reads of a shuffle by group, about.
TIES, TASK_BYTES = 1_000_003, 16 << 20


def tie_place(tie: str) -> Column:
    """Where a row stands among rows of equal key: first by this, then by `tie` itself."""
    return F.pmod(F.xxhash64(tie), F.lit(TIES)).cast("int")


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df with a long column that ascends as `key` does, and its name: the key itself if it is an integer, else the
    rank of the key among its distinct values (a range sort of these and a join by key)."""
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df, key
    ranged = checkpointed(df.select(F.col(key).alias("__key")).filter("__key is not null").distinct().repartitionByRange("__key").sortWithinPartitions("__key").select("__key", F.spark_partition_id().alias("__p"), (F.monotonically_increasing_id() % (1 << 33)).alias("__i")))
    # One number for each partition reaches the driver.
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
    ahead = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))])
    start = F.get(F.split(F.lit(",".join(map(str, ahead))), ",").cast("array<bigint>"), F.col("__p"))
    return df.join(ranged.select("__key", (start + F.col("__i")).alias("__rank")), F.col(key) == F.col("__key"), "left").drop("__key"), "__rank"


def id_groups(df: DataFrame, key: str, weight: Column, target: float, bins: int = 4096, tie: str | None = None) -> Column:
    """The first of `groups`, for a target that is given."""
    return groups(df, key, weight, target, target, bins, tie)[0]


def groups(df: DataFrame, key: str, weight: Column, most: float, least: float = 1 << 20, bins: int = 4096, tie: str | None = None) -> tuple[Column, int]:
    """A long column that deals rows into groups of at most about `most` weight, ascending as the integer `key` does, and
    a number of partitions that gives each task about TASK_BYTES of weight.

    Two aggregates reach the driver, one row and at most `bins` rows, whatever the input: the weights of equal ranges of
    the key. Light neighbours share a group; heavy ranges are cut again, by key and, where the key can't be cut any
    further, by the place of `tie`. Rows with a null key come last, dealt by the place of `tie`.
    """
    parallel = df.sparkSession.sparkContext.defaultParallelism
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(weight.cast("double")).alias("total")).first()
    total = span.total or 1.0
    target = min(most, max(least, total / (4 * parallel)))
    place_of_tie = tie_place(tie or key).cast("double") / F.lit(float(TIES))
    lo, hi = (0, 0) if span.lo is None else (int(span.lo), int(span.hi))
    width = max(1, -(-(hi - lo + 1) // bins))
    # Differences of longs need 20 digits; what is left within a range fits a long, and its share of the range a double.
    above = F.col(key).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")
    place = F.try_divide(above - F.pmod(above, F.lit(width)), F.lit(width)).cast("int")
    loads = {r.at: float(r.load or 0) for r in df.groupBy(place.alias("at")).agg(F.sum(weight.cast("double")).alias("load")).collect()}
    base, cuts, salts, group, filled = [], [], [], 0, 0.0
    for at in range(bins):
        load = loads.get(at, 0.0)
        if filled and filled + load > target:
            group, filled = group + 1, 0.0
        pieces = max(1, round(load / target)) if load > 1.5 * target else 1
        base.append(group)
        cuts.append(min(pieces, width))
        salts.append(max(1, round(pieces / width)))
        filled += load
        if pieces > 1:
            group, filled = group + cuts[-1] * salts[-1], 0.0
    last = group + 1
    nulls = max(1, round(loads.get(None, 0.0) / target))
    # One literal each, folded to an array by the optimizer.
    table = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    share = F.pmod(above, F.lit(width)).cast("long").cast("double") / F.lit(float(width))
    within = F.least(F.floor(share * F.get(table(cuts), place)).cast("long"), F.get(table(cuts), place) - 1)
    salt = lambda n: F.floor(place_of_tie * n).cast("long")
    own = F.get(table(base), place) + within * F.get(table(salts), place) + salt(F.get(table(salts), place))
    return F.when(F.col(key).isNull(), F.lit(last) + salt(F.lit(nulls))).otherwise(own).cast("long"), max(parallel, int(total // TASK_BYTES))


#: Keys with more rows than this share of all rows, or this many, are hot: at most HOT_KEYS of them.
HOT_KEYS, HOT_ROWS = 100_000, 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str, members: str, total: int) -> DataFrame:
    """left joined with right (one row per key; column `members` counts the key's rows in left) such that no task holds a
    hot key: hot keys' rows, at most HOT_KEYS of them, are broadcast, the others are shuffled. `left` is read twice."""
    hot = F.col(members) > max(HOT_ROWS, total // HOT_KEYS)
    heavy, light = right.filter(hot).drop(members), right.filter(~hot).drop(members)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return left.join(F.broadcast(heavy), key).unionByName(rest)
