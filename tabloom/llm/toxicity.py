"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

The kernel of two strings is the sum over all triples of letters that occur in order in both, each weighted by
DECAY ** (length of the stretch it spans) on either side, normalised to 1 for equal strings. A triple may be gapped, so
inserted characters and swapped-in digits or signs leave a string close to the insult it hides. Stretches are at most
SPAN + 1 characters, which bounds the work per character.

A document is cut into units: words, and runs of one-character words joined into one unit (spelled-out insults). Its
value for a landmark is the greatest kernel of its units, which keeps one insult visible in a long text. This maximum
is no kernel itself: the Nyström argument holds for units, and a document's features are the landmark values of its
units, pooled. With K the landmarks' own kernel matrix, K ** -1/2 times these values are the features of a linear SVM
with squared hinge loss; a logistic curve fitted to the margins gives the score.

Landmarks are units that stand in toxic documents beyond chance, the units of other documents that resemble these most
(so that the SVM can tell them apart), and a few common long units.

Fitting uses at most SAMPLE labelled rows of each class, the ones with the least hash of their id among texts of at
most SAMPLE_BYTES bytes, and runs on the driver (30 MB at most). Scoring reads whole texts and needs no shuffle; the
model is at most LANDMARKS short strings and as many weights. A worker keeps the kernels of the KNOWN units that it met
last, as most words of a corpus come again; a unit that isn't among them is compared with the landmarks afresh.

Defined results: null and empty texts have no unit, and get the score of a text that resembles no landmark; without
labelled rows of both classes every score is the share of positive ones, 0 if there are none; a null doc_id is held out
of fitting; repeated rows are scored alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import _BYTE_VALUE, Words, _spans, chunks, mixed

DECAY, SPAN, CLASSES = 0.7, 6, 32
SAMPLE, SAMPLE_BYTES, LANDMARKS, HARD, COMMON = 1500, 10_000, 128, 24, 4
#: Units whose kernels a worker keeps (8 bytes each, and 512 more for each that resembles a landmark).
KNOWN = 1_000_000
#: Units of a matrix product.
BLOCK = 512
#: A unit of toxic documents is a landmark if chance would make one in any sample with probability exp(-BEYOND_CHANCE).
BEYOND_CHANCE = 3.0
#: Kernels below this count as 0. One inserted letter, two gap signs or a starred letter leave an insult 0.5 or more; what chance
#: resemblance of long words is above it, the SVM weighs.
FLOOR = 0.5
#: Signs read as letters.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_GAP = CLASSES - 1
_UNIT_BASE = 0x9E6C63D0876A9A99


def _classes() -> np.ndarray:
    """Letter class of each byte; _GAP for what is only a gap. Bytes of other scripts share four classes."""
    found = np.full(256, _GAP, np.int64)
    for i in range(26):
        found[ord("a") + i] = found[ord("A") + i] = i
    for sign, letter in _SIGNS.items():
        found[ord(sign)] = ord(letter) - ord("a")
    found[128:] = 26 + np.arange(128) % 4
    return found


_CLASS = _classes()
_OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def triples(data: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(place, triple, weight) of all triples of letters; unit numbers ascend, and no triple crosses units."""
    letter = _CLASS[data].astype(np.int32)
    ok = letter != _GAP
    for a, b in _OFFSETS:
        n = len(data) - b
        if n <= 0:
            continue
        place = np.flatnonzero(ok[:n] & ok[a : a + n] & ok[b:] & (unit[:n] == unit[b:]))
        yield place, (letter[place] * CLASSES + letter[place + a]) * CLASSES + letter[place + b], DECAY ** (b + 1)


def profile(word: bytes) -> dict[int, float]:
    """Summed weight of each triple of one unit."""
    data, found = np.frombuffer(word, np.uint8), {}
    for _, codes, weight in triples(data, np.zeros(len(data), np.int8)):
        for code in codes.tolist():
            found[code] = found.get(code, 0.0) + weight
    return found


def _dot(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(v * b[k] for k, v in a.items() if k in b)


def kernel(a: bytes, b: bytes) -> float:
    x, y = profile(a), profile(b)
    norm = (_dot(x, x) * _dot(y, y)) ** 0.5
    return _dot(x, y) / norm if norm else 0.0


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without spaces, the unit of each, and each unit's row."""
    words = Words(data, offsets)
    single = words.end - words.start == 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
    new = np.ones(len(row), bool)
    new[1:] = ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))
    number = np.cumsum(new) - 1
    return data[words.inside], np.repeat(number, words.end - words.start), row[new]


def _picked(text: np.ndarray, start: np.ndarray, stop: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The bytes of some units, each byte's unit among them, and their number."""
    size = stop[which] - start[which]
    unit = np.repeat(np.arange(len(which)), size)
    inside = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    return text[start[which][unit] + inside], unit, len(which)


@dataclass
class Model:
    landmarks: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        profiles = [profile(x) for x in self.landmarks]
        self.norms = np.array([_dot(p, p) ** 0.5 for p in profiles])
        self.table = np.zeros((len({k for p in profiles for k in p}) + 1, len(profiles)), np.float32)
        self.index = np.zeros(CLASSES**3, np.int32)
        self.most = np.zeros(CLASSES**3, np.float32)
        for n, code in enumerate(sorted({k for p in profiles for k in p}), 1):
            self.index[code] = n
            self.table[n] = [p.get(code, 0.0) / m for p, m in zip(profiles, self.norms)]
            self.most[code] = self.table[n].max()

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per row and landmark: the greatest kernel of a unit, 0 below FLOOR. Equal units are compared once."""
        text, unit, row = units(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.landmarks)), np.float32)
        if not len(text) or not self.landmarks:
            return out
        start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        stop = np.append(start[1:], len(text))
        hashed = _spans(_CLASS[text].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), start, stop, _UNIT_BASE)
        distinct, one, which = np.unique(hashed, return_index=True, return_inverse=True)
        to, values = _known(self).looked_up(distinct, lambda new: self._compared(text, start, stop, one[new]))
        at = np.flatnonzero(to[which] >= 0)
        if len(at):
            # Units ascend with rows.
            first = np.flatnonzero(np.append(True, row[at[1:]] != row[at[:-1]]))
            for low in range(0, len(first), 1 << 10):
                begin = first[low : low + (1 << 10)]
                end = first[low + (1 << 10)] if low + (1 << 10) < len(first) else len(at)
                out[row[at[begin]]] = np.maximum.reduceat(values[to[which[at[begin[0] : end]]]], begin - begin[0], axis=0)
        return out

    def _compared(self, text: np.ndarray, start: np.ndarray, stop: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some units, the place in the result of each (-1 for those under FLOOR), and the kernels with all landmarks."""
        near = self._near(*_picked(text, start, stop, which)) if len(which) else which
        to = np.full(len(which), -1, np.int64)
        if not len(near):
            return to, np.zeros((0, len(self.landmarks)), np.float32)
        likely, value = self._kernels(*_picked(text, start, stop, which[near]))
        some = value.max(1) > 0
        to[near[likely[some]]] = np.arange(int(some.sum()))
        return to, value[some]

    def _near(self, text: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
        """The units that may have a kernel of FLOOR or more: the greatest weight that any landmark has for each of
        their triples, summed, reaches FLOOR times the least their norm can be."""
        letter = _CLASS[text].astype(np.int32)
        ok = letter != _GAP
        most, least = np.zeros(len(text), np.float32), np.zeros(len(text), np.float32)
        for b in range(2, SPAN + 1):
            m = len(text) - b
            if m <= 0:
                break
            ends = ok[:m] & ok[b:] & (unit[:m] == unit[b:])
            outer = letter[:m] * CLASSES**2 + letter[b:]
            count = np.zeros(m, np.float32)
            for a in range(1, b):
                whole = ends & ok[a : a + m]
                count += whole
                most[:m] += self.most[outer + letter[a : a + m] * CLASSES] * (whole * np.float32(DECAY ** (b + 1)))
            least[:m] += count * np.float32(DECAY ** (2 * b + 2))
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        most = np.add.reduceat(most, first)
        return np.flatnonzero((most > 0) & (most * 1.001 >= FLOOR * np.sqrt(np.add.reduceat(least, first))))

    def _kernels(self, text: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The units that have a kernel of FLOOR or more with some landmark, and their kernels with all."""
        raw, least = np.zeros((n, len(self.landmarks)), np.float32), np.zeros(n)
        who, what, much = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for place, code, weight in triples(text, unit):
            least += np.bincount(unit[place], minlength=n) * weight**2
            known = self.index[code]
            at = np.flatnonzero(known)
            who.append(unit[place[at]])
            what.append(known[at])
            much.append(np.full(len(at), weight, np.float32))
        who, what, much = map(np.concatenate, (who, what, much))
        order = np.argsort(who, kind="stable")
        who, what, much = who[order], what[order], much[order]
        # A dense block of units by triples, times the landmarks' table.
        block = np.arange(0, n + BLOCK, BLOCK)
        for low, a, b in zip(block, *(np.searchsorted(who, x) for x in (block, block + BLOCK))):
            if b > a:
                dense = np.bincount((who[a:b] - low) * len(self.table) + what[a:b], much[a:b], min(BLOCK, n - low) * len(self.table))
                raw[low : low + BLOCK] = dense.reshape(-1, len(self.table)).astype(np.float32) @ self.table
        # A unit's norm is at least that of its triples taken one by one; most units drop out by this bound.
        likely = np.flatnonzero((raw.max(1) > 0) & (raw.max(1) >= FLOOR * np.sqrt(least)))
        to = np.full(n, -1, np.int64)
        to[likely] = np.arange(len(likely))
        mine = to[unit] >= 0
        keys, amounts = [np.zeros(0, np.int64)], [np.zeros(0)]
        own = to[unit[mine]]
        for place, code, weight in triples(text[mine], own):
            keys.append(own[place] * CLASSES**3 + code)
            amounts.append(np.full(len(place), weight))
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(index, np.concatenate(amounts), len(distinct))
        norm = np.sqrt(np.bincount(distinct // CLASSES**3, sums**2, len(likely)))
        value = raw[likely] / np.maximum(norm, 1e-9)[:, None].astype(np.float32)
        value[value < FLOOR] = 0
        return likely, value

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias if len(self.landmarks) else np.full(len(features), self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


class _Known:
    """Kernels of the units that were met before, by the hash of a unit."""

    def __init__(self, width: int):
        self.hashes, self.to, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, width), np.float32)

    def looked_up(self, distinct: np.ndarray, compared) -> tuple[np.ndarray, np.ndarray]:
        """The place in the kernels of each of the ascending hashes, or -1, and the kernels."""
        if len(self.hashes) > KNOWN:
            self.__init__(self.values.shape[1])
        at = np.searchsorted(self.hashes, distinct)
        hit = np.append(self.hashes, np.uint64(0))[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        hit &= at < len(self.hashes)
        new = np.flatnonzero(~hit)
        if len(new):
            to, values = compared(new)
            to[to >= 0] += len(self.values)
            self.hashes, self.to = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.to, at[new], to)
            self.values = np.concatenate([self.values, values])
        return self.to[np.searchsorted(self.hashes, distinct)], self.values


_KEPT: dict[tuple, _Known] = {}


def _known(model: Model) -> _Known:
    """What this process knows of a model's units; that of other models is dropped."""
    key = tuple(model.landmarks)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = _Known(len(key))
    return _KEPT[key]


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _bare(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' letters in lower case, where each word's begin and end, its row, and its hash."""
    words = Words(data, offsets)
    text, unit = _LOWER[data[words.inside]], np.repeat(np.arange(len(words.start)), words.end - words.start)
    letter = _CLASS[text] != _GAP
    text, size = text[letter], np.bincount(unit[letter], minlength=len(words.start))
    stop = np.cumsum(size)
    return text, stop - size, stop, np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds)), _spans(_BYTE_VALUE[text], stop - size, stop, _UNIT_BASE)


def _counted(keys: np.ndarray, units_: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Distinct keys of each known unit."""
    _, one = np.unique(keys, return_index=True)
    return np.bincount(np.searchsorted(known, units_[one]), minlength=len(known))


def _landmarks(texts: list[bytes], y: np.ndarray) -> list[bytes]:
    """The units whose documents are toxic most beyond chance, HARD units of other documents that resemble these most,
    and COMMON long units of any document."""
    parts, first = [], 0
    column = pa.array(texts, pa.binary()).cast(pa.string())
    for a, b, data, offsets in chunks(column):
        _, start, stop, row, h = _bare(data, offsets)
        before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])[: len(h)]
        before[np.flatnonzero(np.diff(row, prepend=-1))] = 0
        fits = (stop - start >= 4) & (stop - start <= 16)
        # A unit counts once for each unit that stands before it, so that copies of one text count once, and at most
        # once for each document.
        parts.append((h[fits], mixed(h[fits] ^ mixed(before[fits])), mixed(h[fits] ^ mixed((row[fits] + a + 1).astype(np.uint64))), y[row[fits] + a], (stop - start)[fits]))
    unit, pair, document, label, size = (np.concatenate([p[i] for p in parts]) for i in range(5))
    if not len(unit):
        return []
    known, one = np.unique(unit, return_index=True)
    size = size[one]
    n = [np.minimum(_counted(pair[label == k], unit[label == k], known), _counted(document[label == k], unit[label == k], known)) for k in (0, 1)]
    # Chernoff's bound on how likely so many of a unit's documents would be toxic by chance, against the number of units.
    share = y.mean()
    p = n[1] / np.maximum(n[0] + n[1], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        excess = np.where(p > share, (n[0] + n[1]) * (p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0.0)), 0.0)
    toxic = np.flatnonzero(excess >= np.log(max(1, int((n[1] > 0).sum()))) + BEYOND_CHANCE)
    toxic = toxic[np.lexsort((known[toxic], -excess[toxic]))]
    clean = np.flatnonzero((n[0] > 0) & (p <= share))
    common = np.setdiff1d(np.flatnonzero(size >= 7), toxic)
    common = common[np.lexsort((known[common], -(n[0] + n[1])[common]))][: 4 * COMMON]
    word = _spelled(column, known, np.concatenate([toxic[: 2 * LANDMARKS], clean, common]))
    insults = [w for i in toxic if (w := word.get(i)) and profile(w)][: LANDMARKS - HARD - COMMON]
    found = dict.fromkeys(insults)
    if insults:
        # Clean units by resemblance times number of documents.
        near = [w for i in clean if (w := word.get(i))]
        sizes = np.cumsum([0, *map(len, near)])
        to, value = Model(insults)._compared(np.frombuffer(b"".join(near), np.uint8), sizes[:-1], sizes[1:], np.arange(len(near)))
        weight = {w: float(value[t].max()) * n[0][i] for w, t, i in zip(near, to, (i for i in clean if word.get(i))) if t >= 0}
        found |= dict.fromkeys(sorted(weight, key=lambda w: (-weight[w], w))[:HARD])
    return list(found | dict.fromkeys([w for i in common if (w := word.get(i)) and profile(w)][:COMMON]))


def _spelled(column: pa.Array, known: np.ndarray, wanted: np.ndarray) -> dict[int, bytes]:
    """Index among the known hashes to the unit's letters."""
    found: dict[int, bytes] = {}
    asked = np.zeros(len(known), bool)
    asked[wanted] = True
    for _, _, data, offsets in chunks(column):
        text, start, stop, _, h = _bare(data, offsets)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        which, one = np.unique(np.where((known[at] == h) & asked[at], at, -1), return_index=True)
        for i, k in zip(which.tolist(), one.tolist()):
            if i >= 0:
                found[i] = text[start[k] : stop[k]].tobytes()
                asked[i] = False
    return found


def fitted(texts: list[bytes], labels: list[int], ridge: float = 1.0) -> Model:
    """The model of labelled texts."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(slope=0.0, offset=30.0 if share else -30.0)
    model = Model(_landmarks(texts, y))
    if not model.landmarks:
        return Model(offset=float(np.log(y.mean() / (1 - y.mean()))))
    z = np.concatenate([model.features(data, offsets) for _, _, data, offsets in chunks(pa.array(texts, pa.binary()).cast(pa.string()))]).astype(float)
    profiles = [profile(x) for x in model.landmarks]
    gram = np.array([[_dot(p, q) for q in profiles] for p in profiles]) / np.outer(model.norms, model.norms)
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    x = np.hstack([z @ root, np.ones((len(y), 1))])
    sign, cost = 2.0 * y - 1, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3
    for _ in range(50):  # Newton steps of the squared hinge loss
        inside = sign * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        fresh = np.linalg.solve(x[inside].T @ a + penalty, a.T @ sign[inside])
        if np.allclose(fresh, w, atol=1e-8):
            break
        w = fresh
    margin = x @ w
    p = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of the logistic curve
        q = 1 / (1 + np.exp(-np.clip(p[0] * margin + p[1], -30, 30)))
        m = np.stack([margin, np.ones_like(margin)], 1)
        step = np.linalg.solve((m * (q * (1 - q) * cost)[:, None]).T @ m + 1e-3 * np.eye(2), m.T @ ((q - y) * cost) + 1e-3 * (p - [1.0, 0.0]))
        p = p - step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.landmarks, root @ w[:-1], float(w[-1]), float(p[0]), float(p[1]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from fitting: crc32 of its id as text is divisible by 5, or it has no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[bytes], list[int]]:
    """At most `size` rows of each class that may be fitted on."""
    rows = labels.filter(~held_out()).filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    short = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    # Four times as many ids as are needed, for those whose texts are missing or long; at most 8 * size rows are broadcast.
    order = F.xxhash64("doc_id")
    ids = [rows.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(4 * size) for t in (0, 1)]
    joined = short.join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(order, "doc_id", "text"))
    found = joined.select("text", "toxic", place.alias("place")).filter(F.col("place") <= size).orderBy("toxic", "place").collect()
    return [r.text.encode() for r in found], [r.toxic for r in found]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(model.features(data, offsets)) for _, _, data, offsets in chunks(batch.column(2), 3 << 20)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
