"""Each operator against brute force on small tables with null, empty, long, tied and repeated rows."""

import base64
import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import alike
from pyspark.sql import functions as F

from tabloom.llm import licenses, mixing, packing, quality, queries, simhash, substrings, toxicity, urls, warc, winnowing
from tabloom.llm.common import id_groups

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp long, bucket string, fp int, row string, size string"


def words(text):
    return WORD.findall(text or "")


def documents():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = prose(45)
    texts = [None, "", " \n\t ", "one", "two words", "a b c d", "x " * 300, "# $ % & | < > *", "Ünïcode   nbsp em"]
    texts += [prose(rng.randint(1, 120)) for _ in range(25)]
    texts += [prose(20) + " " + shared + "\n" + prose(9) for _ in range(4)] + [shared, shared]
    long = prose(5000)
    texts += [long, long[: len(long) // 2] + " changed " + long[len(long) // 2 :], long, long + " end"]
    texts += ["line one\nline one\nline two\n\nline one\n" + prose(30), "Released under the MIT License.\n" + prose(30)]
    rows = [(i * 3 + 1, t, "en", ["s1", "s2", "s3", None][i % 4] if i % 3 else "s1", len(t or ""), 1, "b", 2, "r", "z") for i, t in enumerate(texts)]
    rows += [(None, long, "en", "s2", 1, 1, "b", 2, "r", "z"), (None, None, "en", None, 0, 1, "b", 2, "r", "z"), rows[12], rows[40]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    order, expected = duck(queries.oracle_sql()[name], SF)
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == order
    assert alike(found.select(*order).collect()) == alike(expected)


def test_every_operator_takes_an_empty_table(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert packing.packed(empty, queries.tokenizer_path()).count() == 0
    assert quality.judged(empty).count() == quality.kept_documents(empty).count() == quality.ablations(quality.ledger(empty)).count() == 0
    assert licenses.scanned(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == simhash.one_of_each(empty).count() == 0
    assert mixing.mixture(empty).count() == mixing.mixed_documents(empty).count() == 0
    assert substrings.removal_digests(empty).count() == substrings.trimmed_documents(empty).count() == 0
    assert toxicity.scored(empty, toxicity.fitted(*toxicity.sample(empty, spark.createDataFrame([], "doc_id long, toxic int")))).count() == 0
    assert warc.round_trip(pages).count() == 0
    assert winnowing.edited_comparison(empty).count() == 0
    assert urls.judged(pages, urls.rule_table(spark, queries.URL_RULES)).count() == 0


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(queries.tokenizer_path())
    expected = Counter((i, tuple(slow.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, *_ in documents())
    pieces = packing.packed(docs, queries.tokenizer_path()).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 for p in pieces)
    for p in pieces:
        assert p.length == len(p.ids) == 2**p.bucket <= 2048
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *p.ids))
    whole, at = Counter(), {}
    for p in sorted(pieces, key=lambda p: p.sequence_id):  # pieces of one document follow each other
        ids = at.pop(p.doc_id, ()) if p.start else ()
        assert len(ids) == p.start
        ids += tuple(p.ids)
        if len(ids) == p.doc_tokens:
            whole[(p.doc_id, ids)] += 1
        else:
            at[p.doc_id] = ids
    assert not at and whole == expected


def test_packing_added_tokens_and_lengths():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "plain", "é" * 50, "  \n\n x"]
    slow = Tokenizer.from_file(queries.tokenizer_path())
    assert packing.encoder(queries.tokenizer_path())(texts) == [slow.encode(t, add_special_tokens=False).ids for t in texts]
    for n in (0, 1, 2, 3, 2047, 2048, 2049, 10_000):
        assert sum(packing.lengths(n)) == n and all(x & (x - 1) == 0 for x in packing.lengths(n))


def test_packing_very_long_runs_of_white_space(spark):
    from tokenizers import Tokenizer

    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", ("word " + " \t" * 60_000) * 3, " " * 100_000 + "x"]
    slow = Tokenizer.from_file(queries.tokenizer_path())
    assert packing.encoder(queries.tokenizer_path())(texts) == [slow.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame([(1, texts[0]), (2, "plain")], "doc_id long, text string")
    assert {r.doc_id for r in packing.packed(docs, queries.tokenizer_path()).collect()} == {1, 2}


def quality_by_hand(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_policies(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    expected = [(i, *quality_by_hand(t)) for i, t, *_ in documents()]
    judged = quality.judged(docs)
    assert alike(collected(judged, "doc_id", *names)) == alike(expected)
    for r in judged.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.kept_documents(docs)
    assert kept.schema.names == docs.schema.names and kept.count() == judged.filter("kept").count()


def test_quality_ablations(docs):
    stored = quality.ledger(docs)
    bits = [r.failed for r in stored.collect()]
    names = [r.name for r in quality.rules()]
    for r in quality.ablations(stored).collect():
        bit = 1 << names.index(r.rule)
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(1 for b in bits if b & bit), bits.count(bit), sum(1 for b in bits if not b & ~bit))


def test_licenses_dice():
    matcher = licenses.Matcher()
    for text in ("Released under the MIT license", "x released under the MIT License y", "nothing here", licenses.TEMPLATES["MIT-text"].replace("without limitation", "")):
        pairs = licenses.bigrams(text.encode())
        dice = {n: 2 * len(pairs & licenses.bigrams(t.encode())) / (len(pairs) + len(licenses.bigrams(t.encode()))) for n, t in licenses.TEMPLATES.items()}
        top = max(dice.values())
        assert matcher.best(text.encode()) == (None if top < licenses.THRESHOLD else (top, min(n for n in dice if dice[n] == top)))
    assert matcher.scan(b"") == (None, 0.0, 0)


def test_licenses_amid_other_words():
    matcher = licenses.Matcher()
    mit, rng = licenses.TEMPLATES["MIT-text"], random.Random(5)
    wrapped = "Some words first and\nmore, then " + mit.replace(" ", "\n", 40) + " and then\nthe text goes on."
    for text, name in (("This project is released under the MIT License", "MIT"), ("Released under the MIT License. See LICENSE for details", "MIT"), ("This file is part of Foo and is licensed under the Apache License, Version 2.0", "Apache-2.0"), ("a b Released under\nthe MIT\n\nLicense c d", "MIT"), (wrapped, "MIT-text")):
        assert matcher.scan(text.encode())[:2] == (name, 1.0)
    vocabulary = [*set(" ".join(licenses.TEMPLATES[n] for n in ("MIT", "Apache-2.0", "CC-BY-SA-4.0")).split()), "foo", "bar"]
    for _ in range(300):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)) + rng.choice(["released under the MIT License", "Licensed under CC x BY-SA 4.0", "Licensed under the the Apache License License Version 2.0"]).split()[rng.randint(0, 2) :] + rng.choices(vocabulary, k=rng.randint(0, 6)))
        w = licenses._OTHER.sub(b" ", text.lower().encode()).split()
        runs = [set(zip(w[i:j], w[i + 1 : j])) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
        dice = [(-2 * len(r & b) / (len(r) + len(b)), n) for r in runs for n, x in licenses.TEMPLATES.items() for b in [licenses.bigrams(x.encode())]]
        low = min(dice)
        assert matcher.scan(text.encode())[:2] == ((low[1], -low[0]) if -low[0] >= licenses.THRESHOLD else (None, 0.0))


def fingerprint_by_hand(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(x, low.get(find(i), x))
    return [low.get(find(i)) for i in range(len(ids))]


def test_simhash_components(docs):
    rows = documents()
    prints = [fingerprint_by_hand(r[1]) for r in rows]
    expected = list(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], components_by_hand([r[0] for r in rows], prints)))
    assert alike(collected(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")) == alike(expected)


def shingles_by_hand(text, n=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups_by_hand(texts, least):
    """The number of each text's group, over pairs whose exact similarity is at least `least`."""
    sets, root = [shingles_by_hand(t) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x == sets[j] or both and both >= least * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def one_of_each_group(ids, texts, kept):
    """Whether the kept ids are one of each group of similar texts; similarities within 0.08 of 0.8 may go either way."""
    loose, tight = groups_by_hand(texts, 0.72), groups_by_hand(texts, 0.88)
    of = {}
    for i, a, b in zip(ids, loose, tight):
        of.setdefault(a, {}).setdefault(b, []).append(i)
    known = lambda xs: min((x for x in xs if x is not None), default=None)
    for groups in of.values():
        firsts = Counter(known(xs) for xs in groups.values())
        stay = Counter(i for i in kept if i in {x for xs in groups.values() for x in xs})
        assert set(stay) <= set(firsts) and known(x for xs in groups.values() for x in xs) in stay
    return True


def test_similar_texts_keep_one_of_each(docs):
    rows = documents()
    kept = simhash.one_of_each(docs)
    assert kept.schema.names == docs.schema.names
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and one_of_each_group([r[0] for r in rows], [r[1] for r in rows], ids)


def test_similar_texts_are_linked(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        for _ in range(rng.choice((1, 2, 6, 40))):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 90))):  # up to about 0.9
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(simhash, "KEY_VARIANTS", 5_000)  # several tasks, and buckets in several parts
    got = dict(collected(simhash.similar_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "component_id"))
    found, of = groups_by_hand([t for _, t in rows], 0.86), {}
    for (i, _), g in zip(rows, found):
        of.setdefault(g, set()).add(got[i])
    assert all(len(x) == 1 for x in of.values()) and len({got[i] for i, _ in rows}) >= 12


def test_similar_links_are_those_of_one_pass(spark):
    rng = np.random.default_rng(13)
    prints = [rng.integers(0, 256, simhash.TABLES * simhash.TABLE_BITS // 8, dtype=np.uint8) for _ in range(20)]
    for _ in range(300):  # chains and groups in which many bits of the 768 differ
        x = np.unpackbits(prints[rng.integers(0, len(prints))])
        x[rng.choice(len(x), rng.integers(1, 90), replace=False)] ^= 1
        prints.append(np.packbits(x))
    ids = rng.permutation(len(prints)).tolist()
    nodes = spark.createDataFrame([(i, bytearray(p.tobytes()), 200) for i, p in zip(ids, prints)], "node long, bits binary, size long").repartition(3)
    of = {n: dict(collected(simhash.components(simhash.similar_links(nodes, first_tables=n)), "node", "root")) for n in (0, simhash.FIRST_TABLES, simhash.TABLES)}
    assert of[0] == of[simhash.FIRST_TABLES] == of[simhash.TABLES] and len(of[0]) > 100
    rooted = nodes.withColumn("root", F.lit(7).cast("long"))
    assert simhash.colliding(rooted).count() == 0 < simhash.colliding(nodes.withColumn("root", F.lit(None).cast("long"))).count()


def test_signature_bits_are_majorities():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 40_000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        got = np.unpackbits(simhash.signature(h).view(np.uint8), bitorder="little")
        each = np.concatenate([np.unpackbits(simhash.mixed(h ^ s).view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little") for s in simhash._SALTS], axis=1) if len(h) else np.zeros((0, len(got)))
        assert (got == (2 * each.sum(0, dtype=np.int64) > len(h))).all()


def test_simhash_keeps_other_texts_of_one_id(spark):
    texts = ["one clean text about rivers and hills", "quite another text that tells of ships at sea"]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (9, texts[1]), (None, texts[0])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in kept.collect()) == [(7, t) for t in texts]


def test_simhash_links_no_more_no_less(spark, monkeypatch):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # chains and a tight group, with every distance up to 6
        prints.append(rng.choice(prints[:60]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a in range(14) for b in range(a)]
    prints = sorted(set(prints))
    monkeypatch.setattr(simhash, "VARIANTS", 20_000)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = dict(collected(simhash.components(simhash.links(df)), "node", "root"))
    assert [roots.get(p, p) for p in signed] == components_by_hand(signed, prints)


def test_mixing_targets_and_budgets(docs):
    rows = mixing.mixture(docs).collect()
    size = Counter()
    for r in rows:
        size[r.source] += r.size
    total, order = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)
    out = mixing.mixed_documents(docs)
    assert out.schema.names == docs.schema.names
    assert sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())


def removal_by_hand(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    seen, found = set(), []
    for i in order:
        w = words(rows[i][1])
        gone = set()
        for p in range(len(w) - 19):
            x = tuple(w[p : p + 20])
            if x in seen:
                gone.update(range(p, p + 20))
            seen.add(x)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        found.append((rows[i][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return found


def test_substring_removal(docs):
    assert alike(collected(substrings.removal_digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")) == alike(removal_by_hand([r for r in documents() if r[0] is not None] + [r for r in documents() if r[0] is None]))
    out = substrings.trimmed_documents(docs)
    assert out.schema.names == docs.schema.names
    assert all(r.n_removed == sum(s.n for s in r.spans) for r in substrings.without_repeats(docs).collect())


def test_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(*toxicity.sample(docs, labels))
    rows = toxicity.scored(docs, model).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in rows if r.toxic == t] for t in (0, 1))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9 and np.mean([r.predicted == r.toxic for r in rows]) > 0.85
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_toxicity_kernel_tolerates_gaps(docs):
    def slow(a, b):
        def spread(w):
            found = Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN + 1)):
                        if w[i].isalpha() and w[j].isalpha() and w[k].isalpha():
                            found[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
            return found

        x, y = spread(a), spread(b)
        dot = lambda p, q: sum(p[c] * q[c] for c in p)
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    for other in ("idiot", "idiiot", "i.d.i.o.t", "idiots", "patriot"):
        assert toxicity.kernel(b"idiot", other.encode()) == pytest.approx(slow("idiot", other))
    assert toxicity.kernel(b"idiot", b"1d10t") == pytest.approx(1) and toxicity.kernel(b"idiot", b"") == 0
    model = toxicity.Model([b"idiot", b"clown"], np.ones(2), -0.5, 1.0)
    texts = ["such an i d i o t here", "1d.iot!", "the clown", "quite ordinary prose", "", "i.d.i.o.t " * 3]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = model.features(data, np.cumsum([0, *map(len, texts)]))
    assert (got[[0, 1, 5], 0] > toxicity.FLOOR).all() and got[2, 1] == pytest.approx(1) and not got[3:5].any()
    assert toxicity.fitted([b"a"], [1]).scores(np.zeros((1, 0)))[0] > 0.99 and toxicity.fitted([], []).scores(np.zeros((1, 0)))[0] < 0.01
    assert toxicity.scored(docs, model).count() == len(documents())


def test_toxicity_features_equal_the_kernel(monkeypatch):
    rng = random.Random(11)
    landmarks = [b"idiot", b"worthless", b"chllach", b"trash", "vequté".encode()]
    model = toxicity.Model(landmarks, np.ones(len(landmarks)), 0.0, 1.0)

    def unit():
        w = rng.choice(landmarks).decode()
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(w))
            w = rng.choice((w[:at] + rng.choice("abest.*1!é") + w[at:], w[:at] + w[at + 1 :], w[:at] + w[at : at + 2][::-1] + w[at + 2 :]))
        return w or "x"

    texts = [" ".join(unit() + "yz" for _ in range(rng.randint(0, 4))) for _ in range(400)]
    expected = np.array([[max((toxicity.kernel(x, u.encode()) for u in t.split()), default=0.0) for x in landmarks] for t in texts])
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for known in (toxicity.KNOWN, toxicity.KNOWN, 0):  # fresh, from what is known, forgotten
        monkeypatch.setattr(toxicity, "KNOWN", known)
        got = model.features(data, offsets)
        sure = np.abs(expected - toxicity.FLOOR) > 1e-4
        assert np.allclose(got[sure], np.where(expected < toxicity.FLOOR, 0, expected)[sure], atol=1e-4)


def test_toxicity_sees_insults_with_inserted_characters():
    hidden = {"trash": "traxsh", "loser": "loxser", "idiot": "idxiot", "stupid": "stuxpid s..t..u..p..i..d stup*d youstupid", "scum": "scxum", "pathetic": "p..a..t..h..e..t..i..c"}
    pairs = [(i, w) for i, ws in hidden.items() for w in ws.split()]
    model = toxicity.Model([i.encode() for i in hidden], np.ones(len(hidden)), -0.4, 10.0)
    texts = [f"we met at the market, you {w} there" for _, w in pairs] + ["we met at the market, you there"]
    got = model.features(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    for n, (i, w) in enumerate(pairs):
        assert got[n, list(hidden).index(i)] == pytest.approx(toxicity.kernel(i.encode(), w.encode()), abs=1e-4) and got[n].max() > 0.5
    assert not got[-1].any() and (model.scores(got)[:-1] > 0.5).all()


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "", None, "<p>é</p>", "b" * 70_000, "c\r\n\r\nWARC/1.1\r\n", "<p>é</p>"]
    rows = [(9 - i if i != 5 else None, f"http://x.example/{i} ü" if i else None, h, i) for i, h in enumerate(html)] + [(9, None, "<p>é</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard long").repartition(2)
    folders = [f"file://{tmp_path}/{n}" for n in "ab"]
    manifests = [warc.write(pages, folder, roll_bytes=1500) for folder in folders]
    files = [{p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab"]
    assert files[0] == files[1] and len(files[0]) > 1 and (tmp_path / "a" / "_SUCCESS").exists() and not (tmp_path / "a" / "_temporary").exists()
    for r in manifests[0].collect():
        data = files[0][r["name"]]
        assert (r.bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest()) and gzip.decompress(data).count(b"WARC-Record-ID") == r.records + 1
    low = {}
    for page, _, h, _ in rows:
        if page is not None:
            low[h or ""] = min(page, low.get(h or "", page))
    expected = []
    for page, _, h, _ in rows:
        data, first = (h or "").encode(), low.get(h or "")
        revisit = first is not None and page != first
        expected.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    back = warc.read(spark, folders[0], manifests[0])
    assert alike(collected(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == alike(expected)
    payloads = {r.page_id: bytes(r.payload) for r in back.filter("record_type = 'response'").collect()}
    assert payloads[5] == b"b" * 70_000 and payloads[None] == html[5].encode()


def xx(x, seed=42):
    return xxhash.xxh64_intdigest(x, seed)


def char_hashes_by_hand(text):
    """Odd hashes of the least runs of 5 characters of texts that are short or have long words."""
    if not text or len(text) > 256 and len(text) <= 32 * len(words(text)):
        return set()
    grams = []
    for i in range(max(1, len(text) - 4)):
        h = xx(b"c")
        for c in text[i : i + 5]:
            h = xx(c.encode(), h)
        grams.append((h - (1 << 64) if h >> 63 else h) >> 24)
    return {2 * min(grams[i : i + 8]) + 1 for i in range(max(1, len(grams) - 7))}


def winnow_by_hand(text):
    w = [xx(x.encode()) for x in words(text)]
    pack = lambda h: struct.pack("<Q", h)
    if not w:
        return []
    if len(w) < 3:
        h = 42
        for x in w:
            h = xx(pack(x), h)
        grams = [h]
    else:
        pair = lambda a, b: xx(pack(b), xx(pack(a)))
        grams = [pair(pair(w[i], w[i + 1]), w[i + 2]) for i in range(len(w) - 2)]
    signed = [(g - (1 << 64) if g >> 63 else g) >> 24 for g in grams]
    picks = []
    for i in range(max(1, len(signed) - 7)):
        window = signed[i : i + 8]
        at = i + max(j for j, x in enumerate(window) if x == min(window))
        if (signed[at], at) not in picks:
            picks.append((signed[at], at))
    return picks


def test_winnowing(spark, docs):
    rows = winnowing.fingerprinted(docs).select("doc_id", "text", "kept", winnowing.positions("kept").alias("at"), "hashes", "fingerprint").collect()
    for r in rows:
        expected = winnow_by_hand(r.text)
        assert [(k >> 24, p) for k, p in zip(r.kept, r.at)] == expected
        assert set(r.hashes) == {2 * h for h, _ in expected} | char_hashes_by_hand(r.text) and len(r.hashes) == len(set(r.hashes))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.fingerprint) == r.fingerprint


def test_winnowing_next_and_edited(spark):
    rows = [r[:2] for r in documents() if r[0] is not None and len(r[1] or "") < 5000]
    rows = sorted({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in winnowing.edited_comparison(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)

    def alike_(a, b):
        x, y = ({2 * h for h, _ in winnow_by_hand(t)} | char_hashes_by_hand(t) for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0

    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike_(t, edited)) and r.near_next == pytest.approx(alike_(t, following))


def test_winnowing_sees_what_short_texts_share(spark):
    rows = [(1, "one two three four five six"), (2, "東京都は日本の首都である" * 40), (3, "x"), (4, "seven eight nine ten eleven")]
    got = {r.doc_id: r for r in winnowing.edited_comparison(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_edited > 0.2 and got[2].near_edited > 0.4 and got[4].near_edited > 0.2 and got[3].near_edited == 1.0 and got[1].near_next == 0


@pytest.mark.parametrize("kind", ["string", "date"])
def test_ids_of_other_types(spark, kind):
    import datetime

    day = datetime.date(2020, 1, 1)
    made = lambda i: f"doc-{i}" if kind == "string" else day + datetime.timedelta(i)
    numbers = [r for r in documents() if r[0] is not None and len(r[1] or "") < 5000][:-2]
    rows = [(made(r[0]), r[1]) for r in numbers]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    assert alike(collected(substrings.removal_digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")) == alike(removal_by_hand(rows))
    ordered = sorted(rows, key=lambda r: r[0])
    got = {r.doc_id: r for r in winnowing.edited_comparison(docs).collect()}
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        t = t or ""
        edited = t[: len(t) - len(t) // 4] + (following or "")[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    pages = docs.selectExpr("doc_id AS page_id", "'http://x/' AS url", "text AS html")
    low = {}
    for i, t in rows:
        low[t or ""] = min(i, low.get(t or "", i))
    back = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(back) == len(rows) and all(back[i].refers_to == (None if low[t or ""] == i else low[t or ""]) for i, t in rows)


def test_many_texts_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 3000)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = " ".join(rng.choices(vocabulary, k=30))
    rows = [(i, f"e{n} " + " ".join(rng.choices(vocabulary, k=10)) + " " + shared) for i in (7, None) for n in range(60)]
    from tabloom.llm.common import TIES

    def place(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return (h - (1 << 64) if h >> 63 else h) % TIES

    ordered = sorted(rows, key=lambda r: (r[0] is None, place(r[1]), r[1]))
    expected = [(i, len(words(t)), 0 if n == 0 else 30, None) for n, (i, t) in enumerate(ordered)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    whole = [r.text.split()[0] for r in got if r.n_removed == 0]
    assert whole == [ordered[0][1].split()[0]] and sum(r.n_removed >= 30 for r in got) == len(expected) - 1


def test_warc_commit_can_be_repeated(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, "x" * i) for i in range(20)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages, folder)
    names = sorted(p.name for p in (tmp_path / "a").glob("*.warc.gz"))
    (tmp_path / "a" / "_SUCCESS").unlink()
    (tmp_path / "a" / "_temporary").mkdir()
    row = manifest.first()
    (tmp_path / "a" / row["name"]).rename(tmp_path / "a" / "_temporary" / row["temporary"])  # a crash before this file was named
    again = warc.commit(spark, folder)
    assert sorted(p.name for p in (tmp_path / "a").glob("*.warc.gz")) == names and (tmp_path / "a" / "_SUCCESS").exists()
    assert warc.read(spark, folder, again).count() == 20


def test_url_rules(spark):
    cases = ["http://WWW.Example.com/en/x?q", "http://example.com/en/", "http://a.b.example.com/fr/", "https://x.net/es/a#f", "http://net/fr/", "http://x.net", "http://xnet/es/", "nothing", None, "http://", "http://example.com/EN/", "ftp://u@h.net:80/es/", "http://x.net/es/a"]
    rules = [*queries.URL_RULES, ("x.net", "/es/a", "allow"), ("x.net", "/es/a", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(cases)] + [(0, cases[0], "h", "r")], "page_id long, url string, host string, rule string")
    for r in urls.judged(pages, urls.rule_table(spark, rules)).collect():
        url = cases[r.page_id] or ""
        rest = url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "allow")


def test_id_groups_ascend_and_hold_their_target(spark):
    rng = random.Random(1)
    ids = sorted(rng.choices(range(10**12), k=300)) + [5] * 200 + list(range(10**6, 10**6 + 500))
    df = spark.createDataFrame([(i, str(n)) for n, i in enumerate(ids)] + [(None, str(n)) for n in range(100)], "id long, t string")

    rows = df.select("id", id_groups(df, "id", F.lit(1), 50, bins=16, tie="t").alias("g")).collect()
    known = sorted((r.id, r.g) for r in rows if r.id is not None)
    assert all(a[1] <= b[1] for a, b in zip(known, known[1:]) if a[0] < b[0])
    assert min(r.g for r in rows if r.id is None) > known[-1][1]
    assert len({r.g for r in rows if r.id is None}) > 1


def test_pipeline_stage_by_stage(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == docs.columns
        found = [tuple(r) for r in out.collect()]
        if name == "quality_rules":
            assert {r[0] for r in found} <= {r[0] for r in rows if not (lambda q: q[0] < 20 or 100 * q[4] > 30 * q[0])(quality_by_hand(r[1]))}
            assert set(found) <= set(rows) and len(found) > 0.6 * len(rows)
        elif name == "simhash_near_dedup":
            assert one_of_each_group([r[0] for r in rows], [r[1] for r in rows], [r[0] for r in found]) and set(found) <= set(rows)
        elif name == "substring_dedup":
            got = {r[0]: (len(words(r[1])), hashlib.sha256(" ".join(words(r[1])).encode()).hexdigest()) for r in found}
            assert got == {i: (n - m, s) for i, n, m, s in removal_by_hand(rows)}
        elif name == "mixing":
            assert {r[0] for r in found} <= {r[0] for r in rows} and max(Counter(r[0] for r in found).values()) <= 3
            total = sum(len(words(r[1])) for r in rows)
            assert total - 20 <= sum(len(words(r[1])) for r in found) <= total
        else:
            assert sum(r.doc_tokens for r in out.filter("start = 0").collect()) == sum(r.length for r in out.collect())
            assert out.filter("start = 0").count() == len(rows)
        docs, rows = out, found
