"""Each operator against a plain version on documents with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.data import frame, rows
from vectrill.llm import bpe, fingerprints, language_id, licenses, lm_scoring, ngram_join, packing, quality_rules, toxicity, warc
from vectrill.llm import _common as common

TEXTS = {r[0]: r[1] or "" for r in rows()}
A_TO_Z = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


# 1 -----------------------------------------------------------------------------------------


def test_language_id(docs, nothing):
    profiles = language_id.learn(docs.where("doc_id < 20"))
    got = language_id.predict(docs, profiles)
    assert got.count() == docs.count() and "score" in got.columns and got.columns.count("score") == 1
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert all(pred[i][0] == ("en" if i % 2 else "fr") for i in range(20, 30))
    assert pred[100] == pred[101] == pred[102] == ("und", 0.0) and all(0 <= s <= 1 for _, s in pred.values())
    assert {r.lang_pred for r in language_id.predict(docs, language_id.learn(nothing)).collect()} == {"und"}
    assert language_id.predict(nothing, profiles).count() == 0


def test_out_of_place_by_hand():
    text = "the theme"
    grams = Counter()
    padded = f" {text} "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and (n < 3 or g[1] != " ") and g != " ":
                grams[g] += 1
    keys, counts = language_id.count_keys(language_id.gram_keys(language_id.folded(text)))
    assert sorted(counts.tolist()) == sorted(grams.values()) and len(keys) == len(grams)


# 2 -----------------------------------------------------------------------------------------


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate(A_TO_Z)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_links(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    return {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}


@pytest.mark.parametrize("block", [512, 2])
def test_ngram_join(docs, nothing, block):
    texts = {i: t for i, t in TEXTS.items() if i not in (7, 107)}
    pairs = brute_links(texts)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs.where("doc_id not in (7, 107)"), block=block).collect()}
    assert {i: got[i].n_links for i in texts} == {i: sum(a == i for a, _ in pairs) for i in texts}
    assert got[104].class_id == got[105].class_id == got[106].class_id == 3 and got[104].rep_id == 3 and got[106].rep_id == 106
    assert got[100].class_id == 100 and got[101].class_id == 101
    assert ngram_join.near_duplicates(nothing, block=block).count() == 0


def test_many_near_copies(spark):
    """A large class in small blocks: every member linked to every other, without pairs as rows."""
    words = [f"w{i}" for i in range(200)]
    texts = {i: " ".join([*words[: 190], f"x{i}", *words[190:]]) for i in range(40)}
    got = ngram_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=7).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {39}


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {104, 105, 106}.isdisjoint(ids) and {3, 7, 100, 101} <= set(ids) and kept.columns == docs.columns


def test_ids_of_any_kind(spark):
    """Null ids, one id with two unlike texts, and text ids: links go by row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows_ = [("1", a), ("1", b), ("2", a), ("3", b + " end"), (None, c), (None, None), ("4", ""), ("1", a)]
    df = spark.createDataFrame(rows_, "doc_id string, text string")
    got = sorted((r.doc_id or "-", r.class_id or "-", r.rep_id or "-", r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert got == [("-", "-", "-", 0), ("-", "-", "-", 0), ("1", "1", "1", 1), ("1", "1", "1", 2), ("1", "1", "1", 2), ("2", "1", "1", 2), ("3", "1", "3", 1), ("4", "4", "4", 0)]
    kept = sorted((r.doc_id or "-", r.text or "") for r in ngram_join.one_of_each(df).collect())
    assert kept == sorted([("-", ""), ("-", c), ("1", a), ("1", b), ("4", "")])
    numbers = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    spans = licenses.scan(spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "apache license"), (1, "x")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_base) for r in licenses.digest(spans).collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert sorted(r.text for r in ngram_join.one_of_each(numbers).collect()) == [a, b]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | dict.fromkeys(range(20, 26), 20)


def test_trie_links(spark):
    """For each prefix length the links connect just the keys that share a prefix, also across tasks."""
    rng = random.Random(3)
    labels = {k: [bytes([t, *(x for _ in range(4) for x in (0, rng.randrange(3)))]) for t in range(2)] for k in range(300)}
    df = spark.createDataFrame([(k, x) for k, v in labels.items() for x in v], "key long, label binary").repartition(5)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        links = ngram_join.trie_links(df, 2, 4).collect()
    finally:
        spark.conf.unset(name)
    for depth in (2, 3, 4):
        nodes = {}
        for k, v in labels.items():
            for x in v:
                nodes.setdefault(x[: 1 + 2 * depth], []).append(k)
        want = [(x[0], y) for x in nodes.values() for y in x]
        got = [(r.a, r.b) for r in links if r.depth >= depth]
        assert all(any(labels[a][t][: 1 + 2 * depth] == labels[b][t][: 1 + 2 * depth] for t in range(2)) for a, b in got)
        assert (ngram_join.forest(300, np.array(got)) == ngram_join.forest(300, np.array(want))).all()


@pytest.mark.parametrize(("changes", "levels"), [(1, 1), (2, 2)])
def test_prefixes_shorten_as_far_as_needed(spark, monkeypatch, changes, levels):
    """Pairs of similarity 0.90 need whole labels only; pairs of 0.81 need shorter prefixes. Recall is measured by brute force."""
    rng, texts, calls = random.Random(11), {}, []
    for i in range(150):
        words = [f"v{rng.randrange(5000)}" for _ in range(100)]
        texts[2 * i] = " ".join(words)
        for at in (30, 60)[:changes]:
            words[at] = f"new{i}"
        texts[2 * i + 1] = " ".join(words)
    inner = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda *a: calls.append(1) or inner(*a))
    got = ngram_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    pairs = brute_links(texts)
    assert len(pairs) >= 300 and sum(r.n_links for r in got) >= 0.99 * len(pairs) and len(calls) == levels
    assert all(r.class_id == r.doc_id // 2 * 2 for r in got if r.n_links)


def test_forest_depth():
    depth = ngram_join.forest_depth(24, 0.8, 0.999, 10)
    assert 1 - (1 - 0.8**depth) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 24


# 3 -----------------------------------------------------------------------------------------


def test_lm_scoring(docs, nothing):
    got = {r.doc_id: r for r in lm_scoring.score(docs, F.col("doc_id") % 3 != 0, table_bits=14, common_parts=20).collect()}
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None]
    c = Counter(w for r in rows() if r[0] % 3 for w in tok(r[1] or ""))
    n, v = sum(c.values()), len(c)
    for i, text in TEXTS.items():
        w, r = tok(text), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r.score < 0 and (r.bits_per_byte is None) == (not text)
    normal = [r.bits_per_byte for i, r in got.items() if i < 30 and i % 3 == 0]
    assert max(normal) < got[111].bits_per_byte
    assert lm_scoring.score(nothing, F.lit(True), table_bits=14).count() == 0


def test_model_is_a_distribution():
    """The probabilities of a byte and of the end, given what came before, add up to one."""
    counts = np.random.default_rng(1).random((2, len(lm_scoring.ORDERS), 1 << 10)).astype(np.float32) * 9
    weights = lm_scoring.start_weights()
    one = pa.array([b"Wab" + bytes([x]) for x in range(256)] + [b"Wab"], pa.binary())
    refine = np.random.default_rng(2).normal(0, 2, lm_scoring._MAPS * lm_scoring._STEPS)
    p = 10 ** lm_scoring.log10_probability(one, counts, weights, 10, refine=refine)
    inner = pa.array([b"Wab" + bytes([x]) for x in range(256)], pa.binary())
    bits = lm_scoring.coded(inner, 10)
    x, gate = lm_scoring._inputs(bits, counts, 0.0)
    z = lm_scoring._refined(lm_scoring._mixed(x, gate, weights), gate, refine)
    logs = -np.logaddexp(0, np.where(bits.bit == 1, -z, z))
    last_flag = np.array([np.flatnonzero(bits.segment == s)[-1] for s in range(256)])
    total = np.bincount(bits.segment, logs, 256) - logs[last_flag]
    prefix = np.bincount(bits.segment, np.where(np.arange(len(logs)) - np.searchsorted(bits.segment, bits.segment) < 18, logs, 0), 256)[0]
    end = math.log(p[256]) - prefix
    assert np.exp(total - prefix).sum() + math.exp(end) == pytest.approx(1, abs=1e-9)


def test_counts_grow_with_the_corpus(spark):
    """However small the tables start, the counts of each context stay apart, and those of prefixes are exact."""
    keys = [b"W" + w.encode() for w in sorted({f"{x}{y:03d}{z}" for x in "abcdefgh" for y in range(0, 1000, 7) for z in ("", "s", "ing")})]
    tokens = spark.createDataFrame([(bytearray(k), i % 5) for i, k in enumerate(keys)], "key binary, n long").repartition(3)
    counts, bits = lm_scoring.context_counts(tokens, 4)
    four = Counter()
    for i, k in enumerate(keys):
        for at in range(1, len(k) + 1):
            four[k[max(0, at - 4) : at]] += i % 5
    one = pa.array(keys, pa.binary())
    assert 2 ** bits[4] >= 2 * len(+four) and counts[0][0].sum() + counts[1][0].sum() == sum(n % 5 * (9 * (len(k) - 1) + 1) for n, k in enumerate(keys))
    number, places = np.arange(len(keys)) % 5, lm_scoring.places(one)
    whole = lm_scoring.Prefixes.of(one, number, 0.0)
    seen = Counter()
    for i, k in enumerate(keys):
        for at in range(1, len(k) + 1):
            seen[k[:at]] += i % 5
    flags = [min(11, int(math.log2(seen[keys[s][: at - f]] + 1))) * 36 for s, at, f in zip(places.of, places.at, places.first, strict=True)]
    assert whole.longest[whole.pair * 9].tolist() == flags


def plain_segments(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    after_word = [False, *(x[0] not in b" \t\n\x0b\x0c\r" for x in found)]
    return [(b"S" if w else b"W") + x for w, x in zip(after_word, [*found, b""], strict=True)]


def test_segments():
    texts = [*TEXTS.values(), " a  b\n", "x", "\n\n", "a b c ", "\ta b", "the cat sat on the mat again and " * 40 + " z"]
    p = lm_scoring.Parsed(pa.array(texts), 3, 2)
    keys = p.keys(np.arange(len(p.hash)))
    assert np.array_equal(lm_scoring.key_hashes(keys), p.hash)
    assert p.token.tolist() == [len(k) == 1 or (k[:1] == b"W" and k[1] not in b" \t\n\x0b\x0c\r") for k in keys.to_pylist()]
    got = [Counter({b"S ": int(p.singles[p.text == i].sum())}) for i in range(len(texts))]
    for k, span in zip(keys.to_pylist(), p.span.tolist(), strict=True):
        got[p.text[span]][k] += 1
    assert [+c for c in got] == [Counter(plain_segments(t.encode().lower())) for t in texts]


def test_spans_follow_the_text():
    """Equal passages have equal spans wherever they stand, and a span's hash tells the order of its words."""
    words = [f"w{x}" for x in np.random.default_rng(9).integers(0, 97, 400)]
    p = lm_scoring.Parsed(pa.array([" ".join(words), "other words first " + " ".join(words[50:]), " ".join(words[::-1])]), 6, 3)
    pairs = [set(zip(p.context[p.text == t][1:].tolist(), p.whole[p.text == t][1:].tolist(), strict=True)) for t in range(3)]
    assert len(pairs[0]) > 20 and len(pairs[0] & pairs[1]) >= 0.7 * len(pairs[0]) and not pairs[0] & pairs[2]


def test_repeated_passages_and_order(spark):
    """A text that another one has word for word scores far better than the same words in another order."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "el", "in", "os", "ut")]
    texts = [" ".join(rng.choice(vocabulary, 300)) for _ in range(20)]
    mixed = " ".join(rng.permutation(texts[3].split()))
    rows_ = [(i, t, True) for i, t in enumerate(texts)] + [(50, texts[3], False), (51, mixed, False), (52, texts[4], True)]
    got = {r.id: r for r in lm_scoring.score(spark.createDataFrame(rows_, "id long, text string, learn boolean"), F.col("learn"), id_col="id", table_bits=12, span_bits=3).collect()}
    assert got[50].base_score == pytest.approx(got[51].base_score) and got[50].score > 0.5 * got[51].score and got[51].n_repeated == 0 and got[50].n_repeated > 200
    assert got[52].n_repeated > 200 and got[4].n_repeated == got[52].n_repeated and got[7].n_repeated == 0


def test_learning_helps():
    """On segments not learnt from, learnt weights and the map do better than the start weights, and known words about as
    well as their own frequencies, though they are coded byte by byte."""
    rng = np.random.default_rng(4)
    vocabulary = [b"W" + "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))).encode() for _ in range(4000)]
    p = 1 / np.arange(2, 4002)
    sample = [Counter(rng.choice(4000, 60_000, p=p / p.sum()).tolist()) for _ in range(2)]
    merged = Counter()
    for i, n in sample[0].items():
        merged[vocabulary[i]] += n
    keys, number = pa.array(sorted(merged), pa.binary()), np.array([merged[k] for k in sorted(merged)])
    tokens = pa.RecordBatch.from_arrays([keys, pa.array(number)], ["key", "n"])
    counts = [[np.zeros(1 << 16, np.float32) for _ in lm_scoring.ORDERS[:-1]] for _ in range(2)]
    bits = lm_scoring.coded(keys, 16)
    for k in range(5):
        for v in (0, 1):
            np.add.at(counts[v][k], bits.slots[k][bits.bit == v], number[bits.segment][bits.bit == v])
    weights, seen, came = lm_scoring.learn_weights(((b.column("key"), b.column("n").to_numpy(), w) for b, w in lm_scoring._with_prefixes(iter([tokens]), True, 1.0)), counts, 16)
    weights = np.where(seen[:, None] > 0, weights, lm_scoring.start_weights())
    fresh = Counter()
    for i, n in sample[1].items():
        fresh[vocabulary[i]] += n

    def cost(weights, refine):
        known = {}
        for b, whole in lm_scoring._with_prefixes(iter([tokens]), False, 0.0):
            known |= dict(zip(b.column("key").to_pylist(), lm_scoring.log10_probability(b.column("key"), counts, weights, 16, whole, refine).tolist(), strict=True))
        return sum(n * known[k] for k, n in fresh.items() if k in known)

    own = sum(n * math.log10(merged[k] / number.sum()) for k, n in fresh.items() if k in merged)
    start, learnt, refined = cost(lm_scoring.start_weights(), None), cost(weights, None), cost(weights, lm_scoring.map_logits(came))
    assert start < learnt < refined and refined > 1.06 * own


# 4 -----------------------------------------------------------------------------------------


def test_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, got = Tokenizer.from_file(path), {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    for i, text in TEXTS.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode(bpe.encode(docs, path), path)
    assert all((r.text or "") == r.decoded for r in both.collect())
    assert bpe.round_trip(nothing, path).count() == 0


# 5 -----------------------------------------------------------------------------------------


def test_license_scan(docs, nothing):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(docs)).collect()}
    assert got.keys() == TEXTS.keys()
    for i, text in TEXTS.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(A_TO_Z))
        places = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        r, starts = got[i], [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
    assert licenses.scan(nothing).count() == 0


def test_whole_licenses(spark):
    """Each whole text, with a name put in, is found once under its own label and under no kindred one."""
    put_in = {k: t.replace("the copyright holder nor", "the very long name of some holder nor").replace("Software is furnished", "Software is thus here furnished") for k, t in licenses.TEXTS.items()}
    rows_ = [(k, f"some words before {t} and some after") for k, t in put_in.items()] + [("none", "permission is hereby granted to nobody " * 50)]
    got = {r.doc_id: r.spans for r in licenses.scan(spark.createDataFrame(rows_, "doc_id string, text string")).collect()}
    for k in licenses.TEXTS:
        full = [s for s in got[k] if s.label in licenses.TEXTS]
        want = {k, "bsd-3-clause-name"} if k == "bsd-3-clause-full" else {k}
        assert {s.label for s in full} == want and len(full) == len(want), (k, full)
        span = next(s for s in full if s.label == k)
        n = len(licenses.words_of(put_in[k].lower().encode()))
        assert (span.first_word, span.last_word) == (3, 2 + n) and span.cover > 0.9
    assert got["none"] == []


def test_license_spans(spark):
    notice = "intro Permission is hereby granted, free of charge, to any person obtaining a NEW copy of this software and associated documentation files end"
    text = spark.createDataFrame([(1, notice), (2, "permission is hereby granted to nobody")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in licenses.scan(text).collect()}
    assert [(s.label, s.first_word, s.last_word) for s in got[1]] == [("mit-text", 1, 21)] and got[2] == []


# 6 -----------------------------------------------------------------------------------------


def test_toxicity(spark, docs, nothing):
    bad = [(1000 + i, f"{rows()[i][1]} you awful {'rotten' if i % 2 else 'vile'} fool", "en", "s", 1, 0.0, 0) for i in range(30)]
    both = docs.unionByName(frame(spark, bad))
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(1000 + i, 1) for i in range(24)] + [(5, None), (77777, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.learn(both, labels, epochs=10, alpha=1.0, l1=0.5)
    got = {r.doc_id: r.score for r in toxicity.score(both, model).collect()}
    assert all(got[1000 + i] > 0.5 for i in range(24, 30)) and all(got[i] < 0.5 for i in range(30))
    assert got[100] == got[101] == got[102] and 0 <= got[107] <= 1
    assert len(model.slots) < 5000
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0


def test_ftrl_by_hand():
    ftrl = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.0)
    ftrl.update(np.array([1]), 1)
    assert ftrl.z[1] == pytest.approx(-0.5) and ftrl.n[1] == pytest.approx(0.25)
    assert ftrl.weights(np.array([1]))[0] == pytest.approx(0.4 / ((1 + 0.5) / 0.5))


def plain_features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z).encode())
    return {("w", x) for x in w} | {("s", x[:4]) for x in w if len(x) > 4} | {("p", *x) for x in zip(w, w[1:])} | {("k", *x) for x in zip(w, w[2:])}


def test_toxicity_features():
    texts = ["A b c D", "abcdefgh bcd abcz a-b", "", None, "Über über ÜBER x1 x2 x1 x2"]
    _, offsets = toxicity.features(pa.array(texts), 28)
    assert np.diff(offsets).tolist() == [len(plain_features(t)) for t in texts]


def test_toxicity_against_plain_ftrl(spark, docs):
    """Score of every document as a plain dictionary of coordinates gives it, learnt in the order of the ids' hashes."""
    labels = {i: int(i % 3 == 0) for i in (*range(30), 104, 110)}
    frame_of = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.learn(docs, frame_of, bits=20, epochs=3, l1=0.3)
    streamed = toxicity.learn(docs, frame_of, bits=20, epochs=3, l1=0.3, held_slots=10)
    assert np.array_equal(model.slots, streamed.slots) and np.array_equal(model.weights, streamed.weights)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    order = [r[0] for r in frame_of.orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    order = [i for i in order for _ in range(1 + (i == 7))]  # the repeated row
    slots = {i: toxicity.features(pa.array([t]), 20)[0].tolist() for i, t in TEXTS.items()}
    z, n = Counter(), Counter()

    def weight(k):
        l1 = 0 if k == "b" else 0.3
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / (1 + math.sqrt(n[k]) + 0.1)

    for _ in range(3):
        for i in order:
            keys = [*slots[i], "b"]
            w = [weight(k) for k in keys]
            g = 1 / (1 + math.exp(-sum(w))) - labels[i]
            for k, x in zip(keys, w, strict=True):
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) * x
                n[k] += g * g
    for i in TEXTS:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-min(35, max(-35, sum(weight(k) for k in [*slots[i], "b"]))))), abs=1e-6)


# 7 -----------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    long = "<html>é\r\n\r\nWARC/1.1\r\n" + "y" * 1200
    pages = [(1, "http://a/", long), (2, None, long), (3, "http://c/\nX", "short"), (4, "http://d/", "short"), (5, "http://e/", None), (6, "http://f/", long)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write_pages(df, path)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    for i, _, html in pages:
        raw, r = (html or "").encode(), got[f"urn:page:{i}"]
        assert (r.payload_length, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r.record_type == ("revisit" if i in (1, 2) else "response") and r.refers_to == ("urn:page:6" if i in (1, 2) else None)
        assert r.payload == (None if i in (1, 2) else raw)
    assert got["urn:page:2"].target_uri is None and got["urn:page:3"].target_uri == "http://c/%0AX"
    light = warc.read(spark, path, payload=False)
    assert light.where("record_type = 'revisit'").count() == 2 and light.where("target_uri in ('http://d/', 'http://e/') and payload_length > 0").count() == 1
    assert light.where("payload is not null").count() == 0
    warc.write_pages(df.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_warc_gzip_and_skipping(tmp_path):
    import gzip

    record = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    content = record("warcinfo", b"x" * 3_000_000) + record("resource", b"WARC/1.0\r\n\r\n") + record("response", b"")
    (tmp_path / "a.warc").write_bytes(content)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(content))
    for name in ("a.warc", "a.warc.gz"):
        got = list(warc.read_records(str(tmp_path / name), {"record_type": frozenset(["resource", "response"])}, True))
        assert [(r["record_type"], r["payload"]) for r in got] == [("resource", b"WARC/1.0\r\n\r\n"), ("response", b"")]


# 8 -----------------------------------------------------------------------------------------


def test_packing(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in TEXTS.items()}
    pieces = Counter((r.doc_id, r.piece) for r in got)
    assert pieces == Counter((r[0], k) for r in rows() for k in range(-(-len(ids[r[0]]) // 4096)))
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(nothing, path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(2).integers(1, 1000, 500))[::-1]
    limits = packing.Capacities(1000, 3, 600_000 + 400_001)
    bins, _ = packing.best_fit(lengths, limits, rule=rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= limits.attention
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5000]), packing.Capacities())


def test_packing_tokens(monkeypatch):
    """Ids of whole slices as the library gives them, also while words are forgotten."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordBpe(path)
    monkeypatch.setattr(packing, "CACHED", 40)
    texts = ["ÀÉÎÖØÞß ×÷ ÿŸ ñ Ñ̃ é É", "a\tb\rc d \x00 x\x07y", "don't (abc) --- !!! ÄÖÜ!!", "", None, "x" * 100, "Ünï,cö.dé", "<|endoftext|> hello<|endoftext|>", "İstanbul ẞ ΑΣ", "日本語 🙂a", " a  b \n\n c "]
    for some in (texts, texts[::-1], list(TEXTS.values()), texts):
        ids, bounds = encoder.encode(pa.array(some, pa.string()))
        for i, text in enumerate(some):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids
    assert len(encoder.encode(pa.array([], pa.string()))[0]) == 0


# 9 -----------------------------------------------------------------------------------------


def test_quality_measures(docs, nothing):
    got = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    for i, s in TEXTS.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", s)
        c, covered = Counter(zip(w, w[1:], w[2:])), set()  # noqa: B905
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert tuple(got[i][k] for k in quality_rules.COUNTS) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(covered))
    assert quality_rules.measure(nothing).count() == 0


def test_decision_list(spark, docs):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.random(900), rng.random(900)])
    bad = (x[:, 0] > 0.7) | ((x[:, 1] < 0.2) & (x[:, 0] < 0.3))
    rules = quality_rules.learn_list(x, bad, ["a", "b"])
    df = spark.createDataFrame([(float(a), float(b), bool(y)) for (a, b), y in zip(x, bad, strict=True)], "a double, b double, bad boolean")
    wrong = df.withColumn("kept", quality_rules.verdict(rules)).where("kept = bad").count()
    assert 2 <= len(rules) <= 12 and wrong < 30
    assert quality_rules.learn_list(x, np.zeros(900, bool), ["a", "b"]) == []
    labels = spark.createDataFrame([(1, 1), (5, None)], "doc_id long, quality int")
    assert quality_rules.learn_rules(docs, labels) == [] and docs.withColumn("k", quality_rules.verdict([])).where("k").count() == docs.count()


# 10 ----------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, nothing):
    once = docs.dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.compare_edited(once, most_share=0.6).collect()}
    ids = sorted(TEXTS, reverse=True)
    for k, i in enumerate(ids):
        text, following = TEXTS[i], TEXTS[ids[(k + 1) % len(ids)]]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].near_next == pytest.approx(alike(got[i].fingerprint, got[ids[(k + 1) % len(ids)]].fingerprint))
        assert got[i].near_edited == pytest.approx(alike(got[i].fingerprint, got[i].edited_fingerprint))
    assert got[3].fingerprint == got[104].fingerprint == got[105].fingerprint and got[105].near_next == 1.0
    assert fingerprints.compare_edited(nothing).count() == 0
    one = fingerprints.compare_edited(once.where("doc_id = 3"), most_share=1.0, least_documents=1).first()
    assert one.near_next == 1.0
    assert fingerprints.compare_edited(docs).count() == docs.count()


def test_fingerprints_of_a_hot_group(spark):
    """A third of the rows are near copies, whose terms are too frequent for the band."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    others = [(i, " ".join(rng.choice(words, 60))) for i in range(60)]
    copies = [(100 + i, " ".join([*(f"c{k}" for k in range(80)), f"odd{i}"])) for i in range(30)]
    got = {r.doc_id: r for r in fingerprints.compare_edited(spark.createDataFrame(others + copies, "doc_id long, text string")).collect()}
    assert all(got[100 + i].near_next > 0.9 for i in range(1, 30))
    assert all(got[100 + i].near_edited > 0.1 for i in range(30)) and np.mean([got[i].near_next for i in range(1, 60)]) < 0.1


def test_lexicon_holds_the_whole_band(spark):
    rows = [(i, " ".join(f"t{i // 2}x{k}" for k in range(50))) for i in range(200)]
    rare = [(200, "rare words alone here")]
    assert len(fingerprints.lexicon(spark.createDataFrame(rows + rare, "id long, text string"))) == 5000
    got = fingerprints.compare_edited(spark.createDataFrame(rows + rare, "doc_id long, text string")).where("doc_id = 200").first()
    assert len(got.fingerprint) == 256 and got.near_edited > 0


def alike(a, b):
    if a.startswith("=") or b.startswith("="):
        return float(a == b)
    pairs = [(a[k : k + 4], b[k : k + 4]) for k in range(0, len(a), 4)]
    some = [p for p in pairs if p != ("----", "----")]
    return sum(x == y for x, y in some) / len(some)
