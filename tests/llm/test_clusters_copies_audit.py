"""Centroid clustering, MinHash near-dedup and the divergence audit: against SQL and brute force, with ties, copies and hard rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import oracle_rows, spark_rows

from chronoplay.llm import divergence, queries
from chronoplay.llm.centroids import LARGEST, centroid_clusters, nearest
from chronoplay.llm.divergence import divergence_audit, term_counts
from chronoplay.llm.minhash_dedup import band_keys, minhash_components, sketch

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op10_jaccard_join", "op11_centroids", "op12_minhash_dedup", "op13_divergence"])
def test_equals_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SMALL)) == oracle_rows(SMALL, queries.ORACLES[name])


def test_partial_search_is_exact():
    """Random blocks with many ties: the nearest centroid, of equal ones the first, whatever the order of dimensions."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, k = int(rng.integers(0, 60)), int(rng.integers(1, 9))
        block, centroids = rng.integers(-2, 3, (n, 64)), rng.integers(-2, 3, (k, 64))
        block[:, 8:] = 0
        centroids[:, 8:] = 0  # distances are small, so ties are many
        full = ((block[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        cluster, distance = nearest(block, centroids, rng.permutation(64), (3, 20))
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def brute_clusters(rows, k=40, rounds=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in whole)[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in whole:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in whole]
    own = Counter()
    for _, j, d in found:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found), key=str)


@pytest.mark.parametrize("k,rounds", [(3, 5), (40, 2)])
def test_op11_hard_rows(spark, k, rounds):
    """Null, short, long, null-holding, NaN and infinite vectors go; ties, repeated rows and ids, null ids stay; empty clusters keep their place."""
    rng = random.Random(5)
    same = [0.5] * 64
    rows = [(i, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(64)]) for i in range(40)] + [(7, same), (7, same), (8, same), (None, same), (None, [0.1] * 64)]
    bad = [(90, None), (91, []), (92, [0.1] * 63), (93, [0.1] * 65), (94, [None] + [0.1] * 63), (95, [math.nan] + [0.1] * 63), (96, [math.inf] + [0.1] * 63)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, _id int, cluster string").repartition(3)
    got = centroid_clusters(frame, clusters=k, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    floats = [(i, [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(floats, k, rounds)
    assert centroid_clusters(frame.limit(0)).count() == 0 and centroid_clusters(frame.filter("vec_id >= 90")).count() == 0


def test_op11_wide_components(spark):
    edge = [(1, [float(LARGEST // 256)] * 64), (2, [-float(LARGEST // 256)] * 64)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r["distance"] for r in centroid_clusters(frame(edge), clusters=1, rounds=0).orderBy("distance").collect()] == [0, 1 << 62]
    with pytest.raises(Exception, match="wouldn't fit a long"):
        centroid_clusters(frame([(1, [1e30] * 64)])).count()


def pairs_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) >= 2 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(docs):
    sets, label, index = {i: pairs_of(t) for i, t in docs}, {i: i for i, _ in docs}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    linked = defaultdict(set)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in index[x]).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                linked[i].add(j)
    while True:
        lower = {i: min([label[i], *(label[j] for j in linked[i])]) for i in label}
        if lower == label:
            return {i: (len(sets[i]), label[i], label[i] == i) for i in label}
        label = lower


@pytest.mark.parametrize("stars,short,block", [(3, 64, 256), (1, 2, 4)])
def test_op12_equals_brute_force(spark, stars, short, block):
    """Copies, chains of near copies, and texts that share long passages without being similar; stars alone, and blocks for what they leave."""
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs, passage = [], word(60)
    for _ in range(12):  # chains: each step changes a few words more
        text = word(80)
        for _ in range(9):
            docs.append(" ".join(text))
            for _ in range(2):
                text[rng.randrange(len(text))] = f"v{rng.randrange(5000)}"
    docs += [" ".join(passage + word(rng.choice([4, 8, 12, 40]))) for _ in range(120)]  # some linked, most not
    docs += ["a b c d e f", "a b c d e", "A  B\tC d e f", "a b", "b a", "a", "A", "", None]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _id string, label string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_components(frame, stars=stars, short_list=short, block=block).collect()}
    assert got == brute_components(rows)


def test_op12_hard_rows(spark):
    rows = [(3, "x y z"), (3, "x y z"), (None, "x y z"), (None, None), (5, None), (6, ""), (7, "one"), (8, "ONE"), (9, "long " * 200_000), (1, "y x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash_components(frame).collect()), key=str)
    want = [(3, 2, 3, True)] * 2 + [(None, 2, None, True), (None, 0, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (1, 1, 1, True)]
    assert got == sorted(want, key=str)
    assert minhash_components(frame.limit(0)).count() == 0


def test_op12_similar_sets_share_a_bucket():
    """Pairs of similarity 0.8, from sets of five shingles to thousands; and what unlike pairs cost."""
    rng = np.random.default_rng(1)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    for size in (5, 10, 50, 200, 2000):
        missed = 0
        for _ in range(400 if size < 2000 else 50):
            both, left, right = draw(size * 8 // 10), draw(size // 10), draw(size - size * 8 // 10 - size // 10)
            a, b = np.union1d(both, left), np.union1d(both, right)
            missed += not (band_keys(a) == band_keys(b)).any()
        assert missed == 0, size
    agree = np.mean([(sketch(draw(3)) == sketch(draw(3))).mean() for _ in range(50)])
    assert agree < 0.01
    unlike = [(draw(100), draw(100), draw(25)) for _ in range(400)]  # similarity 0.1
    assert sum((band_keys(np.union1d(a, c)) == band_keys(np.union1d(b, c))).any() for a, b, c in unlike) <= 2


def brute_audit(rows, least=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [(la, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for la, s, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(t for la, _, w in terms if la == lang for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = {s: Counter(t for la, s2, w in terms if la == lang and s2 == s for t in w if docs[t] >= least) for s in {r[1] for r in rows if r[0] == lang}}
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q = share(every)
        for s, c in count.items():
            p = share(c)
            pairs = [(o, sum(abs(p[t] - x) for t, x in share(oc).items())) for o, oc in count.items() if o != s]
            marks = [(t, p[t] - q[t]) for t in kept if c[t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", marks, top)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(2, 3), (30, 50)])
def test_op13_hard_rows(spark, least, top, monkeypatch):
    """Nulls, empty texts, groups and langs without terms, repeated rows, ties, long texts, characters beyond ASCII."""
    monkeypatch.setattr(divergence, "HELD", 20)
    rng = random.Random(2)
    words = ["Ärger", "ärger", "the", "THE", "naïve", "x1y", "日本", "zz", "emoji😀s", "o'clock"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "B", "é", None]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(150)]
    rows += [("fr", "a", None), ("fr", "b", "123 ..."), ("it", "only", "uno due"), ("en", "a", "the " * 50_000), ("en", "big", "lone"), ("en", "big", "lone")]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "lang string, source string, text string, term string, value int").repartition(3)
    got = divergence_audit(frame, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, least, top)
    assert divergence_audit(frame.limit(0)).count() == 0


def test_terms_are_cut_at_their_ends():
    text = ("alpha Beta " * 5000 + "x" * 5000 + " é" * 3000).encode()
    whole = term_counts(text)
    assert whole == term_counts(text, 7) == term_counts(text, 1000) and whole[b"beta"] == 5000 and whole[b"x" * 5000] == 1


def test_jaccard_join_frees_counts_before_it_joins(spark, monkeypatch):
    """The shuffles that count tokens are released before the joins with those counts write theirs."""
    from chronoplay.llm import jaccard_join

    freed = []
    monkeypatch.setattr(jaccard_join, "release", freed.append)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z")], "doc_id long, text string")
    rows = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert rows == {1: 1, 2: 1, 3: 3} and len(freed) == 4
