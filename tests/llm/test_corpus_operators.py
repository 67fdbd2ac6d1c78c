"""Operators that look at the whole corpus: against brute force, with copies, ties and hard rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from oracle import oracle_rows, spark_rows
from pyspark.sql import functions as F

from chronoplay.llm import queries
from chronoplay.llm.components import connected_components
from chronoplay.llm.decontamination import contaminated, simhash
from chronoplay.llm.exact_dedup import exact_dedup
from chronoplay.llm.jaccard_join import jaccard_components
from chronoplay.llm.toxicity import fit_toxicity, held_out, score_toxicity

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, _id string, _text string, _norm string, _sig string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOC)


def test_op1_equals_sql(spark):
    assert spark_rows(queries.op1_exact_dedup(spark, SMALL)) == oracle_rows(SMALL, queries.ORACLES["op1_exact_dedup"])


@pytest.mark.parametrize("weak", [False, True])
def test_op1_hard_rows(spark, weak):
    """Nulls, empty texts, white space, repeated rows; and a digest under which different texts collide."""
    rows = [(5, "a  b"), (3, "a\tb"), (4, "a b "), (9, None), (8, ""), (None, "x"), (None, "y"), (7, "x"), (2, "dup"), (2, "dup"), (1, "z" * 100_000)]
    kind = {"digest": lambda t: F.substring(t, 1, 0)} if weak else {}
    got = exact_dedup(frame(spark, rows), **kind).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[5] == [(3, 2, False)] and by[3] == [(3, 2, True)] and by[4] == [(4, 1, True)]
    assert by[9] == [(8, 2, False)] and by[8] == [(8, 2, True)]
    assert sorted(by[None], key=str) == sorted([(7, 2, False), (None, 1, True)], key=str) and by[7] == [(7, 2, True)]
    assert by[2] == [(2, 2, True)] * 2 and by[1] == [(1, 1, True)] and len(got) == len(rows)
    assert exact_dedup(frame(spark, rows).limit(0)).count() == 0


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_components(docs):
    sets, parent, index = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for t in s:
            index.setdefault(t, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for t in s for j in index[t] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_op10_is_brute_force_on_the_tables(spark):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_jaccard_join(spark, SF).collect()}
    assert got == brute_components(docs)


def test_op10_chains_thresholds_and_long_lists(spark):
    """Chains of near copies, similarities at the threshold, and lists far longer than a block."""
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(14):  # a chain: each differs from the next in one word, the ends in many
        base = base[:]
        base[(i * 7) % 60] = f"c{i}"
        docs.append((i, " ".join(base)))
    long = [f"p{i}" for i in range(40)]
    for i in range(60):  # one passage, different ends: lists of sixty sets that aren't all similar
        docs.append((100 + i, " ".join(long + [f"e{i}x{j}" for j in range(i % 23)])))
    for i, n in enumerate(range(1, 14)):  # around the threshold
        docs.append((300 + i, " ".join(f"t{j}" for j in range(45))))
        docs.append((400 + i, " ".join([f"t{j}" for j in range(45)] + [f"u{i}y{j}" for j in range(n)])))
    docs += [(500, ""), (501, None), (502, "one two"), (503, "ONE two"), (504, "one two three")]
    want = brute_components(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, docs), short_list=14, block=16).collect()}
    assert got == want


def test_op10_long_lists_of_several_components(spark):
    """Lists whose sets belong to components of all sizes and lengths, with links between them that blocks must find."""
    rng = random.Random(4)
    passage, docs = [f"p{i}" for i in range(50)], []
    for family in range(8):
        end = [f"f{family}x{j}" for j in range(rng.choice((9, 11, 13, 20)))]
        for copy in range((30, 12, 5, 1)[family % 4]):
            words = passage + end + [f"c{family}y{copy}z{j}" for j in range(rng.randint(0, 3))]
            if rng.random() < 0.3:
                words[rng.randrange(50)] = f"d{family}y{copy}"
            docs.append((len(docs), " ".join(words)))
    want = brute_components(docs)
    assert 3 < len({c for _, c in want.values()}) < 60
    for short, block in ((4, 3), (4, 40), (64, 256)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, docs), short_list=short, block=block).collect()}
        assert got == want


def test_op10_one_id_on_many_texts(spark):
    """An id that stands on different texts, and rows that are repeated, are read once each."""
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join([*base, f"e{i}"])) for i in range(60)] + [(2, " ".join(base))] * 50 + [(3, "a text of its own it is")]
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == Counter({(1, 1): 60, (2, 1): 50, (3, 3): 1})


def test_op10_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "A B c d e f")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == Counter({(None, 2, None): 1, (7, 2, 3): 2, (3, 2, 3): 1})
    assert jaccard_components(frame(spark, rows).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["label"] for r in connected_components(edges).collect()} == {0}


def items_in(words, items):
    """Items whose weighted similarity with some window of a text is high enough, by trying all windows."""
    found = set()
    for item, w in items:
        n = len(w)
        k = min(5, n)
        want = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        for at in range(max(1, len(words) - n + 1)):
            part = words[at : at + n]
            have = Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))
            both = sum((have & want).values())
            if both and both >= 0.8 * (sum(have.values()) + sum(want.values()) - both):
                found.add(item)
                break
    return found


def test_op5_is_brute_force(spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    items = [(d["item_id"], words(d["text"])) for d in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    tokens = {t for _, w in items for t in zip(w, w[1:], w[2:], w[3:], w[4:])}
    want = {(i, x) for i, t in docs if tokens & set(zip(w := words(t), w[1:], w[2:], w[3:], w[4:])) for x in items_in(w, items)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, SMALL).collect()}
    assert got == want and want


def test_op5_windows_and_hard_rows(spark):
    item = [f"b{i}" for i in range(40)]
    changed = item[:]
    changed[3] = "x"
    rows = [(1, "lead " * 500 + " ".join(item) + " tail" * 500), (2, " ".join(changed)), (3, " ".join(item[:20])), (4, None), (5, ""), (6, " ".join(item).upper()), (6, " ".join(item).upper()), (None, " ".join(item)), (7, "short one")]
    bench = spark.createDataFrame([(10, " ".join(item), 1), (11, None, 1), (12, "", 1), (13, "short one", 1)], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["start_word"]) for r in contaminated(frame(spark, rows), bench).collect()), key=str)
    assert got == sorted([(1, 10, 500), (2, 10, 0), (6, 10, 0), (None, 10, 0), (7, 13, 0)], key=str)
    assert contaminated(frame(spark, rows).limit(0), bench).count() == 0 and contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_op5_passages_just_above_the_threshold(spark):
    """Many passages of a similarity of 0.80 to 0.85: none is lost for the distance of its fingerprint."""
    docs, items = [], []
    for i in range(700):
        n = (50, 52, 55, 60, 95, 100, 140)[i % 7]
        words = [f"q{i}x{j}" for j in range(n)]
        items.append((i, " ".join(words)))
        for at in (7, 40, 73, 106)[: {95: 2, 100: 2, 140: 3}.get(n, 1)]:
            words[at] = "changed"
        docs.append((i, " ".join(["lead"] * (i % 3) + words)))
    got = {r["doc_id"]: (r["item_id"], r["similarity"]) for r in contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: i for i in range(700)}
    assert all(0.8 <= s < 0.85 for _, s in got.values())


def test_op5_very_long_and_repetitive_items(spark):
    """Repeated shingles weigh as often as they stand there."""
    item = [f"r{i % 50}" for i in range(300)] + [f"s{i}" for i in range(1200)]
    changed = item[:]
    for i in range(0, len(item), 100):
        changed[i] = "y"
    bench = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    rows = contaminated(frame(spark, [(1, "lead " + " ".join(item) + " tail"), (2, " ".join(changed)), (3, " ".join(item[:700]))]), bench).collect()
    assert {(r["doc_id"], r["start_word"]) for r in rows} == {(1, 1), (2, 0)} and {r["doc_id"]: r["similarity"] for r in rows}[1] == 1.0


def test_op5_very_long_items(spark):
    """Tens of thousands of votes for a bit don't overflow its count."""
    rows = spark.createDataFrame([(1, 40_000, 0), (2, 70_000, 0), (3, 70_000, 60_000), (4, 60_000, 70_000)], "k int, x int, y int")
    sets = rows.withColumn("s", F.expr("concat(array_repeat('x', x), array_repeat('y', y))"))
    got = {r["k"]: r["p"] for r in simhash(sets, ["k"], "s", "p").collect()}
    x, y = spark.range(1).select(F.xxhash64(F.lit("x")), F.xxhash64(F.lit("y"))).first()
    assert got == {1: x, 2: x, 3: x, 4: y}


@pytest.mark.parametrize("sf,recall", [(SF, 0.6), ("/root/testdata/sf0.1", 0.9)])
def test_op6_held_out_accuracy(spark, sf, recall):
    rows = queries.op6_toxicity(spark, sf)
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = rows.collect()
    assert len(got) == pq.read_metadata(f"{sf}/documents.parquet").num_rows and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    kept = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for s, y in kept if y], [s for s, y in kept if not y]
    auc = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert auc > 0.85 and sum(s >= 0.5 for s in clean) / len(clean) < 0.05 and sum(s >= 0.5 for s in toxic) / len(toxic) >= recall
    print("held out:", len(toxic), len(clean), auc, sum(s >= 0.5 for s in toxic) / len(toxic), sum(s >= 0.5 for s in clean) / len(clean))


def test_op6_learns_from_no_held_out_label(spark):
    """Turning all held-out labels round changes no score."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda y: sorted((r["doc_id"], r["score"]) for r in score_toxicity(docs, fit_toxicity(docs, y)).collect())
    assert score(labels) == score(turned)


def test_op6_features_and_calibration_are_brute_force(spark):
    """All features by plain counting, and scores that rise with the trees' margin as pooled means do."""
    import math

    from chronoplay.llm import toxicity

    lexicon = {"idiot": 2.0, "rott*": 1.0, "fool": 0.5}
    texts = ["You ROTTEN fool! id1ot, 1d10t, i.d.i.o.t...", "", "nothing here", "fool fool x x x x x your hat", "É!? you", "rotting id-iot you" * 3, "a1b2c3 @@@ $fool$"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "_id int, _lexicon int, _text string")
    got = {r["_id"]: r["_x"] for r in toxicity._features(rows, [lexicon], "_id").collect()}
    weight = lambda w: max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "*", 0.0) for k in range(4, 9) if k < len(w))])
    for i, t in enumerate(texts):
        low, raw = t.lower(), t.encode()
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        v = [weight(x) for x in w]
        hits = [k for k, x in enumerate(v) if x]
        near = sum(any(x in toxicity.SECOND_PERSON for x in w[max(0, k - 4) : k + 5]) for k in hits)
        masked = re.findall(r"[^\W\d_]+(?:[0-9@$!*|+.\-]{1,2}[^\W\d_]+)+", low)
        plain = [weight(m.translate(toxicity._plain)) for m in masked]
        upper, letters = len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[A-Za-z]", raw))
        n, size = max(1, len(w)), max(1, len(raw))
        want = [
            math.log1p(len(w)), sum(v) / n, math.log1p(len(hits)), math.log1p(len({w[k] for k in hits})), max(v, default=0.0), sum(v) / max(1, len(hits)), near / n,
            upper / max(1, letters), len(re.findall(rb"[!?]", raw)) / size, len(re.findall(rb"[!-/:-@\[-`{-~]", raw)) / size, len(masked) / n, math.log1p(sum(x > 0 for x in plain)),
        ]
        assert got[i] == pytest.approx(want), t

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    base = docs.select("doc_id", F.lit(0).alias("_lexicon"), F.coalesce("text", F.lit("")).alias("_text"))
    margins = {r["doc_id"]: r["margin"] for r in toxicity._margin(model.trees, toxicity._features(base, [model.lexicon], "doc_id")).collect()}
    ranked = [scores[i] for i in sorted(margins, key=lambda i: (margins[i], scores[i]))]
    assert ranked == sorted(ranked)
    # the last fold's labels, pooled until they rise
    ids = labels.filter(~held_out("doc_id")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.FOLDS)) == toxicity.FOLDS - 1)
    groups: dict = {}
    for r in ids.collect():
        groups.setdefault(round(margins_of(model, spark, docs)[r["doc_id"]], 9), []).append(r["toxic"])
    pools: list = []
    for m in sorted(groups):
        pools.append([sum(groups[m]), len(groups[m]), [m]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, ms = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + ms]
    want = {m: s / n for s, n, ms in pools for m in ms}
    at = dict(zip(model.calibration.boundaries.toArray().round(9).tolist(), model.calibration.predictions.toArray().tolist(), strict=True))
    assert at and all(want[m] == pytest.approx(p) for m, p in at.items())


_margins: dict = {}


def margins_of(model, spark, docs):
    """Margins of all documents by the lexicon of the other folds, as in fitting."""
    from chronoplay.llm import toxicity

    if id(model) not in _margins:
        last = {r["doc_id"] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.FOLDS)) == toxicity.FOLDS - 1).select("doc_id").collect()}
        base = docs.select("doc_id", F.lit(0).alias("_lexicon"), F.coalesce("text", F.lit("")).alias("_text"))
        rows = toxicity._margin(model.trees, toxicity._features(base, [model.fold_lexicon], "doc_id")).collect()
        _margins[id(model)] = {r["doc_id"]: r["margin"] for r in rows if r["doc_id"] in last}
    return _margins[id(model)]


def test_op6_without_two_classes_and_hard_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "x"), (3, "w " * 50_000), (6, "x" * 1_000_000), (7, "x1" * 300_000), (4, "1d10t! i.d.i.o.t"), (4, "1d10t! i.d.i.o.t")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(i, 1) for i in range(1, 8)] + [(None, 0), (2, None)], "doc_id long, toxic int")
    assert {r["score"] for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()} == {0.0}
    assert {r["score"] for r in score_toxicity(docs, fit_toxicity(docs, one)).collect()} == {1.0}
    assert score_toxicity(docs.limit(0), fit_toxicity(docs, none)).count() == 0
    import zlib

    got = {r["doc_id"]: r["held_out"] for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in (1, 2, 3, 4))


def test_pipeline_is_brute_force(spark):
    """Every stage's decision, on the smallest tables."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    by_id = {d["doc_id"]: d for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    left = set(by_id)
    rows = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, rows, SMALL)
        assert out.columns == docs.columns
        rows = spark.createDataFrame(out.collect(), docs.schema)
        now = {r["doc_id"] for r in rows.collect()}
        assert now <= left
        if name == "exact_dedup":
            first = {}
            for i in sorted(left):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", by_id[i]["text"] or ""), i)
            assert now == set(first.values())
        if name == "jaccard_join":
            assert now == {i for i, (_, c) in brute_components([(i, by_id[i]["text"]) for i in sorted(left)]).items() if i == c}
        if name == "decontamination":
            assert now and left - now
        left = now
    ends = p.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in ends} == left and len(ends) == len(left) and all(r["round_trip"] for r in ends)
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "sentencepiece"]


def test_pipeline_judges_rows_without_ids_and_of_shared_ids(spark, tmp_path):
    """Each stage drops the rows it judges, no others; which rows those are doesn't hang on ids."""
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    names = lambda kind, i, n=40: [f"{kind}{i}w{j}" for j in range(n)]
    x, y, lone = (" ".join(names(k, 0)) for k in "xyl")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda name, rows: Counter((r["doc_id"], r["text"]) for r in stages[name](spark, docs(rows), str(tmp_path)).collect())

    rows = [(1, x), (2, x), (2, y), (3, y), (None, x), (None, lone), (None, lone), (4, None), (5, "a  b"), (5, "a b"), (5, "a b"), (None, None)]
    got = left("exact_dedup", rows)
    assert sum(got.values()) == 5 and sum(n for (i, t), n in got.items() if i == 5) == 1
    assert {k: n for k, n in got.items() if k[0] != 5} == {(1, x): 1, (2, y): 1, (None, lone): 1, (4, None): 1}

    near = lambda t: t + " more"
    got = left("jaccard_join", [(1, x), (2, near(x)), (2, y), (None, near(y)), (None, lone), (None, near(lone)), (6, lone + " a b c d e f g h i j k l m n o p q r s t"), (7, None)])
    assert sum(got.values()) == 5 and {(1, x), (2, y), (7, None)} <= set(got) and len([1 for i, _ in got if i is None]) == 1

    spark.createDataFrame([(10, x)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = left("decontamination", [(1, x), (1, y), (None, x), (None, y), (2, None)])
    assert got == Counter([(1, y), (None, y), (2, None)])

    labels = [(i, int(i % 2)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bad = lambda i: f"you rotten blockhead {lone} {i}"
    good = lambda i: f"kind greetings everyone {lone} {i}"
    rows = [(i, bad(i) if i % 2 else good(i)) for i in range(300)]
    got = left("toxicity", [*rows, (400, good(400)), (400, bad(400)), (None, good(401)), (None, bad(401))])
    assert {(400, good(400)), (None, good(401))} <= set(got) and not {(400, bad(400)), (None, bad(401))} & set(got)


def test_pipeline_takes_hard_rows(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeats, columns that clash; and no rows at all."""
    import corpus_pipeline as p

    words = lambda kind, n: " ".join(f"{kind}{j}" for j in range(n))
    rows = [(1, None), (2, ""), (None, words("a", 30)), (3, words("b", 60_000)), (4, "x" * 300_000), (5, words("c", 40)), (5, words("c", 40)), (6, words("d", 20)), (None, None)]
    docs = frame(spark, rows).withColumnsRenamed({"_norm": "_row", "_sig": "_key"})
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(10, words("d", 20)), (11, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (docs, docs.limit(0)):
        left = given
        for name, stage in p.STAGES:
            left = stage(spark, left, str(tmp_path))
            assert name == "sentencepiece" or left.columns == docs.columns
        got = Counter(r["doc_id"] for r in left.collect())
        assert got == (Counter({1: 1, 3: 1, 4: 1, 5: 1, None: 1}) if given is docs else Counter())
