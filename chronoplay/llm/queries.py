"""The queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .centroids import CLUSTERS, DIMENSIONS, ROUNDS, centroid_clusters
from .common import bound_batches, table
from .decontamination import contaminated
from .divergence import divergence_audit
from .exact_dedup import exact_dedup
from .html_extraction import extract_pages
from .jaccard_join import jaccard_components
from .licenses import license_scan
from .minhash_dedup import minhash_components
from .secrets import secret_scan
from .sentencepiece_codec import sentencepiece_codec
from .sharding import stratified_shards
from .token_counts import token_counts
from .toxicity import fit_toxicity, score_toxicity


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on every machine of the cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _job(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` as a job of its own, with small Arrow batches."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: _job(f) for f in (op1_exact_dedup, op2_sentencepiece, op3_token_counts, op4_licenses, op5_decontamination, op6_toxicity, op7_html_extraction, op8_secrets, op9_sharding, op10_jaccard_join, op11_centroids, op12_minhash_dedup, op13_divergence)}


def _similar_components(words: int, kept: bool) -> str:
    """SQL of the components of similar texts: pairs that share a shingle, then the least label that reaches each row."""
    return rf"""
        WITH RECURSIVE
             base AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
             sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
                                          ELSE list_distinct(list_transform(range(1, CAST(len(w) AS BIGINT) - {words - 2}), lambda i: array_to_string(list_slice(w, i, i + {words - 1}), ' '))) END AS s FROM base),
             kinds AS MATERIALIZED (SELECT min(doc_id) AS k, list_sort(s) AS s, CAST(len(s) AS BIGINT) AS n FROM sets GROUP BY ALL),
             items AS MATERIALIZED (SELECT k, n, hash(x) AS h FROM (SELECT k, n, unnest(s) AS x FROM kinds)),
             links AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM items a JOIN items b ON a.h = b.h AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
                                    GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
             edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
             reach AS (SELECT k AS a, k AS b FROM kinds UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
             label AS MATERIALIZED (SELECT a AS k, min(b) AS c FROM reach GROUP BY a),
             named AS MATERIALIZED (SELECT k.s, k.n, l.c FROM kinds k JOIN label l ON k.k = l.k)
        SELECT t.doc_id, coalesce(d.n, 0) AS n_shingles, CASE WHEN d.n > 0 THEN d.c ELSE t.doc_id END AS component_id{", CASE WHEN d.n > 0 THEN d.c = t.doc_id ELSE true END AS kept" if kept else ""}
        FROM sets t JOIN named d ON list_sort(t.s) = d.s"""


def _centroid_rounds() -> str:
    """SQL of the centroids after each round, spelled out."""
    near = """
             a{k} AS MATERIALIZED (SELECT vec_id, v, unnest(list_transform(list_slice(list_sort(list_transform(cs, lambda c: {{'d': list_sum(list_transform(list_zip(v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': c.k}})), 1, 1), lambda x: x)) AS b
                                   FROM vecs, (SELECT list({{'k': k, 'v': v}} ORDER BY k) AS cs FROM c{k}))"""
    step = """
             m{k} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS v FROM (SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
                                   FROM (SELECT b.k AS k, i, CAST(sum(v[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{k}, range(1, {top}) r(i) GROUP BY ALL)) GROUP BY k),
             c{next} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.k = c.k)"""
    return ",".join(near.format(k=k) + "," + step.format(k=k, next=k + 1, top=DIMENSIONS + 1) for k in range(ROUNDS)) + "," + near.format(k=ROUNDS)


ORACLES = {
    "op1_exact_dedup": r"""
        WITH base AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             groups AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM base GROUP BY norm)
        SELECT b.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, b.doc_id = g.keep_id AS kept, sha256(b.norm) AS text_sha256
        FROM base b JOIN groups g ON b.norm = g.norm""",
    # crc32 is spelled out: a table for each byte, folded over a text's bytes
    "op9_sharding": r"""
        WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
             base AS (SELECT doc_id AS id, coalesce('s' || source, 'n') AS src, coalesce(text, '') AS txt, hex(encode(coalesce(text, ''))) AS h FROM documents),
             sized AS (SELECT id, src, CAST(length(h) // 2 AS BIGINT) + 1 AS size,
                              xor(list_reduce([4294967295] || list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
                       FROM base, tab),
             each AS (SELECT *, row_number() OVER (PARTITION BY id, src, size, crc) - 1 AS copy FROM sized),
             hashed AS (SELECT *, md5(concat_ws(':', 17, coalesce(CAST(id AS VARCHAR), ''), crc, size, copy)) AS hash, (CAST('0x' || substr(md5('17:' || src), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM each),
             ranked AS (SELECT *, (CAST(row_number() OVER (PARTITION BY src ORDER BY hash, id, crc, size, copy) AS DOUBLE) - u) / count(*) OVER (PARTITION BY src) AS f FROM hashed),
             placed AS (SELECT *, row_number() OVER (ORDER BY f, src, hash, id, crc, size, copy) - 1 AS pos, count(*) OVER () AS n FROM ranked),
             cut AS (SELECT *, pos * 16 // n AS shard FROM placed)
        SELECT id AS doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, f AS fraction
        FROM cut""",
    "op10_jaccard_join": _similar_components(5, False),
    "op11_centroids": f"""
        WITH vecs AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                                   WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
             c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM vecs ORDER BY h, v LIMIT {CLUSTERS})),{_centroid_rounds()}
        SELECT a.vec_id, CAST(a.b.k AS INTEGER) AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.b.k""",
    "op12_minhash_dedup": _similar_components(2, True),
    "op13_divergence": r"""
        WITH base AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS txt FROM documents),
             words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base),
             kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
             counts AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
             langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
             groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM base) g),
             shares AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
                                     FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
                       FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
             terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE c > 0 AND p > q),
             parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms),
             ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
