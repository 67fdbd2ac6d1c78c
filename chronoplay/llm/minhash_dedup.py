"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, stars.

One hash of each shingle serves for all bins: the range of hashes is cut into
``bands * rows`` equal bins, and a bin's value is the least hash in it. An
empty bin takes the value of a full one, which it finds by trying all bins in a
random order of its own (the same for all sets); so each empty bin agrees
between two sets with the sets' similarity, independently of the others.

Bands of ``rows`` bins are buckets. At a similarity of 0.8 a band agrees with a
chance of 0.8**6 = 0.26, and all 48 differ once in two million pairs.

A bucket's candidates are a star: one set, its centre, against the others, so a
bucket of m sets costs m - 1 pairs. Candidates are verified on full sets, and
what is linked becomes one component. A centre's pairs are all decided then, so
it leaves the bucket; buckets that lie in one component are done, and the
others may get another star. What the stars leave open is joined in blocks, each
pair of different components once. So no link that two sets in one bucket have
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import tidy
from .common import BROADCAST_KEYS, checkpointed, cut, release, small_side
from .components import connected_components
from .jaccard_join import BLOCK, REMEMBER, SHORT_LIST, _only, _sets, _signature, _verified, _whole_sets, may_fit, open_links, with_components
from .shingles import _M1, _mix, shingle_sets

BANDS, ROWS, WORD_PAIRS = 48, 6, 2
#: Stars for each bucket before the rest is joined in blocks.
STARS = 1


@lru_cache(maxsize=2)
def _plan(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each bin, and for each bin the place of every other in its random order."""
    edges = np.array([-(-(k << 64) // bins) for k in range(bins)], np.uint64)
    return edges, np.random.default_rng(17).permuted(np.tile(np.arange(bins, dtype=np.int16), (bins, 1)), axis=1)


def sketch(tokens: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """Values of all bins of a set of sorted hashes, none of them empty."""
    edges, order = _plan(bins)
    first = np.searchsorted(tokens, edges)
    full = np.flatnonzero(np.append(first[1:], len(tokens)) > first)
    donor = np.arange(bins)
    if len(full) < bins:
        empty = np.setdiff1d(donor, full, assume_unique=True)
        donor[empty] = full[order[np.ix_(empty, full)].argmin(axis=1)]
    return tokens[first[donor]]


def band_keys(tokens: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A set's buckets: a hash of each band's number and values."""
    values = sketch(tokens, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * _M1 + values[:, k])
    return key


def _sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(_id, _key, _s1, _s2, _n, _b): each row's set, and its buckets where the task hasn't just sent that set."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for b in batches:
            one, two, n, keys = [], [], [], []
            for known, tokens in zip(b.column(0).is_valid().to_pylist(), shingle_sets(b.column(2), words), strict=True):
                sig = _signature(tokens) if len(tokens) and known else None
                n.append(len(tokens))
                one.append(sig and sig[0])
                two.append(sig and sig[1])
                if sig is None or sig in sent:
                    keys.append(None)
                    continue
                if len(sent) >= REMEMBER:
                    sent.clear()
                sent.add(sig)
                keys.append(band_keys(tokens, bands, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["_id", "_key", "_s1", "_s2", "_n", "_b"])

    return docs.mapInArrow(tidy(run), f"_id {kind}, _key long, _s1 long, _s2 long, _n long, _b array<long>")


def _buckets(base: DataFrame, words: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (_id, _key, _s1, _s2, _n), the sets (sig, _s1, _s2, _n, _first, _pick) that share a bucket, and those buckets' lists (t, sig, n)."""
    sent = checkpointed(_sketched(base, words, bands, rows))
    each = sent.select("_s1", F.explode("_b").alias("t"))
    shared = checkpointed(each.groupBy("t").agg(F.min("_s1").alias("_lo"), F.max("_s1").alias("_hi")).filter("_lo <> _hi").select("t"))
    # several tasks may have sent a set
    listed = checkpointed(each.join(shared.hint("shuffle_hash"), "t").distinct())
    kept = sent.select("_id", "_key", "_s1", "_s2", "_n")
    sharing = checkpointed(listed.select(F.col("_s1").alias("_in")).distinct())
    sets = _sets(kept).join(sharing, F.col("_s1") == F.col("_in"), "left_semi")
    stay = checkpointed(sets.select(F.monotonically_increasing_id().alias("sig"), "_s1", "_s2", "_n", "_first", "_pick"))
    return kept, stay, checkpointed(listed.join(stay, "_s1").select("t", "sig", F.col("_n").alias("n")))


def _star(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b): each list's centre against its others, but for those of its component; and the lists (t, sig, n) without their centres."""
    centre = lists.groupBy("t").agg(F.min(F.struct("sig", "n", "label")).alias("_c"))
    others = cut(lists.join(centre, "t").filter("sig <> _c.sig"))
    pairs = others.filter((F.col("label") != F.col("_c.label")) & may_fit("n", "_c.n", percent))
    return pairs.select(F.least("sig", "_c.sig").alias("a"), F.greatest("sig", "_c.sig").alias("b")).distinct(), others.select("t", "sig", "n")


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(t, sig, n, label) of the lists whose sets are in several components."""
    labelled = cut(lists.join(found, lists["sig"] == found["node"], "left").select("t", "sig", "n", F.coalesce("label", "sig").alias("label")))
    several = labelled.groupBy("t").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("t")
    return cut(labelled.join(several, "t", "left_semi"))


def minhash_components(
    docs: DataFrame, percent: int = 80, words: int = WORD_PAIRS, bands: int = BANDS, rows: int = ROWS, stars: int = STARS, id_col: str = "doc_id", text_col: str = "text", short_list: int = SHORT_LIST, block: int = BLOCK
) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Two texts link when 100 * intersection >= percent * union of their sets of
    ``words``-word shingles; ``component_id`` is the smallest id reachable by
    links, a row's own included, and the row of that id is kept. Links are exact
    where two sets share a bucket. Texts without words, null or empty, have no
    shingles and link with nothing; rows without an id link with nothing, have
    no component and are kept. Repeated rows share a component. An empty table
    gives an empty result. Only the two named columns are read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    base = base.select("_id", F.xxhash64("_id", "_text").alias("_key"), "_text")
    known, stay, lists = _buckets(base, words, bands, rows)
    release(spark)
    picked = base.join(small_side(stay.select("sig", "_s1", "_s2", "_pick"), BROADCAST_KEYS), F.col("_key") == F.col("_pick")).select("sig", "_s1", "_s2", "_text")
    whole = checkpointed(_whole_sets(picked, words))

    links, found, left = None, None, lists.withColumn("label", F.col("sig"))
    for _ in range(max(1, stars)):
        pairs, rest = _star(left, percent)
        more = cut(_verified(pairs, whole if links is None else _only(whole, left), percent))
        if links is None or not more.isEmpty():
            links = more if links is None else cut(links.unionByName(more))
            found = connected_components(links)
        left = _open(rest, found)
        release(spark)
        if left.isEmpty():
            break
    else:
        more = cut(open_links(left.drop("label"), found, whole, percent, short_list, block))
        found = found if more.isEmpty() else connected_components(links.unionByName(more))
    out = with_components(known, stay.drop("_n"), found, id_col)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
