"""Benchmark decontamination by SimHash windows, on DataFrame functions only.

A benchmark item of n words is looked for in windows of n words (all words of a
shorter document). The weighted Jaccard similarity of two word sequences counts
each five-word shingle as often as it occurs; fewer words make one shingle.

1. Windows: a window that starts at a shared shingle matches no less than one
   that starts just before it, so only shared shingles' places (and the last
   window) can start a best window, and only if enough of them lie in it for the
   similarity asked for. This gate loses nothing, and says which items a window
   may hold. The item shingles are a broadcast of a checked size; the texts
   aren't shuffled for it.
2. Each distinct window gets a 64-bit SimHash of its weighted shingles.
3. Fingerprints are cut into radius + 1 blocks. Two within the radius agree in
   a block, so a look-up by (item, block, value) finds all of them. The blocks
   are narrow, as 0.8 is far from 1; with the item in the key a window meets its
   own items only, at most radius + 1 times each, however many items there are.
4. The exact weighted similarity verifies what lies within the radius: shingles
   are counted on both sides, and the counts are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, checkpointed, small_side

SHINGLE = 5
SIMILARITY = 0.8
#: 24: at a similarity of 0.8 the distance of fingerprints is about 9.7 with a deviation of 2.9, so this is five deviations away.
RADIUS = 24
LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    """Lower-case words: what stands between ASCII characters that are no letters or digits."""
    lower = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _shingles(words: Column, k: Column) -> Column:
    n = F.size(words) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(" ", F.slice(words, i, k)))).otherwise(F.array().cast("array<string>"))


def simhash(df: DataFrame, keys: list[str], shingles: str, out: str) -> DataFrame:
    """Each of the ``keys`` with the 64-bit SimHash of its shingles (repeats weigh more).

    A 64-bit hash's bits b and b + 32 are counted in the two 32-bit lanes of one
    sum, so 32 sums hold all votes, up to 2**31 - 1 shingles, more than an array holds.
    """
    hashes = df.select(*keys, F.explode(shingles).alias("_s")).select(*keys, F.xxhash64("_s").alias("_h"))
    lanes = [F.sum(F.shiftrightunsigned(F.col("_h"), b).bitwiseAND(F.lit(LANES))).alias(f"_v{b}") for b in range(32)]
    votes = hashes.groupBy(*keys).agg(F.count("*").alias("_m"), *lanes)
    parts = []
    for b in range(32):
        counts = [F.shiftrightunsigned(F.col(f"_v{b}"), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF)) for lane in range(2)]
        bits = [F.shiftleft((2 * c > F.col("_m")).cast("bigint"), b + 32 * lane) for lane, c in enumerate(counts)]
        parts.append(bits[0].bitwiseOR(bits[1]))
    while len(parts) > 1:
        parts = [x.bitwiseOR(y) for x, y in zip(parts[::2], parts[1::2], strict=True)]
    return votes.select(*keys, parts[0].alias(out))


def _blocks(fingerprint: str, radius: int) -> Column:
    """array<struct<block, value>>: radius + 1 blocks that cover the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        mask = (1 << (b - a)) - 1
        parts.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fingerprint), a).bitwiseAND(F.lit(mask).cast("bigint")).alias("value")))
    return F.explode(F.array(*parts))


def weighted_similarity(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` (_item, _k, _window, …) with their exact weighted Jaccard similarity to ``items`` (_item, _ish)."""
    keys = ["_item", "_k", "_window"]
    have = pairs.select(*keys, F.explode(_shingles(F.split("_window", " "), F.col("_k"))).alias("_s")).groupBy(*keys, "_s").agg(F.count("*").alias("_a"))
    want = checkpointed(items.select("_item", F.explode("_ish").alias("_s")).groupBy("_item", "_s").agg(F.count("*").alias("_b")))
    both = have.join(small_side(want, BROADCAST_KEYS), ["_item", "_s"]).groupBy(*keys).agg(F.sum(F.least("_a", "_b")).alias("_both"))
    sizes = items.select("_item", F.size("_ish").alias("_m"))
    rows = pairs.join(both, keys).join(sizes, "_item").withColumn("_all", F.size(F.split("_window", " ")) - F.col("_k") + 1 + F.col("_m"))
    return rows.withColumn("similarity", F.col("_both") / (F.col("_all") - F.col("_both"))).drop("_both", "_m", "_all")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (id, item_id) of documents that hold a benchmark item, each with its best window.

    Columns: id, item_id, similarity, distance (of the fingerprints),
    start_word (from 0), n_words. A document that isn't in the result is clean.
    Null or empty texts and items without words match nothing. A repeated row
    gives no second pair; null ids appear as null. Empty tables give an empty
    result. Only the named columns are read. Around a match about a fifth as many
    windows as the item has words are compared, each of that many words, so an
    item of tens of thousands of words is slow.
    """
    items = (
        benchmark.select(F.col(item_col).alias("_item"), words_of(F.col(item_text_col)).alias("_iw"))
        .filter(F.size("_iw") > 0)
        .withColumn("_n", F.size("_iw"))
        .withColumn("_k", F.least(F.col("_n"), F.lit(shingle)))
        .withColumn("_ish", _shingles(F.col("_iw"), F.col("_k")))
    )
    items = checkpointed(items.drop("_iw"))
    items = checkpointed(items.join(simhash(items, ["_item"], "_ish", "_iprint"), "_item"))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter(F.col("_text").isNotNull())
    base = base.select("_id", F.xxhash64("_id", "_text").alias("_key"), words_of(F.col("_text")).alias("_words"))

    # 1. places of shared shingles; k is the shingle size, below five only for items that short
    shared = None
    for k in sorted(r[0] for r in items.select("_k").distinct().collect()):
        wanted = checkpointed(items.filter(F.col("_k") == k).select("_item", "_n", F.explode(F.array_distinct("_ish")).alias("_s")).select("_item", "_n", F.xxhash64(*(F.get(F.split("_s", " "), F.lit(j)) for j in range(k))).alias("_h")))
        places = base.filter(F.size("_words") >= k).select("_id", "_key", F.size("_words").alias("_size"), "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - k)).alias("_at"))
        hashed = places.select("_id", "_key", "_size", "_at", F.xxhash64(*(F.get("_words", F.col("_at") + j) for j in range(k))).alias("_h"))
        found = hashed.join(small_side(wanted), "_h").withColumn("_k", F.lit(k)).drop("_h")
        shared = found if shared is None else shared.unionByName(found)
    if shared is None:
        return items.select(F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), F.col("_item").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words")).limit(0)

    # windows of n words that share enough places: 2I >= s (m_w + m - I), or I >= s (m_w + m) / (1 + s)
    grouped = (
        shared.groupBy("_id", "_key", "_item", "_n", "_k", "_size")
        .agg(F.array_sort(F.collect_set("_at")).alias("_p"))
        .withColumn("_len", F.least("_n", "_size"))
        .withColumn("_mw", F.col("_len") - F.col("_k") + 1)
        .withColumn("_need", F.greatest(F.lit(1), F.ceil(F.lit(similarity) * (F.col("_mw") + F.col("_n") - F.col("_k") + 1) / (1 + similarity) - 1e-9)).cast("int"))
        .withColumn("_last", F.col("_size") - F.col("_len"))
    )
    begins = F.filter("_p", lambda p, j: (p <= F.col("_last")) & (F.get(F.col("_p"), j + F.col("_need") - 1) < p + F.col("_mw")))
    at_end = F.when(F.get(F.col("_p"), F.size("_p") - F.col("_need")) >= F.col("_last"), F.array("_last")).otherwise(F.array().cast("array<int>"))
    windows = checkpointed(
        grouped.filter(F.size("_p") >= F.col("_need"))
        .select("_id", "_key", "_item", "_len", "_n", "_k", F.explode(F.array_union(begins, at_end)).alias("_start"))
        .distinct()
    )
    cut = (
        base.drop("_id")
        .join(small_side(windows, BROADCAST_KEYS), "_key")
        .select("_id", "_item", "_n", "_k", "_start", F.concat_ws(" ", F.slice("_words", F.col("_start") + 1, F.col("_len"))).alias("_window"))
        .distinct()
    )
    cut = checkpointed(cut)

    # 2. fingerprints of the distinct windows
    shingled = cut.select("_k", "_window").distinct().withColumn("_wsh", _shingles(F.split("_window", " "), F.col("_k")))
    printed = simhash(shingled, ["_k", "_window"], "_wsh", "_wprint")
    # 3. blocks; a pair that agrees in several blocks is kept once
    left = cut.select("_item", "_k", "_window").distinct().join(printed, ["_k", "_window"]).select("_item", "_k", "_window", "_wprint", _blocks("_wprint", radius).alias("_b")).select("_item", "_k", "_window", "_wprint", "_b.*")
    right = checkpointed(items.select("_item", "_iprint", _blocks("_iprint", radius).alias("_b")).select("_item", "_iprint", "_b.*"))
    near = (
        left.join(small_side(right), ["_item", "block", "value"])
        .withColumn("distance", F.bit_count(F.col("_wprint").bitwiseXOR(F.col("_iprint"))))
        .filter(F.col("distance") <= radius)
        .select("_item", "_k", "_window", "distance")
        .distinct()
    )
    # 4. exact similarity
    near = checkpointed(near)
    near = checkpointed(weighted_similarity(near, items).filter(F.col("similarity") >= similarity))
    best = cut.join(near, ["_item", "_k", "_window"]).groupBy("_id", "_item").agg(
        F.max_by(F.struct("similarity", "distance", "_start", "_n"), F.struct("similarity", -F.col("_start"))).alias("_b")
    )
    return best.select(
        F.col("_id").alias(id_col), F.col("_item").alias("item_id"), F.col("_b.similarity").alias("similarity"),
        F.col("_b.distance").alias("distance"), F.col("_b._start").alias("start_word"), F.col("_b._n").alias("n_words"),
    )
