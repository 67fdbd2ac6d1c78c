"""N-gram Jaccard join by filters under several global token orders.

A text's set holds the hashes of its distinct five-word shingles. For sets A, B
of Jaccard similarity s or more, the overlap is at least ceil(s|A|) and
ceil(s|B|). Under any one order of all tokens, prefixes of |A| - overlap + k
tokens then share at least k tokens.

1. Rising hashes need no counts. With k a tenth of the set, a set stays only if
   it shares that many prefix tokens with others.
2. Rarity among the sets that stay: tokens of one set only come first, so most
   sets run out of prefix before a shared token. Passages that many texts share
   are common, come last, and make no candidates. Sets whose prefixes hold one
   token are a list; a candidate is a pair from a list.
3. A candidate is verified only if its two prefixes also share a token under
   rising hashes, and under falling hashes: the three filters are intersected
   pair by pair.

Verification is exact and needs not all pairs of a list: its least set is
compared with its others, and what that links is one component. Pairs inside a
component need no check. Of the rest, short lists go pair by pair. A long list
is cut into blocks by component and by length, and only blocks that may hold
similar sets of different components meet.

Equal sets are one set throughout, so exact copies add nothing to the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import tidy
from .common import BROADCAST_KEYS, checkpointed, release, small_side
from .components import connected_components
from .shingles import WORDS, shingle_sets

#: Lists of at most so many sets are checked pair by pair, longer ones in blocks of about so many sets or tokens.
SHORT_LIST = 64
BLOCK, BLOCK_TOKENS = 256, 1 << 18
#: One in so many of a set's tokens must be shared under the first order.
SHARE = 10
#: Bits of tokens and signatures under the first order, where a collision only weakens the filter.
NARROW = 48
#: Signatures that a task remembers.
REMEMBER = 100_000


def _need(n: Column | np.ndarray | int, percent: int):
    """Least overlap of a set of n tokens with any partner: ceil(percent n / 100)."""
    up = percent * n + 99
    return F.floor(up / 100) if isinstance(n, Column) else up // 100


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two numbers: of 10**10 sets no two are likely to share them."""
    import xxhash

    both = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def _prefixes(docs: DataFrame, percent: int, words: int, share: int) -> DataFrame:
    """(_id, _key, _s1, _s2, _n, _p): each row's set, and its first-order prefix where the task hasn't just sent that set.

    Prefix tokens are cut to their first ``NARROW`` bits, which keeps the order.
    """
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for b in batches:
            one, two, n, prefix = [], [], [], []
            for known, tokens in zip(b.column(0).is_valid().to_pylist(), shingle_sets(b.column(2), words), strict=True):
                n.append(len(tokens))
                key = _signature(tokens) if len(tokens) and known else None
                one.append(key and key[0])
                two.append(key and key[1])
                if key is None or key in sent:
                    prefix.append(tokens[:0].view(np.int64))
                else:
                    if len(sent) >= REMEMBER:
                        sent.clear()
                    sent.add(key)
                    need = _need(len(tokens), percent)
                    prefix.append((tokens[: len(tokens) - need + max(1, len(tokens) // share)] >> np.uint64(64 - NARROW)).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefix], dtype=np.int64))).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n, pa.int64()), lists], ["_id", "_key", "_s1", "_s2", "_n", "_p"])

    return docs.mapInArrow(tidy(run), f"_id {kind}, _key long, _s1 long, _s2 long, _n long, _p array<long>")


def _whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """(sig, n, tokens) of rows (sig, _s1, _s2, _text) whose text has that signature; once a task, where a row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            sets = []
            for s, s1, s2, t in zip(*(b.column(i).to_pylist() for i in range(3)), shingle_sets(b.column(3), words), strict=True):
                if len(t) and s not in sent and _signature(t) == (s1, s2):
                    if len(sent) >= REMEMBER:
                        sent.clear()
                    sent.add(s)
                    sets.append((s, t.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in sets], pa.int64()), pa.array([len(t) for _, t in sets], pa.int64()), pa.array([t for _, t in sets], pa.list_(pa.int64()))],
                ["sig", "n", "tokens"],
            )

    whole = checkpointed(docs.mapInArrow(tidy(run), "sig long, n long, tokens array<long>"))
    repeated = checkpointed(whole.groupBy("sig").agg(F.count("*").alias("_m")).filter("_m > 1").select("sig"))
    if repeated.isEmpty():  # the tokens needn't be shuffled
        return whole
    return checkpointed(whole.join(repeated, "sig", "left_anti").unionByName(whole.join(repeated, "sig", "left_semi").dropDuplicates(["sig"])))


def _similar(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def _share_ends(percent: int) -> Column:
    """Whether the sets _ta and _tb, sorted by hash, share a prefix token under rising hashes and one under falling hashes."""

    def prefix(tokens: str, falling: bool) -> Column:
        n = F.size(tokens)
        k = (n - _need(n, percent) + 1).cast("int")
        return F.slice(tokens, n - k + 1 if falling else F.lit(1), k)

    return F.arrays_overlap(prefix("_ta", False), prefix("_tb", False)) & F.arrays_overlap(prefix("_ta", True), prefix("_tb", True))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar: candidates under the rarity order that are ones under both hash orders, verified."""
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("_ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("_tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb").filter(_share_ends(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                lists = [[np.asarray(x.values) for x in part.column(c)] for c in (2, 3)]
                keep = [bool(_similar(np.intersect1d(x, y, assume_unique=True).size, len(x), len(y), percent)) for x, y in zip(*lists, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long")


def _shared_counts(parts: list[np.ndarray]) -> np.ndarray:
    """For every two of the token arrays, how many tokens they share."""
    flat, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times >= 2
    number = np.cumsum(shared) - 1
    inside = shared[token]
    token, owner = number[token[inside]], owner[inside]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    overlap = np.zeros((len(parts), len(parts)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(token, [low, low + 4096])
        has = np.zeros((len(parts), 4096), np.float32)
        has[owner[a:b], token[a:b] - low] = 1
        overlap += has @ has.T
    return overlap


def _block_links(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks, or inside one, that join components: a forest, not all pairs."""
        sig, label, tokens = group["sig"].to_numpy(), group["label"].to_numpy(), group["tokens"].to_list()
        sizes = np.array([len(t) for t in tokens], np.int64)
        prefix = sizes - _need(sizes, percent) + 1
        may = np.triu(label[:, None] != label[None, :], 1) & (100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes))
        if group["_b1"].iloc[0] != group["_b2"].iloc[0]:
            side = group["_side"].to_numpy()
            may &= side[:, None] != side[None, :]
        for ends in ((t[:k] for t, k in zip(tokens, prefix, strict=True)), (t[len(t) - k :] for t, k in zip(tokens, prefix, strict=True))):
            if may.any():
                may &= _shared_counts(list(ends)) > 0
        use = np.flatnonzero(may.any(axis=0) | may.any(axis=1))
        found: list[tuple[int, int]] = []
        if len(use):
            may, sig, label, sizes = may[np.ix_(use, use)], sig[use], label[use], sizes[use]
            x, y = np.nonzero(may & _similar(_shared_counts([tokens[i] for i in use]), sizes[:, None], sizes[None, :], percent))
            root = {v: v for v in label.tolist()}

            def find(v):
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if (p := find(int(label[i]))) != (q := find(int(label[j]))):
                    root[max(p, q)] = min(p, q)
                    found.append((sig[i], sig[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _blocks(lists: DataFrame, percent: int, block: int) -> DataFrame:
    """(t, _b1, _b2, _side, sig, label) from long lists (t, sig, n, label): pairs of blocks that may hold similar sets of different components.

    A block holds sets of one length class; of one component, if that fills a
    block by itself, else of several small ones. Blocks meet if their classes are
    the same or next to each other, unless both are of one component. Where most
    sets of a list are linked already, the others' blocks meet all, but those
    don't meet one another.
    """
    # sets of similar lengths are in one class or in two that are next to each other
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    rows = lists.select("t", "sig", "n", "label", band.alias("_band"))
    sizes = rows.groupBy("t", "_band", "label").agg(F.count("*").alias("_c"), F.sum("n").alias("_w"))
    many = lambda c, w: F.greatest(F.ceil(F.col(c) / block), F.ceil(F.col(w) / BLOCK_TOKENS)).cast("int")
    sizes = sizes.withColumn("_parts", many("_c", "_w")).withColumn("_own", F.when(F.col("_parts") > 1, F.col("label")))
    groups = checkpointed(sizes.groupBy("t", "_band", "_own").agg(F.sum("_c").alias("_c"), F.sum("_w").alias("_w")).withColumn("_parts", many("_c", "_w")))
    meet = lambda x: groups.select("t", *(F.col(c).alias(f"{c}{x}") for c in ("_band", "_own", "_parts")))
    pairs = meet(1).join(meet(2), "t").filter("abs(_band1 - _band2) <= 1 and not coalesce(_own1 = _own2, false)")
    # from each set's side: the blocks of the other group, of its own group too where that is of small components
    pairs = pairs.select("t", F.col("_band1").alias("_band"), F.col("_own1").alias("_own"), F.col("_parts1").alias("_parts"), "_band2", "_own2", "_parts2")
    placed = rows.join(sizes.select("t", "_band", "label", "_own"), ["t", "_band", "label"])
    # small components stay whole
    spread = F.xxhash64(F.when(F.col("_own").isNull(), F.col("label")).otherwise(F.col("sig")))
    name = lambda band, own, part: F.concat_ws(":", band, F.coalesce(own.cast("string"), F.lit("-")), part)
    met = (
        placed.join(pairs.withColumnRenamed("t", "_t").withColumnRenamed("_band", "_bb").withColumnRenamed("_own", "_oo"), (F.col("t") == F.col("_t")) & (F.col("_band") == F.col("_bb")) & F.col("_own").eqNullSafe(F.col("_oo")))
        .withColumn("_part", F.pmod(spread, F.col("_parts").cast("long")))
        .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts2") - 1)))
    )
    here, there = name(F.col("_band"), F.col("_own"), F.col("_part")), name(F.col("_band2"), F.col("_own2"), F.col("_with"))
    return met.select("t", "sig", "label", F.least(here, there).alias("_b1"), F.greatest(here, there).alias("_b2"), (here <= there).alias("_side"))


def _sets(rows: DataFrame) -> DataFrame:
    """(_s1, _s2, _n, _first, _pick): each distinct set, the smallest id of its rows, and the key of one of them."""
    return rows.filter("_s1 is not null").groupBy("_s1", "_s2").agg(F.first("_n").alias("_n"), F.min("_id").alias("_first"), F.min("_key").alias("_pick"))


def _first_order(base: DataFrame, percent: int, words: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _key, _s1, _s2, _n), and the sets (sig, _s1, _s2, _first, _pick) that share enough of their prefix with others, numbered by sig."""
    sent = checkpointed(_prefixes(base, percent, words, share))
    rows = checkpointed(sent.select("_id", "_key", "_s1", "_s2", "_n"))
    # a set that several tasks sent only passes more easily
    tokens = sent.select(F.shiftrightunsigned("_s1", 64 - NARROW).alias("_s"), F.explode("_p").alias("_t"))
    shared = checkpointed(tokens.groupBy("_t").agg(F.count("*").alias("_m")).filter("_m > 1").select("_t"))
    release(base.sparkSession)  # the shuffle that counted, before the next one is written
    counts = tokens.join(shared.hint("shuffle_hash"), "_t").groupBy("_s").agg(F.count("*").alias("_c"))
    least = F.greatest(F.lit(1), F.floor(F.col("_n") / share))
    keyed = _sets(rows).withColumn("_s", F.shiftrightunsigned("_s1", 64 - NARROW))
    stay = counts.join(keyed, "_s").filter(F.col("_c") >= least)
    return rows, checkpointed(stay.select(F.monotonically_increasing_id().alias("sig"), "_s1", "_s2", "_first", "_pick"))


def _second_order(whole: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists (t, sig, n) of the sets whose prefix by rarity holds a token, and the whole sets that are in lists."""
    each = whole.select("sig", "n", F.explode("tokens").alias("t"))
    times = checkpointed(each.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1"))
    release(whole.sparkSession)
    ranked = (
        each.join(times.hint("shuffle_hash"), "t")
        .groupBy("sig", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("_r"))
        .withColumn("_left", (F.col("n") - _need(F.col("n"), percent) + 1 - (F.col("n") - F.size("_r"))).cast("int"))
        .filter("_left > 0")
    )
    lists = checkpointed(ranked.select("sig", "n", F.explode(F.slice("_r", F.lit(1), F.col("_left"))).alias("_e")).select(F.col("_e.t").alias("t"), "sig", "n"))
    return lists, checkpointed(_only(whole, lists))


def _only(whole: DataFrame, lists: DataFrame) -> DataFrame:
    """The sets that are in ``lists``."""
    listed = checkpointed(lists.select(F.col("sig").alias("_in")).distinct())
    return whole.join(small_side(listed), whole["sig"] == listed["_in"], "left_semi")


def may_fit(a: str, b: str, percent: int) -> Column:
    """Whether sets of so many tokens can be similar at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def open_links(lists: DataFrame, found: DataFrame, whole: DataFrame, percent: int, short_list: int, block: int) -> DataFrame:
    """Links (a, b) between sets that a list (t, sig, n) holds and that are in different components of ``found``."""
    labelled = checkpointed(lists.join(found, lists["sig"] == found["node"], "left").select("t", "sig", "n", F.coalesce("label", "sig").alias("label")))
    digest = F.xxhash64("sig")
    mixed = (
        labelled.groupBy("t")
        .agg(F.count("*").alias("m"), F.bit_xor(digest).alias("_x"), F.sum(digest.cast("decimal(38,0)")).alias("_y"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        .filter("_lo <> _hi")
        .groupBy("m", "_x", "_y")  # lists of the same sets are one
        .agg(F.min("t").alias("t"))
        .select("t", "m")
    )
    open_lists = checkpointed(labelled.join(checkpointed(mixed), "t"))
    whole = checkpointed(_only(whole, open_lists))
    short = open_lists.filter(F.col("m") <= short_list)
    one, two = (short.select("t", F.col("sig").alias(x), F.col("n").alias(f"_n{x}"), F.col("label").alias(f"_l{x}")) for x in "ab")
    rest = one.join(two, "t").filter((F.col("a") < F.col("b")) & (F.col("_la") != F.col("_lb")) & may_fit("_na", "_nb", percent)).select("a", "b").distinct()
    more = _verified(rest, whole, percent)
    long = open_lists.filter(F.col("m") > short_list)
    if not long.isEmpty():
        blocks = _blocks(long, percent, block).join(whole.select("sig", "tokens"), "sig")
        more = more.unionByName(blocks.groupBy("t", "_b1", "_b2").applyInPandas(_block_links(percent), "a long, b long"))
    return more


def with_components(rows: DataFrame, stay: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """(id, n_shingles, component_id) of ``rows``: sets that are linked take their component's smallest id, all others their own."""
    linked = found.join(stay, found["node"] == stay["sig"]).select("_s1", "_s2", "label", "_first")
    smallest = linked.groupBy("label").agg(F.min("_first").alias("_c"))
    linked = checkpointed(linked.join(smallest, "label").select(F.col("_s1").alias("_k1"), F.col("_s2").alias("_k2"), "_c"))
    sets = _sets(rows)
    component = sets.join(linked, (sets["_s1"] == linked["_k1"]) & (sets["_s2"] == linked["_k2"]), "left").select(
        F.col("_s1").alias("_k1"), F.col("_s2").alias("_k2"), F.coalesce("_c", "_first").alias("_c")
    )
    component = checkpointed(component)
    return rows.join(component, (F.col("_s1") == F.col("_k1")) & (F.col("_s2") == F.col("_k2")), "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_c", "_id").alias("component_id")
    )


def jaccard_components(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", short_list: int = SHORT_LIST, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id.

    Two texts link when 100 * intersection >= percent * union of their sets;
    ``component_id`` is the smallest id reachable by links, a row's own
    included. Texts without words, null or empty, have no shingles and link
    with nothing; rows without an id link with nothing and get a null
    component. Repeated rows share a component. An empty table gives an empty
    result. Only the two named columns are read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    base = base.select("_id", F.xxhash64("_id", "_text").alias("_key"), "_text")
    rows, stay = _first_order(base, percent, words, share)
    release(docs.sparkSession)
    picked = base.join(small_side(stay.select("sig", "_s1", "_s2", "_pick"), BROADCAST_KEYS), F.col("_key") == F.col("_pick")).select("sig", "_s1", "_s2", "_text")
    lists, whole = _second_order(_whole_sets(picked, words), percent)
    release(docs.sparkSession)

    # each list's least set against its others
    least_of = lists.groupBy("t").agg(F.min(F.struct("sig", "n")).alias("_m"))
    pairs = lists.join(least_of, "t").filter((F.col("sig") != F.col("_m.sig")) & may_fit("n", "_m.n", percent))
    links = checkpointed(_verified(pairs.select(F.col("_m.sig").alias("a"), F.col("sig").alias("b")).distinct(), whole, percent))
    more = open_links(lists, connected_components(links), whole, percent, short_list, block)
    return with_components(rows, stay, connected_components(links.unionByName(more)), id_col)
