"""Source divergence audit: how far the sources of a language are from one another, and which terms mark each.

A term's share in a group is an integer: p = 1 + floor(10**9 (count + 5) / (N + 5 V)), with V terms that the group's
language keeps and N the group's occurrences of them. So a term that a group lacks has a share too, z, the same for all
such terms, and the divergence of two groups g, h is a sum over all V terms that needn't touch most of them:

1. baseline: as if neither held any term, V * |z_g - z_h|;
2. each term that g holds corrects that by |p_g - z_h| - |z_g - z_h|, the same for all terms of one count, so g's
   postings are counted by that before they meet the other groups; likewise h's;
3. a term that both hold was corrected twice: the inverted index of postings joins them by term and emits what is left,
   |p_g - p_h| - |p_g - z_h| - |z_g - p_h| + |z_g - z_h|, where it isn't zero.

Sums are exact: counts go through 38 digits, shares and divergences are long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import byte_slices, tidy
from .common import checkpointed, small_side

#: Documents of its language that a term must be in, and terms reported for each group.
LEAST_DOCS, TOP_TERMS = 30, 50
#: Counts that a task holds before it passes them on, and bytes of a text that are cut into terms at once.
HELD, WINDOW = 200_000, 1 << 20

#: Letters of ASCII, and all bytes of characters beyond it.
_term = re.compile(rb"[A-Za-z\x80-\xFF]+")
_break = re.compile(rb"[^A-Za-z\x80-\xFF]")
_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def term_counts(text: bytes, window: int = WINDOW) -> Counter:
    """Occurrences of each term in UTF-8 text, A-Z lower-cased; the text is cut at a term's end after each ``window`` bytes."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        cut = _break.search(text, at + window)
        end = cut.start() if cut else len(text)
        found.update(_term.findall(text[at:end].translate(_lower)))
        at = end
    return found


def group_term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) from rows (lang, source, text): occurrences and documents; counted by task, then by shuffle."""
    names = ["lang", "source", "term", "n", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = {}
        holders: dict[tuple[str, str], Counter] = {}

        def flush() -> pa.RecordBatch:
            keys = [(*g, t, n, holders[g][t]) for g, c in times.items() for t, n in c.items()]
            times.clear()
            holders.clear()
            columns = list(zip(*keys, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], names)

        held = 0
        for b in batches:
            groups = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for first, end, data, at in byte_slices(b.column(2)):
                for i in range(end - first):
                    one, g = term_counts(data[at[i] : at[i + 1]].tobytes()), groups[first + i]
                    mine = times.setdefault(g, Counter())
                    before = len(mine)
                    mine.update(one)
                    holders.setdefault(g, Counter()).update(one.keys())
                    held += len(mine) - before
                    if held > HELD:
                        yield flush()
                        held = 0
        yield flush()

    return docs.mapInArrow(tidy(run), "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(count: str, total: str, terms: str = "v") -> Column:
    """1 + floor(10**9 (count + 5) / (total + 5 terms)), null without any term."""
    wide = "cast({} as decimal(25,0))"
    return F.expr(f"case when {terms} > 0 then 1 + (cast(1000000000 as decimal(10,0)) * ({wide.format(count)} + 5)) div ({wide.format(total)} + 5 * {terms}) end")


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of rows with one lang and source.

    Part ``pair``: each other source of the lang, with the sum over all kept
    terms of the difference of both shares (0 where the lang keeps no term).
    Part ``term``: kept terms that the group holds more of than its lang does,
    with the difference, the ``top_terms`` largest. Ranks go by value, then by
    the item's bytes. Null text, lang and source count as empty; each row is a
    document, so repeated rows count again; a text may be of any length. A lang
    of one source has no pairs, a group without terms none of part ``term``. An
    empty table gives an empty result. Other columns aren't read.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = checkpointed(group_term_counts(rows))
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n_lang")).filter(F.col("d") >= least_docs)
    kept = checkpointed(kept.drop("d"))
    postings = checkpointed(counts.join(kept, ["lang", "term"]).select("lang", "term", "source", "n", "n_lang"))

    # one row for each group, and for each lang
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_all"))
    groups = rows.select("lang", "source").distinct().join(postings.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["n_group", "v", "n_all"]).withColumn("none", F.lit(0))
    groups = checkpointed(groups.withColumn("z", _share("none", "n_group")).drop("none"))
    groups = small_side(groups)
    shares = postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "z", "n_lang", "n_all", "v", _share("n", "n_group").alias("p"))

    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    one = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    baseline = one.join(two, "lang").filter("a < b").select("lang", "a", "b", F.coalesce(F.col("v") * gap("za", "zb"), F.lit(0)).alias("value"))
    held = shares.groupBy("lang", F.col("source").alias("a"), F.col("z").alias("za"), F.col("p").alias("pa")).agg(F.count("*").alias("terms"))
    held = held.join(two, "lang").filter("a <> b").withColumn("each", gap("pa", "zb") - gap("za", "zb"))
    corrections = held.filter("each <> 0").select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("terms") * F.col("each")).alias("value"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    twice = left.join(right, ["lang", "term"]).filter("a < b").select("lang", "a", "b", (gap("pa", "pb") - gap("pa", "zb") - gap("za", "pb") + gap("za", "zb")).alias("value")).filter("value <> 0")
    sums = baseline.unionByName(corrections).unionByName(twice).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", "value", sides.alias("_s")).select("lang", "_s.source", F.lit("pair").alias("part"), "_s.item", "value")
    terms = shares.withColumn("value", F.col("p") - _share("n_lang", "n_all")).filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    out = lambda x: x.select("lang", "source", "part", "item", "value", rank)
    return out(pairs).unionByName(out(terms).filter(F.col("rank") <= top_terms))
