"""Exact deduplication by skew-safe combining.

Equal texts are combined in three stages, and every stage compares the full
text beside its digest:

1. locally: the partial aggregation of each map task keeps one row a text;
2. among salted digest groups: the salt is the map partition's, so one task
   sends a text of any number of copies to one salt only, once;
3. globally: the salts' winners meet, at most ``salts`` rows a text.

The groups, a short row each, are checkpointed. Then each row looks up its
group by digest and length. Both sides of that join are dealt by the planner,
so adaptive execution splits a digest that a third of all rows share. Only if
two different texts were found to share a digest, a second look-up by digest
*and* text is planned for their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after replacing each run of ASCII
    white space by one space; null counts as empty. The smallest id of a group
    stays. Nulls: a row without an id never stays unless its whole group lacks
    ids (keep_id is then null). Repeated rows of one id all carry kept=true;
    they count in group_size. An empty table gives an empty result. Only the
    two named columns are read, so other columns may have any name. ``digest``
    may be a weak hash: different texts of one digest are kept apart.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.regexp_replace(text_or_empty(text_col), SPACES, " ").alias("_norm"))
    base = base.withColumn("_digest", digest(F.col("_norm")))
    salted = (
        base.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_norm", "_salt")
        .agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
    )
    classes = (
        salted.groupBy("_digest", "_norm")
        .agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))
        .withColumn("_len", F.octet_length("_norm"))
    )
    rows = base.select("_id", "_digest", F.octet_length("_norm").alias("_len"), F.sha2("_norm", 256).alias("_sha"))
    groups = checkpointed(
        classes.groupBy("_digest", "_len").agg(F.count("*").alias("_texts"), F.first("_keep").alias("_keep"), F.first("_size").alias("_size"))
    )
    found = rows.join(groups.filter("_texts = 1").drop("_texts"), ["_digest", "_len"])
    clash = groups.filter("_texts > 1").select("_digest", "_len")
    if not clash.isEmpty():
        whole = base.withColumn("_len", F.octet_length("_norm")).join(clash, ["_digest", "_len"], "left_semi")
        found = found.unionByName(
            whole.join(classes, ["_digest", "_norm", "_len"]).select("_digest", "_len", "_id", F.sha2("_norm", 256).alias("_sha"), "_keep", "_size")
        )
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
