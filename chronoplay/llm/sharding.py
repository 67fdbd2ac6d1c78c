"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked there; the
fractional rank ``(r - u) / n`` spreads every source evenly over (0, 1). The
offset u in (0, 1) is a seeded hash of the source, so that many sources of few
rows, which would else all have the same fractions, are spread as well.
Sorting by it interleaves the sources in proportion, so equal cuts of that
order all have the mixture of the whole.

Both rankings are exact and global, yet no task holds a source: rows are dealt
by leading digits of the hash (then by the fraction, which is uniform), bucket
counts give each bucket's first rank, and only a bucket is sorted in one task.
Rows that agree in all that is returned are counted first, and each copy gets a
hash of its own, so they are shuffled and dealt like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of the hash that make a bucket: 16**3 buckets a source.
DIGITS = 3
#: Copies of a row that one record makes at once.
COPIES = 4096


def stratified_shards(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digits: int = DIGITS) -> DataFrame:
    """One row for each row: id, size, text_crc32, law, shard, slot, grown_shard, fraction.

    Law ``rows``: counts of the shards differ by at most one. ``size`` is the
    text's UTF-8 bytes (null: none) plus one. ``slot`` counts from 0 in each
    shard without gaps. A null source is a source of its own; a null id is
    shuffled as the empty string; repeated rows get places of their own (which
    of two identical rows comes first is open), spread like other rows. An empty table gives an empty
    result; a table with fewer rows than shards leaves some shards empty. Only
    the named columns are read.
    """
    text = F.col(text_col).cast("string")
    buckets = 16**digits
    base = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_source"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("_size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("_crc"),
    )
    last = F.least(F.col("_m"), (F.col("_piece") + 1) * COPIES) - 1
    base = (
        base.groupBy(*base.columns).agg(F.count("*").alias("_m"))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {COPIES}"))))
        .withColumn("_copy", F.explode(F.sequence(F.col("_piece") * COPIES, last)))
        .withColumn("_hash", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), "_crc", "_size", "_copy")))
        .withColumn("_bucket", F.substring("_hash", 1, digits))
        .drop("_m", "_piece")
    )

    of_source = Window.partitionBy("_source")
    counts = (
        base.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(of_source.orderBy("_bucket")) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(of_source))
        .select("_source", "_bucket", "_before", "_total")
    )
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_id", "_crc", "_size", "_copy")
    offset = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_source")), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    ranked = (
        base.withColumn("_local", F.row_number().over(in_bucket))
        .join(counts, ["_source", "_bucket"])
        .withColumn("_f", (F.col("_before") + F.col("_local") - offset) / F.col("_total"))
        .withColumn("_slice", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)))
    )
    slices = ranked.groupBy("_slice").agg(F.count("*").alias("_n"))
    # at most `buckets` rows, whatever the input: the one window without keys
    slices = slices.withColumn("_start", F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy())
    )
    in_slice = Window.partitionBy("_slice").orderBy("_f", "_source", "_hash", "_id", "_crc", "_size", "_copy")
    placed = (
        ranked.withColumn("_at", F.row_number().over(in_slice) - 1)
        .join(slices.drop("_n"), "_slice")
        .withColumn("_pos", F.col("_start") + F.col("_at"))
        .withColumn("_shard", F.expr(f"(_pos * {shards}) div _all"))
    )
    first = F.expr(f"(_shard * _all + {shards - 1}) div {shards}")
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_pos") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_f").alias("fraction"),
    )
