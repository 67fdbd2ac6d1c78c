"""A corpus pipeline of five stages, each one operator over all rows that its predecessor kept.

1. toxicity: documents that the model rejects go;
2. exact dedup: of equal texts, the smallest id stays;
3. n-gram Jaccard join: of each group of near copies, the smallest id stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece: what is left is encoded.

A stage decides on rows, each by its id and its text (``row_key``). So rows
without an id are judged like all others, and where one id stands on different
texts, only the rows that were judged go. Of copies and near copies a row
without an id stays only if all of its group lack ids.

Null texts count as empty, texts may be of any length, and every stage passes
all columns of its documents on but the last, whatever their names: helper
columns take names that are free. An empty table passes all stages and gives an
empty result; without labels, or with one class only, nothing is toxic unless
all labels are; without benchmark items nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplay.llm.common import BROADCAST_KEYS, bound_batches, checkpointed, fresh, release, row_key, small_side, table, text_or_empty, text_sha, without
from chronoplay.llm.decontamination import contaminated
from chronoplay.llm.exact_dedup import SPACES, exact_dedup
from chronoplay.llm.jaccard_join import jaccard_components
from chronoplay.llm.queries import tokenizer_file
from chronoplay.llm.sentencepiece_codec import sentencepiece_codec
from chronoplay.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. The model learns from the labels of documents that are in ``docs``."""
    bound_batches(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scores = score_toxicity(docs.select(row_key().alias("_row"), "text"), model, id_col="_row")
    return without(docs, scores.filter("predicted = 1").select("_row"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; repeated rows of the id that stays go too."""
    row = fresh(docs, "_row")
    judged = checkpointed(exact_dedup(docs).select(row_key("doc_id", F.col("text_sha256")).alias(row), "kept"))
    key = row_key("doc_id", text_sha(F.regexp_replace(text_or_empty("text"), SPACES, " ")))
    left = without(docs, judged.filter(~F.col("kept")).select(row), key)
    again = checkpointed(judged.filter("kept").groupBy(row).count().filter("count > 1").select(row))
    if again.isEmpty():  # the texts needn't be shuffled
        return left
    again, left = small_side(again, BROADCAST_KEYS), left.withColumn(row, key)
    twice = left.join(again, row, "left_semi").dropDuplicates([row])
    return left.join(again, row, "left_anti").unionByName(twice).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: the smallest id's, and of that id's the one of the smallest key."""
    bound_batches(spark)
    no_id = F.when(F.col("doc_id").isNull(), F.lit(True))  # null comes before true
    ranked = docs.select(F.struct(no_id.alias("no_id"), "doc_id", row_key().alias("row")).alias("_rank"), "text")
    found = jaccard_components(ranked, id_col="_rank")
    return without(docs, found.filter("component_id <> _rank").select("_rank.row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contaminated(docs.select(row_key().alias("_row"), "text"), table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(docs, found.select("_row"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left, and whether decoding them gives the text again."""
    release(spark)  # what the other stages left on the executors
    bound_batches(spark)
    return sentencepiece_codec(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL has no twin of the models and tokenizers in these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result materialised for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
