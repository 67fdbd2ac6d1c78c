"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. Lexicon. Its units are words and prefixes that go on (``stem*``, four to
   eight letters), so inflected and compounded forms count. A unit's weight is
   the lower bound of its log odds between toxic and other labelled documents,
   counted over the sample by Spark.
2. Features, all dense: densities of lexicon hits, hits near a second person,
   capitals, punctuation and obfuscation. A training row's features use the
   lexicon of the other folds, so no row vouches for itself.
3. Boosted trees are fitted on all folds but one; on that one, isotonic
   regression turns their margin into a probability.

Labels serve for fitting only. The labelled sample has a documented bound,
``max_train`` rows; everything else sees all rows and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import byte_slices, sums_by_row, tidy
from .common import checkpointed, small_side

FOLDS = 4
#: Most labelled rows that the model is fitted on; a hash of the id picks them.
MAX_TRAIN = 16_000
PREFIXES = range(4, 9)
#: Toxic documents of the sample, less one fold, that a unit must be in, and what its lower bound must be above.
SUPPORT, LEAST_BOUND = 3, 0.8
NEAR = 4
FEATURES = ("words", "density", "hits", "kinds", "strongest", "mean_hit", "second_person", "capitals", "shouts", "punctuation", "obfuscated", "masked_hits")
#: Second persons in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch ihr sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os".split())
#: Words that a worker remembers, of at most so many characters; longer ones count by their prefixes only.
REMEMBER, LONG_WORD = 50_000, 100
#: Counts of units that a task holds before it passes them on.
HELD = 100_000

_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Letters with marks between them. It starts at a run's first letter and gives no letter back, so a long run is read once.
_masked = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*|+.\-]{1,2}+[^\W\d_]++)++")
_plain = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": None, ".": None, "-": None, "2": None, "6": None, "8": None, "9": None})


def held_out(id_col: str | Column) -> Column:
    """Whether crc32 of the id as text is a multiple of five; a null id counts as the empty text."""
    text = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 5 == 0


def units_of(word: str) -> list[str]:
    return [*([word] if len(word) <= LONG_WORD else []), *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def _unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, t0, t1, …, c0, c1, …): toxic and other documents of each fold that hold a unit; task by task, then by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*((*k, n) for k, n in found.items()), strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["y", "fold", "unit", "n"])

        for b in batches:
            for y, fold, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found.update((y, fold, u) for u in {u for w in set(_word.findall(text.lower())) for u in units_of(w)})
                if len(found) > HELD:
                    yield flush()
        yield flush()

    sent = sample.select("_y", "_fold", "_text").mapInArrow(tidy(run), "y int, fold int, unit string, n long")
    return sent.groupBy("unit").agg(*(F.sum(F.when((F.col("fold") == k) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"{name}{k}") for y, name in ((1, "t"), (0, "c")) for k in range(FOLDS)))


def _weight(toxic: np.ndarray, clean: np.ndarray, without: int | None) -> Column:
    """A unit's weight from its counts by fold, leaving out one fold: the lower bound of its log odds; null for weak units."""
    use = [k for k in range(FOLDS) if k != without]
    held = sum((F.col(f"t{k}") for k in use), F.lit(0))
    t, c = held + 0.5, sum((F.col(f"c{k}") for k in use), F.lit(0)) + 0.5
    bound = F.log(t / float(toxic[use].sum() + 1)) - F.log(c / float(clean[use].sum() + 1)) - F.sqrt(1 / t + 1 / c)
    return F.when((held >= SUPPORT) & (bound > LEAST_BOUND), F.round(bound, 4))


def weights(counts: DataFrame, toxic: np.ndarray, clean: np.ndarray) -> list[dict[str, float]]:
    """Lexicons without each fold in turn, and the whole one. Only units that have a weight in one of them leave the executors."""
    names = [f"w{k}" for k in range(FOLDS + 1)]
    found = counts.select("unit", *(_weight(toxic, clean, k if k < FOLDS else None).alias(n) for k, n in enumerate(names)))
    found = found.filter(F.coalesce(*names).isNotNull()).toArrow()
    units = found["unit"].to_pylist()
    return [{u: w for u, w in zip(units, found[n].to_pylist(), strict=True) if w is not None} for n in names]


def _features(docs: DataFrame, lexicons: list[dict[str, float]], keep: str) -> DataFrame:
    """``keep`` columns and ``_x`` of rows (…, _lexicon, _text), with the lexicon of that number."""

    def scorer(lexicon: dict[str, float]):
        known: dict[str, float] = {}

        def score(word: str) -> float:
            if (x := known.get(word)) is None:
                x = max((lexicon.get(u, 0.0) for u in units_of(word)), default=0.0)
                if len(word) <= LONG_WORD:
                    if len(known) > REMEMBER:
                        known.clear()
                    known[word] = x
            return x

        return score

    def words_part(text: str, score) -> tuple[float, ...]:
        low = text.lower()
        words = _word.findall(low)
        each = list(map(score, words))
        hits = [i for i, x in enumerate(each) if x]
        near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        masked = [m[0] for m in _masked.finditer(low)]
        uncovered = sum(score(m.translate(_plain)) > 0 for m in masked)
        n, total = max(1, len(words)), sum(each[i] for i in hits)
        return (
            math.log1p(len(words)), total / n, math.log1p(len(hits)), math.log1p(len({words[i] for i in hits})),
            max((each[i] for i in hits), default=0.0), total / max(1, len(hits)), near / n, len(masked) / n, math.log1p(uncovered),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = [scorer(x) for x in lexicons]
        for b in batches:
            rows, which = [], b.column(b.num_columns - 2).to_pylist()
            for first, end, data, at in byte_slices(b.column(b.num_columns - 1)):
                upper = sums_by_row((data >= 65) & (data <= 90), at)
                letters = upper + sums_by_row((data >= 97) & (data <= 122), at)
                shouts = sums_by_row((data == 33) | (data == 63), at)
                marks = sums_by_row((data > 32) & (data < 127), at) - letters - sums_by_row((data >= 48) & (data <= 57), at)
                size = np.maximum(1, np.diff(at))
                for i in range(end - first):
                    w = words_part(data[at[i] : at[i + 1]].tobytes().decode(), score[which[first + i]])
                    rows.append([*w[:7], upper[i] / max(1, letters[i]), shouts[i] / size[i], marks[i] / size[i], *w[7:]])
            x = pa.array([[float(v) for v in r] for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], x], [*b.schema.names[:-2], "_x"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep.split())
    return docs.select(*keep.split(), "_lexicon", "_text").mapInArrow(tidy(run), f"{kinds}, _x array<double>")


@dataclass
class ToxicityModel:
    """A fitted model; without trees (one class only) every score is ``rate``."""

    lexicon: dict[str, float]
    rate: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    #: What the calibration's rows were scored with: the lexicon of the other folds.
    fold_lexicon: dict[str, float] | None = None


def _margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows.withColumn("features", array_to_vector("_x")))
    return scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, trees: int = 25) -> ToxicityModel:
    """A model from the labelled rows that aren't held out.

    At most about ``max_train`` of them are used; a hash of the id picks them.
    An id with several labels counts as toxic if one says so; null labels and
    ids are left out. Without labels the score is 0, with one class only it is
    that class's.
    """
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_lid")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    total = ids.count()
    if total > max_train:
        ids = ids.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "_lid"), F.lit(1 << 20)) < int((1 << 20) * max_train / total))
    ids = checkpointed(ids)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sample = texts.join(small_side(ids), F.col("_id") == F.col("_lid")).select(F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("_fold"), "_y", "_text")
    sample = checkpointed(sample)
    size = np.zeros((2, FOLDS))
    for r in sample.groupBy("_y", "_fold").count().collect():
        size[r[0], r[1]] = r[2]
    toxic, clean = size[1], size[0]
    rate = float(toxic.sum() / size.sum()) if size.sum() else 0.0
    if not toxic.sum() or not clean.sum():
        return ToxicityModel({}, rate)

    *lexicons, whole = weights(_unit_counts(sample), toxic, clean)

    rows = _features(sample.withColumn("_lexicon", F.col("_fold")), lexicons, "_fold _y").withColumn("label", F.col("_y").cast("double"))
    rows = checkpointed(rows.coalesce(4))
    last = F.col("_fold") == FOLDS - 1
    both = bool(size[:, :-1].sum(axis=1).all() and size[:, -1].all())
    fit = rows.filter(~last) if both else rows  # a tiny sample is used twice
    booster = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.2, minInstancesPerNode=3, maxBins=64, seed=17)
    model = booster.fit(fit.withColumn("features", array_to_vector("_x")).select("features", "label"))
    margins = checkpointed(_margin(model, rows.filter(last) if both else rows).select("label", "margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margins)
    return ToxicityModel(whole, rate, model, calibration, lexicons[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted.

    The score is a probability; null and empty texts get one like any other.
    Ids are passed on as they are; a null id is held out. Repeated rows get
    equal scores. An empty table gives an empty result. Only the two named
    columns are read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.lit(0).alias("_lexicon"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    if model.trees is None:
        scored = base.select("_id", F.lit(model.rate).alias("score"))
    else:
        margins = _margin(model.trees, _features(base, [model.lexicon], "_id"))
        scored = model.calibration.transform(margins.select("_id", "margin")).select("_id", "score")
    return scored.select(
        F.col("_id").alias(id_col), held_out("_id").alias("held_out"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"), (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
