"""Operator 8: quality classifier by regularised quadratic discriminant analysis.

Every document is a vector of transformed statistics (logs of rates, smoothed so that short and empty texts
have defined values).  Class means and covariances come from one distributed aggregation over all labelled
rows outside the held-out fold (sums of products, merged on the map side; two rows reach the driver).
Each class covariance is shrunk towards the pooled one and towards its own mean variance, factored once by
Cholesky, and the inverse factors are put into the scoring plan as constants: a score is the logistic of the
difference of the classes' log densities (Mahalanobis term and log determinant) plus the log prior odds.
Scoring is built-in functions only.

Edge cases: null text is empty; null ids match no label; repeated label rows count as often as they are
there; with no labelled rows at all every score is 0.5, with one class only the score is that class's prior
smoothed by one row; an empty table gives no rows; extra columns are kept by ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, whole_row
from .stats import SYMBOLS, count_of, duplicate_lines, lines_with_words, text_words, word_chars

THRESHOLD = 0.7
TO_POOLED, TO_ROUND, FLOOR = 0.1, 0.05, 1e-3
HELD_OUT_FOLD, FOLDS = 2, 4
FEATURES = ("words", "word_length", "symbols", "bars", "capitals", "shouts", "digits", "variety", "repeated_lines", "stops", "commas")


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and one double a feature."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = {
        "__words": text_words(text),
        "__chars": word_chars(text),
        "__lines": lines_with_words(text),
        "__symbols": count_of(text, SYMBOLS.replace("|", "")),
        "__bars": count_of(text, "|"),
        "__capitals": count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÑÓÖÚÜ"),
        "__shouts": count_of(text, "!"),
        "__digits": count_of(text, "0123456789"),
        "__stops": count_of(text, ".?"),
        "__commas": count_of(text, ",;:"),
    }
    raw = docs.select(*keep, *[c.alias(n) for n, c in counts.items()])
    n, chars = F.size("__words").cast("double"), F.col("__chars").cast("double")
    by_char = lambda c: F.log((F.col(c) + 0.5) / (chars + 20))
    by_word = lambda c: F.log((F.col(c) + 0.5) / (n + 5))
    values = (
        F.log1p(n),
        F.log((chars + 25) / (n + 5)),
        by_char("__symbols"),
        by_char("__bars"),
        by_char("__capitals"),
        by_char("__shouts"),
        by_char("__digits"),
        F.log((F.size(F.array_distinct("__words")) + 5) / (n + 5)),
        F.log((duplicate_lines(F.col("__lines")) + 0.5) / (F.size("__lines") + 5)),
        by_word("__stops"),
        by_word("__commas"),
    )
    return raw.select(*keep, *[v.alias(f) for f, v in zip(FEATURES, values, strict=True)])


@dataclass
class Gaussian:
    """A class: mean, inverse Cholesky factor of its covariance, log determinant, log prior."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: float
    log_prior: float

    def log_density(self) -> Column:
        centred = [F.col(f) - float(m) for f, m in zip(FEATURES, self.mean, strict=True)]
        rows = (reduce(add, [float(self.inverse[i, j]) * centred[j] for j in range(i + 1)]) for i in range(len(centred)))
        return F.lit(self.log_prior - 0.5 * self.log_det) - 0.5 * reduce(add, [r * r for r in rows])


@dataclass
class Discriminant:
    classes: dict[int, Gaussian]
    prior: float

    def score(self) -> Column:
        if len(self.classes) < 2:
            return F.lit(self.prior)
        odds = self.classes[1].log_density() - self.classes[0].log_density()
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), odds))))


def fit(labelled: DataFrame, label: str = "quality") -> Discriminant:
    """``labelled``: features and a 0/1 label. One aggregation; the driver gets a row a class."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r[label]: r for r in labelled.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums).collect()}
    total, d = sum(r["n"] for r in rows.values()), len(FEATURES)
    prior = (rows[1]["n"] + 1 if 1 in rows else 1) / (total + 2)
    if len(rows) < 2:
        return Discriminant({}, prior)
    means, scatters = {}, {}
    for k, r in rows.items():
        means[k] = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        scatters[k] = products - r["n"] * np.outer(means[k], means[k])
    pooled = sum(scatters.values()) / total
    classes = {}
    for k, r in rows.items():
        own = (scatters[k] + d * pooled) / (r["n"] + d)
        shrunk = (1 - TO_POOLED - TO_ROUND) * own + TO_POOLED * pooled + (TO_ROUND * np.trace(own) / d + FLOOR) * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        classes[k] = Gaussian(means[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), float(np.log(r["n"] / total)))
    return Discriminant(classes, prior)


def held_out() -> Column:
    """Whether a row belongs to the fold that no label is learnt from. Null ids: false, as they have no label."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    known = scratch.keep(features(docs, ["doc_id"]).withColumn("held_out", held_out()), "features")
    train = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull())
    model = fit(known.filter(~F.col("held_out")).join(train, "doc_id"))
    return known.select("doc_id", "held_out", model.score().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` predicted good, all columns as they are. Features are counted twice, to fit and to score: rows are neither written nor shuffled."""
    train = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull())
    narrow = scratch.keep(features(docs.filter(~held_out()), ["doc_id"]).join(train, "doc_id"), "train")
    model = fit(narrow)
    scored = features(docs.withColumn("__row", whole_row(docs)), ["__row"])
    return scored.filter(model.score() >= THRESHOLD).select("__row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op8"))
