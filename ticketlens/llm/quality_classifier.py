"""Operator 6: quality classifier by regularised quadratic discriminant.

Document statistics (counts per word, logs of smoothed shares) are column
expressions. Both classes get a Gaussian over the standardised statistics;
a class covariance is shrunk towards the pooled covariance and a scaled
identity. The moments are sums over all labelled rows that may be learned
from, so no sample is drawn; the driver gets one row per class. A score is
the logistic of prior plus the difference of the two Mahalanobis
log-densities, computed in tasks with the Cholesky factors of the fit.
Texts under ``FULL_WEIGHT`` words carry too few counts for a full verdict,
so their difference counts in proportion to their length.

Defined cases: a null text is an empty one; a text without words scores 0;
null doc_id: never held out, never learned from; null labels are not
learned from; repeated label rows count each; without labels of both
classes the score of a text with words is 0.5 (no labels) or the one
class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import NOT_SPACE, crc_mod, cut, let, text_or_empty, words
from ticketlens.llm.quality_rules import WORD_LIST, char_classes, repeated_lines

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SHRINKAGE = 0.2
FULL_WEIGHT = 30


def statistics(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """doc_id, n_words, x (the array of transformed statistics) and the
    columns to keep."""
    text = F.col("text")
    df = docs.select("doc_id", text_or_empty("text").alias("text"), *keep)
    df = df.select(
        "doc_id", *keep, words(text).alias("w"), F.length(text).alias("n_chars"), *char_classes(text),
        repeated_lines(text).alias("dup_lines"),
        F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))).alias("lines"),
        F.size(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D.,]+"), lambda x: x.isin(WORD_LIST))).alias("common"))
    df = df.select(
        "*", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("distinct"),
        let(F.col("w"), lambda w: F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: a == b), lambda e: e))).alias("echo"))

    def share(a, b):
        return F.log((F.col(a) + 0.5) / (F.col(b) + 1.0))

    df = df.withColumn("chars", F.col("n_chars") - F.col("c_space"))
    return df.select("doc_id", *keep, F.col("n").cast("long").alias("n_words"), F.array(
        F.log1p("n"), F.log1p(F.col("chars") / F.greatest("n", F.lit(1))),
        share("c_symbol", "chars"), share("c_upper", "chars"), share("c_digit", "chars"), share("c_mark", "chars"),
        share("common", "n"), share("distinct", "n"), share("dup_lines", "lines"), share("lines", "n"), share("echo", "n"),
    ).alias("x"))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    centres: list
    inverse_factors: list  # of the Cholesky factors, by class
    log_dets: list
    log_priors: list

    def margin(self, x: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        dens = [-0.5 * np.square((z - m) @ inv.T).sum(axis=1) - d
                for m, inv, d in zip(self.centres, self.inverse_factors, self.log_dets)]
        weight = np.minimum(1.0, n_words / FULL_WEIGHT)
        return self.log_priors[1] - self.log_priors[0] + weight * (dens[1] - dens[0])


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model | float:
    """The model, or the constant score where a class has no rows. Learns
    from all labelled rows that are not held out; what reaches the driver
    are sums by class."""
    rows = stats.where(F.coalesce(crc_mod("doc_id", FOLDS) != HELD_OUT, F.lit(False))).join(
        labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)"), "doc_id").select("quality", "x")
    d = 11
    x = [F.element_at("x", i + 1) for i in range(d)]
    first = rows.groupBy("quality").agg(
        F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c * c) for c in x]).alias("ss")).collect()
    if len(first) < 2:
        return float(first[0].quality) if first else 0.5
    n = sum(r.n for r in first)
    mean = sum(np.array(r.s) for r in first) / n
    scale = np.sqrt(np.maximum(sum(np.array(r.ss) for r in first) / n - mean ** 2, 1e-12))
    z = [(c - float(m)) / float(s) for c, m, s in zip(x, mean, scale)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    second = rows.select("quality", F.array(*z).alias("z")).groupBy("quality").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.element_at("z", i + 1)) for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.element_at("z", i + 1) * F.element_at("z", j + 1)) for i, j in pairs]).alias("ss")).collect()
    cov, centre, count = {}, {}, {}
    for r in second:
        m, c = np.array(r.s) / r.n, np.zeros((d, d))
        for (i, j), v in zip(pairs, r.ss):
            c[i, j] = c[j, i] = v / r.n
        cov[r.quality], centre[r.quality], count[r.quality] = c - np.outer(m, m), m, r.n
    pooled = sum(cov[k] * count[k] for k in (0, 1)) / n
    inverse, log_dets = [], []
    for k in (0, 1):
        target = 0.5 * pooled + 0.5 * (np.trace(cov[k]) / d + 1e-3) * np.eye(d)
        factor = np.linalg.cholesky((1 - shrinkage) * cov[k] + shrinkage * target)
        inverse.append(np.linalg.inv(factor))
        log_dets.append(float(np.log(np.diag(factor)).sum()))
    return Model(mean, scale, [centre[0], centre[1]], inverse, log_dets, [float(np.log(count[k] / n)) for k in (0, 1)])


def score_of(model: Model | float):
    """The score column of statistics (x, n_words)."""
    if isinstance(model, float):
        score = F.lit(model)
    else:
        @F.pandas_udf("double")
        def scored(x, n_words):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype="float64")
            m = np.clip(model.margin(np.vstack(x.to_numpy()), n_words.to_numpy()), -40, 40)
            return pd.Series(np.round(1 / (1 + np.exp(-m)), 6))

        score = scored("x", "n_words")
    return F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(score)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, n_words, score, predicted of every row."""
    stats = cut(statistics(docs))
    return stats.select(
        "doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_words",
        score_of(fit(stats, labels)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of the threshold or more, with their
    columns. The statistics are taken twice, once to fit and once to judge:
    a row's decision needs no join back."""
    model = fit(cut(statistics(docs)), labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = statistics(docs.select("doc_id", "text", row), keep=("row",))
    return rows.where(score_of(model) >= threshold).select("row.*")
