"""Toxicity by non-negative positive-unlabelled learning.

Known are some toxic documents and a class prior, no clean ones: the classifier is trained from confirmed
toxic examples P and a sample U of all text, whose labels are not looked at. With the sigmoid loss the risk
of a scorer is prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)); the second part estimates the risk on clean
text and cannot be below zero, so a step that finds it there turns round and undoes the overfit.

Features are the first 3 to 8 letters of words and whole words, taken as log(1 + occurrences). Kept are
those whose share of documents is far higher in P than in U (``features``, at most ``MOST_FEATURES``).
U is dealt to ``MODELS`` parts; one numpy classifier per part is trained in a task of its own against all
of P, and their scores are averaged, which for linear scorers is one scorer with mean weights.

Bounds (all parameters): P and U are hash samples of at most ``MOST_POSITIVE`` and ``MOST_UNLABELLED``
documents in expectation; features and models as above. Only the training reads samples; every whole text
is scored. Labels are read from the training fold alone, and the id serves for nothing but the folds, the
sample and the join of labels.

Nulls and odd input: a null or empty text has no features and gets the score of the bias, which is below
one half wherever the prior is; a null id counts as an empty string in the fold and has no label; a null
label is no label; repeated labels count once, toxic if any says so; equal rows score equally; without a
toxic example in the training fold every score is 0; an empty table gives no rows; texts may have any
length; other columns are ignored, so that their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.registry import query, table

FOLDS = 5
MOST_POSITIVE = 6_000
MOST_UNLABELLED = 24_000
MODELS = 4
SHORTEST, LONGEST = 3, 8
#: A feature occurs in so many documents of P at least, and in so many times U's share of documents.
LEAST_DOCUMENTS, LEAST_LIFT = 5, 2.0
MOST_FEATURES = 4_096
STEPS, RATE, DECAY = 400, 0.05, 1e-4
#: Features or words that a task remembers; beyond that it hands them on or starts anew.
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether a document is outside the training fold."""
    told = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(told.cast("binary")) % folds == 0


def traits(word: str) -> list[str]:
    """The features of a word."""
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "$"]


def word_counts(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """Distinct (doc_id, text) of ``rows``, about ``most`` if there are more."""
    total = rows.count()
    share = min(1.0, most / max(total, 1))
    keyed = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    return keyed.where(F.shiftrightunsigned("_h", 11) < int(share * 2**53)).dropDuplicates(["doc_id", "_h"]).select("doc_id", "text")


def labelled(labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, toxic (boolean) of the training fold's labels."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(folds=folds))
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int") == 1).alias("toxic"))


def document_frequencies(sample: DataFrame) -> DataFrame:
    """feature, p, u: the documents of P and of U that hold each feature; ``sample`` has positive and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def handed() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            counts = [pa.array([c[n] for n in names], pa.int64()) for c in seen]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["feature", "p", "u"])

        for batch in batches:
            for positive, text in zip(batch.column(0), batch.column(1), strict=True):
                seen[0 if positive.as_py() else 1].update({t for w in word_counts(text.as_py()) for t in traits(w)})
                if len(seen[0]) + len(seen[1]) >= REMEMBERED:
                    yield handed()
        yield handed()

    partial = sample.select("positive", "text").mapInArrow(run, "feature string, p bigint, u bigint")
    return partial.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def features(frequencies: DataFrame, positives: int, unlabelled: int, most: int = MOST_FEATURES) -> list[str]:
    """The ``most`` features by how many deviations their documents in P exceed what U's share predicts."""
    share = (F.col("u") + 1) / (unlabelled + 1)
    above = (F.col("p") - positives * share) / F.sqrt(positives * share)
    far = frequencies.where(F.col("p") >= LEAST_DOCUMENTS).where(F.col("p") / positives >= LEAST_LIFT * share)
    return [r["feature"] for r in far.orderBy(above.desc(), "feature").limit(most).select("feature").collect()]


class Reader:
    """Counts of known features in texts."""

    def __init__(self, names: list[str]):
        self.number = {n: i for i, n in enumerate(names)}
        self.words: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, log(1 + occurrences)) of the features of a text."""
        found: dict[int, int] = {}
        if len(self.words) > REMEMBERED:
            self.words.clear()
        for word, times in word_counts(text).items():
            own = self.words.get(word)
            if own is None:
                own = self.words[word] = tuple(self.number[t] for t in traits(word) if t in self.number)
            for i in own:
                found[i] = found.get(i, 0) + times
        return np.fromiter(found, np.int32, len(found)), np.log1p(np.fromiter(found.values(), np.float64, len(found)))


def fit(positive: np.ndarray, numbers: list[np.ndarray], values: list[np.ndarray], size: int, prior: float) -> np.ndarray:
    """Weights, and the bias last, that minimise the non-negative risk over documents in sparse form."""
    row = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
    column = np.concatenate([*numbers, np.zeros(0, np.int32)]).astype(np.int64)
    value = np.concatenate([*values, np.zeros(0)])
    p, u = positive, ~positive
    share_p, share_u = prior / max(p.sum(), 1), 1 / max(u.sum(), 1)
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[column] * value, len(p)) + w[-1]
        s = 0.5 * (1 + np.tanh(z / 2))
        slope = s * (1 - s)
        clean = share_u * s[u].sum() - share_p * s[p].sum()
        if clean >= 0:  # risk of P as toxic, and of U less P as clean
            pull = np.where(p, -2 * share_p, share_u) * slope
        else:  # the clean part fell below zero: step back out of it
            pull = np.where(p, share_p, -share_u) * slope
        grad = np.append(np.bincount(column, pull[row] * value, size), pull.sum())
        grad[:-1] += DECAY * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, models: int = MODELS, folds: int = FOLDS) -> tuple[list[str], np.ndarray, float]:
    """(features, weights, bias) learnt from the training fold of ``docs`` and ``labels``; no features without toxic examples."""
    known = stage(labelled(labels, folds), "toxic-labels")
    total = known.agg(F.count("*").alias("n"), F.count_if("toxic").alias("p")).first()
    if not total["p"]:
        return [], np.zeros(0), -np.inf
    rows = docs.where(~held_out(folds=folds))
    chosen = known.where("toxic").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_POSITIVE)
    confirmed = sampled(rows.join(F.broadcast(chosen), "doc_id", "left_semi"), MOST_POSITIVE)
    both = confirmed.withColumn("positive", F.lit(True)).unionByName(sampled(rows, MOST_UNLABELLED).withColumn("positive", F.lit(False)))
    sample = stage(both, "toxic-sample")
    count = sample.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    if not count["p"]:
        return [], np.zeros(0), -np.inf
    names = features(document_frequencies(sample), count["p"], count["u"])
    prior, size = total["p"] / total["n"], len(names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(names)
        for batch in batches:
            pairs = [reader(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([n for n, _ in pairs], pa.list_(pa.int32())), pa.array([v for _, v in pairs], pa.list_(pa.float64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["positive", "numbers", "counts", "part"])

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable")
        return pd.DataFrame({"w": [fit(part["positive"].to_numpy(bool), list(part["numbers"]), list(part["counts"]), size, prior)]})

    key = F.xxhash64("doc_id", "text")
    told = sample.select("positive", "text", key.alias("part")).mapInArrow(read, "positive boolean, numbers array<int>, counts array<double>, part bigint")
    parts = F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(models - 1))).otherwise(F.array(F.pmod("part", F.lit(models)).cast("int")))
    dealt = told.select("positive", "numbers", "counts", F.col("part").alias("key"), F.explode(parts).alias("part"))
    learnt = dealt.groupBy("part").applyInPandas(learn, "w array<double>").collect()  # one row per model
    w = np.mean([r["w"] for r in learnt], axis=0)
    return names, w[:-1], float(w[-1])


def scores(docs: DataFrame, names: list[str], weights: np.ndarray, bias: float, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(names)
        for batch in batches:
            z = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(2)):
                number, value = reader(text.as_py())
                z[k] = bias + (weights[number] * value).sum()
            score = 0.5 * (1 + np.tanh(z / 2))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(folds=folds).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, models: int = MODELS, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a classifier learnt from the training fold."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    return scores(own, *train(own, told, models, folds), folds)


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
