"""Positive-unlabelled learning: folds, risk, edge cases and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.registry import QUERIES, load_all

DOCS = "doc_id bigint, text string, score string, positive int, part string"


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    plain, rude = "the quiet river runs past old stone houses and children play near water".split(), ["nasty", "vilest", "grubbing"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [rnd.choice(plain) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randint(10, 80))]
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(rude) + rnd.choice(["", "ly"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_edge_cases(spark):
    rows, labels = corpus()
    odd = [(None, None), (None, "nasty vilest grubbing nasty"), (601, ""), (602, None), (1, rows[1][1]), (1, rows[1][1]), (603, "river " * 50_000), (604, "nasty vilest " * 20_000), (605, "q" * 300_000)]
    docs, told = frames(spark, rows + odd, [*labels, (0, 0), (0, 1), (8, None), (None, 1), (9999, 1)])
    got = toxicity.toxicity(docs, told).toPandas()
    assert len(got) == len(rows) + len(odd) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    assert got.held_out.tolist() == [fold(None if np.isnan(i) else int(i)) for i in got.doc_id]
    assert set(got[got.doc_id.isin([601, 602, 603, 605])].predicted) == {0} and set(got[got.doc_id == 604].predicted) == {1}
    assert sorted(got[got.doc_id.isna()].predicted) == [0, 1] and got[got.doc_id == 1].score.nunique() == 1
    own = got[got.doc_id < 600]
    truth = own.doc_id.astype(int) % 8 == 0
    assert ((own.predicted == 1) == truth).mean() >= 0.99
    again = toxicity.toxicity(docs, told).toPandas()
    assert sorted(again.score) == sorted(got.score)
    assert toxicity.toxicity(docs.limit(0), told).count() == 0
    assert toxicity.toxicity(docs, told.limit(0)).agg(F.max("score")).first()[0] == 0.0


def test_labels_of_the_other_fold_are_not_read(spark):
    rows, labels = corpus(200)
    docs, told = frames(spark, rows, labels)
    flipped = told.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    pick = lambda t: sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, t).collect())
    assert pick(told) == pick(flipped)


def test_samples_keep_their_bounds(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    many = rows.unionByName(spark.range(5_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t1").alias("text")))
    assert toxicity.sampled(many, 20_000).count() == 5_000
    assert 300 <= toxicity.sampled(many, 1_000).count() <= 700  # the repeated row counts in the share and once in the sample


def test_risk_does_not_go_below_zero():
    """With more features than documents the plain estimate of the clean risk would fall far below zero."""
    rng = np.random.default_rng(3)
    positive = np.arange(300) < 60
    numbers = [rng.choice(2_000, 30, replace=False).astype(np.int32) for _ in positive]
    values = [np.ones(30) for _ in positive]
    prior = 0.3
    w = toxicity.fit(positive, numbers, values, 2_000, prior)
    s = 1 / (1 + np.exp(-np.array([w[n].sum() + w[-1] for n in numbers])))
    assert s[~positive].mean() - prior * s[positive].mean() > -0.05


@pytest.mark.parametrize("size", ["sf0.1"])
def test_held_out_accuracy(spark, size):
    load_all()
    folder = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op12_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    # Of the toxic ones that are missed, the toxic words were written over by junk.
    assert toxic.predicted.mean() >= 0.88 and clean.predicted.mean() <= 0.005
