"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, curve, dac, kneser, licenses, mixing, packing, rules, simhash, warc
from tidemark.llm.tokens import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, perplexity string, n_words string, fp string, place string, found string"
rnd = random.Random(3)
LONG = " ".join(rnd.choice("alpha beta gamma delta eins zwei drei".split()) for _ in range(30_000))
LINE = "Licensed under the Apache License, Version 2.0. Released under the MIT License. "


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * 7)


ROWS = [
    row(1, "one two three four five"), row(1, "one two three four five"), row(2, None), row(3, ""), row(4, " \n\t "),
    row(5, LONG), row(None, "one two three four five"), row(None, None, None, None), row(6, LINE * 3, None, "b"),
    row(7, "Straße ÉCLAIR \U0001f600 naïve", "de", "B"), row(8, "x" * 5000, "en", ""), row(9, "same words here", "fr", "a"), row(10, "same words here", "fr", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(docs, none):
    got = mixing.taken(docs, block=16, shard_slots=8).toPandas()
    assert len(got) == len(ROWS) and (got.taken <= 3 * got["size"]).all()
    assert got[got["size"] == 0].taken.eq(0).all()
    again = mixing.taken(docs, block=16, shard_slots=8).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    parts = mixing.mixed(docs, block=16, shard_slots=8)
    assert parts.columns == docs.columns
    words = parts.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert words == got.taken.sum()
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0


def test_curve(docs, none):
    got = curve.shard(docs, shards=4)
    assert set(docs.columns) - {"shard"} <= set(got.columns)
    rows = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).toPandas()
    assert rows.n.sum() == len(ROWS) and rows.n.max() - rows.n.min() <= 1
    assert (rows.lo == 0).all() and (rows.hi == rows.n - 1).all()
    assert curve.shard(none, shards=4).count() == 0


def test_rules(docs, none):
    got = rules.apply_policy(rules.ledger(docs), rules.POLICIES[3])
    assert got.count() == len(ROWS) and not got.where("text IS NULL AND kept").count()
    assert got.where("doc_id = 5").first()["n_words"] == 30_000
    assert rules.ablation(got, rules.POLICIES[3]).count() == len(rules.POLICIES[3].enforced)
    assert rules.ledger(none).count() == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == len(ROWS)
    by = dict(zip(got.doc_id, got.component_id, strict=True))
    assert by[10] == by[9] == 9 and by[2] == by[3] == by[4] == 2
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()]
    assert sorted(ids) == [1, 2, 5, 6, 7, 8, 9]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_codes(spark, docs, none):
    path = dac.write_tokens(docs, tokenizer_path(dac.VOCABULARY))
    got = dac.with_start(dac.read_tokens(spark, path)).orderBy("start").toPandas()
    assert len(got) == len(ROWS) and got.n_tokens.min() == 1
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all()
    known = got.doc_id.dropna().tolist()
    assert known == sorted(known) and got.doc_id.isna().tolist()[:2] == [True, True]
    assert dac.read_tokens(spark, dac.write_tokens(none, tokenizer_path(dac.VOCABULARY))).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, tokenizer_path(packing.VOCABULARY)).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    assert got[got.doc_id == 2].length.tolist() == [1]
    assert packing.pack(none, tokenizer_path(packing.VOCABULARY)).count() == 0


def test_licenses(docs, none):
    got = licenses.labelled(licenses.scan(docs)).toPandas()
    assert len(got) == len(ROWS)
    hit = got[got.doc_id == 6].iloc[0]
    assert (hit.n_base, hit.first_word, hit.base_labels, hit.labels) == (6, 3, "apache,mit", "apache,apache-2.0,mit")
    assert got[got.doc_id != 6].labels.eq("").all()
    assert licenses.scan(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, True), (1, True), (5, True), (9, True), (10, False), (None, True), (99, True)], "doc_id bigint, trusted boolean")
    got = kneser.judge(docs, labels).toPandas()
    assert len(got) == len(ROWS)
    assert got[got.lang == "de"].perplexity.isna().all() and got[got.lang == "de"].kept.all()
    assert got[got.lang == "en"].perplexity.notna().all()
    kept = kneser.keep(docs, labels)
    assert kept.columns == docs.columns
    assert kneser.judge(none, labels).count() == 0
    assert kneser.judge(docs, labels.limit(0)).where("NOT kept").count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (40, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    usable = ann.usable(table, "vec_id", "embedding")
    got = ann.search(usable, usable.where("vec_id % 20 = 0").distinct(), nearest_=3, k=2, share=1.0).toPandas()
    first = got[got.query_id == 0].sort_values("rank")
    assert first.vec_id.tolist() == [20, 3, 40] and first.score.tolist() == [1.0, 0.5, 0.0]
    assert not set(got.vec_id) & {4, 5, 6, 7, 8, 9}
    assert ann.search(usable.limit(0), usable.limit(0)).count() == 0


def test_warc(spark):
    big = "y" * 2000
    rows = [(1, "http://a/\r\nx", big, 0), (2, None, big, 0), (None, "u", big, 0), (3, "u", None, 0), (4, "u", "", 0), (2, None, big, 0), (5, "u", "short", 0), (6, "u", "short", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, owner int")
    read = warc.read_warc(spark, warc.write_warc(pages)).toPandas()
    assert len(read) == len(rows) and (read.kind == "record").all()
    kinds = dict(zip(read.record_id, read.record_type, strict=True))
    assert kinds["<urn:page:1>"] == "revisit" and kinds["<urn:page:2>"] == "response" and kinds["<urn:page:>"] == "revisit"
    assert set(read[read.record_type == "revisit"].refers_to) == {"<urn:page:2>"}
    assert (read[read.record_type == "revisit"].payload_bytes == 2000).all()
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0
