"""Position-table hashes and the importance draw against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import importance
from tidemark.llm.registry import QUERIES, load_all

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"


def word_list(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, target, least=1, most=1, buckets=10_000, percent=10, seed=2024, least_words=20):
    def buckets_of(text):
        w = word_list(text)
        runs = [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = Counter(b for _, x in docs for b in buckets_of(x)), Counter(b for x in target for b in buckets_of(x))
    alls, allt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in buckets_of(x))
        rows.append([i, len(buckets_of(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(word_list(x)) >= least_words])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(repr((*r[:4], places.get(id(r)))) for r in rows)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=700), st.data())
def test_span_crcs(data, draw):
    edges = draw.draw(st.lists(st.tuples(st.integers(0, len(data)), st.integers(0, len(data))), max_size=8))
    spans = [tuple(sorted(e)) for e in edges]
    got = importance.span_crcs(np.frombuffer(data, np.uint8), *(np.array([s[k] for s in spans], np.int64) for k in (0, 1)))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def test_spans_of_many_blocks():
    data = np.random.default_rng(1).integers(0, 256, 3_000_000).astype(np.uint8)
    starts, ends = np.array([0, 5, 1_000, 64]), np.array([3_000_000, 1_200_006, 1_064, 64])
    assert importance.span_crcs(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


TEXTS = ["ab", "cd ef", "", None, "gh", "Äß_É x9", "-", "z", "a b c d e f g " + "long" * 20 + " h i", "jk", "l" * 40]


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 20])
def test_windows_end_between_words(size, monkeypatch):
    data, offsets = importance.text_bytes(pa.array(["skipped", *TEXTS], pa.string()).slice(1))
    runs = list(importance.windows(data, offsets, size))
    assert [a for a, _ in runs] == [0, *[b for _, b in runs][:-1]] and runs[-1][1] == len(data)
    monkeypatch.setattr(importance, "windows", lambda d, o: iter(runs))
    for least, most in ((1, 1), (1, 3), (3, 4)):
        want, got, told = [], [], []
        for i, x in enumerate(TEXTS):
            w = word_list(x)
            want += [(i, zlib.crc32(" ".join(w[k : k + n]).encode())) for n in range(least, most + 1) for k in range(len(w) - n + 1)]
        for word, own, bucket in importance.features(data, offsets, least, most, (1 << 32) - 1):
            told += word.tolist()
            got += list(zip(own.tolist(), bucket.tolist(), strict=True))
        assert sorted(got) == sorted(want)
        assert told == [i for i, x in enumerate(TEXTS) for _ in word_list(x)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, x, 0, "b") for i, x in rows], "doc_id bigint, text string, bucket int, score string")


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 3), (2, 2)])
def test_draw_as_brute_force(spark, least, most):
    rnd = random.Random(least * 10 + most)
    texts = [" ".join(rnd.choice(["Alpha", "beta", "gämma", "x" * 150, "a_b", "7"]) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    rows = [*enumerate(texts), (None, texts[3]), (None, None), (7, None), (8, ""), (3, texts[3]), (3, texts[3]), (200, "y" * 100_000 + " z" * 50_000)]
    target = [texts[5], texts[9], None, ""]
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(docs_of(spark, rows), goal, least=least, most=most, percent=25, buckets=97).collect()
    # Rows that tie with equal ids are interchangeable.
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, target, least, most, 97, 25)
    assert len(got) == len(rows) and sum(r.rank is not None for r in got) > 10


def test_empty_tables(spark):
    none, goal = docs_of(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(none, goal).count() == 0
    got = importance.resample(docs_of(spark, [(1, "word " * 30)]), goal.limit(0), percent=100).first()
    assert (got.n_features, got.rank) == (30, 1)


def test_query_as_brute_force(spark):
    load_all()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = QUERIES["op11_importance_resampling"](spark, SMALL).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(docs, target)
