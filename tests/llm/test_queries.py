"""Whole query results on the smallest tables against brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import dac, packing
from tidemark.llm.registry import QUERIES, load_all
from tidemark.llm.tokens import END, tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    load_all()
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def encoded(name, documents):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.encode_special_tokens = True  # the README states this choice
    return {i: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, END] for i, r in documents.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes_query(spark, documents):
    ids = encoded(dac.VOCABULARY, documents)
    want, start = {}, 0
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), crc(ids[i]))
        start += len(ids[i])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_addressable_codes"](spark, SMALL).collect()}
    assert got == want


def test_packing_query(spark, documents):
    ids, got = encoded(packing.VOCABULARY, documents), defaultdict(list)
    rows = QUERIES["op9_min_slack_packing"](spark, SMALL).collect()
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(ids)
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert [crc(ids[i][p.start : p.start + p.length]) for p in pieces] == [p.ids_crc32 for p in pieces]
        assert sum(p.length for p in pieces) == len(ids[i]) and all(p.length == 1024 for p in pieces[1:]) and 1 <= pieces[0].length <= 1024
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    # No packing can use fewer sequences than the tokens fill.
    least = -(-sum(map(len, ids.values())) // 1024)
    assert least <= len(sequences) <= 1.02 * least + 1


def test_neighbours_query(spark):
    load_all()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    name = next(c for c in rows[0].asDict() if c != "vec_id" and isinstance(rows[0][c], list))
    vectors = {r.vec_id: np.array(r[name], float) for r in rows if r[name] and all(v is not None for v in r[name])}
    vectors = {i: v for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    got = defaultdict(list)
    for r in QUERIES["op5_inverted_multi_index"](spark, SMALL).collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hits = total = 0
    for q, own in got.items():
        own.sort(key=lambda r: r.rank)
        assert [r["rank"] for r in own] == list(range(1, min(20, len(vectors) - 1) + 1)) and q not in {r.vec_id for r in own}
        assert [(r.score, r.vec_id) for r in own] == sorted(((r.score, r.vec_id) for r in own), key=lambda x: (-x[0], x[1]))
        for r in own:
            assert r.score == pytest.approx(float(vectors[q] @ vectors[r.vec_id]), abs=1e-12)
        best = sorted((i for i in vectors if i != q), key=lambda i: (-float(vectors[q] @ vectors[i]), i))[:20]
        hits, total = hits + len(set(best) & {r.vec_id for r in own}), total + len(best)
    assert hits / total >= 0.9


def test_shards_query(spark, documents):
    rows = QUERIES["op8_hilbert_shards"](spark, SMALL).collect()
    raw = {i: (r.text or "").encode() for i, r in documents.items()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in raw.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and {r.law for r in rows} == {"rows"}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_mix_query(spark, documents):
    rows = QUERIES["op2_mix_to_weights"](spark, SMALL).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in documents.items()}
    assert {r.doc_id: r["size"] for r in rows} == words and all(r.taken <= 3 * r["size"] for r in rows)
    own, sizes = defaultdict(int), defaultdict(int)
    for r in rows:
        own[documents[r.doc_id].source] += r.taken
        sizes[documents[r.doc_id].source] += r["size"]
    target = {documents[r.doc_id].source: r.target for r in rows}
    assert all(r.source_size == sizes[documents[r.doc_id].source] for r in rows)
    assert sum(target.values()) == pytest.approx(sum(words.values()))
    for source, goal in target.items():
        assert goal <= 3 * sizes[source] + 1e-6 and abs(own[source] - goal) <= 0.05 * goal + 1
    again = QUERIES["op2_mix_to_weights"](spark, SMALL).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
