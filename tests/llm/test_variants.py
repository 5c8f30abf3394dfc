"""Trie-node pairs against brute force."""

import random
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tidemark.llm import variants
from tidemark.llm.registry import ORACLES, QUERIES, load_all

SMALL = "/root/testdata/sf0.001"


def near(a, b):
    """Whether one inserted, deleted or replaced character turns ``a`` into ``b``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    form, rows = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = (n, len(others), form[w], None if form[w] is None else counts[form[w]])
    for w in rows:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] += (root,)
    return rows


def grouped(spark, counts, **options):
    rows = spark.createDataFrame([(w, n, 1, "x") for w, n in counts.items()], "word string, n bigint, id int, prefix string")
    got = variants.group_variants(rows, **options).collect()
    assert len(got) == len(counts)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_groups_as_brute_force(spark, seed):
    rnd = random.Random(seed)
    letters = "ab" if seed == 0 else "abcé"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(0, 7))) for _ in range(350)}
    words |= {"aaaaa", "aaaa", "aaaaaa", "a", "", "b" * 3000, "b" * 2999, "b" * 1500 + "a" + "b" * 1499, "漢字\U0001f600", "漢\U0001f600"}
    counts = {w: rnd.choice([1, 2, 3, 5, 8, 20, 100]) for w in words}
    assert grouped(spark, counts) == brute(counts)


def test_long_chains_of_forms(spark):
    counts = {"a" * k: 2**k for k in range(1, 40)}
    got = grouped(spark, counts)
    assert {r[4] for r in got.values()} == {"a" * 39} and got == brute(counts)


def test_ties_ratio_and_null_words(spark):
    counts = {"abcde": 1, "abcdf": 3, "abcdg": 3, "xyxyx": 2}
    got = grouped(spark, counts, ratio=3)
    assert got["abcde"] == (1, 2, "abcdf", 3, "abcdf") and got["abcdf"][2] is None and got["xyxyx"] == (2, 0, None, None, "xyxyx")
    rows = spark.createDataFrame([(None, 3), ("ab", 1)], "word string, n bigint")
    assert [tuple(r)[:3] for r in variants.group_variants(rows).collect()] == [("ab", 1, 0)]
    assert variants.group_variants(rows.limit(0)).count() == 0


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 3, 7], [4, 8]])
def test_partitions_number_one_trie(cuts):
    words = sorted({"", "a", "ab", "abc", "abcd", "abd", "abdef", "b", "ba", "bac"})
    edges, bounds = [], [0, *cuts, len(words)]
    for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        own = words[a:b]
        edges += variants.edge_of(pa.table({"__part": pa.array([p] * len(own), pa.int32()), "__pos": range(len(own)), "word": own})).to_pylist()
    number = {}
    for p, (before, nodes, free, after) in variants.takeovers(edges).items():
        own, nodes = words[bounds[p] : bounds[p + 1]], list(nodes)
        assert (before, after) == (words[bounds[p] - 1] if p else "", words[bounds[p + 1]] if p + 1 < len(bounds) - 1 else "")
        for word in own:
            keep = variants.common(before, word)
            nodes[keep:] = range(free, free + len(word) - keep)
            free, before = free + len(word) - keep, word
            for k, x in enumerate(nodes, 1):
                assert number.setdefault(word[:k], x) == x
    assert sorted(number.values()) == list(range(1, len(number) + 1))


def test_counts_of_words(spark):
    letters, rnd = "ABcdé", random.Random(4)
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(200)) for _ in range(40)]
    rows = [*enumerate(texts), (None, texts[0]), (1, None), (2, ""), (3, "z" * 60_000), (3, "z" * 60_000), (4, "z" * 60_000 + "1×÷ñ")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    want = Counter()
    for i, t in rows:
        lowered = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for w in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in lowered).split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 5 == 0 else w] += 1
    for least, count in ((5, 3), (4, 1)):
        got = {r.word: r.n for r in variants.word_counts(docs, misspelt=5, least_length=least, least_count=count).collect()}
        assert got == {w: n for w, n in want.items() if len(w) >= least and n >= count}
    assert variants.word_counts(docs.limit(0)).count() == 0


def test_query_against_sql(spark):
    load_all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in QUERIES["op13_spelling_variants"](spark, SMALL).collect())
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op13_spelling_variants']})").fetchall()))
    assert got == want and any("None" not in r for r in got)
