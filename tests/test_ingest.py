"""Hand-made archives with the published quirks, and reruns of incremental jobs."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import formula
from tidemark.sources import archives, sinks

TITLE = '"Participant wise Trading Volumes as on Jul 29, 2026",,,\n'
HEAD = "Client Type,Future Index Long ,Future Index Short,Future Stock Long,Future Stock Short   \n"
BODY = 'Client,"1,200",200,50,-\nFII,10,20,30,40\nTOTAL,1,1,1,1\n'


def test_participant_quirks(spark, tmp_path):
    (tmp_path / "fao_participant_vol_29072026.csv").write_text(TITLE + HEAD + BODY)
    (tmp_path / "fao_participant_vol_30072026.csv").write_text(HEAD + BODY)
    (tmp_path / "fao_participant_vol_31072026.csv").write_text("<html><head></head></html>")
    (tmp_path / "fao_participant_vol_99999999.csv").write_text(HEAD + BODY)
    rows, failures = archives.participant_archive(archives.read_files(spark, str(tmp_path)))
    got = {(r.date, r.participant): r for r in rows.collect()}
    assert set(got) == {(dt.date(2026, 7, d), p) for d in (29, 30) for p in ("Client", "FII")}
    assert got[(dt.date(2026, 7, 29), "Client")].fut_index_long == 1200.0
    assert got[(dt.date(2026, 7, 29), "FII")].net_futures == 10 + 30 - 20 - 40
    assert sorted(r.reason for r in failures.collect()) == ["HTML page", "no session date"]


def test_bar_archive_quirks(spark, tmp_path):
    head = "SYMBOL, SERIES, DATE1, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, DELIV_PER\n"
    (tmp_path / "a.csv").write_text(head + "AAA, EQ, 02-Jan-2024, 1, 2, 0.5, 1.5, 100, 2.5, -\nBBB, BE, 02-Jan-2024, 1, 1, 1, 1, 1, 1, 5\n")
    rows, _ = archives.bar_archive(archives.read_files(spark, str(tmp_path)))
    (r,) = rows.collect()
    assert (r.symbol, r.turnover, r.delivery_pct, r.adj_factor) == ("AAA", 250000.0, None, 1.0)


def test_upsert_replay_is_harmless(spark):
    root = session.scratch_dir(spark, "test")
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, ts int, v string")
    second = spark.createDataFrame([(1, 2, "c")], "k int, ts int, v string")
    sinks.upsert(spark, first, root, ["k"], ["ts"])
    for _ in range(2):
        table = sinks.upsert(spark, second, root, ["k"], ["ts"])
    assert {(r.k, r.v) for r in table.collect()} == {(1, "c"), (2, "b")}


def test_upsert_after_gaps_and_lost_checkpoints_keeps_all_rows(spark):
    root = session.scratch_dir(spark, "test")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, ts int, v string")
    sinks.upsert(spark, rows((1, 1, "a"), (2, 1, "b")), root, ["k"], ["ts"])
    spark.range(1).write.parquet(f"{root}/version=7/half")  # a merge that died: no success mark of its own
    sinks.upsert(spark, rows((3, 1, "c")), root, ["k"], ["ts"])
    for _ in range(2):  # a stream that lost its checkpoint sends its first batch again
        table = sinks.upsert(spark, rows((1, 1, "a"), (2, 1, "b")), root, ["k"], ["ts"])
    assert {(r.k, r.v) for r in table.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert sinks.upsert(spark, rows((1, 1, "a")).limit(0), root, ["k"], ["ts"]).count() == 3


def test_long_keys_stay_apart(spark):
    from tidemark.sources.tables import symbol_of

    keys = [7, 1234567890123, 1234567890124]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select(symbol_of("k")).collect()]
    assert got == ["S000000000007", "S1234567890123", "S1234567890124"]


def test_water_fill_of_mixed_magnitudes(spark):
    from tidemark.operators.portfolio import water_fill

    rows = [("g", 1e17, 0.5, 1.0), ("g", 1.0, 0.5, 1.0), ("g", 2.0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "g string, mag double, cap double, target double")
    got = sorted(r.out for r in water_fill(df, ["g"], "mag", "cap", "target", "out").collect())
    assert abs(sum(got) - 1.0) < 1e-12 and got[2] == 0.5 and abs(got[0] * 2 - got[1]) < 1e-12


def test_kept_formulas_cost_novelty(spark):
    scored = spark.createDataFrame(
        [(1, ["a", "b"], 0.10, 80), (2, ["c"], 0.05, 80), (3, ["d"], None, 3)], "candidate int, tokens array<string>, reward double, n_rows int"
    )
    kept = spark.createDataFrame([(9, ["a", "b"], 0.2, 80)], "candidate int, tokens array<string>, reward double, n_rows int")
    got = [(r.candidate, round(r.reward, 6)) for r in formula.keep_best(scored, 2, kept).collect()]
    assert got == [(9, 0.2), (2, 0.05)]


def test_stage_writes_a_table_where_a_shared_folder_is_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    out = session.stage(spark.range(10).withColumn("x", F.col("id") * 2), "probe")
    assert out.count() == 10 and any(p.name.startswith("tidemark-probe") for p in tmp_path.iterdir())
    session.release_staged()
    assert not list(tmp_path.iterdir())


def test_validity_is_judged_by_position(spark):
    table = formula.arities()
    cases = [
        (["close", "neg"], True, "neg(close)"),
        (["close", "volume", "add"], True, "add(close, volume)"),
        (["close", "volume"], False, None),
        (["add", "close", "volume", "add"], False, None),
        (["neg", "neg"], False, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, tokens array<string>")
    rows = df.select(
        "i", formula.is_complete(F.col("tokens"), table).alias("ok"), formula.infix(F.col("tokens"), table).alias("text")
    ).orderBy("i").collect()
    for row, (_, ok, text) in zip(rows, cases):
        assert row.ok == ok and (text is None or row.text == text)


@pytest.mark.parametrize(
    ("text", "page"),
    [
        ("<?xml version='1.0'?><html><head>", True), ("<!-- x --><html>", True), ("oops <head>", True), ("﻿ <!DOCTYPE html>", True),
        ("<!-- a\n --> <!-- b -->\n<BODY>", True), ("x" * 400 + "<head>", False), (" " * 900 + "x <HEAD>", True), ("date,symbol\n<html>", False),
        ("<tag>1</tag>", False), ("<!-- open <html>", False), ("", False), (None, None),
    ],
)
def test_pages_are_told_from_data(spark, text, page):
    import duckdb

    from tidemark.plans.q_ingest import HTML_SQL

    row = spark.createDataFrame([(text,)], "t string").select(archives.is_html(F.col("t"))).first()
    assert row[0] == page
    assert duckdb.connect().execute(f"SELECT {HTML_SQL} FROM (SELECT ?::VARCHAR AS t)", [text]).fetchone()[0] == (page if text is not None else None)


def keyed(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, ts int, v string")


def test_keyed_table_does_not_grow_with_merges(spark, tmp_path):
    root, want = str(tmp_path / "t"), {}
    for i in range(12):
        sinks.upsert(spark, keyed(spark, (i % 7, i, f"v{i}"), (100 + i % 3, 50 - i, "w")), root, ["k"], ["ts"], buckets=4)
        want[i % 7] = f"v{i}"
    table = sinks.read_keyed(spark, root, "k int, ts int, v string")
    assert {r.k: r.v for r in table.collect() if r.k < 100} == want and table.filter("k = 100").first().ts == 50
    parts = [p for p in tmp_path.rglob("*.parquet")]
    assert len(parts) <= 4 * sinks.KEPT_MANIFESTS and len(list((tmp_path / "t/_log").glob("0*.json"))) == sinks.KEPT_MANIFESTS


def test_readers_see_whole_merges_and_writers_meet_with_an_error(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    sinks.upsert(spark, keyed(spark, (1, 1, "a"), (2, 1, "a")), root, ["k"], ["ts"])
    before = sinks.read_keyed(spark, root, "k int, ts int, v string")
    original, met = sinks._Files.write_new, []

    def late(self, name, text):
        # Written but not committed: a reader still has the old table; then another merge commits first.
        assert sorted(r.v for r in sinks.read_keyed(spark, root, "k int, ts int, v string").collect()) == ["a", "a"]
        if not met:
            met.append(name)
            sinks.upsert(spark, keyed(spark, (2, 9, "other")), root, ["k"], ["ts"])
        return original(self, name, text)

    monkeypatch.setattr(sinks._Files, "write_new", late)
    with pytest.raises(sinks.ConcurrentMerge):
        sinks.upsert(spark, keyed(spark, (1, 5, "b"), (2, 5, "b")), root, ["k"], ["ts"])
    monkeypatch.setattr(sinks._Files, "write_new", original)
    assert sorted(r.v for r in sinks.read_keyed(spark, root, "k int, ts int, v string").collect()) == ["a", "other"]
    assert sorted(r.v for r in before.collect()) == ["a", "a"]
    assert sorted(r.v for r in sinks.upsert(spark, keyed(spark, (1, 5, "b"), (2, 5, "b")), root, ["k"], ["ts"]).collect()) == ["b", "other"]


def test_reads_of_a_span_list_its_months_only(spark, tmp_path):
    for d in ("31122025", "01012026", "15012026", "28022026", "01032026", "nodate00"):
        (tmp_path / f"fao_participant_vol_{d}.csv").write_text(TITLE + HEAD + BODY)
    span = (dt.date(2026, 1, 10), dt.date(2026, 2, 28))
    files = archives.read_files(spark, str(tmp_path), between=span)
    assert sorted(p.rsplit("_", 1)[1] for p in spark.read.option("pathGlobFilter", archives.month_glob(*span)).text(str(tmp_path)).inputFiles()) == ["01012026.csv", "15012026.csv", "28022026.csv"]
    assert sorted(r.path.rsplit("_", 1)[1] for r in files.collect()) == ["15012026.csv", "28022026.csv"]
    rows, _ = archives.participant_archive(files)
    assert {r.date for r in rows.collect()} == {dt.date(2026, 1, 15), dt.date(2026, 2, 28)}
    assert archives.month_glob(dt.date(2025, 12, 31), dt.date(2026, 1, 1)) == "{*[0-3][0-9]122025*,*[0-3][0-9]012026*}"
