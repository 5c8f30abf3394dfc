"""Registered queries: scans, raw-archive ingestion, sinks and incremental jobs.

The provided tables are rendered as the text archives the ingestion expects, written to the
scratch folder, read back and compared with direct aggregates. Archives are chunked so that
no file grows with the data: a chunk holds a bounded range of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import asof, panel, quality
from ..operators.factors import shares_usable
from ..session import scratch_dir, stage
from ..sources import archives, sinks, tables
from ..streaming import incremental
from . import oracle
from .catalog import Inputs, query

CHUNK = 1000


def _write_chunks(df: DataFrame, path: str, keys: list[str], line: Column, order: str, head: Column) -> str:
    """One text file per key combination: ``head`` and then the group's lines in order."""
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"])
    files = df.groupBy(*keys).agg(F.array_join(F.concat(F.array(F.first(head)), body), "\n").alias("value"))
    files.repartition(*keys).write.partitionBy(*keys).text(path)
    return path


# -- scans and dimensions ----------------------------------------------------------------


@query("io1_parquet_scan", "o_orderdate:d n:i", "SELECT o_orderdate::DATE AS o_orderdate, count(*) AS n FROM orders GROUP BY 1")
def _(t: Inputs):
    orders = asof.Dataset("orders", date="o_orderdate", entity="o_custkey", lag_sessions=0)
    return asof.load(t.spark, f"{t.sf_dir}/orders.parquet", orders).groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))


@query(
    "io2_csv_dimension",
    "kind symbol text",
    "SELECT 'sector' AS kind, symbol, sector AS text FROM sectors UNION ALL SELECT 'shares', symbol, shares::DECIMAL(18, 2)::VARCHAR FROM shares UNION ALL SELECT 'session', NULL, date::VARCHAR FROM sessions",
)
def _(t: Inputs):
    root = scratch_dir(t.spark, "dimensions")
    sinks.write_result(t.sectors.select(F.col("symbol").alias("SYMBOL"), F.col("sector").alias("Industry")), f"{root}/s", "csv")
    sinks.write_result(t.shares.select(F.col("symbol").alias("Symbol"), F.col("shares").alias("Shares")), f"{root}/n", "csv")
    sectors = archives.sector_csv(t.spark, f"{root}/s").select(F.lit("sector").alias("kind"), "symbol", F.col("sector").alias("text"))
    counts = archives.share_csv(t.spark, f"{root}/n").select(
        F.lit("shares").alias("kind"), "symbol", F.col("shares").cast("decimal(18,2)").cast("string").alias("text")
    )
    sinks.write_result(t.sessions.select(F.date_format("date", "yyyy-MM-dd").alias("Date")), f"{root}/d", "csv")
    days = archives.session_csv(t.spark, f"{root}/d").select(
        F.lit("session").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.col("date").cast("string").alias("text")
    )
    return sectors.unionByName(counts).unionByName(days)


@query("io3_shares_usable", "usable", "SELECT count(DISTINCT shares) > 1 AS usable FROM shares")
def _(t: Inputs):
    return shares_usable(t.shares)


# -- raw archives ------------------------------------------------------------------------

BAR_HEADER = "SYMBOL, SERIES, DATE1, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, DELIV_PER"


def _quarter_chunks(t: Inputs) -> DataFrame:
    """Bars keyed by quarter and symbol range: small files without one per session."""
    return t.px.withColumns(
        {
            "session": F.date_format(F.date_trunc("quarter", "date"), "yyyyMM"),
            "chunk": F.floor(F.substring("symbol", 2, 12).cast("long") / CHUNK),
        }
    )


@query(
    "io4_bar_archive",
    "date symbol close volume turnover:2 delivery_pct adj_close",
    """SELECT date, symbol, close, volume, turnover, CASE WHEN delivery_pct > 0 THEN delivery_pct END AS delivery_pct, close AS adj_close
       FROM px WHERE volume % 7 <> 0""",
)
def _(t: Inputs):
    series = F.when(F.col("volume") % 7 == 0, " BE").otherwise(" EQ")
    share = F.when(F.col("delivery_pct") > 0, F.col("delivery_pct").cast("string")).otherwise(" -")
    text = F.concat_ws(
        ",", F.concat("symbol", F.lit(" ")), series, F.date_format("date", " dd-MMM-yyyy"),
        *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")],
        (F.col("turnover") / 1e5).cast("string"), share,
    )
    path = _write_chunks(
        _quarter_chunks(t), scratch_dir(t.spark, "bars"), ["session", "chunk"], text, "symbol", F.lit(BAR_HEADER)
    )
    rows, _ = archives.bar_archive(archives.read_files(t.spark, path))
    return rows


POSITION_HEADER = "Client Type,Future Index Long ,Future Index Short,Future Stock Long,Future Stock Short   ,Total Long Contracts"


def _participant_files(t: Inputs) -> str:
    """One archive per session: optional title, thousands commas, a total row, some HTML pages."""
    comma = lambda c: F.concat(F.lit('"'), F.format_number(c, 2), F.lit('"'))
    days = tables.participant_positions(t.spark, t.sf_dir).withColumn("session", F.date_format("date", "ddMMyyyy"))
    title = F.concat(F.lit('"Participant wise volumes as on '), F.date_format("date", "MMM dd, yyyy"), F.lit('",,\n'))
    head = F.concat(F.when(F.month("date") % 2 == 0, title).otherwise(F.lit("")), F.lit(POSITION_HEADER))
    page = F.lit("<!DOCTYPE html><html><body>not found</body></html>")
    text = F.concat_ws(",", "participant", comma("long"), comma("short"), F.lit("-"), F.lit("0"), comma("long"))
    return _write_chunks(
        days, scratch_dir(t.spark, "participants"), ["session"], text, "participant",
        F.when(F.dayofmonth("date") == 13, page).otherwise(head),
    )


def _ingested(t: Inputs):
    return archives.participant_archive(archives.read_files(t.spark, _participant_files(t)))


@query(
    "io5_participant_archive",
    "date participant fut_index_long:2 fut_index_short:2 net_futures:2 total_long:2",
    "SELECT date, participant, long AS fut_index_long, short AS fut_index_short, NULL::DOUBLE AS net_futures, long AS total_long FROM flows WHERE day(date) <> 13",
)
def _(t: Inputs):
    return _ingested(t)[0]


@query("io6_archive_failures", "date reason", "SELECT DISTINCT date, 'HTML page' AS reason FROM pos_flows WHERE day(date) = 13")
def _(t: Inputs):
    return _ingested(t)[1]


@query("io7_title_date", "date parsed:d", "SELECT DISTINCT date, date AS parsed FROM pos_flows")
def _(t: Inputs):
    fmt = F.when(F.month("date") % 2 == 0, F.date_format("date", "MMMM dd, yyyy")).otherwise(F.date_format("date", "MMM d , yyyy"))
    line = F.concat(F.lit("Volumes (no. of contracts) as on "), fmt, F.lit(" ,,"))
    return t.flows.select("date").distinct().withColumn("parsed", archives.title_date(line))


HTML_SQL = f"""(coalesce(lower(regexp_extract(t, '{archives.PAGE_LEAD}<\\s*(!?[A-Za-z]+)', 1)) IN {archives.PAGE_TAGS}, false)
  OR contains(lower(substr(regexp_replace(t, '^\\s+', ''), 1, 400)), '<head>'))"""


@query(
    "io8_html_rejection",
    "kind n_html:i n:i",
    f"""SELECT kind, count(*) FILTER ({HTML_SQL}) AS n_html, count(*) AS n FROM (
         SELECT 'pages' AS kind, html AS t FROM pages UNION ALL SELECT 'documents', text FROM documents) GROUP BY 1""",
)
def _(t: Inputs):
    texts = t.table("pages").select(F.lit("pages").alias("kind"), F.col("html").alias("text")).unionByName(
        t.table("documents").select(F.lit("documents").alias("kind"), "text")
    )
    return texts.groupBy("kind").agg(
        F.count(F.when(archives.is_html(F.col("text")), 1)).alias("n_html"), F.count(F.lit(1)).alias("n")
    )


CASH_KINDS = {"click": "FII/FPI *", "view": "DII **", "purchase": "FPI", "signup": "MF", "error": "OTHER"}


@query(
    "io9_cash_json",
    "date participant buy_crore:2 net_crore:2 n:i",
    """SELECT ts::DATE AS date, CASE WHEN event_type = 'view' THEN 'DII' ELSE 'FII' END AS participant, sum(value * 1000) AS buy_crore,
         sum(CASE WHEN event_id % 3 <> 0 THEN value END) AS net_crore, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2""",
)
def _(t: Inputs):
    day = F.dayofmonth("ts") % 5
    date = F.when(day == 0, F.date_format("ts", "dd-MMM-yyyy"))
    for i, f in enumerate(("dd-MMMM-yyyy", "dd MMM yyyy", "yyyy-MM-dd", "dd-MM-yyyy"), start=1):
        date = date.when(day == i, F.date_format("ts", f))
    kind = F.create_map(*[F.lit(x) for kv in CASH_KINDS.items() for x in kv])
    entry = F.to_json(
        F.struct(
            kind[F.col("event_type")].alias("category"),
            date.alias("date"),
            F.format_number(F.col("value") * 1000, 2).alias("buyValue"),
            F.lit("-").alias("sellValue"),
            F.when(F.col("event_id") % 3 == 0, "NA").otherwise(F.format_number("value", 2)).alias("netValue"),
        )
    )
    rows = t.table("events").withColumns(
        {"session": F.date_format("ts", "yyyyMMdd"), "chunk": F.floor(F.col("event_id") / CHUNK), "_json": entry}
    )
    whole = F.concat(F.lit("["), F.array_join(F.collect_list("_json"), ","), F.lit("]"))
    wrapped = F.when(F.first(F.dayofmonth("ts")) % 2 == 0, F.concat(F.lit('{"data":'), whole, F.lit("}"))).otherwise(whole)
    path = scratch_dir(t.spark, "cash")
    rows.groupBy("session", "chunk").agg(wrapped.alias("value")).repartition("session").write.partitionBy(
        "session", "chunk"
    ).text(path)
    parsed, _ = archives.cash_flows(archives.read_files(t.spark, path))
    return parsed.groupBy("date", "participant").agg(
        F.sum("buy_crore").alias("buy_crore"), F.sum("net_crore").alias("net_crore"), F.count(F.lit(1)).alias("n")
    )


@query(
    "io10_deals",
    "date symbol client_name buy_sell quantity:2 price:2",
    """SELECT ts::DATE AS date, 'U' || user_id AS symbol, event_type AS client_name, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS buy_sell,
         value * 1000 AS quantity, value AS price FROM events""",
)
def _(t: Inputs):
    third = F.col("event_id") % 3
    date = F.when(third == 0, F.date_format("ts", "dd-MMM-yyyy")).when(third == 1, F.date_format("ts", "dd-MM-yyyy")).otherwise(
        F.date_format("ts", "yyyy-MM-dd")
    )
    text = F.concat_ws(
        ",", date, F.concat(F.lit(" U"), "user_id"), "event_type", F.when(F.col("event_id") % 2 == 0, "BUY ").otherwise("SELL"),
        F.concat(F.lit('"'), F.format_number(F.col("value") * 1000, 2), F.lit('"')), F.col("value").cast("string"),
    )
    rows = t.table("events").withColumn("chunk", F.floor(F.col("event_id") / CHUNK))
    path = _write_chunks(
        rows, scratch_dir(t.spark, "deals"), ["chunk"], text, "event_id",
        F.lit("Deal Date,Symbol ,Client Name,Buy / Sell,Quantity Traded,Trade Price / Wght. Avg. Price"),
    )
    return archives.deals(archives.read_files(t.spark, path))[0]


@query(
    "io11_constituents",
    "kind symbol industry",
    """SELECT CASE WHEN s_suppkey % 17 = 0 THEN 'placeholder' ELSE 'member' END AS kind,
         CASE WHEN s_suppkey % 17 = 0 THEN 'DUMMY' || s_suppkey ELSE 'N' || s_suppkey END AS symbol,
         CASE WHEN s_suppkey % 17 <> 0 THEN n_name END AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 13 <> 0""",
)
def _(t: Inputs):
    nation = t.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = t.table("supplier").join(nation, "s_nationkey")
    symbol = F.concat(F.when(F.col("s_suppkey") % 17 == 0, "DUMMY").otherwise("N"), "s_suppkey")
    series = F.when(F.col("s_suppkey") % 13 == 0, "BE").otherwise("EQ")
    one = F.concat_ws(",", "s_name", "n_name", symbol, series, F.lit("ISIN"))
    again = F.concat_ws(",", "s_name", F.lit("LATER ROW"), symbol, series, F.lit("ISIN"))
    chunked = rows.withColumn("chunk", F.floor(F.col("s_suppkey") / CHUNK))
    path = _write_chunks(
        chunked, scratch_dir(t.spark, "constituents"), ["chunk"], F.concat_ws("\n", one, again), "s_suppkey",
        F.lit("Company Name,Industry,Symbol,Series,ISIN Code"),
    )
    members, placeholders = archives.constituents(archives.read_files(t.spark, path))
    return members.withColumn("kind", F.lit("member")).unionByName(
        placeholders.select(F.lit("placeholder").alias("kind"), "symbol", F.lit(None).cast("string").alias("industry"))
    )


@query(
    "io12_assemble_panel",
    "kind symbol n:i",
    """SELECT 'present' AS kind, symbol, count(*) AS n FROM px GROUP BY 2 UNION ALL
       SELECT 'absent', symbol, 0 FROM (SELECT 'S' || lpad(c_custkey::VARCHAR, 12, '0') AS symbol FROM customer) WHERE symbol NOT IN (SELECT symbol FROM px)""",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "per-symbol")
    t.px.select("date", "symbol", "close").withColumn("part", tables.symbol_code()).write.partitionBy("part").parquet(path)
    universe = t.table("customer").select(tables.symbol_of("c_custkey").alias("symbol"))
    rows, absent = archives.assemble(t.spark, path, universe)
    present = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("present"))
    return present.unionByName(absent.select("symbol", F.lit(0).alias("n"), F.lit("absent").alias("kind")))


@query("io13_wide_to_long", "date symbol net:2", "SELECT date, participant AS symbol, net_futures AS net FROM flows")
def _(t: Inputs):
    names = list(archives.PARTICIPANTS)
    wide = panel.to_wide(t.flows, names, on="participant", value="net_futures")
    return archives.wide_to_long(wide.withColumnRenamed("date", "Day"), "Day", names, "net")


@query("io14_panel_sink", "date symbol close volume", "SELECT date, symbol, close, volume FROM px")
def _(t: Inputs):
    path = scratch_dir(t.spark, "prices")
    sinks.write_panel(t.px, path)
    return sinks.read_panel(t.spark, path)


@query(
    "io14_flow_sinks",
    "kind date name value:2",
    """SELECT 'flows' AS kind, date, participant AS name, net_futures AS value FROM flows
       UNION ALL SELECT 'features', date, 'fii_flow', fii_flow FROM feat UNION ALL SELECT 'features', date, 'dii_flow', dii_flow FROM feat""",
)
def _(t: Inputs):
    """Participant flows and the features made of them, through monthly panels of their own."""
    root = scratch_dir(t.spark, "flows")
    sinks.write_panel(t.flows, f"{root}/flows", name="participant")
    sinks.write_panel(t.features, f"{root}/features", name="date", files=1)
    flows = sinks.read_panel(t.spark, f"{root}/flows").select(F.lit("flows").alias("kind"), "date", F.col("participant").alias("name"), F.col("net_futures").alias("value"))
    wide = sinks.read_panel(t.spark, f"{root}/features").select("date", "fii_flow", "dii_flow")
    features = wide.unpivot("date", ["fii_flow", "dii_flow"], "name", "value").withColumn("kind", F.lit("features"))
    return flows.unionByName(features)


LATEST = """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""


@query("io15_keyed_upsert", "user_id:i event_type event_id:i value:2", LATEST)
def _(t: Inputs):
    root, events = scratch_dir(t.spark, "upsert"), t.table("events")
    late = F.dayofmonth("ts") > 15
    sinks.upsert(t.spark, events.filter(~late), root, ["user_id", "event_type"], ["ts", "event_id"])
    return sinks.upsert(t.spark, events.filter(late), root, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "io16_result_sinks",
    "fmt participant n:i total:2",
    """SELECT f AS fmt, participant, count(*) AS n, sum(net_futures) AS total FROM flows
       CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) v(f) GROUP BY 1, 2""",
)
def _(t: Inputs):
    root, out = scratch_dir(t.spark, "results"), None
    rows = t.flows.select("date", "participant", "net_futures")
    for fmt in ("csv", "json", "parquet"):
        sinks.write_result(rows, f"{root}/{fmt}", fmt)
        back = t.spark.read.schema(rows.schema).option("header", True).format(fmt).load(f"{root}/{fmt}")
        part = back.groupBy("participant").agg(F.count(F.lit(1)).alias("n"), F.sum("net_futures").alias("total")).withColumn(
            "fmt", F.lit(fmt)
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "io17_ingest_coverage",
    "n_rows:i n_sessions:i first_session:d last_session:d n_missing:i",
    """SELECT count(*) AS n_rows, count(DISTINCT date) AS n_sessions, min(date) AS first_session, max(date) AS last_session,
         (SELECT count(*) FROM sessions WHERE date NOT IN (SELECT date FROM flows WHERE day(date) <> 13)) AS n_missing FROM flows WHERE day(date) <> 13""",
)
def _(t: Inputs):
    rows, _ = _ingested(t)
    missing = quality.missing_sessions(t.sessions, rows).agg(F.count(F.lit(1))).scalar()
    return archives.coverage(rows).withColumn("n_missing", missing)


@query(
    "p8_dataset_listing",
    "dataset lag:i unit entity present n_rows:i",
    """SELECT d AS dataset, l AS lag, u AS unit, e AS entity, d = 'prices' AS present, CASE WHEN d = 'prices' THEN (SELECT count(*) FROM px) END AS n_rows
       FROM (VALUES ('prices', 0, 'sessions', 'symbol'), ('flow_features', 0, 'sessions', NULL), ('flows_daily', 1, 'sessions', NULL),
       ('participant_flows', 1, 'sessions', NULL), ('fii_dii_cash', 1, 'sessions', NULL), ('bulk_deals', 1, 'sessions', 'symbol'),
       ('block_deals', 1, 'sessions', 'symbol'), ('shareholding', 21, 'days', 'symbol')) v(d, l, u, e)""",
)
def _(t: Inputs):
    root = scratch_dir(t.spark, "processed")
    sinks.write_panel(t.px, f"{root}/prices")
    counted = sinks.read_panel(t.spark, f"{root}/prices").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("dataset", F.lit("prices"))
    return asof.Registry().describe(t.spark, root).join(counted, "dataset", "left")


# -- incremental jobs --------------------------------------------------------------------


@query("st1_streaming_upsert", "user_id:i event_type event_id:i value:2", LATEST)
def _(t: Inputs):
    root, events = scratch_dir(t.spark, "stream"), t.table("events")
    for part in (events.filter(F.dayofmonth("ts") > 15), events.filter(F.dayofmonth("ts") <= 15)):
        part.write.mode("append").parquet(f"{root}/in")
    source = incremental.file_stream(t.spark, f"{root}/in", events.schema, files_per_batch=1)
    return incremental.accumulate_latest(
        t.spark, source, f"{root}/table", f"{root}/state", ["user_id", "event_type"], ["ts", "event_id"]
    )


@query(
    "st3_resumed_ingest",
    "kind date n:i",
    """SELECT 'rows' AS kind, date, count(*) AS n FROM flows WHERE day(date) <> 13 GROUP BY 2
       UNION ALL SELECT 'missing', date, 0 FROM sessions WHERE date NOT IN (SELECT date FROM flows WHERE day(date) <> 13)""",
)
def _(t: Inputs):
    root, path = scratch_dir(t.spark, "resume"), _participant_files(t)
    source = (
        t.spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 200)
        .option("recursiveFileLookup", True).load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )

    def parse(batch: DataFrame) -> DataFrame:
        return archives.participant_archive(batch)[0].select("date", "participant", "fut_index_long")

    rows, missing = incremental.resume_ingest(t.spark, source, parse, f"{root}/out", f"{root}/state", t.sessions)
    seen = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("rows"))
    return seen.unionByName(missing.select("date", F.lit(0).alias("n"), F.lit("missing").alias("kind")))
