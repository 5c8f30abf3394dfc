"""Raw archive ingestion as Spark jobs over directories of text files.

One archive file describes one session and is small, so it is read whole; the directory is
what grows, and every file is parsed independently. Malformed files become rows of a
failure table with a reason instead of disappearing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import finalise

#: Published category names and header spellings of the archives (fixed values).
PARTICIPANTS = ("Client", "DII", "FII", "Pro")
PARTICIPANT_HEADERS = {
    "fut_index_long": "future index long",
    "fut_index_short": "future index short",
    "fut_stock_long": "future stock long",
    "fut_stock_short": "future stock short",
    "opt_index_call_long": "option index call long",
    "opt_index_put_long": "option index put long",
    "opt_index_call_short": "option index call short",
    "opt_index_put_short": "option index put short",
    "opt_stock_call_long": "option stock call long",
    "opt_stock_put_long": "option stock put long",
    "opt_stock_call_short": "option stock call short",
    "opt_stock_put_short": "option stock put short",
    "total_long": "total long contracts",
    "total_short": "total short contracts",
}
FUTURES = ("fut_index_long", "fut_index_short", "fut_stock_long", "fut_stock_short")
DEAL_HEADERS = {
    "date": ("date", "deal date"),
    "symbol": ("symbol",),
    "client_name": ("client name",),
    "buy_sell": ("buy/sell", "buy / sell"),
    "quantity": ("quantity traded", "quantity"),
    "price": ("trade price / wght. avg. price", "trade price / wght.avg.price", "trade price", "price"),
}
CASH_DATE_FORMATS = ("dd-MMM-yyyy", "dd-MMMM-yyyy", "dd MMM yyyy", "yyyy-MM-dd", "dd-MM-yyyy")
DEAL_DATE_FORMATS = ("dd-MMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd")
PLACEHOLDER_PREFIX = "DUMMY"


#: Tags that a page opens with.
PAGE_TAGS = ("!doctype", "html", "head", "body", "meta", "title", "script")


#: What may stand before a page's first tag: white space, byte-order marks, declarations and comments.
PAGE_LEAD = r"(?s)^(?:[\s\x{FEFF}]+|<\?[^>]*>|<!--.*?-->)*"
#: Characters, after white space, in which a bare ``<head>`` marks a page whatever stands before it.
HEAD_REACH = 400


def is_html(text: Column) -> Column:
    """An HTML page served in place of data: its first tag says so, or a ``<head>`` near its start."""
    first = F.lower(F.regexp_extract(text, PAGE_LEAD + r"<\s*(!?[A-Za-z]+)", 1))
    start = F.lower(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, HEAD_REACH))
    return first.isin(*PAGE_TAGS) | start.contains("<head>")


def number(text: Column, blanks: Sequence[str] = ("", "-")) -> Column:
    """Numeric text with thousands separators; blanks and dashes are missing."""
    clean = F.regexp_replace(F.trim(text), ",", "")
    return F.when(~clean.isin(*blanks), clean.try_cast("double"))


def any_date(text: Column, formats: Sequence[str]) -> Column:
    """First format that parses, as a date."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


TITLE_DATE_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy")


def title_date(line: Column) -> Column:
    """Session date in a title such as ``... as on Jan 01, 2019``; month long or short."""
    day = F.regexp_extract(line, r'as on\s+([^"]*?\d{4})', 1)
    return any_date(F.initcap(F.regexp_replace(F.regexp_replace(day, r"\s*,\s*", ", "), r"\s+", " ")), TITLE_DATE_FORMATS)


def month_glob(first: dt.date, last: dt.date) -> str:
    """A pattern for names that carry a day of the months from ``first`` to ``last`` as ddMMyyyy."""
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return "{" + ",".join(f"*[0-3][0-9]{m % 12 + 1:02d}{m // 12:04d}*" for m in months) + "}"


def read_files(
    spark: SparkSession, path: str | list[str], glob: str | None = None, *, between: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """``(path, text)`` of every file below a directory.

    With ``between``, of files whose names carry a day in that span as ddMMyyyy: other months are left out
    when files are listed, other days when they are read.
    """
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if between:
        reader = reader.option("pathGlobFilter", month_glob(*between))
    elif glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("_name"))
    if between:
        day = F.try_to_timestamp(F.regexp_extract("_name", r"(\d{8})", 1), F.lit("ddMMyyyy")).cast("date")
        files = files.filter(day.between(*[F.lit(d) for d in between]))
    return files.drop("_name")


def _cells(line: Column) -> Column:
    """Fields of one CSV line as strings; commas inside quotes do not separate."""
    fields = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(fields, lambda x: F.regexp_replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), '""', '"'))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")


def _header_name(cell: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(cell), '"', "")))


def table_rows(files: DataFrame, header_at: Column) -> DataFrame:
    """Explode files into ``(path, line, header, cells)``; ``header_at`` is 0-based over ``_lines``."""
    heads = files.withColumn("_head", header_at)
    named = heads.withColumn(
        "header", F.transform(_cells(F.get("_lines", F.col("_head"))), _header_name)
    )
    return (
        named.select(
            *[c for c in named.columns if c not in ("_lines", "_head")],
            F.posexplode(F.slice("_lines", F.col("_head") + 2, F.greatest(F.size("_lines"), F.lit(1)))).alias("line", "_raw"),
        )
        .withColumn("cells", _cells(F.col("_raw")))
        .drop("_raw")
    )


def cell(*names: str) -> Column:
    """The field under the first of the given header spellings that the file carries."""
    position = F.coalesce(
        *[F.nullif(F.array_position("header", F.lit(n)), F.lit(0).cast("long")) for n in names]
    )
    return F.get("cells", (position - 1).cast("int"))


def has_header(*names: str) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | F.coalesce(F.array_contains("header", F.lit(n)), F.lit(False))
    return found


# -- participant positions ---------------------------------------------------------------


def participant_archive(
    files: DataFrame, *, date_pattern: str | None = r"(\d{8})", date_format: str = "ddMMyyyy"
) -> tuple[DataFrame, DataFrame]:
    """Participant derivatives archives -> ``(rows, failures)``.

    The date comes from the path (authoritative) when ``date_pattern`` is given, else from
    the title line. Rows outside the four categories, such as totals, are dropped.
    """
    lined = files.withColumn("_lines", _lines(F.col("text")))
    first = F.get("_lines", F.lit(0))
    header_first = F.contains(_header_name(F.get(F.split(first, ","), F.lit(0))), F.lit("client type"))
    head_at = F.when(header_first, 0).otherwise(1)
    header = F.transform(_cells(F.get("_lines", head_at)), _header_name)
    if date_pattern:
        stamp = F.regexp_extract(F.element_at(F.split("path", "/"), -1), date_pattern, 1)
        parent = F.regexp_extract("path", r"=" + date_pattern, 1)
        day = F.coalesce(*[F.try_to_timestamp(s, F.lit(date_format)).cast("date") for s in (stamp, parent)])
    else:
        day = title_date(first)
    required = F.array(F.lit("client type"), *[F.lit(PARTICIPANT_HEADERS[c]) for c in FUTURES])
    absent = F.array_except(required, F.coalesce("_header", F.array().cast("array<string>")))
    faults = F.array(
        F.when(F.col("date").isNull(), "no session date"),
        F.when(is_html(F.col("text")), "HTML page"),
        F.when(F.size("_lines") <= F.col("_head_at"), F.when(F.size("_lines") > 0, "title without data").otherwise("empty file")),
        F.when(F.size(absent) > 0, F.when(F.get(absent, F.lit(0)) == "client type", "no client type column").otherwise("futures column missing")),
    )
    judged = lined.withColumns({"date": day, "_header": header, "_head_at": head_at}).withColumn(
        "reason", F.get(F.array_compact(faults), F.lit(0))
    )
    usable = judged.filter(F.col("reason").isNull()).select("path", "date", "_lines", "_head_at")
    exploded = table_rows(usable, F.col("_head_at"))
    typed = exploded.select(
        "path",
        "date",
        F.trim(cell("client type")).alias("participant"),
        *[number(cell(h)).alias(c) for c, h in PARTICIPANT_HEADERS.items()],
    ).filter(F.col("participant").isin(*PARTICIPANTS))
    net = F.col("fut_index_long") + F.col("fut_stock_long") - F.col("fut_index_short") - F.col("fut_stock_short")
    rows = typed.withColumn("net_futures", net)
    no_category = (
        usable.select("path", "date")
        .join(rows.select("path").distinct(), "path", "left_anti")
        .withColumn("reason", F.lit("no known category"))
    )
    failures = judged.filter(F.col("reason").isNotNull()).select("path", "date", "reason").unionByName(no_category)
    return rows.drop("path"), failures


def coverage(rows: DataFrame) -> DataFrame:
    """Rows, sessions covered and the first and last session of an ingest."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("date").alias("n_sessions"),
        F.min("date").alias("first_session"),
        F.max("date").alias("last_session"),
    )


# -- exchange bars -----------------------------------------------------------------------

_BAR_REQUIRED = ("symbol", "series", "open_price", "high_price", "low_price", "close_price", "ttl_trd_qnty")


def bar_archive(
    files: DataFrame, *, series: Sequence[str] = ("EQ",), session_date: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Daily exchange bars -> ``(canonical prices, failures)``.

    Only the wanted series; dashes are missing; reported turnover arrives in lakhs. Prices
    are unadjusted, so the adjusted close equals the close until an adjusted source exists.
    """
    lined = files.withColumn("_lines", _lines(F.col("text")))
    header = F.transform(_cells(F.get("_lines", F.lit(0))), _header_name)
    lacking = F.size(F.array_except(F.array(*[F.lit(c) for c in _BAR_REQUIRED]), "_header")) > 0
    dateless = F.lit(session_date is None) & ~F.coalesce(F.array_contains("_header", F.lit("date1")), F.lit(False))
    judged = lined.withColumn("_header", header).withColumn(
        "reason",
        F.when(is_html(F.col("text")), "HTML page")
        .when(F.size("_lines") == 0, "empty file")
        .when(lacking, "columns missing")
        .when(dateless, "no date column"),
    )
    rows = table_rows(judged.filter(F.col("reason").isNull()).select("path", "_lines"), F.lit(0))
    day = session_date if session_date is not None else any_date(cell("date1"), ("dd-MMM-yyyy",))
    typed = rows.filter(F.trim(cell("series")).isin(*series)).select(
        "path",
        "line",
        day.alias("date"),
        F.trim(cell("symbol")).alias("symbol"),
        number(cell("open_price")).alias("open"),
        number(cell("high_price")).alias("high"),
        number(cell("low_price")).alias("low"),
        number(cell("close_price")).alias("close"),
        number(cell("ttl_trd_qnty")).alias("volume"),
        number(cell("deliv_per")).alias("delivery_pct"),
        (number(cell("turnover_lacs")) * F.lit(1e5)).alias("_reported"),
    )
    bars = typed.withColumns(
        {
            "adj_close": F.col("close"),
            "turnover": F.coalesce("_reported", F.col("close") * F.col("volume")),
        }
    ).drop("_reported")
    failures = judged.filter(F.col("reason").isNotNull()).select("path", "reason")
    return finalise(bars, order=[F.col("path"), F.col("line")]), failures


# -- cash flows, deals, constituents -----------------------------------------------------

_CASH_LIST = "array<struct<category:string,date:string,buyValue:string,sellValue:string,netValue:string>>"


def cash_flows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Institutional cash-flow JSON (a list, or a list under ``data``) -> ``(rows, failures)``."""
    listed = F.from_json("text", _CASH_LIST)
    nested = F.from_json("text", f"data {_CASH_LIST}")["data"]
    is_list = F.startswith(F.ltrim("text"), F.lit("["))
    parsed = files.withColumn("_entries", F.when(is_list, listed).otherwise(nested))
    reason = F.when(is_html(F.col("text")), "HTML page").when(F.col("_entries").isNull(), "not valid JSON")
    judged = parsed.withColumn("reason", reason)
    entries = judged.filter(F.col("reason").isNull()).select("path", F.inline("_entries"))
    label = F.upper(F.trim("category"))
    who = F.when(F.startswith(label, F.lit("FII")) | F.startswith(label, F.lit("FPI")), "FII").when(
        F.startswith(label, F.lit("DII")), "DII"
    )
    blanks = ("", "-", "NA", "na")
    rows = entries.select(
        "path",
        any_date(F.col("date"), CASH_DATE_FORMATS).alias("date"),
        who.alias("participant"),
        number(F.col("buyValue"), blanks).alias("buy_crore"),
        number(F.col("sellValue"), blanks).alias("sell_crore"),
        number(F.col("netValue"), blanks).alias("net_crore"),
    ).filter(F.col("participant").isNotNull())
    undated = rows.filter(F.col("date").isNull()).select("path").distinct().withColumn("reason", F.lit("unparseable date"))
    failures = judged.filter(F.col("reason").isNotNull()).select("path", "reason").unionByName(undated)
    return rows.filter(F.col("date").isNotNull()).drop("path"), failures


def deals(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk and block deals with header aliases and three date formats -> ``(rows, failures)``."""
    lined = files.withColumn("_lines", _lines(F.col("text")))
    header = F.transform(_cells(F.get("_lines", F.lit(0))), _header_name)
    judged = lined.withColumn("header", header).withColumn(
        "reason",
        F.when(is_html(F.col("text")), "HTML page")
        .when(F.size("_lines") == 0, "empty file")
        .when(~has_header(*DEAL_HEADERS["date"]) | ~has_header("symbol"), "columns missing"),
    )
    rows = table_rows(judged.filter(F.col("reason").isNull()).select("path", "_lines"), F.lit(0))
    typed = rows.select(
        any_date(cell(*DEAL_HEADERS["date"]), DEAL_DATE_FORMATS).alias("date"),
        F.trim(cell("symbol")).alias("symbol"),
        F.trim(cell(*DEAL_HEADERS["client_name"])).alias("client_name"),
        F.trim(cell(*DEAL_HEADERS["buy_sell"])).alias("buy_sell"),
        number(cell(*DEAL_HEADERS["quantity"])).alias("quantity"),
        number(cell(*DEAL_HEADERS["price"])).alias("price"),
    )
    return typed, judged.filter(F.col("reason").isNotNull()).select("path", "reason")


def constituents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index constituents -> ``(members, placeholders)``; tradable series, first row per symbol."""
    lined = files.withColumn("_lines", _lines(F.col("text"))).filter(~is_html(F.col("text")))
    rows = table_rows(lined.select("path", "_lines"), F.lit(0)).select(
        "path",
        "line",
        F.trim(cell("symbol")).alias("symbol"),
        F.trim(cell("industry")).alias("industry"),
        F.trim(cell("series")).alias("series"),
    )
    kept = rows.filter((F.col("series") == "EQ") & (F.col("symbol") != ""))
    first = kept.groupBy("symbol").agg(F.min_by("industry", F.struct("path", "line")).alias("industry"))
    placeholder = F.startswith(F.upper("symbol"), F.lit(PLACEHOLDER_PREFIX))
    return first.filter(~placeholder), first.filter(placeholder).select("symbol")


# -- dimensions and vendor frames --------------------------------------------------------


def dimension_csv(spark: SparkSession, path: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """CSV dimension with case-insensitive headers; ``wanted`` maps a column to its spellings."""
    raw = spark.read.option("header", True).csv(path)
    lower = {c.lower().strip(): c for c in raw.columns}
    picked = []
    for out, spellings in wanted.items():
        hit = next((lower[s] for s in spellings if s in lower), None)
        if hit is None:
            raise ValueError(f"{path}: none of {spellings} among {raw.columns}")
        picked.append(F.col(f"`{hit}`").alias(out))
    return raw.select(*picked)


def sector_csv(spark: SparkSession, path: str) -> DataFrame:
    return dimension_csv(spark, path, {"symbol": ("symbol",), "sector": ("sector", "industry")})


def share_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = dimension_csv(spark, path, {"symbol": ("symbol",), "shares": ("shares",)})
    return raw.select("symbol", F.col("shares").try_cast("double").alias("shares")).filter("shares IS NOT NULL")


def session_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = dimension_csv(spark, path, {"date": ("date",)})
    return raw.select(F.col("date").cast("date").alias("date"))


def assemble(spark: SparkSession, paths: list[str] | str, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many per-symbol parquet files as one panel, plus the symbols that brought no row."""
    panel = spark.read.option("recursiveFileLookup", True).parquet(*([paths] if isinstance(paths, str) else paths))
    absent = universe.select("symbol").distinct().join(panel.select("symbol").distinct(), "symbol", "left_anti")
    return panel, absent


def wide_to_long(df: DataFrame, date: str, tickers: Sequence[str], value: str) -> DataFrame:
    """A vendor frame with one column per ticker as typed ``(date, symbol, value)`` rows."""
    return (
        df.select(F.col(date).cast("date").alias("date"), *[F.col(f"`{t}`").cast("double").alias(t) for t in tickers])
        .unpivot(["date"], list(tickers), "symbol", value)
        .filter(F.col(value).isNotNull())
    )


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest row per key by arrival order.

    ``max_by`` keeps one candidate per key and task before the shuffle, so a key that
    arrives very often stays cheap.
    """
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


