"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores the measurements and one bit per failed rule. Policies
are versioned sets of bits applied to the ledger, so that a new version or an ablation reads no text.
Only DataFrame functions are used.

Nulls, ties and odd input: a null text has no words, no lines and fails the length rule; equal rows get
equal results; an empty table gives no rows; other columns pass through untouched, and the columns that
a ledger adds replace those of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, bind
from tidemark.llm.registry import query, table

WORD = f"[^{SPACE}]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20


def ratio(part: str, whole: str) -> Column:
    """A share that is 0 where the whole is 0."""
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))




def rules() -> tuple[tuple[str, Column], ...]:
    """(name, failure); a rule's bit is its place. Append only: stored ledgers refer to the places."""
    c = F.col
    return (
        ("few_words", c("n_words") < MIN_WORDS),
        ("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        ("symbols", ratio("n_symbols", "n_words") > 0.2),
        ("duplicate_lines", ratio("n_dup_lines", "n_lines") > 0.4),
        ("shouting", ratio("n_shouted", "n_words") > 0.4),
        ("exclamations", ratio("n_exclaimed", "n_words") > 0.2),
        ("word_length", (ratio("word_chars", "n_words") < 2.5) | (ratio("word_chars", "n_words") > 15)),
        ("few_letters", ratio("n_letter_words", "n_words") < 0.7),
        ("ellipses", ratio("n_ellipsis_lines", "n_lines") > 0.4),
        ("bullets", ratio("n_bullet_lines", "n_lines") > 0.9),
        ("stutter", ratio("n_stuttered", "n_words") > 0.3),
    )


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it enforces; a document may fail up to ``allowed`` of them."""

    version: int
    enforced: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        names = [n for n, _ in rules()]
        return sum(1 << names.index(n) for n in self.enforced)


BASE = ("few_words", "repeated_windows")
POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, (*BASE, "symbols", "shouting", "exclamations", "few_letters", "word_length", "stutter")),
    3: Policy(3, (*BASE, "symbols", "shouting", "exclamations", "few_letters", "word_length", "stutter", "duplicate_lines", "ellipses", "bullets")),
}
CURRENT = 3
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted",
    "n_exclaimed", "n_letter_words", "n_ellipsis_lines", "n_bullet_lines", "n_stuttered",
)


def covered(hashes: Column, width: int) -> Column:
    """Words inside windows whose hash occurs twice or more: sort by hash, mark equal neighbours, then
    let every marked window add what the next one does not cover."""

    def mark(pairs: Column) -> Column:
        def twin(pair: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pairs, i - 1)["h"])
            return (F.coalesce(before, pair["h"] + 1) == pair["h"]) | F.coalesce(F.get(pairs, i + 1)["h"] == pair["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

    def spread(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width)))),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        )

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bind(bind(pairs, mark), spread)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """The number of words in ``width``-word windows found twice or more; windows meet by 64-bit hash."""

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashed) - (width - 1))
        return F.when(
            F.size(hashed) > width, F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, width)))
        ).otherwise(F.array().cast("array<bigint>"))

    def count(hashes: Column) -> Column:
        repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeated, covered(hashes, width)).otherwise(F.lit(0).cast("long"))

    return bind(bind(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def measurements(text: Column) -> Column:
    """A struct of all measurements; words and lines are cut once."""

    def of_words(words: Column) -> Column:
        how_many = lambda test: F.size(F.filter(words, test)).cast("long")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeat_words(words).alias("n_repeat_words"),
            how_many(lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")).alias("n_shouted"),
            how_many(lambda w: F.endswith(w, F.lit("!"))).alias("n_exclaimed"),
            how_many(lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
            F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))).cast("long").alias("n_stuttered"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…")))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(f"^[{SPACE}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        )

    def of_text(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(WORD), 0)
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        bare = F.translate(t, " \t\n\x0b\x0c\r", "")
        return F.struct(
            bind(words, of_words).alias("w"),
            bind(lines, of_lines).alias("l"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        )

    return bind(F.coalesce(text, F.lit("")), of_text)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``."""
    own = docs.withColumn("__m", measurements(F.col(text)))
    found = {m: F.col(f"__m.{m}") for m in ("word_chars", "n_symbols")}
    found |= {m: F.col(f"__m.l.{m}") for m in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")}
    found |= {m: F.col(f"__m.w.{m}") for m in ("n_words", "n_repeat_words", "n_shouted", "n_exclaimed", "n_letter_words", "n_stuttered")}
    measured = own.withColumns({m: found[m] for m in MEASURES}).drop("__m")
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(rules()):
        bits = bits + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def passes(policy: Policy) -> Column:
    return F.bit_count(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.allowed


def apply_policy(recorded: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with ``policy`` (its version) and ``kept``."""
    return recorded.withColumns({"policy": F.lit(policy.version), "kept": passes(policy)})


def ablation(recorded: DataFrame, policy: Policy) -> DataFrame:
    """One row per enforced rule: how many documents fail it, and how many more would stay without it.

    One pass of partial aggregation over the bits; no text is read.
    """
    names, enforced = [n for n, _ in rules()], F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    count = lambda test: F.count_if(test)
    sums = []
    for name in policy.enforced:
        bit = 1 << names.index(name)
        has = enforced.bitwiseAND(F.lit(bit).cast("long")) != 0
        gained = has & (F.bit_count(enforced) == policy.allowed + 1)
        sums.append(F.struct(F.lit(name).alias("rule"), count(has).alias("failing"), count(gained).alias("kept_without")))
    return recorded.agg(F.array(*sums).alias("r")).select(F.inline("r"))


#: The ledger of ``documents`` in DuckDB's dialect, rule by rule.
LEDGER_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), x AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS l
  FROM d
), grams AS (
  SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM x)
), twice AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda v: regexp_matches(v, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$'))) AS n_shouted,
         len(list_filter(w, lambda v: v LIKE '%!')) AS n_exclaimed,
         len(list_filter(w, lambda v: regexp_matches(v, '\p{L}'))) AS n_letter_words,
         len(list_filter(l, lambda v: rtrim(v, ' ') LIKE '%...' OR rtrim(v, ' ') LIKE '%…')) AS n_ellipsis_lines,
         len(list_filter(l, lambda v: regexp_matches(v, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stuttered
  FROM x LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
         + 4 * (coalesce(n_symbols / nullif(n_words, 0), 0) > 0.2)::BIGINT
         + 8 * (coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.4)::BIGINT
         + 16 * (coalesce(n_shouted / nullif(n_words, 0), 0) > 0.4)::BIGINT
         + 32 * (coalesce(n_exclaimed / nullif(n_words, 0), 0) > 0.2)::BIGINT
         + 64 * (coalesce(word_chars / nullif(n_words, 0), 0) < 2.5 OR coalesce(word_chars / nullif(n_words, 0), 0) > 15)::BIGINT
         + 128 * (coalesce(n_letter_words / nullif(n_words, 0), 0) < 0.7)::BIGINT
         + 256 * (coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) > 0.4)::BIGINT
         + 512 * (coalesce(n_bullet_lines / nullif(n_lines, 0), 0) > 0.9)::BIGINT
         + 1024 * (coalesce(n_stuttered / nullif(n_words, 0), 0) > 0.3)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, 3 AS policy
FROM b
"""


@query("op7_rule_ledger", LEDGER_SQL)
def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES[CURRENT])
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[1].mask).cast("long")) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits", "policy",
    )
