"""Spelling variants: words one edit apart, found through a dictionary of trie-node pairs.

The words' forward trie and the trie of the reversed words are numbered: a node stands for a prefix or a
suffix. A word that skips its character at position i gives the pair (node of what precedes, node of what
follows); a word that is parted before position i gives the pair of the two parts. Two words with one
skipping pair in common differ by one replaced character. A word that skips meets the one word that is
parted at the same pair if deleting the character turns the first into the second; of a run of equal
characters only the first is skipped for that, so that each such two words meet once. Nothing is verified
afterwards, as equal pairs are equal texts.

Numbering a trie is one pass over sorted words: a word's nodes up to its common prefix with the word
before are those of that word, the rest are new and numbered on. Words are sorted over range partitions;
what a partition takes over from those before it (the nodes of one word) passes through the driver, one
row per partition. A prefix or suffix that only one word has meets nothing, so its pairs are left out:
the sorted neighbours tell.

The rows of a pair are the words that differ in one place, at most one per character of the alphabet and
the parted word. They are ranked within their list, so a word learns how many it meets and which is most
frequent without a list of all pairs of words.

Nulls and odd input: a null text has no words; a null id counts as an empty string in the hash; equal
rows are occurrences of their own; ties of frequency go to the word first in code-point order; words and
texts may have any length (a word of length n gives at most n + n rows); an empty table gives no rows;
other columns are ignored, so that their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ORDINAL_BITS, ranged, stage
from tidemark.llm.registry import query, table
from tidemark.llm.sqltext import CRC_TABLE, crc32, lower_ascii

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is so many times as frequent as its variant.
RATIO = 2
#: One occurrence in so many loses a character.
MISSPELT = 97
#: Words that a task counts before it hands them on; this bounds its memory and changes no result.
COUNTED = 300_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_counts(docs: DataFrame, misspelt: int = MISSPELT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all letter runs of whole texts (doc_id, text), after deleting a character of some.

    An occurrence loses the code point at h modulo its length if ``misspelt`` divides h, the CRC-32 of its
    document's id, a colon and itself.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for told, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{told.as_py()}:".encode())
                for word, times in Counter(run_of.findall(text.as_py().translate(LOWER).decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % misspelt == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += times
                if len(total) >= COUNTED:
                    yield handed()
        yield handed()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def edge_of(part: pa.Table) -> pa.Table:
    """A partition's first and last word, its number of nodes if it stood alone, and its last word's nodes."""
    words = part.sort_by("__pos").column("word").to_pylist()
    nodes, number, before = [], 0, ""
    for word in words:
        keep = common(before, word)
        nodes[keep:] = range(number, number + len(word) - keep)
        number, before = number + len(word) - keep, word
    return pa.table({
        "part": part.column("__part")[:1], "first": [words[0]], "last": [words[-1]],
        "nodes": pa.array([number], pa.int64()), "stack": pa.array([nodes], pa.list_(pa.int64())),
    })


def takeovers(edges: list) -> dict[int, tuple[str, list[int], int, str]]:
    """By partition: the word before it, that word's nodes, the first free number, the word after it.

    ``edges`` has one row per partition. The root is node 0.
    """
    edges, found = sorted(edges, key=lambda e: e["part"]), {}
    before, nodes, free = "", [], 1
    for i, e in enumerate(edges):
        found[e["part"]] = (before, nodes, free, edges[i + 1]["first"] if i + 1 < len(edges) else "")
        keep = common(before, e["first"])
        nodes = [nodes[x] if x < keep else free + x - keep for x in e["stack"]]
        before, free = e["last"], free + e["nodes"] - keep
    return found


def shared_nodes(words: DataFrame, purpose: str) -> DataFrame:
    """id, word and ``nodes`` of every distinct ``word`` (with ``id``): those of its prefixes, by length from
    0, that another word has too."""
    sorted_ = ranged(words.select("id", "word"), ["word"], purpose)
    parts = sorted_.groupBy("__part")
    edge = "part int, first string, last string, nodes bigint, stack array<bigint>"
    taken = takeovers(parts.applyInArrow(edge_of, edge).collect())  # one row per partition

    def number(part: pa.Table) -> pa.Table:
        part = part.sort_by("__pos")
        words = part.column("word").to_pylist()
        before, nodes, free, after = taken[part.column("__part")[0].as_py()]
        nodes, keep, out = list(nodes), common(before, words[0]), []
        for word, following in zip(words, [*words[1:], after], strict=True):
            nodes[keep:] = range(free, free + len(word) - keep)
            free += len(word) - keep
            ahead = common(word, following)
            out.append([0, *nodes[: max(keep, ahead)]])
            keep = ahead
        return pa.table({"id": part.column("id"), "word": part.column("word"), "nodes": pa.array(out, pa.list_(pa.int64()))})

    return parts.applyInArrow(number, "id bigint, word string, nodes array<bigint>")


#: What a word is to a pair: parted there, skipping a character, or skipping one that differs from the character before.
PARTED, SKIPS, LEADS = 0, 1, 2


def pairs(words: DataFrame) -> DataFrame:
    """prefix, suffix, id, n, role: the node pairs of ``words`` (id, word, n) that may meet others."""
    ahead = shared_nodes(words, "variants-prefixes").select("id", F.col("nodes").alias("_p"))
    behind = shared_nodes(words.select("id", F.reverse("word").alias("word")), "variants-suffixes").select("id", F.col("nodes").alias("_s"))
    every = words.join(ahead, "id").join(behind, "id").withColumn("_l", F.length("word"))

    def of(skipped: int, role) -> Column:
        """The pairs with ``skipped`` characters between their two parts, as an array."""
        low = F.greatest(F.lit(0), F.col("_l") - skipped - (F.size("_s") - 1))
        high = F.least(F.size("_p") - 1, F.col("_l") - skipped)
        at = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.get("_p", i).alias("prefix"), F.get("_s", F.col("_l") - skipped - i).alias("suffix"), role(i).alias("role")))

    character = lambda i: F.substring(F.col("word"), i, F.lit(1))
    skips = of(1, lambda i: F.when((i > 0) & (character(i) == character(i + 1)), F.lit(SKIPS)).otherwise(F.lit(LEADS)))
    parted = of(0, lambda i: F.lit(PARTED))
    return every.select("id", "n", F.explode(F.concat(skips, parted)).alias("_pair")).select("_pair.*", "id", "n")


def meetings(met: DataFrame) -> DataFrame:
    """id, n_near, best (n, minus id): the near words of every id that has any, counted and the most frequent."""
    row = F.struct("n", (-F.col("id")).alias("minus"), "role")
    # At most one row per character and one for the parted word.
    lists = met.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(row), asc=False).alias("_all")).where(F.size("_all") > 1)
    skip = F.filter("_all", lambda e: e["role"] != PARTED)
    lists = lists.select(skip.alias("_skip"), F.filter("_all", lambda e: e["role"] == PARTED).alias("_part"))
    lists = lists.withColumn("_lead", F.filter("_skip", lambda e: e["role"] == LEADS))

    def seen(e: Column) -> Column:
        """What a skipping word sees: the others that skip, and the parted one if it leads."""
        other = F.when(F.get("_skip", F.lit(0))["minus"] == e["minus"], F.get("_skip", F.lit(1))).otherwise(F.get("_skip", F.lit(0)))
        parted = F.when(e["role"] == LEADS, F.get("_part", F.lit(0)))
        bare = lambda x: F.when(x.isNotNull(), F.struct(x["n"].alias("n"), x["minus"].alias("minus")))
        near = F.size("_skip") - 1 + F.when(parted.isNotNull(), 1).otherwise(0)
        return F.struct((-e["minus"]).alias("id"), near.alias("near"), F.greatest(bare(other), bare(parted)).alias("best"))

    lead = F.get("_lead", F.lit(0))
    told = F.transform("_part", lambda e: F.struct(
        (-e["minus"]).alias("id"), F.size("_lead").alias("near"), F.when(lead.isNotNull(), F.struct(lead["n"].alias("n"), lead["minus"].alias("minus"))).alias("best")
    ))
    rows = lists.select(F.explode(F.concat(F.transform("_skip", seen), told)).alias("_r")).select("_r.*").where("near > 0")
    return rows.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: where following ``form_id`` from every ``id`` ends. Each round doubles the steps taken; a form
    is at least twice as frequent, so paths are short and have no circle."""
    current = stage(forms.select("id", F.col("form_id").alias("root")), "variants-roots")
    while True:
        beyond = current.select(F.col("id").alias("_at"), F.col("root").alias("_next"))
        step = current.join(beyond, F.col("root") == F.col("_at"), "left")
        current = stage(step.select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variants-roots")
        if current.where("_moved").isEmpty():
            return current.select("id", "root")


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every distinct ``word`` of ``counts`` (word, n).

    Near words differ by one inserted, deleted or replaced code point. A word's form is its most frequent
    near word if that is at least ``ratio`` times as frequent; its root is where forms lead.
    """
    own = ranged(counts.where("word IS NOT NULL").select("word", "n"), ["word"], "variants-words")
    # Ids ascend in code-point order.
    words = own.select((F.shiftleft(F.col("__part").cast("long"), ORDINAL_BITS) + F.col("__pos")).alias("id"), "word", "n")
    found = words.join(meetings(pairs(words)), "id", "left")
    has_form = F.col("best.n") >= F.lit(ratio) * F.col("n")
    found = stage(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, -F.col("best.minus")).alias("form_id")), "variants-near")
    ends = roots(found.where("form_id IS NOT NULL"))
    name = lambda kind: words.select(F.col("id").alias(f"_{kind}"), F.col("word").alias(kind), F.col("n").alias(f"{kind}_n"))
    led = found.where("form_id IS NOT NULL").join(ends, "id").join(name("form"), F.col("form_id") == F.col("_form"))
    led = led.withColumnRenamed("root", "root_id").join(name("root"), F.col("root_id") == F.col("_root"))
    bare = found.where("form_id IS NULL").select("word", "n", "n_near", F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root"))
    return led.select("word", "n", "n_near", "form", F.col("form_n").cast("long").alias("form_n"), "root").unionByName(bare)


SQL = f"""
WITH RECURSIVE tab AS (SELECT {CRC_TABLE} AS tab),
runs AS (SELECT doc_id, w, count(*) AS k
         FROM (SELECT doc_id, unnest(regexp_extract_all({lower_ascii('text')}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) GROUP BY doc_id, w),
hashed AS (SELECT w, k, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM runs, tab),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
skips AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT s.word AS long_word, s.n AS long_n, w.word, w.n FROM skips s JOIN words w ON s.a || s.b = w.word),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
         UNION ALL SELECT long_word, word, n FROM shorter UNION ALL SELECT word, long_word, long_n FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top, min_by(other, (-other_n, other)) AS other FROM near GROUP BY word),
found AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * n THEN other END AS form,
          CASE WHEN top >= 2 * n THEN top END::BIGINT AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
led AS (SELECT word, word AS reached, form AS next FROM found
        UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN found f ON l.next = f.word)
SELECT f.word, n, n_near, form, form_n, reached AS root FROM found f JOIN led l ON f.word = l.word AND l.next IS NULL
"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(table(spark, sf_dir, "documents")))
