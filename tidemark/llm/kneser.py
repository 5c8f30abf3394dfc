"""Quality classifier: an interpolated modified Kneser-Ney n-gram model trained on trusted text.

The model is over characters (UTF-16 units) of each language, of order 4, so that a gram fits one long:
16 bits a character, an absent character 0. Counting, discounts, back-off weights and probabilities are
Spark aggregates and joins on (lang, gram), i.e. sharded by gram. Scoring asks for the grams of a block
of documents once: the distinct grams of each block join the model's shards, and the answers return to
their block, where every document's perplexity is summed. What is gathered grows with the text, and no
table of the model is ever held whole.

A document is kept if its perplexity is at most the limit of its language: a quantile over trusted
documents that were held out of training, times a margin. A language with trusted text none of which was
held out takes the quantile over the held-out documents of all languages; if there are none at all, every
document is kept. Quantiles come from a histogram of log
perplexity in steps of 1/1000.

Trusted are labelled documents of quality 1 that are not toxic. Nulls, ties and odd input: a null text is
empty and has only the end to predict; a null language is a language of its own; a language without
trusted text has no model, so its documents have a null perplexity and are kept; equal rows score
equally; repeated labels count once if any trusts; an empty table gives no rows; other columns pass
through ``classify`` untouched, and its own (perplexity, limit, kept) replace those of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.registry import query, table

ORDER = 4
UNIT_BITS = 16
BEGIN, FINISH, OTHER = 1, 2, 0xFFFF
#: Rows of a block. A block's text, grams and answers are in memory at once.
BLOCK_ROWS = 8192
#: Characters whose grams are sorted at once.
CHUNK = 1 << 21
#: One trusted document in so many is held out to set the limits.
HELD_OUT = 8
QUANTILE = 0.99
MARGIN = 1.25
STEP = 1000
LABELS = "doc_id bigint, trusted boolean"


def units(text: str | None) -> np.ndarray:
    """The text's UTF-16 units with three begin marks and an end mark; the marks' own codes are replaced."""
    raw = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2")
    out = np.empty(len(raw) + ORDER, np.uint64)
    out[: ORDER - 1], out[-1] = BEGIN, FINISH
    out[ORDER - 1 : -1] = np.where(raw <= FINISH, OTHER, raw)
    return out


def grams(u: np.ndarray) -> np.ndarray:
    """The grams of order 4 that end at each character after the begin marks."""
    s = np.uint64(UNIT_BITS)
    return ((u[:-3] << s | u[1:-2]) << s | u[2:-1]) << s | u[3:]


def distinct(texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) over texts, sorted; chunks are merged as they come."""
    keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merge() -> None:
        nonlocal keys, counts, held, size
        k, c = np.unique(np.concatenate(held), return_counts=True)
        both = np.concatenate([keys, k])
        order = np.argsort(both, kind="stable")
        both, c = both[order], np.concatenate([counts, c])[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        keys, counts, held, size = both[first], np.add.reduceat(c, first), [], 0

    for text in texts:
        held.append(grams(units(text)))
        size += len(held[-1])
        if size >= CHUNK:
            merge()
    if held:
        merge()
    return keys, counts


def by_language(langs: list[str | None]) -> dict[str | None, list[int]]:
    found: dict[str | None, list[int]] = {}
    for i, lang in enumerate(langs):
        found.setdefault(lang, []).append(i)
    return found


def rows_of(docs: pa.Table) -> tuple[list, list, pa.ChunkedArray]:
    return docs.column("doc_id").to_pylist(), docs.column("lang").to_pylist(), docs.column("text")


def trusted_rows(ids: list, labels: pa.Table) -> tuple[set, set]:
    """The block's trusted ids: (training, held out)."""
    good = {i for i, t in zip(labels.column("doc_id").to_pylist(), labels.column("trusted").to_pylist(), strict=True) if t}
    good &= set(ids)
    held = {i for i in good if (i * 2654435761 % 4294967291) % HELD_OUT == 0}
    return good - held, held


def count_trusted(key: tuple, docs: pa.Table, labels: pa.Table) -> pa.Table:
    """The grams of a block's training documents."""
    ids, langs, texts = rows_of(docs)
    train, _ = trusted_rows(ids, labels)
    out = []
    for lang, own in by_language(langs).items():
        k, c = distinct(texts[i].as_py() for i in own if ids[i] in train)
        out.append(pa.table({"lang": pa.array([lang] * len(k), pa.string()), "gram": k.view(np.int64), "c": c}))
    return pa.concat_tables(out)


def ask(key: tuple, docs: pa.Table) -> pa.Table:
    """All grams, of every order, that scoring a block may need."""
    _, langs, texts = rows_of(docs)
    out = []
    for lang, own in by_language(langs).items():
        k, _ = distinct(texts[i].as_py() for i in own)
        # What precedes a character is a gram of lower order too, and so is what its first one leaves.
        every = [k] + [x for o in range(1, ORDER) for x in (np.unique(k & np.uint64((1 << UNIT_BITS * o) - 1)), np.unique(k >> np.uint64(UNIT_BITS) & np.uint64((1 << UNIT_BITS * o) - 1)))]
        every = np.unique(np.concatenate(every))
        out.append(pa.table({"block": pa.array([key[0].as_py()] * len(every), pa.int32()), "lang": pa.array([lang] * len(every), pa.string()), "gram": every.view(np.int64)}))
    return pa.concat_tables(out)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, nan where absent."""
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.nan)


def log_probabilities(k: np.ndarray, keys: np.ndarray, logp: np.ndarray, back: np.ndarray, unseen: float, order: int = ORDER) -> np.ndarray:
    """Log probability of the last character of each gram; only grams that are absent back off."""
    suffix = k & np.uint64((1 << UNIT_BITS * order) - 1)
    got = look_up(keys, logp, suffix)
    missing = np.isnan(got)
    if missing.any():
        weight = np.nan_to_num(look_up(keys, back, suffix[missing] >> np.uint64(UNIT_BITS))) if order > 1 else 0.0
        got[missing] = weight + (log_probabilities(k[missing], keys, logp, back, unseen, order - 1) if order > 1 else unseen)
    return got


def score_block(docs: pa.Table, answers: pa.Table, labels: pa.Table | None) -> pa.Table:
    """doc_id, lang, text_hash, perplexity and whether a document is held out, for every row of a block."""
    ids, langs, texts = rows_of(docs)
    held = set() if labels is None else trusted_rows(ids, labels)[1]
    mean = np.full(len(ids), np.nan)
    told = by_language(answers.column("lang").to_pylist())
    gram, logp, back = (answers.column(c).to_numpy() for c in ("gram", "logp", "back"))
    for lang, own in by_language(langs).items():
        at = np.array(told.get(lang, []), np.int64)
        keys = gram[at].view(np.uint64)
        order = np.argsort(keys)
        at, keys = at[order], keys[order]
        floor = at[keys == 0]
        if not len(floor):
            continue  # no model for this language
        unseen = float(logp[floor[0]])
        p, b = logp[at[keys > 0]], back[at[keys > 0]]
        keys = keys[keys > 0]
        for i in own:
            g = grams(units(texts[i].as_py()))
            total = 0.0
            for s in range(0, len(g), CHUNK):
                total += float(log_probabilities(g[s : s + CHUNK], keys, p, b, unseen).sum())
            mean[i] = total / len(g)
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "text_hash": docs.column("text_hash"),
        "perplexity": pa.array(np.exp(-mean), from_pandas=True), "held": pa.array([i in held for i in ids], pa.bool_()),
    })


def discounted(counts: DataFrame) -> DataFrame:
    """lang, order, gram, c, and the discount of each count, from the order's counts of counts.

    Where a corpus is too small for the estimates the usual 0.5, 1 and 1.5 serve.
    """
    of = lambda n: F.sum((F.col("c") == n).cast("double"))
    own = counts.groupBy("lang", "order").agg(of(1).alias("n1"), of(2).alias("n2"), of(3).alias("n3"), of(4).alias("n4"))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    level = lambda k, a, b, d: F.when((F.col(a) > 0) & (F.col(b) > 0), F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(b) / F.col(a)))).otherwise(d)
    own = own.select(
        F.col("lang").alias("_l"), F.col("order").alias("_o"),
        level(1, "n1", "n2", 0.5).alias("d1"), level(2, "n2", "n3", 1.0).alias("d2"), level(3, "n3", "n4", 1.5).alias("d3"),
    )
    joined = counts.join(own, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("order") == F.col("_o"))).drop("_l", "_o")
    return joined.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))


def model(counts: DataFrame) -> DataFrame:
    """lang, gram, logp (of its last character), back (log weight of backing off from it); gram 0 has the
    log probability of a character never seen.

    ``counts`` has the grams of order 4. Lower orders count the distinct characters before a gram.
    """
    mask = lambda o: (1 << UNIT_BITS * o) - 1
    of_order = {ORDER: counts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))}
    for o in range(ORDER - 1, 0, -1):
        of_order[o] = of_order[o + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask(o)).cast("long")).alias("gram")).agg(F.count("*").alias("c"))
    every = None
    for o, frame in of_order.items():
        rows = frame.select("lang", F.lit(o).alias("order"), "gram", "c")
        every = rows if every is None else every.unionByName(rows)
    every = stage(discounted(stage(every, "lm-counts")), "lm-discounts")

    context = F.call_function("shiftrightunsigned", F.col("gram"), F.lit(UNIT_BITS))
    contexts = every.groupBy("lang", "order", context.alias("context")).agg(F.sum("c").alias("total"), F.sum("d").alias("off"))
    contexts = contexts.withColumn("weight", F.col("off") / F.col("total"))
    types = every.where("order = 1").groupBy("lang").agg((F.count("*") + 1).alias("_v"))

    empty = contexts.where("order = 1").join(types.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")))
    unseen = stage(empty.select("lang", (F.col("weight") / F.col("_v")).alias("p0")), "lm-unseen")
    lower = None
    for o in range(1, ORDER + 1):
        own = every.where(F.col("order") == o).withColumn("context", context)
        totals = contexts.where(F.col("order") == o).select(F.col("lang").alias("_l"), F.col("context").alias("_c"), "total", "weight")
        own = own.join(totals, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("context") == F.col("_c"))).drop("_l", "_c")
        if lower is None:
            below = unseen.select(F.col("lang").alias("_l"), F.col("p0").alias("below"))
            own = own.join(below, F.col("lang").eqNullSafe(F.col("_l")))
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("below")
        else:
            below = lower.select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), F.col("p").alias("below"))
            suffix = F.col("gram").bitwiseAND(F.lit(mask(o - 1)).cast("long"))
            own = own.join(below, F.col("lang").eqNullSafe(F.col("_l")) & (suffix == F.col("_g")))
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")
        lower = stage(own.select("lang", "gram", p.alias("p")), f"lm-order{o}")
        found = lower if o == 1 else found.unionByName(lower)  # noqa: F821
    back = contexts.where("order > 1").select(F.col("lang").alias("_l"), F.col("context").alias("_c"), F.log("weight").alias("back"))
    grams_ = found.join(back, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("gram") == F.col("_c")), "full")
    grams_ = grams_.select(F.coalesce("lang", "_l").alias("lang"), F.coalesce("gram", "_c").alias("gram"), F.log("p").alias("logp"), "back")
    floor = unseen.select("lang", F.lit(0).cast("long").alias("gram"), F.log("p0").alias("logp"), F.lit(None).cast("double").alias("back"))
    return stage(grams_.unionByName(floor), "lm")


def deal(docs: DataFrame, blocks: int) -> DataFrame:
    """block and docs: the rows of ``docs``, dealt to blocks by doc_id, as compressed Arrow streams.

    Many documents share a stream, so that what is shuffled is smaller than the texts by themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            number, rows = batch.column("block").to_numpy(), batch.select(["doc_id", "lang", "text", "text_hash"])
            for block in np.unique(number):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, rows.schema, options=options) as stream:
                    stream.write_batch(rows.take(pa.array(np.flatnonzero(number == block))))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

    text = docs.select(
        block_of("doc_id", blocks), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    return text.mapInArrow(run, "block int, docs binary")


def block_of(doc_id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(blocks)).cast("int").alias("block")


def opened(dealt: pa.Table) -> pa.Table:
    """The documents of a block."""
    tables = [pa.ipc.open_stream(d.as_buffer()).read_all() for d in dealt.column("docs")]
    return pa.concat_tables(tables) if tables else pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "text": pa.array([], pa.string()), "text_hash": pa.array([], pa.int64())})


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash, perplexity, held of every document; ``trusted`` has doc_id and trusted."""
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    labels = trusted.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("trusted").alias("trusted"))
    labels = labels.where("trusted").select(block_of("doc_id", blocks), "doc_id", "trusted")
    text = deal(docs, blocks).groupBy("block")

    def count(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"lang": pa.array([], pa.string()), "gram": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        return count_trusted(key, opened(left), right) if left.num_rows else none

    counts = text.cogroup(labels.groupBy("block")).applyInArrow(count, "lang string, gram bigint, c bigint")
    lm = model(counts)
    asked = text.applyInArrow(lambda key, left: ask(key, opened(left)), "block int, lang string, gram bigint")
    floor = docs.select(block_of("doc_id", blocks), F.col("lang").cast("string").alias("lang")).distinct()
    asked = asked.unionByName(floor.withColumn("gram", F.lit(0).cast("long")))
    own = lm.select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), "logp", "back")
    answers = asked.join(own, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("gram") == F.col("_g"))).select("block", "lang", "gram", "logp", "back")
    # Labels travel with the answers, so that one cogroup scores and marks what is held out.
    none = F.lit(None).cast("double")
    marks = labels.select("block", F.lit(None).cast("string").alias("lang"), F.col("doc_id").alias("gram"), none.alias("logp"), none.alias("back"), F.lit(True).alias("mark"))
    answers = answers.withColumn("mark", F.lit(False)).unionByName(marks)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        flag = right.column("mark").to_numpy()
        label = right.filter(pa.array(flag))
        label = pa.table({"doc_id": label.column("gram"), "trusted": label.column("mark")})
        return score_block(opened(left), right.filter(pa.array(~flag)), label)

    return text.cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id bigint, lang string, text_hash bigint, perplexity double, held boolean")


def limits(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """all, lang and limit, from the held-out documents: one row per language that has any, and one over ``all``
    of them; a histogram bounds the rows per language."""
    held = scored.where("held AND perplexity IS NOT NULL")
    # Every document counts once for its language and once for all of them, which languages without own ones use.
    of = F.explode(F.array(F.struct(F.lit(False).alias("all"), "lang"), F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang"))))
    held = held.select("perplexity", of.alias("_of")).select("perplexity", "_of.*")
    bins = held.groupBy("all", "lang", F.ceil(F.log("perplexity") * STEP).alias("bin")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("all", "lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("all", "lang"))
    reached = bins.withColumn("_s", so_far / total).where(F.col("_s") >= quantile)
    return reached.groupBy("all", "lang").agg((F.exp(F.min("bin") / STEP) * margin).alias("limit"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """doc_id and trusted of the labels: quality 1 and not toxic."""
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("trusted"))


def judged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash, perplexity, limit, kept of every document."""
    scored = stage(perplexities(docs, trusted), "lm-scores")
    limit = stage(limits(scored), "lm-limits")
    pooled = limit.where("all").first()
    own = limit.where("NOT all").select(F.col("lang").alias("_l"), F.col("limit").alias("_own"))
    rows = scored.join(own, F.col("lang").eqNullSafe(F.col("_l")), "left")
    fallback = F.when(F.col("perplexity").isNotNull(), F.lit(pooled["limit"] if pooled else None).cast("double"))
    rows = rows.withColumn("limit", F.coalesce("_own", fallback))
    kept = F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True))
    return rows.select("doc_id", "lang", "text_hash", "perplexity", "limit", kept.alias("kept"))


def judge(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, limit, kept of every document."""
    return judged(docs, trusted).drop("text_hash")


def keep(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps.

    Language and text alone decide, so a row goes if a rejected one equals it in doc_id, language and a
    hash of the text; a doc_id that other rows share, or none, changes nothing.
    """
    gone = judged(docs, trusted).where("NOT kept")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("lang").alias("__lang"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__gone")) & F.col("lang").cast("string").eqNullSafe(F.col("__lang"))
    return docs.join(gone, same & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left_anti")


@query("op10_kneser_ney_quality")
def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = trusted_labels(table(spark, sf_dir, "labels"))
    return judge(table(spark, sf_dir, "documents"), labels)
