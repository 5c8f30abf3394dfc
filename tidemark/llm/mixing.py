"""Mixing sources to target weights.

Every source is one stream of words, cut into blocks of a fixed length, of which the last may be short:
``block`` words, or for a source below ``block * FINE`` words a ``FINE``-th of it, so that a block is a small
part of any source. A source has as many slots of the mix as blocks that fill its target, exactly.

The slots of all sources lie in an urn, and output shards draw them in turn without replacement: a keyed
permutation of the urn says which shard and slot each one becomes. So the counts of sources in a shard are
multinomial draws given the totals, and the totals meet the targets. The n-th slot of a source takes block
``permutation(n mod blocks)`` of pass ``n / blocks``, another permutation for every pass, and blocks are joined
by that index; at a target of ``repeats`` times its size a source is taken in whole passes. Each slot follows
from its number alone, so any task can draw any part of the urn. Only DataFrame functions are used.

Nulls, ties and odd input: a null text has size 0 and is taken 0 times; null sources form one source
that sorts last; equal rows are places of their own in the stream; a table without words yields rows
with ``taken`` 0 and target 0; texts may have any length, as what follows sees sizes and places of words only;
extra columns are ignored, so that their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, bind, stage, tasks
from tidemark.llm.registry import query, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words of a block.
BLOCK = 32
#: Blocks of a small source: what rounding to whole blocks can miss of a target is below half of such a part.
FINE = 64
#: Slots of an output shard.
SHARD_SLOTS = 128
#: Slots of one source that a row stands for until they are spread over tasks.
RUN = 4096
#: A source's stream is ordered by hash bucket first, so that a hot source spreads over tasks.
BUCKETS = 4096
ROUNDS = 12
#: Slots are made from one row per source, so Spark takes their table for a small one and would broadcast it.
MERGED = "shuffle_merge"
#: The key of the urn's permutation.
URN_KEY = 5


def permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Swap-or-not shuffle: a bijection of [0, n) chosen by ``key``, for any n and without a table.

    Each round reflects the index at a keyed point or leaves it, by a bit that both partners share; so a
    round undoes itself, and the rounds in reverse give the inverse.
    """
    def turn(x: Column, r: Column) -> Column:
        pivot = (key * (F.lit(7919) + r * 2) + (r + 1) * 104729) % n
        partner = (pivot - x + n) % n
        top = F.greatest(x, partner)
        return F.when(F.xxhash64(top, key, r) % 2 == 0, x).otherwise(partner)

    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in rounds]), index, turn)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, the number of words of the whole text, and a hash of the text."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACE}]+"))
    return docs.select("doc_id", "source", words.cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(sized: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, place, source_size, target.

    The weights repeat over the sources in code point order, null last. A target above ``repeats``
    times its source is cut there and the excess is shared anew by weight. Sources fill up in order
    of room per weight, so the cut is found by running sums instead of a loop.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = per.withColumn("place", (F.row_number().over(place) - 1).cast("long")).withColumn("weight", weigh)
    rows = rows.withColumn("room", (F.lit(repeats) * F.col("source_size")).cast("double"))
    by_room = Window.orderBy((F.col("room") / F.col("weight")).asc(), F.col("place"))
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full_before", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("room"))
        # From the first source that does not fill up on, the level holds for all.
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("room") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)["level"])
        .withColumn("target", F.least(F.col("room"), F.col("level") * F.col("weight")))
    )
    return rows.select("source", "place", "source_size", "target")


def stream(sized: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The words' places: ``start`` of every document in its source's stream."""
    rows = sized.withColumn("__h", F.xxhash64("doc_id", "text_hash")).withColumn("_b", F.pmod("__h", F.lit(buckets)))
    per = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("_s"), F.col("_b").alias("_pb"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_b").orderBy("__h", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_pb")))
    return joined.select("doc_id", "source", "size", "text_hash", (F.col("_base") + F.col("_in")).alias("start"))


def cut(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """``goals`` with ``length`` (words of a block), ``blocks``, ``slots`` and ``base`` (slots of the sources before)."""
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / FINE))).cast("long")
    rows = goals.withColumn("length", length)
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    # The last block may be short, so a slot is worth the mean of its source's blocks.
    rows = rows.withColumn("slots", F.round(F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0))).cast("long"))
    earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))


def slots(goals: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, slot, place, epoch, index: the block that each slot of the mix takes.

    ``goals`` is the table of ``cut``, one row per source.
    """
    urn = goals.withColumn("_all", F.sum("slots").over(Window.partitionBy())).where("slots > 0")
    long = lambda c: F.lit(c).cast("long")
    runs = urn.withColumn("_run", F.explode(F.sequence(long(0), F.floor((F.col("slots") - 1) / RUN).cast("long"))))
    # A source of many slots leaves its row in runs that go to tasks by themselves.
    runs = runs.select("place", "blocks", "slots", "base", "_all", "_run").repartition(tasks(goals.sparkSession), "place", "_run")
    last = F.least((F.col("_run") + 1) * RUN, F.col("slots")) - 1
    each = runs.withColumn("_n", F.explode(F.sequence(F.col("_run") * RUN, last)))
    turn = permuted(F.col("base") + F.col("_n"), F.col("_all"), long(URN_KEY), inverse=True)
    epoch = F.floor(F.col("_n") / F.col("blocks"))
    index = permuted(F.col("_n") % F.col("blocks"), F.col("blocks"), F.col("_epoch") * 1009 + F.col("place") % 999983 + 1)
    each = each.withColumns({"_turn": turn, "_epoch": epoch})
    return each.select(
        F.floor(F.col("_turn") / shard_slots).alias("shard"), (F.col("_turn") % shard_slots).alias("slot"),
        "place", F.col("_epoch").alias("epoch"), index.alias("index"),
    )


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with place and start, targets, slots) of the mix of all ``docs``."""
    sized = stage(sizes(docs), "mix-sizes")
    goals = stage(cut(targets(sized), block), "mix-targets")
    return stream(sized), goals, slots(goals, shard_slots)


def spread(docs: DataFrame, block: int, shard_slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their targets, a row per document and block that meet, slots)."""
    placed, goals, drawn = mix(docs, block, shard_slots)
    goal = goals.select(F.col("source").alias("_s"), "place", "source_size", "target", "length")
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    first, last = F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    met = placed.where("size > 0").select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("index"))
    return placed, met, drawn


def taken(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words of each document in the mix."""
    placed, met, drawn = spread(docs, block, shard_slots)
    length = F.col("length")
    overlap = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * length) - F.greatest(F.col("start"), F.col("index") * length)
    times = drawn.groupBy("place", "index").agg(F.count("*").alias("_times"))
    words = (
        met.join(times.hint(MERGED), ["place", "index"])
        .groupBy("place", "start")
        .agg(F.sum(overlap * F.col("_times")).alias("taken"))
        .select(F.col("place").alias("_p"), F.col("start").alias("_st"), "taken")
    )
    # An empty document shares its start with the next one, so the size joins too.
    joined = placed.join(words, (F.col("place") == F.col("_p")) & (F.col("start") == F.col("_st")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as rows with the columns of ``docs``: what each pass over a source takes of a document.

    Neighbouring blocks of one pass stay together, so a pass over a whole source gives whole documents
    and a partial one runs of whole blocks; ``n_chars``, if there, counts the run. White space between
    words is kept. Documents without words give no row.
    """
    _, met, drawn = spread(docs, block, shard_slots)
    passes = met.join(drawn.select("place", "index", "epoch").hint(MERGED), ["place", "index"])
    doc = ["place", "start", "epoch"]
    run = F.col("index") - F.row_number().over(Window.partitionBy(*doc).orderBy("index"))
    runs = passes.withColumn("_run", run).groupBy(*doc, "_run", "doc_id", "text_hash", "size", "length").agg(F.min("index").alias("_i"), F.max("index").alias("_j"))
    begin = F.greatest(F.col("_i") * F.col("length") - F.col("start"), F.lit(0))
    end = F.least((F.col("_j") + 1) * F.col("length") - F.col("start"), F.col("size"))
    # Equal rows differ by their place in the stream; their n-th takes the n-th row's runs.
    twin = F.dense_rank().over(Window.partitionBy("doc_id", "text_hash").orderBy("place", "start"))
    parts = runs.select("doc_id", "text_hash", F.struct(twin.alias("twin"), begin.cast("int").alias("a"), end.cast("int").alias("b")).alias("__part"))
    parts = parts.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).agg(F.collect_list("__part").alias("__parts"))
    rows = docs.withColumn("__h", F.xxhash64("text")).join(parts, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")))
    rows = rows.withColumn("__twin", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy(F.col("source").asc_nulls_last())))
    words = F.regexp_extract_all("text", F.lit(f"[{SPACE}]*[^{SPACE}]+"), 0)
    own = F.filter("__parts", lambda p: p["twin"] == F.col("__twin"))
    cut = bind(words, lambda w: F.transform(own, lambda p: F.array_join(F.slice(w, p["a"] + 1, p["b"] - p["a"]), "")))
    rows = rows.withColumn("__text", F.explode(cut))
    fresh = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return rows.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns])


@query("op2_mix_to_weights")
def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
