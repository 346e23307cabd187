"""Mixing sources to target weights (operator 6). DataFrame and SQL functions only.

Each source's words are one stream: its documents in the order of a hash bucket and, inside it, doc_id.
The stream is cut into blocks of `block_tokens` words. A source's target is turned into a number of block slots.
The counts of sources in output shards of `shard_blocks` slots are multinomial, given that they add up to those
numbers: all slots of all shards are one urn that holds each source so often, drawn without replacement. Slot j
draws ball p(j) of a pseudorandom permutation p, so each slot tells its draw by itself, and no count depends on the
shards before it. Independent draws would miss the targets by the root of their size; this correction is part of the
draw and falls on all shards alike. (Counts of a shard have the hypergeometric spread, multinomial but for the factor
(N - n) / (N - 1).) The ball's place among those of its source is the source's slot; it maps to a block by a swap-or-not
permutation of the block numbers, a new one for each epoch (pass over the source), and slots are joined with blocks by
(source, block).

Running sums have two levels: sums per (source, bucket), then inside a bucket, so that a source with a
third of all rows is not one task's work. The number of buckets follows the number of rows.
One row per source is sorted in one task and sent to the driver; sources are part of the mixture's recipe: more than
MAX_SOURCES are an error.

Results for edge cases: null and empty texts have size 0 and are never taken; a null source is a source of
its own, after all others; rows that repeat are documents of their own; a source without words has target 0;
an empty table gives no rows; columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240_601
ROUNDS = 16
MAX_SOURCES = 10_000


def permuted(k: Column, n: Column, *names: Column) -> Column:
    """k in [0, n) under a pseudorandom permutation named by `names` (swap-or-not, ROUNDS rounds)."""

    def step(x, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *names, r), n) + n - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), *names, r, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k.cast("bigint"), step)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def target_table(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, n_rows, target, rank): one row per source.

    Targets are min(most * size, level * weight) with the level at which they add up to `share` of all sizes.
    That is where resharing the excess by weight ends.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    by_ratio = every.orderBy(F.col("bound") / F.col("weight"), F.col("rank"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the first source, by bound per weight, that the level leaves under its bound: the level holds for all
    tried = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("bound"))
    held = F.min(F.when(F.col("open"), F.struct(F.col("bound") / F.col("weight"), "rank", "level"))).over(every)["level"]
    target = F.when(held.isNull(), F.col("bound")).otherwise(F.least("bound", held * F.col("weight")))
    return tried.select("source", "source_size", "n_rows", target.alias("target"), "rank")


def positions(sizes: DataFrame, rows: int) -> DataFrame:
    """`sizes` with `at`: how many words of the source stand before the document's."""
    buckets = max(1024, rows // 500_000)
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("local", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = local.join(starts, local.source.eqNullSafe(starts.s) & (local.bucket == starts.b))
    return joined.withColumn("at", F.col("base") + F.col("local")).drop("s", "b", "base", "local", "bucket")


def slot_table(targets: DataFrame, block_tokens: int, shard_blocks: int) -> DataFrame:
    """(source, shard, slot, epoch, block): one row per output slot."""
    spark = targets.sparkSession
    n_blocks = F.ceil(F.col("source_size") / F.lit(block_tokens)).cast("bigint")
    planned = targets.where("source_size > 0").withColumn("blocks", n_blocks)
    planned = planned.withColumn("slots", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("bigint"))
    plan = planned.where("slots > 0").select("rank", "source", "blocks", "slots").orderBy("rank").limit(MAX_SOURCES + 1).collect()
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    first = [0]
    for row in plan:
        first.append(first[-1] + row["slots"])
    balls = spark.range(first[-1]).select(F.col("id").alias("place"))
    # explode: the optimizer would else copy the permutation into every use of `ball`
    balls = balls.select("place", F.explode(F.array(permuted(F.col("place"), F.lit(max(1, first[-1])).cast("bigint"), F.lit("urn")))).alias("ball"))
    # the source whose balls these are: the last one whose first ball is not beyond
    starts = F.array(*[F.lit(x).cast("bigint") for x in first[:-1] or [0]])
    if len(plan) <= 64:
        which = F.lit(0)
        for x in first[1:-1]:
            which = which + (F.col("ball") >= x).cast("int")
    else:
        which = F.size(F.filter(starts, lambda x: x <= F.col("ball"))) - 1
    table_of = F.array(*[F.struct(F.lit(r["source"]).cast("string").alias("source"), F.lit(r["rank"]).cast("bigint").alias("rank"), F.lit(r["blocks"]).cast("bigint").alias("blocks"), F.lit(a).cast("bigint").alias("first")) for r, a in zip(plan, first)] or [F.struct(F.lit(None).cast("string").alias("source"), *[F.lit(0).cast("bigint").alias(c) for c in ("rank", "blocks", "first")])])
    slots = balls.select("place", "ball", F.explode(F.array(F.element_at(table_of, which.cast("int") + 1))).alias("of"))
    slots = slots.select("of.source", F.floor(F.col("place") / F.lit(shard_blocks)).alias("shard"), (F.col("ball") - F.col("of.first")).alias("slot"), "of.rank", "of.blocks")
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    block = permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.col("rank"), F.col("epoch"))
    return slots.select("source", "shard", "slot", "epoch", block.alias("block"))


def pieces(placed: DataFrame, block_tokens: int) -> DataFrame:
    """One row for each document and block that share words: + block, from_word and n_words inside the document."""
    size = F.lit(block_tokens).cast("bigint")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("size") - 1) / size))))
    begin = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
    stop = F.least((F.col("block") + 1) * size - F.col("at"), F.col("size"))
    return cut.withColumn("from_word", begin).withColumn("n_words", stop - begin)


class Mix:
    """The mixture of `docs`: `targets`, `placed` documents, `slots`, and what follows from them."""

    def __init__(self, docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block_tokens: int = 128, shard_blocks: int = 8192, keep: tuple[str, ...] = ()):
        self.block_tokens = block_tokens
        sizes = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *keep), "sizes")
        self.targets = stage(target_table(sizes, list(weights), share, most), "targets")
        rows = self.targets.agg(F.sum("n_rows")).first()[0] or 0
        self.placed = positions(sizes, rows)
        self.slots = slot_table(self.targets, block_tokens, shard_blocks)

    def pieces_taken(self) -> DataFrame:
        """Pieces with `times`: how many slots hold their block."""
        times = self.slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        cut = pieces(self.placed, self.block_tokens)
        # the planner takes exploded slots for as few as their sources: without the hint it would broadcast them
        joined = cut.join(times.hint("merge"), cut.source.eqNullSafe(times.s) & (cut.block == times.b), "left")
        return joined.drop("s", "b").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """(doc_id, source, size, at, taken) of each document."""
        some = self.pieces_taken().groupBy("doc_id", "source", "size", "at").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        none = self.placed.where("size = 0").select("doc_id", "source", "size", "at", F.lit(0).cast("bigint").alias("taken"))
        return some.unionByName(none)

    def digest(self) -> DataFrame:
        t = self.targets.select(F.col("source").alias("s"), "source_size", "target")
        rows = self.taken()
        return rows.join(t, rows.source.eqNullSafe(t.s)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each time a document's blocks are taken, a row with the words it gives.

    A document that is taken whole keeps its text as it is; else the words are joined by one space.
    Other columns keep their values, n_chars is counted anew.
    """
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # any names, those used here included
    name = F.concat_ws("|", F.col(at["doc_id"]).cast("string"), F.hex(F.xxhash64(at["source"], at["text"])))
    rows = docs.toDF(*at.values()).withColumn("row", name)  # only rows with the same doc_id, source and text share it
    mix = Mix(rows.select(*[F.col(at[c]).alias(c) for c in ("doc_id", "source", "text")], "row"), keep=("row",), **options)
    taken = mix.pieces_taken().where("times > 0")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    parts = taken.groupBy("row", "copy", "at", "size").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("parts"), F.sum("n_words").alias("words"))
    parts = parts.select("row", "parts", (F.col("words") == F.col("size")).alias("whole"))
    # rows that repeat are alike and have places of their own in the stream: one of them gives the text for all
    joined = rows.dropDuplicates(["row"]).join(parts.hint("merge"), "row")
    words = F.regexp_extract_all(at["text"], F.lit(f"({WORD})"))
    chosen = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")))), " ")
    out = joined.withColumn(at["text"], F.when(F.col("whole"), F.col(at["text"])).otherwise(chosen))
    return out.select(*[F.length(at["text"]).cast("bigint").alias(c) if c == "n_chars" else F.col(x).alias(c) for c, x in at.items()])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all of `documents`: weights 5, 2, 1 and again, 150 % of all words, at most twice a source."""
    return Mix(table(spark, sf_dir, "documents")).digest()
