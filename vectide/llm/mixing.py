"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

1. Words per document and source. Sources in code point order, null last, take the weights in turn
   and share the words of all; no target exceeds ``most`` times its source's words, and what is
   above is shared again by weight (solved in one step as a water level).
2. A keyed hash deals each source's documents into blocks. A target of r times the source takes
   every block floor(r) times and goes through the blocks once more in permuted order, until the
   target is met; in the block where that happens, shorter documents fill what the first too long one leaves,
   then the shortest one left out replaces a document if that comes nearer to the target.
3. A binary tree over the output shards splits the exact numbers of block draws: at each node the
   left half's number is drawn from the multivariate hypergeometric distribution, source by source.
   A leaf's numbers are disjoint runs of each source's permuted draws.
4. Rows are shuffled inside their shard by a keyed hash.

All of it is DataFrame expressions; the randomness is keyed hashing, so reruns agree. Windows run
over (source, block), never over a source's documents, so a hot source is spread like any other. What meets
in one place: a row for each source (targets, and one tree node's quotas), and the sums of one source's blocks.
Null texts have no words, sourceless rows form one source; an empty table gives an empty result;
a source without words has the target 0 and isn't drawn; repeated rows are drawn each on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import free_name, ident, saved, words_count

DOCS_PER_BLOCK = 512
WORDS_PER_SHARD = 8_000_000
#: Further passes over the block in which a target is met.
REFINE = 4
#: Exchanges of one document for another in that block after those passes.
SWAPS = 2
#: Levels of the tree after which its nodes are dealt anew; the nodes of a level are independent.
SPREAD_LEVELS = 6
#: A table of sources is broadcast up to so many rows (under 2 MB); beyond it Spark joins it by shuffle.
BROADCAST_SOURCES = 10_000


def _unit(*key: Column) -> Column:
    """A number in (0, 1) from a keyed hash."""
    return (F.xxhash64(*key).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def targets(stats: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3) -> DataFrame:
    """stats: source, source_size, one row per source. Adds rank, weight, target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = stats.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w).withColumn("top", F.col("source_size") * float(most))
    every, before = Window.partitionBy(), Window.orderBy(F.col("top") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return rows.withColumn("target", F.least("top", F.col("level") * F.col("weight"))).drop("level", "top")


def _drawn(total: Column, good: Column, n: Column, key: list[Column]) -> Column:
    """How many of n draws from total items are among the good ones: the largest of log probability plus Gumbel noise.

    Only numbers within twelve deviations (and 64) of the most likely one are looked at; the rest have less than
    e to the -72 of the probability, so the work grows with the deviation, not with n.
    """
    size, share = F.greatest(total, F.lit(1)).cast("double"), good / F.greatest(total, F.lit(1)).cast("double")
    spread = F.sqrt(F.greatest(F.lit(0.0), n * share * (1 - share) * (size - n) / F.greatest(size - 1, F.lit(1.0))))
    mode, reach = F.floor((n + 1) * ((good + 1) / (size + 2))).cast("long"), (F.ceil(12 * spread) + 64).cast("long")
    lo, hi = F.greatest(F.lit(0).cast("long"), n + good - total, mode - reach), F.least(good, n, mode + reach)

    def step(s: Column, k: Column) -> Column:
        noise = -F.log(-F.log(_unit(*key, k)))
        better = s["log"] + noise > s["top"]
        ratio = (good - k).cast("double") * (n - k) / ((k + 1).cast("double") * (total - good - n + k + 1))
        return F.struct((s["log"] + F.when((k < good) & (k < n), F.log(ratio)).otherwise(F.lit(0.0))).alias("log"), F.when(better, s["log"] + noise).otherwise(s["top"]).alias("top"), F.when(better, k).otherwise(s["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("log"), F.lit(-math.inf).alias("top"), lo.alias("k"))
    return F.aggregate(F.sequence(lo, hi), start, step, lambda s: s["k"])


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: sid, q (draws of each source). Returns sid, shard, q: the draws that each shard gets of each source."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("sid", F.col("q").cast("long").alias("q")))).alias("qs")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "qs")
    for level in range(max(0, math.ceil(math.log2(shards)))):
        if level and level % SPREAD_LEVELS == 0:
            node = node.repartition("first", "n")
        half = F.floor((F.col("n") + 1) / 2).cast("int")
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda s, x: s + x["q"])
        node = node.withColumn("half", half).withColumn("total", total).withColumn("take", F.when(F.col("n") > 1, F.floor(F.col("total") * F.col("half") / F.col("n"))).otherwise(F.col("total")).cast("long"))

        def deal(s: Column, x: Column) -> Column:
            got = _drawn(s["total"], x["q"], s["take"], [F.lit(seed), F.col("first"), F.col("n"), x["sid"]])
            # the draw is kept in a one-element array so that it is evaluated once
            return F.element_at(F.transform(F.array(got), lambda g: F.struct((s["total"] - x["q"]).alias("total"), (s["take"] - g).alias("take"), F.concat(s["out"], F.array(g)).alias("out"))), 1)

        start = F.struct(F.col("total").alias("total"), F.col("take").alias("take"), F.array().cast("array<bigint>").alias("out"))
        node = node.withColumn("left", F.aggregate("qs", start, deal, lambda s: s["out"]))
        part = lambda keep: F.zip_with("qs", "left", lambda x, g: F.struct(x["sid"].alias("sid"), keep(x, g).alias("q")))
        left = F.struct(F.col("first").alias("first"), F.col("half").alias("n"), part(lambda x, g: g).alias("qs"))
        right = F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("n") - F.col("half")).alias("n"), part(lambda x, g: x["q"] - g).alias("qs"))
        node = node.select(F.explode(F.filter(F.array(left, right), lambda x: x["n"] > 0)).alias("x")).select("x.*")
    return node.select(F.col("first").alias("shard"), F.explode("qs").alias("x")).select("x.sid", "shard", "x.q")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3, docs_per_block: int = DOCS_PER_BLOCK, words_per_shard: int = WORDS_PER_SHARD, seed: int = 7, keep: bool = True) -> DataFrame:
    """One row per row of docs: row (its columns if keep, else its id), size, source_size, target, draws.

    draws is an array of (epoch, shard), one for each time that the mix takes the row.
    """
    own = F.struct(*[F.col(ident(c)) for c in docs.columns]) if keep else F.struct(F.col(ident(id_col)))
    rows = docs.select(own.alias("row"), F.col(ident(source_col)).cast("string").alias("source"), words_count(F.col(ident(text_col))).alias("size"), F.xxhash64(F.col(ident(id_col)), F.col(ident(text_col)), F.lit(seed)).alias("key"))
    if not keep:
        rows = saved(rows)
    stats = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, most))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    stats = stats.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    stats = stats.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / docs_per_block)).cast("long")).withColumnRenamed("rank", "sid")
    words, sources = stats.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, math.ceil(words / words_per_shard))

    side = stats.select(F.col("source").alias("name"), "sid", "source_size", "target", "full", "rest", "blocks")
    rows = rows.join(F.broadcast(side) if sources <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks"))).drop("blocks")

    # Draws of blocks: the whole passes, and in permuted order as much of one more as the target needs.
    blocks = saved(rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("full").alias("full"), F.first("rest").alias("rest")))
    passes = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full")))).withColumn("turn", F.xxhash64("sid", "block", "epoch", F.lit(seed)))
    order = Window.partitionBy("sid", "epoch").orderBy("turn", "block")
    passes = passes.withColumn("pos", F.row_number().over(order)).withColumn("off", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    passes = passes.filter((F.col("epoch") < F.col("full")) | (F.col("off") < F.col("rest")))
    passes = passes.withColumn("draw", F.row_number().over(Window.partitionBy("sid").orderBy("epoch", "pos")).cast("long"))
    leaves = split_quotas(passes.groupBy("sid").agg(F.count(F.lit(1)).alias("q")), shards, seed)
    end = F.sum("q").over(Window.partitionBy("sid").orderBy("shard"))
    dealt = leaves.withColumn("end", end).filter("q > 0").select("sid", "shard", F.explode(F.sequence(F.col("end") - F.col("q") + 1, F.col("end"))).alias("draw"))
    of_block = passes.join(dealt, ["sid", "draw"]).groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "off"))).alias("draws"))

    rows = rows.join(of_block, ["sid", "block"], "left").withColumn("draws", F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int,off:bigint>>")))
    once_more = F.filter("draws", lambda x: x["epoch"] == F.col("full"))
    rows = rows.withColumn("left", F.when(F.size(once_more) > 0, F.col("rest") - F.get(once_more, F.lit(0))["off"] + 1e-6))
    rows = _fitted(rows)
    met = lambda x: (x["epoch"] < F.col("full")) | F.col("fits")
    draws = F.transform(F.filter("draws", met), lambda x: F.struct(x["epoch"].alias("epoch"), x["shard"].alias("shard")))
    return rows.select("row", "key", "size", "source_size", "target", draws.alias("draws"))


def _fitted(rows: DataFrame) -> DataFrame:
    """Adds fits: whether the last, partial pass takes the row. left: the words that its block may still give (null: none).

    In key order rows are taken up to the first that is too long for what is left; then, ``REFINE`` times, of
    the rows not taken those short enough for the gap, longest first, again up to its end. A gap may stay that is
    shorter than all rows left out: ``SWAPS`` times the shortest of those goes in for the shortest row
    that makes room for it.
    """
    block = Window.partitionBy("sid", "block")
    by_key, by_size = (block.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow) for order in (["key", "size"], [F.col("size").desc(), "key"]))
    rows = rows.withColumn("gap", F.coalesce("left", F.lit(-1.0))).withColumn("fits", F.lit(False))
    for turn in range(1 + REFINE):
        able = ~F.col("fits") & (F.lit(turn == 0) | (F.col("size") <= F.col("gap")))
        rows = rows.withColumn("able", able & (F.col("gap") >= 0)).withColumn("sum", F.sum(F.when(F.col("able"), F.col("size")).otherwise(0)).over(by_size if turn else by_key))
        rows = rows.withColumn("more", F.col("able") & (F.col("sum") <= F.col("gap")))
        rows = rows.withColumn("gap", F.col("gap") - F.coalesce(F.max(F.when(F.col("more"), F.col("sum"))).over(block), F.lit(0)))
        rows = rows.withColumn("fits", F.col("fits") | F.col("more"))
    rows = rows.withColumn("place", F.struct("size", F.row_number().over(block.orderBy("size", "key")).alias("nth")))
    for _ in range(SWAPS):
        rows = rows.withColumn("come", F.min(F.when(~F.col("fits") & (F.col("gap") >= 0), F.col("place"))).over(block))
        room = F.col("fits") & (F.col("size") >= F.col("come.size") - F.col("gap")) & (F.col("size") < F.col("come.size")) & (F.col("come.size") > F.col("gap"))
        rows = rows.withColumn("go", F.min(F.when(room, F.col("place"))).over(block))
        swapped = F.col("go").isNotNull()
        rows = rows.withColumn("gap", F.when(swapped, F.col("gap") - F.col("come.size") + F.col("go.size")).otherwise(F.col("gap")))
        rows = rows.withColumn("fits", F.when(swapped & (F.col("place") == F.col("come")), True).when(swapped & (F.col("place") == F.col("go")), False).otherwise(F.col("fits")))
    return rows.drop("gap", "able", "sum", "more", "place", "come", "go")


def mix(docs: DataFrame, *, seed: int = 7, **options) -> DataFrame:
    """The mixed rows of docs, as often as the mix takes each, dealt by shard and shuffled inside it; plus mix_epoch and mix_shard (with _ before, where docs has such columns)."""
    rows = mix_plan(docs, seed=seed, **options).select("row", "key", F.explode("draws").alias("draw"))
    rows = rows.repartition("draw.shard").sortWithinPartitions(F.col("draw.shard"), F.xxhash64("key", "draw.epoch", F.lit(seed + 1)))
    return rows.select("row.*", F.col("draw.epoch").alias(free_name(docs, "mix_epoch")), F.col("draw.shard").alias(free_name(docs, "mix_shard")))
