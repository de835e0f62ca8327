"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

Each source's shuffled word stream is cut into equal blocks, at most BLOCK words and at most a FINEST-th part of the source, so that
small sources come as near to their targets as large ones. Every source owns a part of [0, 1) in proportion to the blocks that its target
needs. Slot i of the schedule has the golden-ratio point frac(i * phi), and the part that the point falls in names the slot's source. The
slots of a source, ranked, are joined with its blocks one after the other, starting again at the first block when the last is taken; what
a document gives is the sum over the joined blocks that it lies in.

Nulls, ties and edges: a null text has size 0 and takes nothing; a null source is a source of its own, last in order;
rows that repeat count each; an empty table gives an empty result; columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nava.session import stored

#: Weights by a source's rank, repeating; the most times that a source is taken; the golden ratio's fraction.
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
PHI = 0.6180339887498949

SPACE = " \t\n\x0b\f\r"
#: Words of a block at most, and blocks of a source at least (of a word at least).
BLOCK = 256
FINEST = 4096
#: Rows of a part of the shuffle order, which is summed on its own, about; cells of [0, 1) for the join of points with sources.
PART_ROWS = 50_000
CELLS = 4096


def word_count(text: Column) -> Column:
    """Runs of bytes other than ASCII white space; null has none."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(text.isNull() | (F.length(inner) == 0), 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """52 bits that order a source's documents: the same in every run and engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_key() -> Column:
    """A key for joins that keeps the null source apart from every text."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))


def targets(sizes: DataFrame) -> DataFrame:
    """One row for each source: source, source_size, weight, target, block, blocks, slots, and its part lo, hi of [0, 1).

    Targets share the whole by weight; a source stops at MOST_TIMES its size and the excess is shared again by weight until
    none is above. Sorted by size over weight, that fixpoint is one level times the weight, found with two running sums.
    The table of sources (a row each) is ordered as a whole.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    everyone = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full_at", "rank")
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("most", F.col("source_size") * float(MOST_TIMES))
        .withColumn("full_at", F.col("most") / F.col("weight"))
    )
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("total") - before) / left
    needed = F.when(F.col("total") > 0, F.col("target") / F.col("block")).otherwise(0.0)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everyone))
        .withColumn("target", F.least("most", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
        .withColumn("block", F.expr(f"greatest(1, least({BLOCK}, source_size div {FINEST}))"))
        .withColumn("blocks", F.expr("greatest(1, (source_size + block - 1) div block)"))
        .withColumn("needed", F.sum(needed).over(upto))
        .withColumn("all_needed", F.max("needed").over(everyone))
        .withColumn("hi", F.when(F.col("all_needed") > 0, F.col("needed") / F.col("all_needed")).otherwise(0.0))
        .withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
        .withColumn("last", F.max(F.when(F.col("target") > 0, F.col("rank"))).over(everyone))
        .withColumn("hi", F.when(F.col("rank") == F.col("last"), 1.0).otherwise(F.col("hi")))
        .select(source_key().alias("key"), "source", "source_size", "weight", "target", "block", "blocks", F.ceil("all_needed").alias("slots"), "lo", "hi")
    )


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """slot, key, source, for slots 0 to slots - 1. Points and parts meet in cells of [0, 1), so this is an equi-join."""
    points = shares.sparkSession.range(slots).withColumnRenamed("id", "slot")
    product = F.col("slot") * F.lit(PHI)
    points = points.withColumn("point", product - F.floor(product)).withColumn("cell", F.floor(F.col("point") * CELLS))
    last_cell = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    parts = shares.where(F.col("hi") > F.col("lo")).select(
        "key", "source", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") * CELLS), last_cell), last_cell)).alias("cell")
    )
    return points.join(parts, "cell").where("point >= lo and point < hi").select("slot", "key", "source")


def ranked_schedule(plan: DataFrame, chunk: int = 65536) -> DataFrame:
    """slot, source, rank of the slot within its source from 0. Ranks add the counts of the chunks before, so no source is ordered in one task."""
    plan = plan.withColumn("chunk", F.floor(F.col("slot") / chunk))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = plan.groupBy("key", "chunk").count().select("key", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    return plan.withColumn("within", within).join(before, ["key", "chunk"]).select("slot", "source", (F.col("before") + F.col("within")).alias("rank"))


def block_times(shares: DataFrame, slots: int) -> DataFrame:
    """key, block, times: how many slots take each block. A slot's rank, modulo the source's blocks, is the block that it takes."""
    ranked = ranked_schedule(schedule(shares, slots)).withColumn("key", source_key())
    taken = ranked.join(F.broadcast(shares.select("key", "blocks")), "key").where(F.col("rank") < MOST_TIMES * F.col("blocks"))
    return taken.groupBy("key", (F.col("rank") % F.col("blocks")).alias("at")).agg(F.count("*").alias("times"))


def mix(docs: DataFrame, seed: int = 17, **carried: Column) -> DataFrame:
    """doc_id, size, source_size, target, taken, and starts: how often the mix takes the document's first word; then carried columns."""
    sizes = stored(
        docs.select("doc_id", "source", *[c.alias(name) for name, c in carried.items()], word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("h")),
        "mix-sizes",
    )
    shares = stored(targets(sizes), "mix-targets")
    first = shares.select("slots").first()
    slots = int(first["slots"] or 0) if first else 0
    bits = max(10, (sizes.count() // PART_ROWS).bit_length())

    # The start of each document in its source's shuffled stream: sums by part of the order, then within the part.
    sizes = sizes.withColumn("key", source_key()).withColumn("part", F.shiftright("h", 52 - bits))
    parts = sizes.groupBy("key", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"))
    # What holds for a source reaches its documents by part, so that a large source is dealt to many tasks.
    within = Window.partitionBy("key", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sizes.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(parts.join(shares.select("key", "source_size", "target", "block"), "key"), ["key", "part"])
        .withColumn("start", F.col("start") + F.col("part_start"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    placed = stored(placed.drop("source", "h", "part", "part_start"), "mix-placed")

    # The blocks that a document lies in; one without words stands before a word, whose block says how often.
    first = F.expr("least(start, greatest(source_size - 1, 0)) div block")
    last = F.expr("greatest(start + size - 1, least(start, greatest(source_size - 1, 0))) div block")
    lying = placed.select("row", "key", "block", "start", "size", first.alias("first"), F.explode(F.sequence(first, last)).alias("at"))
    inside = F.expr("greatest(0, least(start + size, (at + 1) * block) - greatest(start, at * block))")
    given = (
        lying.join(block_times(shares, slots), ["key", "at"])
        .groupBy("row")
        .agg(F.sum(inside * F.col("times")).alias("taken"), F.max(F.when(F.col("at") == F.col("first"), F.col("times"))).alias("starts"))
    )
    none = F.lit(0)
    return placed.join(given, "row", "left").select(
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        F.coalesce("taken", none).cast("long").alias("taken"),
        F.coalesce("starts", none).cast("long").alias("starts"),
        *carried,
    )
