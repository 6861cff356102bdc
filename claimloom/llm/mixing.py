"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot ``i`` is the golden-ratio point ``i * PHI mod 1``; the cumulative target
shares map it to a source, and its rank among that source's slots to a block of
the source's shuffled words (a source that is taken more than once starts again
at its first block). Closing slots bring a source that the schedule leaves short
to its target, and its last block is cut there, so a source's words come to its
target to the word, whatever the block size.

Everything is DataFrame work. Windows run inside (source, shard) groups, where a
shard is one of 4,096 slices of the shuffle order, so that a source with a third
of all rows is dealt over many tasks; only totals by source and shard meet in one
place. The plan of sources is broadcast where its counted rows are few.

Defined results: a null text has size 0; sources are ordered by code point with
null last; rows of size 0 get ``taken`` 0; repeated rows share a place in the
shuffle and are laid one after the other, and so do rows without doc_id; an empty table
gives an empty result; columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from claimloom.llm.common import shared_folder, small, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST_PASSES = 3
#: Words in a block.
BLOCK_WORDS = 1024
#: 18 digits of the golden ratio's fraction.
GOLDEN = 618033988749894848
#: Slots made by one task row, and cells of the unit interval in which sources are looked up.
CHUNK, CELLS = 4096, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _before(value: str, order: list[Column], *group: str) -> Column:
    """The sum of ``value`` over the rows before this one."""
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size), one row each.

    Resharing the excess of capped sources until none is above its cap ends at one
    water level: a source takes ``level * weight`` or its cap. With the sources
    sorted by cap for each unit of weight, the level follows from running sums.
    """
    one = W.partitionBy(F.lit(0))
    cap = (F.col("source_size") * F.lit(most)).cast("long")
    ranked = sizes.withColumn("place", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("place") % len(weights) + 1))
    ranked = ranked.withColumn("fill", (cap / F.col("weight")).cast("double"))
    by_fill = one.orderBy("fill", "place")
    level = ranked.select(
        "*",
        (F.sum("source_size").over(one) - F.coalesce(F.sum(cap).over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("double").alias("rest"),
        F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)).cast("double").alias("weights"),
    )
    level = level.withColumn("level", F.col("rest") / F.col("weights"))
    # The first source that the level would not fill sets it for itself and all after it.
    stop = level.withColumn("open", F.col("level") <= F.col("fill")).withColumn(
        "water", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    )
    target = F.when(F.col("water").isNull() | (F.col("fill") <= F.col("water")), cap.cast("double")).otherwise(F.col("water") * F.col("weight"))
    return stop.select("source", "place", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _blocks(size: Column, block: int) -> Column:
    return F.ceil(size / F.lit(block)).cast("long")


def schedule(plan: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: place of the source, slot, rank among the source's slots, block and words taken from the block's start.

    Closing slots are numbered after the drawn ones, source by source. ``plan`` is a written table with place, source_size and words (its target as a
    whole number). Points are exact: 18-digit decimals, not floating point.
    """
    plan = plan.where("words > 0")
    total = plan.agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("total"))
    slots = _blocks(F.col("total"), block)
    wide = "decimal(19,0)"
    points = (
        total.select(slots.alias("slots"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(slots / CHUNK).cast("long"))).alias("chunk"))
        .repartition("chunk")
        .select("chunk", "slots", F.explode(F.sequence(F.col("chunk") * CHUNK, F.col("chunk") * CHUNK + (CHUNK - 1))).alias("slot"))
        .where("slot < slots")
        .select("chunk", "slot", (((F.col("slot").cast(wide) * F.lit(GOLDEN).cast(wide)) % F.lit(10**18).cast(wide)).cast("double") / F.lit(1e18)).alias("spot"))
        .withColumn("cell", F.floor(F.col("spot") * CELLS))
    )
    one = W.partitionBy(F.lit(0))
    upto = F.sum("words").over(one.orderBy("place").rowsBetween(W.unboundedPreceding, 0)) / F.sum("words").over(one)
    own = F.col("words") / F.sum("words").over(one)
    shares = plan.select("place", (upto - own).alias("low"), upto.alias("high")).withColumn("low", F.lag("high", 1, 0.0).over(one.orderBy("place")))
    cells = shares.select("place", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))).alias("cell"))
    drawn = points.join(cells, "cell").where("spot >= low AND spot < high").select("chunk", "slot", "place")
    # Ranks in two steps, so that a source with a third of all slots is no single group.
    counts = drawn.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select("place", "chunk", _before("n", [F.col("chunk")], "place").alias("base"))
    local = F.row_number().over(W.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("local", local).join(offsets, ["place", "chunk"]).select("place", "slot", (F.col("base") + F.col("local")).cast("long").alias("rank"))
    had = counts.groupBy("place").agg(F.sum("n").cast("long").alias("had"))
    per_pass = _blocks(F.col("source_size"), block)
    need = F.floor(F.col("words") / F.col("source_size")) * per_pass + _blocks(F.col("words") % F.col("source_size"), block)
    short = plan.join(had, "place", "left").select("place", F.coalesce("had", F.lit(0)).cast("long").alias("had"), need.cast("long").alias("need")).where("had < need")
    short = short.withColumn("short", F.col("need") - F.col("had"))
    after = short.select("place", "had", "need", _before("short", [F.col("place")]).alias("before")).join(F.broadcast(total.select(slots.cast("long").alias("slots"))))
    closing = after.select("place", "had", "slots", "before", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank"))
    closing = closing.select("place", (F.col("slots") + F.col("before") + F.col("rank") - F.col("had")).cast("long").alias("slot"), "rank")
    first = F.floor(F.col("rank") / per_pass) * F.col("source_size") + F.col("rank") % per_pass * block
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("words") - F.col("first"))
    return (
        ranked.unionByName(closing)
        .join(small(plan.select("place", "source_size", "words")), "place")
        .withColumns({"first": first.cast("long"), "block": (F.col("rank") % per_pass).cast("long")})
        .where("first < words")
        .select("place", "slot", "rank", "block", length.cast("long").alias("n"), (length == F.least(F.lit(block), F.col("source_size") - F.col("block") * block)).alias("whole"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, block: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (doc_id, source, text) with size, source_size, target, taken, first_slot and last_slot.

    The shuffle order inside a source is the MD5 of doc_id, so reruns agree on any
    number of executors. ``taken`` is the words of the document that the mix takes,
    repeats counted; the slots are the first and the last of the schedule that take any of
    them (null if none), so a consumer that reads by slot meets the sources in their shares from
    the start.
    """
    folder = shared_folder(docs.sparkSession)
    turn = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    lean = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), turn.alias("turn"), F.substring(turn, 1, 3).alias("shard")), folder, "sizes")
    sums = lean.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = written(targets(sums, weights, most).withColumn("words", F.round("target").cast("long")), folder, "plan")
    by_source = small(plan.select(F.col("source").alias("s"), "place", "source_size", "target"))
    placed = lean.join(by_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per_shard = placed.groupBy("place", "shard").agg(F.sum("size").cast("long").alias("n"))
    base = per_shard.select("place", "shard", _before("n", [F.col("shard")], "place").alias("base"))
    inner = _before("size", [F.col("turn"), F.col("doc_id"), F.col("size")], "place", "shard")
    # Repeated rows get numbers of their own, so that each is counted once.
    lined = placed.withColumns({"inner": inner, "copy": F.row_number().over(W.partitionBy("place", "shard").orderBy("turn", "doc_id", "size"))})
    lined = lined.join(base, ["place", "shard"]).withColumn("start", F.col("base") + F.col("inner"))
    taken = schedule(plan, block).groupBy("place", "block").agg(
        F.sum(F.when(F.col("whole"), 1).otherwise(0)).alias("passes"),
        F.max(F.when(~F.col("whole"), F.col("n"))).alias("part"),
        F.min(F.when(F.col("whole"), F.col("slot"))).alias("whole_first"),
        F.max(F.when(F.col("whole"), F.col("slot"))).alias("whole_last"),
        F.max(F.when(~F.col("whole"), F.col("slot"))).alias("part_slot"),
    )
    low, high = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block).cast("long")
    pieces = lined.withColumn("block", F.explode(F.sequence(low, high)))
    at = F.col("block") * block

    def overlap(length: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), at + length) - F.greatest(F.col("start"), at))

    got = overlap(F.lit(block)) * F.coalesce("passes", F.lit(0)) + overlap(F.coalesce("part", F.lit(0)))
    part_slot = F.when(overlap(F.coalesce("part", F.lit(0))) > 0, F.col("part_slot"))
    some = overlap(F.lit(block)) > 0
    slots = F.when(some, F.least("whole_first", part_slot)), F.when(some, F.greatest("whole_last", part_slot))
    keys = ["doc_id", "source", "size", "source_size", "target"]
    return (
        pieces.join(taken, ["place", "block"], "left")
        .groupBy("place", "shard", "copy", *keys)
        .agg(F.sum(got).cast("long").alias("taken"), F.min(slots[0]).alias("first_slot"), F.max(slots[1]).alias("last_slot"))
        .select(*keys, "taken", "first_slot", "last_slot")
    )
