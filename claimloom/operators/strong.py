"""Strongly connected components of an edge table, in rounds that grow with the logarithm of its paths.

Three steps repeat on the edges that are left:

1. Trimming. A node without an edge in, or without one out, is alone. So is every node whose only
   edges in lead back, one after another, to such a node: each node with a single edge in points to
   its source, and a round replaces each pointer by its target's, so a chain of any length falls in the
   logarithm of its length.
2. Labels. Every node has a priority of its own, another in each turn, and takes the smallest one that
   reaches it, and the smallest one that it reaches. A round looks along all edges and along a pointer of
   each node, which doubles its reach in each round; pointers are set anew when they are spent.
3. Splitting. Two nodes of one component have both labels in common. A node whose labels are its own
   has found its component: all nodes with these two labels. Edges between different labels are on
   no cycle and go, as do components that are found.

Every node starts a search at once, so there are as many pivots as nodes; as priorities change from turn to turn,
what remains falls apart like a sorted list does in quicksort. Only labels and pointers travel, one of each
for a node and direction, never pairs that reach each other. Results do not depend on priorities.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.durable import cut

#: Chains are trimmed in every so many turns, again while that takes such a share of the edges; in between, splitting takes them apart too.
TRIM_EVERY, WORTHWHILE = 3, 0.2


def _ends(live: DataFrame) -> DataFrame:
    return live.select(F.explode(F.array("src", "dst")).alias("node"))


def _lone_sides(live: DataFrame) -> DataFrame:
    """For each node its edges in and out, and a single one's other end."""
    sides = live.select(F.col("dst").alias("node"), F.col("src").alias("came"), F.lit(None).cast("long").alias("went")).unionByName(
        live.select(F.col("src").alias("node"), F.lit(None).cast("long").alias("came"), F.col("dst").alias("went"))
    )
    both = sides.groupBy("node").agg(*[f(c).alias(f"{name}_{c}") for c in ("came", "went") for name, f in (("n", F.count), ("one", F.min))])
    # A pointer to no node (null) is at an end: "dead" where nothing leads on, else alive.
    pointer = lambda c: F.when(F.col(f"n_{c}") == 1, F.col(f"one_{c}")).alias(f"to_{c}")
    return both.select("node", pointer("came"), pointer("went"), *[(F.col(f"n_{c}") == 0).alias(f"dead_{c}") for c in ("came", "went")])


def peeled(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` (src, dst, of any type, within each of ``keys``) without most of those on no cycle: their source has no edge in, or their target none out.

    Two layers fall at a time, as long as that takes a share worth a pass; ``strong_components`` does the rest. Edges of a node to itself stay.
    """
    n = edges.count()
    while n:
        left = edges
        for _ in range(2):
            for here, there in (("src", "dst"), ("dst", "src")):
                left = left.join(left.select(*keys, F.col(there).alias(here)).distinct(), [*keys, here], "left_semi")
        edges = cut(left.select(*edges.columns))
        n, before = edges.count(), n
        if before - n <= WORTHWHILE * before:
            break
    return edges


#: What a node learns from itself (kind 0) and from its two pointers' targets (1, 2).
DOUBLED = [
    "to AS node",
    "max(IF(kind = 1, to_came, NULL)) AS to_came",
    "max(IF(kind = 2, to_went, NULL)) AS to_went",
    "IF(max(IF(kind = 0, to_came, NULL)) IS NULL, max(IF(kind = 0, dead_came, NULL)), max(IF(kind = 1, dead_came, NULL))) AS dead_came",
    "IF(max(IF(kind = 0, to_went, NULL)) IS NULL, max(IF(kind = 0, dead_went, NULL)), max(IF(kind = 2, dead_went, NULL))) AS dead_went",
]


def _doubled(state: DataFrame) -> DataFrame:
    """Each pointer replaced by its target's, and what its end says: one join and one aggregate for both directions."""
    return state.sparkSession.sql(
        f"""WITH asked AS (SELECT node AS at, node AS to, 0 AS kind FROM {{state}} UNION ALL SELECT to_came, node, 1 FROM {{state}} WHERE to_came IS NOT NULL
            UNION ALL SELECT to_went, node, 2 FROM {{state}} WHERE to_went IS NOT NULL)
        SELECT {", ".join(DOUBLED)} FROM asked JOIN {{state}} s ON s.node = at GROUP BY to""",
        state=state,
    )


def trimmed(live: DataFrame) -> DataFrame:
    """``live`` (src, dst) without nodes that chains of single edges tie to a node without edges in, or out."""
    state = cut(_lone_sides(live))
    if state.where("dead_came OR dead_went").isEmpty():
        return live
    open_ = F.col("to_came").isNotNull() | F.col("to_went").isNotNull()
    left = state.where(open_).count()
    # Where a round ends no pointer, none is as far from its end as it reaches: the rest go round.
    while left:
        state = cut(_doubled(state))
        left, before = state.where(open_).count(), left
        if left == before:
            break
    gone = state.where("(to_came IS NULL AND dead_came) OR (to_went IS NULL AND dead_went)").select("node")
    return cut(_without(live, gone))


def _without(live: DataFrame, gone: DataFrame) -> DataFrame:
    return live.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def _pointed(labels: DataFrame, live: DataFrame) -> DataFrame:
    """``labels`` (node, low, high) with pointers along an edge: to the neighbour with the smallest label, forward and backward."""
    back = live.join(labels.select(F.col("node").alias("src"), "low"), "src").groupBy(F.col("dst").alias("node")).agg(F.min_by("src", F.struct("low", "src")).alias("to_low"))
    on = live.join(labels.select(F.col("node").alias("dst"), "high"), "dst").groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.struct("high", "dst")).alias("to_high"))
    own = lambda c: F.coalesce(c, "node").alias(c)
    return labels.join(back, "node", "left").join(on, "node", "left").select("node", "low", "high", own("to_low"), own("to_high"))


#: What a node learns along edges (kind 0 forward, 1 backward), from its two pointers' targets (2, 3) and from itself (4).
REACHED = [
    "to AS node",
    "min(IF(kind IN (0, 2, 4), low, NULL)) AS low",
    "min(IF(kind IN (1, 3, 4), high, NULL)) AS high",
    "max(IF(kind = 2, to_low, NULL)) AS to_low",
    "max(IF(kind = 3, to_high, NULL)) AS to_high",
    "max(IF(kind = 4, low, NULL)) AS was_low",
    "max(IF(kind = 4, high, NULL)) AS was_high",
]


def _reached(state: DataFrame, arcs: DataFrame) -> DataFrame:
    """One round: each label with those along ``arcs`` and of the pointer's target, each pointer with its target's.

    ``arcs`` (at, to, kind) has every edge in both directions; all that a node asks for meets in one aggregate.
    """
    return state.sparkSession.sql(
        f"""WITH asked AS (SELECT at, to, kind FROM {{arcs}} UNION ALL SELECT to_low, node, 2 FROM {{state}} UNION ALL SELECT to_high, node, 3 FROM {{state}} UNION ALL SELECT node, node, 4 FROM {{state}})
        SELECT {", ".join(REACHED)} FROM asked JOIN {{state}} s ON s.node = at GROUP BY to""",
        arcs=arcs,
        state=state,
    )


def _labelled(live: DataFrame, n: int, turn: int) -> DataFrame:
    """For each node of ``live`` (``n`` edges) its own priority, and the smallest that reaches it (low) and that it reaches (high)."""
    own = F.col("node").bitwiseXOR(F.lit((turn * 0x9E3779B97F4A7C15 >> 1) & (2**62 - 1)))
    state = _ends(live).distinct().select("node", own.alias("low"), own.alias("high"))
    arcs = live.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0).alias("kind")).unionByName(live.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).alias("kind")))
    done = False
    while not done:
        state = cut(_pointed(state.select("node", "low", "high"), live))
        for _ in range(math.ceil(math.log2(n + 2))):  # by then the pointers are spent
            state = cut(_reached(state, arcs))
            done = state.where("low <> was_low OR high <> was_high").isEmpty()
            if done:
                break
    return state.select("node", "low", "high", own.alias("own"))


def strong_components(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges`` (src, dst), within each of ``keys``.

    Nodes are of any type that has an order; those that are no integers, or belong to keys, are numbered first.
    """
    place = [F.col(k) for k in keys]
    ends = edges.select(*place, F.explode(F.array("src", "dst")).alias("node")).distinct()
    pairs = edges.where("src <> dst").select(*place, "src", "dst").distinct()
    if not keys and dict(edges.dtypes)["src"] in ("bigint", "int", "smallint", "tinyint"):
        nodes = ends.withColumn("_n", F.col("node").cast("long"))
        live = cut(pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    else:
        nodes = cut(ends.withColumn("_n", F.monotonically_increasing_id()))
        side = lambda c: nodes.select(*place, F.col("node").alias(c), F.col("_n").alias(f"_{c}"))
        live = cut(pairs.join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"]).select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    every = _numbered_components(live)
    if every is None:
        return nodes.select(*place, "node", F.col("node").alias("component"))
    mine = nodes.join(every.withColumnRenamed("node", "_n"), "_n", "left")
    least = mine.where("id IS NOT NULL").groupBy("id").agg(F.min("node").alias("component"))
    return mine.join(least, "id", "left").select(*place, "node", F.coalesce("component", "node").alias("component"))


def _numbered_components(live: DataFrame) -> DataFrame | None:
    """``node`` and the ``id`` of its component, for nodes on cycles of ``live`` (src, dst: long); None if there are none."""
    n, turn, every = live.count(), 0, None
    while n:
        more = turn % TRIM_EVERY == 0
        while more and n:
            live, before = trimmed(live), n
            n = live.count()
            more = before - n > WORTHWHILE * before
        if not n:
            break
        labels = _labelled(live, n, turn)
        heads = labels.where("low = own AND high = own").select(F.col("own").alias("low"), F.col("own").alias("high"))
        own = labels.join(heads, ["low", "high"], "left_semi").select("node", F.struct(F.lit(turn).alias("turn"), F.col("low").alias("label")).alias("id"))
        every = own if every is None else every.unionByName(own)
        rest = labels.join(heads, ["low", "high"], "left_anti")
        a = rest.select(F.col("node").alias("src"), "low", "high")
        b = rest.select(F.col("node").alias("dst"), "low", "high")
        live = cut(live.join(a, "src").join(b, ["dst", "low", "high"]).select("src", "dst"))
        n, turn = live.count(), turn + 1
    return every
