"""Relation graph: grouped edges, neighbourhoods, cycles and node risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.strong import peeled, strong_components
from claimloom.sources.durable import cut

#: Cyclic relations with the shortest length that counts; weights of degree, cycle and severity.
CYCLIC = {"OWNED_BY": 2, "WIRED_FUNDS_TO": 3}
WEIGHTS = (0.25, 0.40, 0.35)
LONGEST = 5
HIGH_VACUITY = 0.45
SEVERITY = {"auto_file": 0.0, "flag": 0.5, "escalate": 1.0}


def routing_by_confidence(claims: DataFrame) -> DataFrame:
    """A routing column from confidence alone, where claims have none yet."""
    return claims.withColumn("routing", F.when(F.col("confidence") >= 0.8, "escalate").when(F.col("confidence") >= 0.6, "flag").otherwise("auto_file"))


def severity(routing):
    return F.when(routing == "escalate", 1.0).when(routing == "flag", 0.5).otherwise(0.0)


def grouped_edges(claims: DataFrame) -> DataFrame:
    """One edge for each subject, object and relation, with its worst routing and all its claims; a routing of no name counts as the mildest.

    The worst is found among numbers: where the list of claims is not asked for, no rows are sorted.
    """
    worst = F.max(severity(F.col("routing")))
    return claims.groupBy(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "relation").agg(
        F.max("confidence").alias("confidence"),
        F.min("vacuity").alias("vacuity"),
        F.when(worst == SEVERITY["escalate"], "escalate").when(worst == SEVERITY["flag"], "flag").otherwise("auto_file").alias("routing"),
        F.array_sort(F.collect_list("claim_id")).alias("claim_ids"),
        F.count("*").alias("weight"),
    )


def incident(edges: DataFrame) -> DataFrame:
    """Both ends of each edge with its direction; an edge to itself is outward only."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relation", "confidence", "vacuity", "routing", F.lit("out").alias("direction"))
    back = edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "relation", "confidence", "vacuity", "routing", F.lit("in").alias("direction"))
    return out.unionByName(back)


def neighbourhood(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of ``root``, whichever way edges point, and their distance."""
    both = incident(edges).select("node", "other").distinct()
    found = edges.sparkSession.createDataFrame([(root, 0)], "node long, hops int")
    for hop in range(1, depth + 1):
        step = found.join(both, "node").select(F.col("other").alias("node"), F.lit(hop).alias("hops"))
        found = found.unionByName(step).groupBy("node").agg(F.min("hops").alias("hops"))
    return found


def simple_cycles(edges: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Simple cycles of up to ``longest`` steps within each relation, each from its smallest node.

    Paths grow from their smallest node through larger ones only, so each cycle is met
    once. The paths of each length are written, so no level is worked out twice.
    """
    step = cut(edges.select("relation", F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    paths = step.where("to > at").select("relation", F.array("at", "to").alias("path"))
    found = step.where("at = to").select("relation", F.array("at").alias("path"))
    for length in range(2, longest + 1):
        ends = cut(paths.withColumn("at", F.element_at("path", -1)).join(step, ["relation", "at"]).where("to >= path[0]"))
        found = found.unionByName(ends.where("to = path[0]").select("relation", "path"))
        if length < longest:
            paths = ends.where((F.col("to") > F.col("path")[0]) & ~F.array_contains("path", F.col("to"))).select("relation", F.concat("path", F.array("to")).alias("path"))
    return found.withColumn("length", F.size("path"))


def counted_cycles(edges: DataFrame) -> DataFrame:
    """Cycles of the cyclic relations that are long enough to count; an owner of itself is a cycle.

    Paths grow inside strongly connected components only, since no cycle leaves one.
    """
    return _cycles_within(_inside_components(_cyclic(edges)))


def cycles_and_members(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counted_cycles`` and ``cycle_members`` from one search for components."""
    inside = _inside_components(_cyclic(edges))
    cycles = cut(_cycles_within(inside))
    return cycles, _members(inside, cycles.where("relation <> 'OWNED_BY'"))


def _cyclic(edges: DataFrame) -> DataFrame:
    return cut(edges.where(F.col("relation").isin(*CYCLIC)).select("relation", "src", "dst").distinct())


def _inside_components(cyclic: DataFrame) -> DataFrame:
    """Edges whose two ends are in one strongly connected component of their relation; those that are plainly in none go first."""
    cyclic = peeled(cyclic, ("relation",))
    strong = strong_components(cyclic, ("relation",))
    a, b = strong.select("relation", F.col("node").alias("src"), "component"), strong.select("relation", F.col("node").alias("dst"), "component")
    return cut(cyclic.join(a, ["relation", "src"]).join(b, ["relation", "dst", "component"]).select("relation", "src", "dst"))


def _cycles_within(edges: DataFrame) -> DataFrame:
    least = F.when(F.col("relation") == "OWNED_BY", 1).otherwise(CYCLIC["WIRED_FUNDS_TO"])
    return simple_cycles(edges).where(F.col("length") >= least)


def cycle_members(edges: DataFrame) -> DataFrame:
    """``relation`` and ``node`` for every node on a cycle of a cyclic relation.

    Two steps are enough for ownership, so its members are those of the strongly connected
    components, however long their cycles are, and owners of themselves; for funds they are the
    nodes of simple cycles that are long enough.
    """
    inside = _inside_components(_cyclic(edges))
    return _members(inside, _cycles_within(inside.where("relation <> 'OWNED_BY'")))


def _members(inside: DataFrame, funds: DataFrame) -> DataFrame:
    owners = inside.where("relation = 'OWNED_BY'").select("relation", F.explode(F.array("src", "dst")).alias("node"))
    return owners.unionByName(funds.select("relation", F.explode("path").alias("node"))).distinct()


def minimal_cycles(cycles: DataFrame) -> DataFrame:
    """Cycles without those whose nodes strictly include another's, by an inverted list of nodes."""
    keyed = cycles.withColumn("id", F.concat_ws("-", "path"))
    parts = keyed.select("relation", "id", "length", F.explode("path").alias("node"))
    other = parts.select("relation", "node", F.col("id").alias("small"), F.col("length").alias("small_length"))
    held = parts.join(other, ["relation", "node"]).where("small_length < length").groupBy("relation", "id", "small", "small_length").agg(F.count("*").alias("n"))
    covered = held.where("n = small_length").select("relation", "id").distinct()
    return keyed.join(covered, ["relation", "id"], "left_anti").drop("id")


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """The shortest path between the ends of each pair within its own graph, whichever way edges point.

    ``edges``: key, src, dst; ``pairs``: pair_id, key, start, goal. Of paths of one length the first in
    order of its nodes; a pair that is not joined has none. The search goes on until no pair is open, or
    for ``longest`` steps if they are given. Each node is
    reached once for a pair, so it holds no more rows than pairs times nodes of their graphs.
    """
    step = cut(edges.select("key", F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(edges.select("key", F.col("dst").alias("at"), F.col("src").alias("to"))).distinct())
    edge = pairs.select("pair_id", "key", "goal", F.col("start").alias("at"), F.array("start").alias("path"))
    seen = edge = cut(edge)
    step_no = 0
    while longest is None or step_no < longest:
        step_no += 1
        further = edge.where("at <> goal").join(step, ["key", "at"]).select("pair_id", "key", "goal", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        best = further.groupBy("pair_id", "key", "goal", "at").agg(F.min("path").alias("path"))
        open_pairs = seen.where("at = goal").select("pair_id")
        edge = cut(best.join(seen.select("pair_id", "at"), ["pair_id", "at"], "left_anti").join(open_pairs, "pair_id", "left_anti").select("pair_id", "key", "goal", "at", "path"))
        if edge.isEmpty():
            break
        seen = cut(seen.unionByName(edge))
    return seen.where("at = goal").select("pair_id", "path")


def node_degree(edges: DataFrame) -> DataFrame:
    ends = incident(edges)
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.avg(severity(F.col("routing"))).alias("severity"), F.max("vacuity").alias("vacuity"))


def node_risk(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Composite risk of each node: degree against the largest, membership of a cycle and mean severity."""
    nodes = node_degree(edges)
    member = members.select("node").distinct().withColumn("in_cycle", F.lit(1.0))
    most = nodes.agg(F.max("degree").alias("most")).withColumn("k", F.lit(1))
    wd, wc, ws = WEIGHTS
    score = (wd * F.col("degree") / F.col("most") + wc * F.coalesce("in_cycle", F.lit(0.0)) + ws * F.col("severity")) / (wd + wc + ws)
    joined = nodes.withColumn("k", F.lit(1)).join(F.broadcast(most), "k").join(member, "node", "left")
    return joined.select("node", "degree", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("risk"))


def node_flags(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Flags of each node in a fixed order, joined by commas."""
    member = members.groupBy("node").agg(F.max(F.col("relation") == "OWNED_BY").alias("owns"), F.max(F.col("relation") == "WIRED_FUNDS_TO").alias("funds"))
    ends = incident(edges).groupBy("node").agg(F.max(F.col("relation") == "SHARES_ADDRESS_WITH").alias("shares"), F.max("vacuity").alias("vacuity"))
    marks = [("owns", "ownership_cycle"), ("funds", "funds_cycle"), ("shares", "shared_address")]
    flags = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in marks] + [F.when(F.col("vacuity") >= HIGH_VACUITY, F.lit("high_vacuity"))]
    return ends.join(member, "node", "left").select("node", F.array_join(F.array_compact(F.array(*flags)), ",").alias("flags"))


def cycle_risk(cycles: DataFrame, risk: DataFrame) -> DataFrame:
    parts = cycles.withColumn("id", F.array_join(F.transform("path", lambda x: x.cast("string")), "-")).select("relation", "id", "length", F.explode("path").alias("node"))
    return parts.join(risk, "node").groupBy("relation", "id", "length").agg(F.round(F.avg("risk"), 6).alias("risk"))
