"""Composed views: what one request about a claim, an entity, a document, the graph or a report shows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import uuid5
from claimloom.operators import evals, feed, graph, jobs, matching, reports
from claimloom.sources.durable import cut

#: Steps that a claim's neighbourhood is said to have, of which the parties are the first.
DEPTH = 2
#: Types of entities that are values, not parties.
VALUE_TYPES = ("MONEY", "DATE", "ACCOUNT")


def edge_id(namespace: str, src: Column, dst: Column, relation: Column) -> Column:
    """The name-based identifier of a grouped edge."""
    return uuid5(namespace, F.concat_ws("|", src.cast("string"), relation, dst.cast("string")))


def claim_neighbourhood(claims: DataFrame, claim_id: int) -> DataFrame:
    """Both parties of a claim and the other parties of their claims."""
    ends = claims.where(F.col("claim_id") == claim_id).select(F.explode(F.array("subject_id", "object_id")).alias("node")).distinct()
    both = claims.select(F.col("subject_id").alias("node"), F.col("object_id").alias("other")).unionByName(claims.select(F.col("object_id").alias("node"), F.col("subject_id").alias("other")))
    for _ in range(DEPTH - 1):
        ends = ends.unionByName(both.join(ends, "node").select(F.col("other").alias("node"))).distinct()
    return ends


def _text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def claim_detail(claims: DataFrame, documents: DataFrame, trials: DataFrame, runs: DataFrame, claim_id: int) -> DataFrame:
    """One claim with its document's title, its neighbourhood, its newest ablations and its trials by family."""
    base = claims.where(F.col("claim_id") == claim_id).join(documents.select("document_id", "title"), "document_id", "left")
    k = F.lit(claim_id).cast("long").alias("claim_id")
    near = claim_neighbourhood(claims, claim_id).agg(F.array_sort(F.collect_list("node")).alias("v")).select(k, _text(F.col("v")).alias("neighbourhood"))
    history = jobs.newest(runs, "claim_id", claim_id, "created_at").agg(F.array_sort(F.collect_list("run_id")).alias("v")).select(k, _text(F.col("v")).alias("ablations"))
    families = trials.where(F.col("claim_id") == claim_id).agg(F.array_sort(F.collect_list(F.concat_ws(":", "family", F.col("flipped").cast("string")))).alias("v")).select(k, F.array_join("v", ",").alias("trials"))
    out = base.select("claim_id", F.coalesce("title", F.lit("")).alias("title"), "subject_id", "object_id", "relation", "confidence", "routing")
    return out.join(near, "claim_id").join(history, "claim_id").join(families, "claim_id")


def entity_detail(entity_id: int, entities: DataFrame, claims: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """One party with its neighbours, its documents and the number of its claims; values have no page."""
    own = entities.where((F.col("entity_id") == entity_id) & ~F.col("entity_type").isin(*VALUE_TYPES)).select("entity_id", "canonical", "entity_type")
    k = F.lit(entity_id).cast("long").alias("entity_id")
    near = matching.neighbours_of(entity_id, claims, entities).select("entity_id", "confidence", "canonical")
    near = near.agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "canonical", F.col("entity_id").alias("n")))).alias("v")).select(k, _text(F.transform("v", lambda x: x["n"])).alias("neighbours"))
    held = matching.documents_of(entity_id, mentions, documents)
    held = held.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("c"), "title", "document_id"))).alias("v")).select(k, _text(F.transform("v", lambda x: x["document_id"])).alias("documents"))
    count = claims.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id)).agg(F.count("*").alias("n_claims")).select(k, "n_claims")
    return own.join(near, "entity_id").join(held, "entity_id").join(count, "entity_id")


def document_detail(document_id: int, documents: DataFrame, mentions: DataFrame, claims: DataFrame) -> DataFrame:
    """One document with its length and the numbers of its mentions and claims."""
    one = documents.where(F.col("document_id") == document_id).select("document_id", "title", F.length("text").alias("chars"))
    count = lambda df, name: df.where(F.col("document_id") == document_id).agg(F.count("*").alias(name)).select(F.lit(document_id).cast("long").alias("document_id"), name)
    return one.join(count(mentions, "n_mentions"), "document_id").join(count(claims, "n_claims"), "document_id")


def documents_list(documents: DataFrame, sources: list[str] | None = None, title: str | None = None) -> DataFrame:
    """Documents by source and title; in ``title`` a per cent sign and an underscore are wildcards."""
    if sources is not None:
        documents = documents.where(F.col("source").isin(*sources))
    if title is not None:
        documents = documents.where(F.ilike("title", F.lit(f"%{title}%")))
    return documents.select("document_id", "source", "title", F.length("text").alias("chars"))


class RiskGraph(NamedTuple):
    """A view of the graph: nodes by risk, the edges between them, and the cycles that they hold whole."""

    nodes: DataFrame
    edges: DataFrame
    cycles: DataFrame


def risk_graph(
    claims: DataFrame, limit: int, relation: list[str] | None = None, routing: list[str] | None = None, least: float | None = None, root: int | None = None, depth: int = 2, entities: DataFrame | None = None
) -> RiskGraph:
    """Nodes by risk, then name or id, up to ``limit``, with flags and degree; ``truncated`` tells if there are more.

    Edges and cycles with a node beyond the limit are dropped. ``root`` keeps the nodes within ``depth`` steps of it,
    whichever way edges point, and everything else is worked out on what is kept: degrees against the
    largest one there, and only cycles there. ``entities`` (entity_id, canonical) drops claims with an end that is no entity, adds
    entities without claims as nodes without risk and gives names. Of cycles those that hold another's nodes are left out.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    if not 1 <= depth <= 4:
        raise ValueError("depth must be 1 to 4")
    held = feed.filtered(claims, relations=relation, routing=routing, min_confidence=least)
    if entities is not None:
        for side in ("subject_id", "object_id"):
            held = held.join(entities.select(F.col("entity_id").alias(side)), side, "left_semi")
    edges = cut(graph.grouped_edges(held).drop("claim_ids"))
    names = entities.select(F.col("entity_id").alias("node"), "canonical") if entities is not None else None
    if root is not None:
        near = cut(graph.neighbourhood(edges, root, depth).select("node"))
        edges = cut(edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns))
        names = names.join(near, "node", "left_semi") if names is not None else None
    found, members = graph.cycles_and_members(edges)
    cycles = graph.minimal_cycles(found)
    nodes = graph.node_risk(edges, members).join(graph.node_flags(edges, members), "node")
    if names is not None:
        nodes = names.join(nodes, "node", "left").fillna({"degree": 0, "risk": 0.0, "flags": ""})
    nodes = cut(nodes)
    total = nodes.agg((F.count("*") > limit).alias("truncated")).withColumn("_k", F.lit(1))
    order = [F.desc("risk"), *(["canonical"] if names is not None else []), "node"]
    kept = cut(nodes.orderBy(*order).limit(limit))
    risk = kept.select("node", "risk")
    end = lambda c: F.broadcast(risk.select(F.col("node").alias(c)))
    inside = graph.grouped_edges(held.join(end("subject_id"), "subject_id", "left_semi").join(end("object_id"), "object_id", "left_semi"))
    parts = cycles.withColumn("id", F.concat_ws("-", "path")).select("relation", "id", "path", "length", F.explode("path").alias("node")).join(F.broadcast(risk), "node")
    whole = parts.groupBy("relation", "id").agg(F.first("path").alias("path"), F.first("length").alias("length"), F.round(F.avg("risk"), 4).alias("risk"), F.count("*").alias("n")).where("n = length").drop("n", "id")
    return RiskGraph(kept.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k").orderBy(*order), inside, whole.orderBy(F.desc("risk"), "length", "path"))


def cycles_by_risk(cycles: DataFrame, risk: DataFrame) -> DataFrame:
    """Cycles by mean risk of their members, the shorter first on a tie."""
    return graph.cycle_risk(cycles, risk).orderBy(F.desc("risk"), "length", "id")


def row(claims: DataFrame) -> DataFrame:
    """Feed rows; whether attention is there to show."""
    return claims.select("claim_id", "relation", "confidence", (F.coalesce(F.size("attention"), F.lit(0)) > 0).alias("attention_available"))


def calibration_report(snapshots: DataFrame) -> DataFrame:
    """Snapshots in order with the change of each post snapshot against its baseline."""
    base = snapshots.where("label = 'baseline'").select("org_id", "day", "temperature")
    post = snapshots.where("label = 'post'").select("org_id", "day", F.col("temperature").alias("post"))
    met = evals.latest_as_of(post, base, "org_id", "day", "temperature")
    change, relative = jobs.improvement(F.col("temperature"), F.col("post"))
    return met.select("org_id", "day", "post", "temperature", change.alias("change"), relative.alias("relative"))


def fragility_report(trials: DataFrame) -> DataFrame:
    """Fragility by family beside the fragility of all claims."""
    everything = evals.fragility(trials).agg(F.count("*").alias("claims"), F.round(F.avg("fragility"), 6).alias("mean_fragility")).withColumn("_k", F.lit(1))
    return evals.by_family(trials).withColumn("_k", F.lit(1)).join(F.broadcast(everything), "_k").drop("_k")


class FragilityView(NamedTuple):
    """What the perturbations of all claims show together."""

    points: DataFrame
    families: DataFrame
    quartiles: DataFrame
    headline: DataFrame


def fragility_view(trials: DataFrame, families: tuple[str, ...]) -> FragilityView:
    """Points (claim_id, vacuity, fragility), families, quartiles of vacuity with their bounds, and a headline.

    The headline is one row: both correlations of vacuity with fragility, the p-value, its verdict, the contrast of the
    top quartile with the bottom one, and the family that flips most. Claims without trials are not in it.
    """
    points = cut(trials.groupBy("claim_id", "vacuity").agg(F.round(F.avg(evals.instability()), 6).alias("fragility")))
    by_family = evals.by_family(trials)
    table = cut(evals.quartile_table(trials).join(reports.quartile_bounds(points, "vacuity"), "quartile"))
    test = evals.correlation_test(points, "vacuity", "fragility").withColumn("verdict", reports.strength(F.col("spearman"), F.col("n"), F.col("p_value")))
    worst = reports.worst_family(by_family, families).select(F.col("family").alias("worst_family"), F.col("flip_rate").alias("worst_rate"))
    headline = test.join(F.broadcast(reports.quartile_contrast(table))).join(F.broadcast(worst))  # one row each
    return FragilityView(points, by_family, table, headline)


class RoutingView(NamedTuple):
    """How routed cases compare with their truth."""

    summary: DataFrame
    matrix: DataFrame
    classes: DataFrame
    failures: DataFrame


def routing_view(cases: DataFrame, claims: DataFrame, opinions: DataFrame, labels: tuple[str, ...]) -> RoutingView:
    """The three arms of the cascade, the confusion matrix, the classes' scores and the failures.

    ``cases``: claim_id, truth, predicted, resolved_by, is_failure. ``claims``: claim_id, classical; the classical arm counts
    cases whose claim is stored, with the prediction where the claim keeps no classical outcome. ``opinions``:
    truth, predicted of the cases that were all asked; without any, that arm is the cascade's.
    """
    kept = cut(cases)
    hit = F.avg((F.col("truth") == F.col("predicted")).cast("double"))
    arm = lambda df, name: df.agg(F.round(F.coalesce(hit, F.lit(0.0)), 4).alias(name))
    classical = kept.join(claims.select("claim_id", "classical"), "claim_id").withColumn("predicted", F.coalesce("classical", "predicted"))
    asked = opinions.agg(F.count("*").alias("opinion_calls"), F.round(hit, 4).alias("_opinion"))
    classes = cut(evals.per_class(kept, labels))
    head = kept.agg(F.count("*").alias("n_cases"), F.round(F.coalesce(hit, F.lit(0.0)), 4).alias("accuracy"), F.count_if(F.col("resolved_by") == "second_opinion").alias("cascade_calls"))
    rows = head.join(F.broadcast(arm(classical, "classical_accuracy"))).join(F.broadcast(asked)).join(F.broadcast(classes.agg(F.round(F.avg("f1"), 4).alias("macro_f1"))))  # one row each
    summary = rows.select("n_cases", "accuracy", "macro_f1", "classical_accuracy", F.coalesce("_opinion", "accuracy").alias("opinion_accuracy"), "cascade_calls", "opinion_calls")
    return RoutingView(summary, evals.confusion(kept, labels), classes, kept.where(F.col("is_failure")))


def members(users: DataFrame, org_id: int) -> DataFrame:
    """A tenant's users in the order in which they came."""
    return feed.scoped(users, org_id).orderBy("created_at", "user_id")


def table_sorted(frame: DataFrame, column: str, descending: bool, key: str, page: int | None = None) -> DataFrame:
    """Rows by one column with nulls always last; ties in the order of ``key``.

    ``page`` keeps that many rows from the first on; they are counted by ranges, so no task holds a page.
    """
    value = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    if page is not None:
        placed = evals.running(frame.withColumn("_one", F.lit(1)), [value, F.col(key)], "_one")
        frame = placed.where(F.col("before") < page).select(*frame.columns)
    return frame.orderBy(value, key)


def url_filters(query: dict[str, str]) -> dict:
    """Feed filters from a URL: shares are held within 0 and 1, unknown names and values that are no numbers are dropped."""
    out: dict = {}
    for name, value in query.items():
        if name in ("min_confidence", "max_confidence", "min_vacuity"):
            try:
                number = float(value)
            except ValueError:
                continue
            if number == number:
                out[name] = min(1.0, max(0.0, number))
        elif name in ("relations", "routing"):
            kept = [v for v in value.split(",") if v]
            if kept:
                out[name] = kept
    return out
