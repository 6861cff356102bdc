"""Counterfactual edge ablation on attention over sentence graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from claimloom.functions import trust
from claimloom.operators import routing, spans
from claimloom.sources.durable import cut

#: A change beyond this carries load; bounds of the verdict's words.
LOAD = 0.10
BOUNDS = ((0.25, "decisive"), (0.10, "strong"), (0.02, "slight"))


def edge_id(src: Column, dst: Column) -> Column:
    return F.format_string("%d->%d", src, dst)


def edge_ends(edge: Column) -> tuple[Column, Column]:
    return F.regexp_extract(edge, r"^(\d+)->", 1).cast("int"), F.regexp_extract(edge, r"->(\d+)$", 1).cast("int")


def unknown_edges(edges: DataFrame, masked: list[str]) -> list[str]:
    """Masked edges that are not in the graph."""
    ids = edges.select(edge_id(F.col("src"), F.col("dst")).alias("id")).where(F.col("id").isin(masked)).distinct()
    return sorted(set(masked) - {r.id for r in ids.collect()})


def masked(edges: DataFrame, mask: Column, mode: str = "zero") -> DataFrame:
    """Attention with masked edges left out (``zero``) or at an even share (``uniform``)."""
    if mode == "zero":
        return spans.segment_softmax(edges.where(~mask))
    if mode == "uniform":
        even = 1.0 / F.count("*").over(W.partitionBy("doc_id", "dst"))
        return spans.segment_softmax(edges).withColumn("weight", F.when(mask, even).otherwise(F.col("weight")))
    raise ValueError(mode)


def readout(edges: DataFrame, value: str = "value") -> DataFrame:
    """Each node's weighted mean over the edges into it."""
    return edges.groupBy("doc_id", "dst").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("out"))


def effect(edges: DataFrame, mask: Column, mode: str = "zero") -> DataFrame:
    """Readout of each node before and after, the change and whether it carries load."""
    before = readout(spans.segment_softmax(edges)).withColumnRenamed("out", "before")
    after = readout(masked(edges, mask, mode)).withColumnRenamed("out", "after")
    change = F.coalesce("after", F.lit(0.0)) - F.col("before")
    return before.join(after, ["doc_id", "dst"], "left").select("doc_id", "dst", F.round("before", 6).alias("before"), F.round(F.coalesce("after", F.lit(0.0)), 6).alias("after"), F.round(change, 6).alias("change"), (F.abs(change) > LOAD).alias("load_bearing"))


def magnitude(change: Column) -> Column:
    out = F.lit("negligible")
    for bound, word in reversed(BOUNDS):
        out = F.when(F.abs(change) > bound, word).otherwise(out)
    return out


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The heaviest ``n`` edges of each document."""
    turn = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("weight"), "src", "dst"))
    return edges.withColumn("turn", turn).where(F.col("turn") <= n).drop("turn")


def sweep(effects: DataFrame) -> DataFrame:
    """By edge count and mode: mean and largest change, and the share that carries load."""
    return effects.groupBy("edge_count", "mode").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs("change")), 6).alias("mean_change"), F.round(F.max(F.abs("change")), 6).alias("max_change"), F.round(F.avg(F.col("load_bearing").cast("double")), 6).alias("load_share")
    )


#: A sentence's graph is found by the exact span that its claim cites, never by its text.
SPAN = ["document_id", "char_start", "char_end"]


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _means(parts: Column, n: int) -> Column:
    """Of each part (w: weights, v: as many arrays of ``n`` values) the weighted mean of its arrays; 0 where nothing weighs.

    What a lambda reads more than once is bound as a field first, since an expression in it is worked out wherever it stands.
    """
    arcs = lambda p: F.zip_with(p["w"], p["v"], lambda w, v: F.struct(w.alias("w"), v.alias("v")))
    summed = lambda p: F.aggregate(arcs(p), F.array_repeat(F.lit(0.0), n), lambda s, a: F.zip_with(s, a["v"], lambda x, v: x + a["w"] * v))
    sums = F.transform(parts, lambda p: F.struct(trust.total(p["w"]).alias("whole"), summed(p).alias("z")))
    return F.transform(sums, lambda p: F.transform(p["z"], lambda z: F.coalesce(F.try_divide(z, p["whole"]), F.lit(0.0))))


def sentence_graphs(edges: DataFrame, n: int) -> DataFrame:
    """One row for each span: the ids of its edges (known) and for each node with edges in what reaches it (into).

    Of a node: dst, ids and softmax shares of the edges into it in order of their sources, the ``n`` values of each, and
    their mean (before). A score or value that is null weighs nothing. An edge from a node to itself is none. No run is needed for any of it.
    """
    values = F.array(*[F.coalesce(F.col("values")[k], F.lit(0.0)) for k in range(n)])
    arc = F.struct("src", edge_id(F.col("src"), F.col("dst")).alias("id"), "score", values.alias("values"))
    nodes = edges.where("src <> dst").groupBy(*SPAN, "dst").agg(F.array_sort(F.collect_list(arc)).alias("arcs"), F.max("score").alias("top"))  # of one node
    # The largest score only keeps the exponentials in range.
    nodes = nodes.withColumn("e", F.transform("arcs", lambda a: F.coalesce(F.exp(a["score"] - F.col("top")), F.lit(0.0))))
    nodes = nodes.withColumn("whole", trust.total(F.col("e")))
    nodes = nodes.select(*SPAN, "dst", F.col("arcs.id").alias("ids"), F.transform("e", lambda x: F.coalesce(F.try_divide(x, F.col("whole")), F.lit(0.0))).alias("shares"), F.col("arcs.values").alias("values"))
    nodes = nodes.withColumn("before", _means(F.array(F.struct(F.col("shares").alias("w"), F.col("values").alias("v"))), n)[0])
    into = F.collect_list(F.struct("dst", "ids", "shares", "values", "before")).alias("into")  # of one sentence
    return nodes.groupBy(*SPAN).agg(into).withColumn("known", F.flatten("into.ids"))


def ablate(requests: DataFrame, claims: DataFrame, nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...], members: DataFrame | None = None) -> DataFrame:
    """Each requested run: what a stored claim's confidence, relation and routing become without some edges of its sentence.

    ``requests``: run_id, claim_id, mode (zero or uniform), masked (array of edge ids). ``claims``: claim_id, document_id,
    char_start, char_end, subject_id, object_id, relation, confidence. ``nodes``: the span and node, entity_id.
    ``edges``: the span and src, dst, score, values (array of one logit for each of ``relations``). A node is read
    as the mean of the values that reach it, weighted by the softmax of the scores of the edges into it; a pair as the mean of its two nodes.

    A run is refused, with the reason and without figures, if its claim is gone, no graph has its span, one of its parties is no
    node there, its mode is unknown, it masks nothing, or an edge that is not in the graph (an edge from a node to itself is none).
    Of a party with several nodes the first counts. All runs are one plan; routing is worked out again in the context of all claims.

    Whatever does not depend on a run is worked out once: for a claim its nodes, for a sentence its shares and what they give. What is
    asked of a sentence is worked out once, within a row, however many runs ask it; a run takes its figures by an equi-join.
    """
    runs = requests.select("run_id", F.col("claim_id").alias("_asked"), "mode", F.array_distinct("masked").alias("masked"))
    own = claims.select("claim_id", *SPAN, "subject_id", "object_id", "relation").join(runs.select(F.col("_asked").alias("claim_id")).distinct(), "claim_id", "left_semi")
    place = nodes.groupBy(*SPAN, "entity_id").agg(F.min("node").alias("node"))
    for side in ("subject", "object"):
        own = own.join(place.select(*SPAN, F.col("entity_id").alias(f"{side}_id"), F.col("node").alias(f"{side}_node")), [*SPAN, f"{side}_id"], "left")
    met = cut(runs.join(own, runs["_asked"] == own["claim_id"], "left"))  # read twice
    # Runs that ask the same of one sentence have the same figures.
    question = [*SPAN, "subject_node", "object_node", "mode", "masked"]
    asked = met.where("claim_id IS NOT NULL").select(*question).distinct().join(sentence_graphs(edges, len(relations)), SPAN, "left")
    unknown = F.array_sort(F.array_except("masked", F.coalesce("known", F.array().cast("array<string>"))))
    refused = (
        F.when(F.col("known").isNull(), "no sentence at this span")
        .when(F.col("subject_node").isNull() | F.col("object_node").isNull(), "a party is not in the sentence").when(~F.col("mode").isin("zero", "uniform") | F.col("mode").isNull(), "unknown mode")
        .when(F.col("masked").isNull() | (F.size("masked") == 0), "nothing masked").when(F.size(unknown) > 0, F.concat(F.lit("unknown edges: "), F.array_join(unknown, ",")))
    )
    read = F.filter("into", lambda x: (x["dst"] == F.col("subject_node")) | (x["dst"] == F.col("object_node")))
    asked = asked.withColumn("refused", refused).withColumn("read", F.when(F.col("refused").isNull(), read)).drop("known", "into")

    def left(x: Column) -> Column:
        """The weights of the edges into a node that a run leaves."""
        off = F.when(F.col("mode") == "zero", 0.0).otherwise(1.0 / F.size(x["ids"]))
        return F.zip_with(x["ids"], x["shares"], lambda i, w: F.when(F.array_contains("masked", i), off).otherwise(w))

    parts = F.transform("read", lambda x: F.struct(left(x).alias("w"), x["values"].alias("v")))
    n = len(relations)
    rows = asked.withColumns({"before": F.col("read.before"), "after": _means(parts, n)}).drop("read")  # by node; of two parties one or two
    for w in ("before", "after"):
        # One column for each relation: Spark compiles these, lambdas over arrays it does not.
        one, two = F.get(w, F.lit(0)), F.get(w, F.lit(1))
        rows = rows.withColumns({f"z{k}": F.when(F.size(w) > 1, (F.get(one, F.lit(k)) + F.get(two, F.lit(k))) / 2.0).otherwise(F.get(one, F.lit(k))) for k in range(n)})
        z = [F.col(f"z{k}") for k in range(n)]
        rows = rows.withColumns({f"e{k}": trust.softplus(z[k]) for k in range(n)}).withColumn("top", _greatest(z))
        e = [F.col(f"e{k}") for k in range(n)]
        rows = rows.withColumns({"whole": sum(e, F.lit(0.0)) + float(n), f"relation_{w}": F.coalesce(*[F.when(z[k] == F.col("top"), relations[k]) for k in range(n)])})
        rows = rows.withColumns({f"confidence_{w}": (_greatest(e) + 1.0) / F.col("whole"), f"vacuity_{w}": float(n) / F.col("whole")})
    found = [f"{c}_{w}" for c in ("relation", "confidence", "vacuity") for w in ("before", "after")]
    figures = rows.select(*[F.col(c).alias(f"_{c}") for c in question], F.col("refused").alias("_refused"), *found)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in question]
    rows = met.join(figures, same, "left").withColumn("refused", F.when(F.col("claim_id").isNull(), "no such claim").otherwise(F.col("_refused")))
    # Only the confidence changes from run to run; what routing adds to it is the claim's.
    rows = routing.additions(rows.select(*met.columns, "refused", *found), claims, members, how="left")
    for w in ("before", "after"):
        confidence = F.col(f"confidence_{w}")
        rows = rows.withColumn(f"routing_{w}", F.when(confidence.isNotNull(), routing.by_risk(routing.raw_risk(F.col("added"), confidence))))
    change = F.col("confidence_after") - F.col("confidence_before")
    moved = F.col("routing_before") != F.col("routing_after")
    return rows.select(
        "run_id", F.col("_asked").alias("claim_id"), "mode", F.array_join(F.array_sort("masked"), ",").alias("masked"), "refused",
        "relation_before", "relation_after", "routing_before", "routing_after", *[F.round(f"{c}_{w}", 6).alias(f"{c}_{w}") for c in ("confidence", "vacuity") for w in ("before", "after")],
        F.round(change, 6).alias("change"), ((F.abs(change) > LOAD) | moved).alias("load_bearing"),
        F.when(F.col("confidence_before").isNotNull(), verdict(change, F.size("masked"), F.col("relation_before"), F.col("relation_after"), moved)).alias("verdict"),
    )


def verdict(change: Column, n: Column, before: Column, after: Column, rerouted: Column) -> Column:
    """One sentence on a run: what changed most decides which it is."""
    edges = F.concat(n.cast("string"), F.when(n == 1, F.lit(" edge")).otherwise(F.lit(" edges")))
    size = F.concat(magnitude(change), F.when(change < 0, F.lit(" loss")).otherwise(F.lit(" gain")), F.lit(" of confidence"))
    return (
        F.when(before != after, F.concat(F.lit("Without "), edges, F.lit(" the sentence reads as "), after, F.lit(" and no longer as "), before, F.lit(", a "), size, F.lit(".")))
        .when(rerouted, F.concat(F.lit("Without "), edges, F.lit(" the claim is routed elsewhere, with a "), size, F.lit(".")))
        .when(F.abs(change) > LOAD, F.concat(F.lit("The claim rests on "), edges, F.lit(": masking brings a "), size, F.lit(".")))
        .otherwise(F.concat(F.lit("The claim holds without "), edges, F.lit(".")))
    )
