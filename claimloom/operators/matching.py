"""Joins of claims, mentions and sentences with gold labels and with each other.

Unless a docstring says otherwise: null keys match nothing, rows that are repeated are joined
each, and an empty side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Entity types that can be an argument of a relation, and pairs of a sentence at most.
ARGUMENT_TYPES, MOST_PAIRS = ("ORG", "PERSON"), 24
PARTIES = ["document_id", "subject_id", "object_id"]


def gold_cases(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """Evaluation cases: gold relations met by a claim of the same parties and relation.

    ``gold`` has document_id, subject_id, object_id, relation, truth and note. A case fails where
    the claim's routing is not the truth.
    """
    keys = [*PARTIES, "relation"]
    met = gold.select(*keys, "truth", "note").join(claims.select(*keys, "claim_id", F.col("routing").alias("predicted"), "resolved_by"), keys)
    return met.select("claim_id", "truth", "predicted", "resolved_by", (F.col("predicted") != F.col("truth")).alias("is_failure"), "note")


def unmatched_gold(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """Gold relations that no claim meets."""
    return gold.join(claims.select(*PARTIES, "relation").distinct(), [*PARTIES, "relation"], "left_anti")


def labelled_claims(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims with the gold relation of their parties, the misclassified ones too.

    Of the claims of the same parties the last stands for them, and of the gold relations
    that meet it the first in ``position``.
    """
    last = claims.withColumn("_n", F.row_number().over(W.partitionBy(*PARTIES).orderBy(F.desc("claim_id")))).where("_n = 1").drop("_n")
    met = gold.select(*PARTIES, "position", F.col("relation").alias("gold_relation")).join(last, PARTIES)
    return met.withColumn("_n", F.row_number().over(W.partitionBy("claim_id").orderBy("position"))).where("_n = 1").drop("_n", "position")


def entities_of_drafts(drafts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Drafts (document_id, char_start, char_end) with the entity whose mention has that span exactly."""
    return drafts.join(mentions.select("document_id", "char_start", "char_end", "entity_id"), ["document_id", "char_start", "char_end"])


def _cells(start: str, end: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width)))


def inside(mentions: DataFrame, sentences: DataFrame, width: int = 256) -> DataFrame:
    """Mentions with every sentence (document_id, sent, sent_start, sent_end) that holds them whole.

    Both meet in the cell of the text where the mention starts, so a long document is dealt
    over its cells.
    """
    a = mentions.withColumn("_cell", F.floor(F.col("char_start") / width))
    b = sentences.withColumn("_cell", _cells("sent_start", "sent_end", width))
    return a.join(b, ["document_id", "_cell"]).where("sent_start <= char_start AND char_end <= sent_end").drop("_cell")


def sentence_of(mentions: DataFrame, sentences: DataFrame, key: str = "mention_id") -> DataFrame:
    """The first sentence that holds each mention; one without is left out."""
    held = inside(mentions, sentences)
    return held.groupBy(key).agg(F.min("sent").alias("sent"))


def aligned(spans: DataFrame, tokens: DataFrame, width: int = 256) -> DataFrame:
    """Character spans as token spans; one that touches tokens of two sentences is left out.

    ``spans``: span_id, document_id, char_start, char_end; ``tokens``: document_id, tok_idx,
    sent, tok_start, tok_end.
    """
    a = spans.withColumn("_cell", _cells("char_start", "char_end", width))
    b = tokens.withColumn("_cell", _cells("tok_start", "tok_end", width))
    met = a.join(b, ["document_id", "_cell"]).where("char_start < tok_end AND char_end > tok_start")
    sums = met.groupBy("span_id").agg(F.min("tok_idx").alias("token_start"), (F.max("tok_idx") + 1).alias("token_end"), F.min("sent").alias("s0"), F.max("sent").alias("s1"))
    return sums.where("s0 = s1").select("span_id", F.col("s0").alias("sent"), "token_start", "token_end")


def candidate_pairs(mentions: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Ordered pairs of argument mentions of a sentence with different surfaces, the first ``most`` by subject, then object.

    ``mentions``: document_id, sent, position, surface, entity_type. The limit belongs to the
    operator; a subject beyond the first ``most`` mentions that has a partner can have no pair left.

    Mentions of one position and surface are one with a number. At most two of them before any subject that has a
    partner have none, so the first ``most + 2`` hold all subjects. An object among the first ``most`` of a subject is among the first
    ``most + 1`` of its surface and of its position; of what is left, a subject passes over ``most + 1`` of its own surface and
    as many of its own position, so the first ``3 * most + 2`` hold all objects. No sentence gives more pairs than these two make.
    """
    spot = ["document_id", "sent"]
    fine = mentions.where(F.col("entity_type").isin(*ARGUMENT_TYPES)).groupBy(*spot, "position", "surface").agg(F.count("*").alias("n")).where("surface IS NOT NULL AND position IS NOT NULL")
    first = lambda df, keys, order, k: df.withColumn("_k", F.row_number().over(W.partitionBy(*spot, *keys).orderBy(*order))).where(F.col("_k") <= k)
    few = first(first(fine, ["surface"], ["position"], most + 1).drop("_k"), ["position"], ["surface"], most + 1).drop("_k")
    held = first(few, [], ["position", "surface"], 3 * most + 2)
    a = held.where(F.col("_k") <= most + 2).select(*spot, F.col("position").alias("subject"), F.col("surface").alias("subject_surface"), F.col("n").alias("_a"))
    b = held.select(*spot, F.col("position").alias("object"), F.col("surface").alias("object_surface"), F.col("n").alias("_b"))
    met = a.join(b, spot).where("subject <> object AND subject_surface <> object_surface")
    times = F.least(F.col("_a") * F.col("_b"), F.lit(most)).cast("int")
    pairs = met.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_a", "_b", "_n")
    turn = F.row_number().over(W.partitionBy(*spot).orderBy("subject", "object"))
    return pairs.withColumn("turn", turn).where(F.col("turn") <= most)


def stale_cases(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """Cases whose claim is gone."""
    return cases.join(claims.select("claim_id"), "claim_id", "left_anti")


def missing_permissions(required: Column, granted: Column) -> Column:
    """What a caller lacks; empty if the call is allowed."""
    return F.array_sort(F.array_except(required, granted))


def contaminated(texts: DataFrame, aliases: list[str], most: int = 1000) -> DataFrame:
    """Texts in which a held-out alias occurs; empty if training texts are clean. The aliases are a short list of the configuration."""
    if len(aliases) > most:
        raise ValueError(f"at most {most} aliases")
    found = F.filter(F.array(*[F.lit(a) for a in aliases]), lambda a: F.contains(F.lower("text"), F.lower(a)))
    return texts.withColumn("aliases", found).where(F.size("aliases") > 0)


def overlapping_pools(names: DataFrame) -> DataFrame:
    """Names (pool, name) that two pools or more share without regard to case; empty if pools are disjoint."""
    return names.groupBy(F.lower("name").alias("name")).agg(F.array_sort(F.collect_set("pool")).alias("pools")).where(F.size("pools") > 1)


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) with both ends among ``nodes``."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def one_cycle(edges: DataFrame, relation: str, members: DataFrame) -> DataFrame:
    """The edges of one relation between the members of a cycle."""
    return kept_edges(edges.where(F.col("relation") == relation), members)


def loaded(claims: DataFrame, entities: DataFrame, runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with the names of both parties, the latency of their run and the title of their document, where there are any."""
    side = lambda c: entities.select(F.col("entity_id").alias(f"{c}_id"), F.col("canonical").alias(c))
    return (
        claims.join(side("subject"), "subject_id", "left")
        .join(side("object"), "object_id", "left")
        .join(runs.select("claim_id", "latency_ms"), "claim_id", "left")
        .join(documents.select("document_id", "title"), "document_id", "left")
        .withColumn("title", F.coalesce("title", F.lit("")))
    )


def documents_of(entity_id: int, mentions: DataFrame, documents: DataFrame, most: int = 8) -> DataFrame:
    """The documents that mention an entity most, by count and title."""
    counts = mentions.where(F.col("entity_id") == entity_id).groupBy("document_id").agg(F.count("*").alias("n"))
    return counts.join(documents.select("document_id", "title"), "document_id").orderBy(F.desc("n"), "title", "document_id").limit(most)


def neighbours_of(entity_id: int, claims: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """The other parties of an entity's claims by greatest confidence, then name."""
    mine = claims.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    other = F.when(F.col("subject_id") == entity_id, F.col("object_id")).otherwise(F.col("subject_id"))
    best = mine.groupBy(other.alias("entity_id")).agg(F.max("confidence").alias("confidence"))
    return best.join(entities.select("entity_id", "canonical"), "entity_id").orderBy(F.desc("confidence"), "canonical", "entity_id").limit(most)


def mentions_of(document_id: int, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """A document's mentions with their entity's name and type, in order of their spans."""
    mine = mentions.where(F.col("document_id") == document_id).select("mention_id", "entity_id", "surface", "char_start", "char_end")
    return mine.join(entities.select("entity_id", "canonical", "entity_type"), "entity_id").orderBy("char_start", "char_end", "mention_id")
