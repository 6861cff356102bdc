"""Adversarial variants of a text around a tracked span, and the scoring of trials.

Every choice comes from a hash of (seed, claim, family, variant, place), so reruns
agree on any number of executors. Variants are lists of edits; ``applied`` keeps the
tracked span at its words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import normalized_name
from claimloom.operators import evals
from claimloom.sources.durable import cut

#: The families in order, the share of words or places that are changed.
FAMILIES = ("synonym", "rename", "boilerplate", "reorder", "punctuation")
SYNONYM_SHARE, NOISE_SHARE = 0.15, 0.10
#: Everyday words and words that may stand for them.
SYNONYMS = dict(
    pair.split(":")
    for pair in (
        "about:roughly also:likewise answer:reply ask:request begin:start big:large buy:purchase change:alter choose:pick close:shut collect:gather "
        "correct:right cost:price deal:bargain easy:simple end:finish error:mistake false:untrue fast:quick final:last find:locate first:initial fix:repair "
        "get:obtain give:hand goods:wares happy:glad hard:difficult help:assist hide:conceal home:house idea:notion important:weighty job:task keep:retain "
        "kind:sort leave:depart little:small look:glance make:produce many:numerous meet:encounter money:funds need:require new:recent often:frequently old:former "
        "only:merely owns:possesses part:piece place:spot plan:scheme quiet:silent rich:wealthy safe:secure say:state show:display sick:ill speak:talk stop:halt "
        "strange:odd strong:sturdy take:seize thin:slim think:believe true:genuine use:employ want:desire whole:entire work:labour wrong:mistaken yearly:annually"
    ).split()
)
NOTICES = ("This message may be confidential.", "Please consider the environment before printing.")


def chance(*parts) -> float:
    """A number from 0 to 1 that the parts decide."""
    return int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=7).digest()) / 2**56


def chances(places: list[int], *seed) -> list[float]:
    """``chance(*seed, place)`` of each place; what all have in common is written out once."""
    head, draw, number = ":".join(map(str, seed)), hashlib.blake2b, int.from_bytes
    return [number(draw(f"{head}:{p}".encode(), digest_size=7).digest()) / 2**56 for p in places]


@lru_cache(maxsize=1)
def _words(text: str) -> list[tuple[int, int]]:
    """Where the words of a text stand: two families ask one after another."""
    return [m.span() for m in re.finditer(r"\w+", text)]


def _standing(name: str, text: str) -> Iterator[int]:
    """Where a name stands, from left to right without overlap; an empty one stands at every place."""
    at = text.find(name)
    while at >= 0:
        yield at
        at = text.find(name, at + (len(name) or 1)) if at < len(text) else -1


def applied(text: str, edits: list[tuple[int, int, str]], start: int, end: int) -> tuple[str, int, int]:
    """The text after edits (start, end, new) and the tracked span; overlapping edits are an error.

    An edit without width at the span's start counts as before it, at its end as after.
    """
    out, at, shift, stretch, last = [], 0, 0, 0, 0
    for a, b, new in sorted(edits):
        if a < last:
            raise ValueError("edits overlap")
        out += [text[at:a], new]
        grow = len(new) - (b - a)
        if b <= start:
            shift += grow
        elif a < end:
            stretch += grow
        at = last = b
    return "".join(out) + text[at:], start + shift, end + shift + stretch


def edits_of(family: str, text: str, start: int, end: int, names: list[str], *seed) -> list[tuple[int, int, str]]:
    if family == "synonym":
        free = [(a, b, new) for a, b in _words(text) if (new := SYNONYMS.get(text[a:b].lower()))]
        return free if len(free) == 1 else [x for x, p in zip(free, chances([a for a, _, _ in free], *seed), strict=True) if p < SYNONYM_SHARE]
    if family == "rename":
        new, out, last = renamed(names, *seed), [], 0
        for a, b, n in sorted((a, a + len(n), n) for n in names for a in _standing(n, text)):
            if a >= last:  # beyond all that began before it
                out.append((a, b, new[n]))
            last = max(last, b)
        return out
    if family == "boilerplate":
        notice = NOTICES[int(chance(*seed) * len(NOTICES))]
        return [(start, start, notice + " ")] if chance(*seed, "side") < 0.5 else [(end, end, " " + notice)]
    if family == "punctuation":
        gaps = [b for _, b in _words(text) if not start < b < end]
        return [(g, g, ",") for g, p in zip(gaps, chances(gaps, *seed), strict=True) if p < NOISE_SHARE]
    raise ValueError(family)


def reordered(text: str, start: int, end: int, *seed) -> tuple[str, int, int] | None:
    """Sentences in another order, the span moved with its own; null below three sentences."""
    cuts = [0, *(m.end() for m in re.finditer(r"[.!?]\s+", text)), len(text)]
    parts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    if len(parts) < 3 or not any(a <= start and end <= b for a, b in parts):
        return None
    order = [p for _, p in sorted(zip(chances([a for a, _ in parts], *seed), parts, strict=True))]
    pieces = [text[a:b].rstrip() for a, b in order]
    at = 0
    for (a, b), piece in zip(order, pieces, strict=True):
        if a <= start and end <= b:
            return " ".join(pieces), at + start - a, at + end - a
        at += len(piece) + 1
    return None


def renamed(names: list[str], *seed) -> dict[str, str]:
    """The new name of each."""
    return {n: f"Party {int(chance(*seed, n) * 9000) + 1000}" for n in names}


#: Characters of variants that leave a task together, and what a row counts beside its text.
CHARS, ROW = 4_000_000, 500


def variants(claims: DataFrame, per_family: int = 1, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``claims`` (claim_id, text, char_start, char_end, names) with the variants of every family; vacuous ones are left out.

    ``renames`` has the old name of each new one; columns to ``keep`` follow. Variants leave a task as soon as they hold ``CHARS`` characters together.
    """
    given = ["claim_id", "text", "char_start", "char_end", "names"]
    names = ["claim_id", "perturbation", "variant", "text", "char_start", "char_end", "renames", *keep]

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, size = [], 0
            for claim, text, start, end, parties, *kept in zip(*(f[c] for c in (*given, *keep)), strict=True):
                parties = list(parties)
                for family in FAMILIES:
                    for v in range(per_family):
                        key = (seed, claim, family, v)
                        if family == "reorder":
                            got = reordered(text, start, end, *key)
                        else:
                            got = applied(text, edits_of(family, text, start, end, parties, *key), start, end)
                        if got and got[0] != text:
                            old = {new: n for n, new in renamed(parties, *key).items()} if family == "rename" else {}
                            rows.append((claim, family, v, *got, old, *kept))
                            size += len(got[0]) + ROW
                if size >= CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    kinds = dict(claims.dtypes)
    schema = ", ".join(["claim_id long, perturbation string, variant int, text string, char_start int, char_end int, renames map<string, string>", *(f"{c} {kinds[c]}" for c in keep)])
    return claims.select(*given, *keep).where("text IS NOT NULL").mapInPandas(build, schema)


def scored(targets: DataFrame, drafts: DataFrame) -> DataFrame:
    """Trials: the surest draft that overlaps the moved span for the same parties, or a lost relation.

    ``targets``: claim_id, perturbation, variant, start, end, subject_id, object_id, routing,
    confidence; ``drafts``: claim_id, perturbation, variant, start2, end2, subject_id,
    object_id, new_routing, new_confidence.
    """
    keys = ["claim_id", "perturbation", "variant", "subject_id", "object_id"]
    met = targets.join(drafts, keys).where("start2 < end AND end2 > start")
    best = met.groupBy("claim_id", "perturbation", "variant").agg(F.max_by("new_routing", "new_confidence").alias("new_routing"), F.max("new_confidence").alias("new_confidence"))
    joined = targets.join(best, ["claim_id", "perturbation", "variant"], "left")
    lost = F.col("new_confidence").isNull()
    return joined.select(
        "claim_id", "perturbation", "variant", (lost | (F.col("new_routing") != F.col("routing"))).alias("label_flipped"),
        F.round(F.coalesce("new_confidence", F.lit(0.0)) - F.col("confidence"), 6).alias("conf_delta"), lost.alias("relation_lost"),
    )


class Run(NamedTuple):
    """What a run of all families leaves: its trials, and the claims with their fragility."""

    trials: DataFrame
    claims: DataFrame


def run(claims: DataFrame, documents: DataFrame, extract: Callable[[DataFrame], DataFrame], per_family: int = 1, seed: int = 0) -> Run:
    """Perturb the document of every claim, extract from each variant, and score what became of the claim.

    ``claims``: claim_id, document_id, char_start, char_end, subject, object (names as they stand), relation, confidence and, if they
    have one, fragility; ``documents``: document_id, text. ``extract`` takes claim_id, perturbation, variant, text and gives, beside all columns but the text
    (more may be there), subject, object, relation, confidence, start2, end2 of each claim that it reads. A draft is the claim's if it overlaps the moved span
    and has its parties once renames are undone; of several the surest counts (ties: the first). The relation is lost without one, and
    the label flips if it is lost or another. Families that cannot change a text leave no trial. Fragility is the mean
    instability of a claim's trials, 0 without any; claims whose document is gone keep what they had. Nothing is written
    back to the documents, and reruns agree.
    """
    held = claims.join(documents.select("document_id", "text"), "document_id").where("text IS NOT NULL")
    own = {"_s": F.col("subject"), "_o": F.col("object"), "_r": F.col("relation"), "_c": F.col("confidence").cast("double")}
    # A claim takes long for its few bytes, so claims are dealt to all partitions, however small. What a draft is held against travels with its text.
    dealt = held.select("claim_id", "text", "char_start", "char_end", F.array("subject", "object").alias("names"), *[c.alias(n) for n, c in own.items()]).repartition(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), "claim_id")
    made = cut(variants(dealt, per_family, seed, tuple(own)))
    keys = ["claim_id", "perturbation", "variant", "_r", "_c"]
    was = lambda c: F.coalesce(F.try_element_at("renames", F.col(c)), F.col(c))
    same = lambda a, b: (a == b) | (normalized_name(a) == normalized_name(b))  # noqa: E731  names alike as they stand need no more
    drafts = extract(made).where("start2 < char_end AND end2 > char_start").where(same(was("subject"), F.col("_s")) & same(was("object"), F.col("_o")))
    read = drafts.select(*keys, F.struct("relation", "confidence").alias("draft"), F.struct("confidence", -F.col("start2")).alias("rank"))
    every = made.select(*keys).unionByName(read, allowMissingColumns=True).repartition("claim_id")  # so trials and their mean need no more
    best = every.groupBy(*keys).agg(F.max_by("draft", "rank").alias("best"))
    lost = F.col("best").isNull()
    trials = best.select(
        "claim_id", "perturbation", "variant", (lost | (F.col("best")["relation"] != F.col("_r"))).alias("flipped"), lost.alias("lost"),
        F.round(F.coalesce(F.col("best")["confidence"], F.lit(0.0)) - F.col("_c"), 6).alias("delta"),
    )
    trials = cut(trials)
    scores = evals.fragility(trials).withColumnRenamed("fragility", "_new")
    before = F.col("fragility") if "fragility" in claims.columns else F.lit(None).cast("double")
    tried = held.select("claim_id").withColumn("_tried", F.lit(True))
    stored = claims.join(tried, "claim_id", "left").join(scores, "claim_id", "left")
    kept = [c for c in claims.columns if c != "fragility"]
    return Run(trials, stored.select(*kept, F.when(F.col("_tried"), F.coalesce("_new", F.lit(0.0))).otherwise(before).alias("fragility")))
