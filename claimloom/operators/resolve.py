"""Entity resolution: what an ordered reading of all names would decide, in rounds over joins.

Names of a tenant come in order. One with a known key is that entity; else one that is the first whole
words of a known key, or starts with all of its words, is the entity of the longest overlap, the
earliest on a tie; else one whose trigram vector has a cosine of ``LEAST`` or more with an entity's own
vector is the entity of the greatest one; else it is a new entity. Every key then finds its entity.

No task reads a tenant in order:

* Prefixes. Among earlier keys, those that begin with the whole key overlap most, so the earliest of
  them decides; without one, the longest key that it begins with does. Both are found by joins on
  the key's own beginnings, with minima that are combined before the shuffle.
* Vectors. Two vectors of unit length that agree in fewer than ``SHARED`` of their first dimensions, in one order for
  all, have a cosine below ``LEAST``; so each vector is listed under all sets of that many of its first ones. Vectors of few
  dimensions (two make up almost all of them) are listed under single ones, where they meet all others.
* Rounds. A key that is the first undecided one in all of its lists has no earlier key to wait for:
  it is an entity of its own, and meets its lists. What it matches is decided too. A round settles many keys in many
  lists at once, and an entity that resembles very many names meets each once: pairs of names that
  are no entity are never made.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import LEGAL_FORMS
from claimloom.sources.durable import cut

#: Width of a vector, least cosine of a match, least length of a first word.
WIDTH, LEAST, HEAD = 256, 0.86, 4
#: Dimensions that two matching vectors share among their first ones, unless fewer make up almost all of one of them.
SHARED = 3
#: An entity table of so many rows at most is broadcast to the lists that it meets.
SMALL = 10_000


def key_of(surface: str) -> str:
    """Case folded, letters, digits and & in words by single blanks, without legal forms at the end; if nothing is left, the surface."""
    words = re.sub("[^0-9a-z& ]+", " ", surface.casefold()).split()
    while words and words[-1] in LEGAL_FORMS:
        words.pop()
    return " ".join(words) or surface.casefold()


@lru_cache(maxsize=100_000)
def _place(gram: str) -> tuple[int, int]:
    h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest())
    return h % WIDTH, 1 if h >> 63 else -1


def vector(key: str, idf: dict[str, float] | None = None) -> np.ndarray:
    """Signed hashed trigram counts ``(1 + ln tf) * idf``, of length one."""
    out, padded = np.zeros(WIDTH), f" {key} "
    grams = [padded[i : i + 3] for i in range(len(padded) - 2)]
    for gram in dict.fromkeys(grams):
        at, sign = _place(gram)
        out[at] += sign * (1 + np.log(grams.count(gram))) * (idf or {}).get(gram, 1.0)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def first_dimensions(v: np.ndarray, order: np.ndarray, shared: int) -> list[int]:
    """The fewest first dimensions of ``v`` in ``order`` of which a vector with a cosine of ``LEAST`` shares ``shared``, or all.

    Whatever else it shares lies in the rest of ``v`` and in ``shared - 1`` of the first ones, whose length stays below ``LEAST``.
    """
    own = [d for d in order.tolist() if v[d]]
    squares = [float(v[d]) ** 2 for d in own]
    for n in range(shared, len(own)):
        if sum(squares[n:]) + sum(sorted(squares[:n])[n - shared + 1 :]) < LEAST * LEAST - 1e-9:
            return own[:n]
    return own


def lists_of(v: np.ndarray, order: np.ndarray) -> tuple[list[str], list[str]]:
    """Names of the lists that a vector is in: those of sets of dimensions, and those of single ones."""
    mark = lambda d: f"{d}{'+' if v[d] > 0 else '-'}"
    few = np.sort(v * v)[1 - SHARED :].sum() >= LEAST * LEAST - 1e-9 or not v.any()
    sets = [] if few else [".".join(map(mark, sorted(c))) for c in itertools.combinations(first_dimensions(v, order, SHARED), SHARED)]
    return sets, [mark(d) for d in first_dimensions(v, order, 1)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [key_of(s or "") for s in batch.column("surface").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*batch.schema.names, "key"])


def _vectors(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, values, sets, ones = [], [], [], []
        for key in batch.column("key").to_pylist():
            v = vector(key)
            at = np.flatnonzero(v)
            dims.append(at.tolist())
            values.append(v[at].tolist())
            a, b = lists_of(v, order)
            sets.append(a)
            ones.append(b)
        kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.string()))
        columns = [pa.array(x, t) for x, t in zip((dims, values, sets, ones), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "dims", "values", "sets", "ones"])


def _dense(dims: pa.Array, values: pa.Array) -> np.ndarray:
    out = np.zeros((len(dims), WIDTH))
    row = np.repeat(np.arange(len(dims)), pc.list_value_length(dims).to_numpy())
    out[row, dims.flatten().to_numpy()] = values.flatten().to_numpy()
    return out


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            a, b = (_dense(part.column(f"{s}_dims"), part.column(f"{s}_values")) for s in ("a", "b"))
            cosine = np.round((a * b).sum(1), 12)
            keep = pa.array(cosine >= LEAST)
            yield pa.RecordBatch.from_arrays([*[part.column(c).filter(keep) for c in ("org_id", "key", "at", "center", "center_at")], pa.array(cosine).filter(keep)], names=["org_id", "key", "at", "center", "center_at", "cosine"])


def _by_prefix(keys: DataFrame) -> DataFrame:
    """org_id, key and ``parent``, the earlier key that decides by whole words, where there is one."""
    words = F.split("key", " ")
    long = keys.where(F.length(words[0]) >= HEAD)
    starts = long.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(words)))).withColumn("start", F.array_join(F.slice(words, F.lit(1), F.col("n")), " "))
    # The earliest key that begins with all words of this one, and the longest earlier key that this one begins with.
    longer = starts.where("start <> key").groupBy("org_id", F.col("start").alias("key")).agg(F.min(F.struct("at", F.col("key").alias("k"))).alias("long"))
    named = long.select("org_id", F.col("key").alias("start"), F.col("at").alias("start_at"))
    shorter = starts.where("start <> key").join(named, ["org_id", "start"]).where("start_at < at").groupBy("org_id", "key").agg(F.max_by("start", "n").alias("short"))
    met = long.join(longer, ["org_id", "key"], "left").join(shorter, ["org_id", "key"], "left")
    parent = F.coalesce(F.when(F.col("long")["at"] < F.col("at"), F.col("long")["k"]), F.col("short"))
    return met.select("org_id", "key", parent.alias("parent")).where("parent IS NOT NULL")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _by_cosine(keys: DataFrame) -> DataFrame:
    """org_id, key, ``parent`` (the entity's own key, which is the key itself for a new one) and ``cosine``.

    ``keys`` (org_id, key, at, dims, values, sets, ones, fixed) are those that no prefix decides; ``fixed`` ones are stored entities.
    """
    few = F.size("sets") == 0
    # Two vectors meet in lists of sets, or where one of them has few dimensions in lists of single ones.
    entries = cut(
        keys.select("org_id", "key", "at", F.explode("sets").alias("list"), F.lit(False).alias("few"))
        .unionByName(keys.select("org_id", "key", "at", F.explode("ones").alias("list"), few.alias("few")))
    )
    body = keys.select("org_id", "key", "dims", "values")
    state = cut(keys.select("org_id", "key", "at", F.lit(False).alias("settled"), F.col("fixed").alias("center")))
    pairs, fresh = None, state.where("center")
    while True:
        found = cut(_met(fresh, entries, body))
        pairs = found if pairs is None else pairs.unionByName(found)
        out = found.select("org_id", "key").distinct()
        new = fresh.select("org_id", "key").withColumn("_new", F.lit(True))
        state = cut(
            state.join(out.withColumn("_out", F.lit(True)), ["org_id", "key"], "left").join(new, ["org_id", "key"], "left")
            .select("org_id", "key", "at", (F.col("settled") | F.coalesce("_out", "_new", F.lit(False))).alias("settled"), (F.col("center") | F.coalesce("_new", F.lit(False))).alias("center"))
        )
        open_ = state.where("NOT settled").select("org_id", "key")
        if open_.isEmpty():
            break
        waiting = entries.join(open_, ["org_id", "key"], "left_semi")
        # Lists of single dimensions matter to vectors of few dimensions and to what meets them there.
        heads = waiting.groupBy("org_id", "list").agg(F.min("at").alias("first"), F.min(F.when(F.col("few"), F.col("at"))).alias("first_few"))
        single = ~F.contains("list", F.lit("."))
        waits = waiting.join(heads, ["org_id", "list"]).withColumn("late", F.when(single & ~F.col("few"), F.coalesce(F.col("first_few") < F.col("at"), F.lit(False))).otherwise(F.col("first") < F.col("at")))
        ready = waits.groupBy("org_id", "key").agg(F.max("late").alias("late")).where("NOT late").select("org_id", "key")
        lone = open_.join(waiting.select("org_id", "key").distinct(), ["org_id", "key"], "left_anti")  # a vector of zeros
        fresh = cut(state.join(ready.unionByName(lone), ["org_id", "key"], "left_semi"))
    best = pairs.where("center_at < at").groupBy("org_id", "key").agg(F.max_by("center", F.struct("cosine", F.struct((-F.col("center_at")["stage"]).alias("s"), (-F.col("center_at")["position"]).alias("p")))).alias("parent"), F.max("cosine").alias("cosine"))
    own = state.where("center").select("org_id", "key", F.col("key").alias("parent"), F.lit(None).cast("double").alias("cosine"))
    return own.unionByName(best.join(own.select("org_id", "key"), ["org_id", "key"], "left_anti"))


def _met(fresh: DataFrame, entries: DataFrame, body: DataFrame) -> DataFrame:
    """Later keys with a cosine of ``LEAST`` or more with each of the new entities."""
    lists = entries.join(fresh.select("org_id", "key"), ["org_id", "key"], "left_semi").select("org_id", "list", F.col("key").alias("center"), F.col("at").alias("center_at"), F.col("few").alias("center_few"))
    single = ~F.contains("list", F.lit("."))
    asked = entries.join(_small(cut(lists)), ["org_id", "list"]).where((F.col("center_at") < F.col("at")) & (~single | F.col("few") | F.col("center_few")))
    asked = asked.select("org_id", "key", "at", "center", "center_at").distinct()
    a = body.select("org_id", F.col("key").alias("center"), F.col("dims").alias("a_dims"), F.col("values").alias("a_values"))
    b = body.select("org_id", "key", F.col("dims").alias("b_dims"), F.col("values").alias("b_values"))
    both = asked.join(a, ["org_id", "center"]).join(b, ["org_id", "key"])
    kind = {f.name: f.dataType.simpleString() for f in both.schema}
    return both.mapInArrow(_cosines, f"org_id {kind['org_id']}, key string, at {kind['at']}, center string, center_at {kind['at']}, cosine double")


def _roots(links: DataFrame) -> DataFrame:
    """org_id, key and ``root`` from org_id, key, parent, by doubling each parent."""
    now = cut(links.select("org_id", "key", F.col("parent").alias("root")))
    while True:
        ahead = now.select("org_id", F.col("key").alias("root"), F.col("root").alias("next"))
        new = cut(now.join(ahead, ["org_id", "root"]).select("org_id", "key", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def resolved(mentions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``mentions`` (org_id, position, surface): the entity of each and how it was found, in the order of positions.

    ``stored`` (org_id, entity_id, surface, alias) has entities that are known before, by their names and aliases. A new
    entity's id is the position of its first mention. Rows without a surface are no mentions and not in the result.
    """
    first = mentions.groupBy("org_id", "surface").agg(F.min("position").alias("position"))
    order = lambda stage, position: F.struct(F.lit(stage).alias("stage"), F.col(position).cast("long").alias("position"))
    rows = first.select("org_id", "surface", order(2, "position").alias("at"), F.lit(None).cast("long").alias("entity_id"))
    if stored is not None:
        known = F.struct(F.when(F.col("alias"), 1).otherwise(0).alias("stage"), F.col("entity_id").cast("long").alias("position"))
        rows = rows.unionByName(stored.select("org_id", "surface", known.alias("at"), F.col("entity_id").cast("long").alias("entity_id")))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    spelled = cut(rows.mapInArrow(_keyed, f"{kinds}, key string"))
    keys = cut(spelled.groupBy("org_id", "key").agg(F.min("at").alias("at"), F.min_by("entity_id", "at").alias("entity_id")))
    prefixed = cut(_by_prefix(keys).join(keys.where("entity_id IS NULL").select("org_id", "key"), ["org_id", "key"], "left_semi"))
    # Stored aliases and keys that a prefix decides have no vector of their own.
    rest = keys.join(prefixed, ["org_id", "key"], "left_anti").where("entity_id IS NULL OR at.stage = 0").select("org_id", "key", "at", F.col("entity_id").isNotNull().alias("fixed"))
    turn = np.random.default_rng(1).permutation(WIDTH)
    kinds = ", ".join(f"{n} {t}" for n, t in rest.dtypes)
    listed = cut(rest.mapInArrow(lambda it: _vectors(it, turn), f"{kinds}, dims array<int>, values array<double>, sets array<string>, ones array<string>"))
    near = cut(_by_cosine(listed))
    aliases = keys.where("entity_id IS NOT NULL AND at.stage = 1").select("org_id", "key", F.col("key").alias("parent"))
    links = prefixed.unionByName(near.select("org_id", "key", "parent")).unionByName(aliases)
    how = prefixed.select("org_id", "key", F.lit("prefix").alias("how")).unionByName(near.select("org_id", "key", F.when(F.col("cosine").isNull(), "new").otherwise("cosine").alias("how")))
    ends = _roots(links).join(keys.select("org_id", F.col("key").alias("root"), F.coalesce("entity_id", F.col("at")["position"]).alias("entity")), ["org_id", "root"])
    named = spelled.where("entity_id IS NULL").select("org_id", "surface", "key").join(keys.select("org_id", "key", F.col("at").alias("key_at")), ["org_id", "key"]).join(ends, ["org_id", "key"]).join(how, ["org_id", "key"], "left")
    found = named.select("org_id", "surface", F.col("entity").alias("entity_id"), "how", "key_at")
    # The first mention of a key is decided; those after it are exact.
    begins = (F.col("key_at")["stage"] == 2) & (F.col("key_at")["position"] == F.col("position"))
    return mentions.join(found, ["org_id", "surface"]).select(*mentions.columns, "entity_id", F.when(begins, F.col("how")).otherwise("exact").alias("method"))


def near_names(names: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of different keys with a cosine of ``least`` (``LEAST`` at least) or more: a, b (in order) and cosine.

    ``names`` has surface; equal keys are one. The join is exact: only keys that share a list are compared, once.
    """
    if least < LEAST:
        raise ValueError(f"lists hold all pairs from a cosine of {LEAST} on")
    keyed = names.select("surface").distinct().mapInArrow(_keyed, "surface string, key string").select("key").distinct()
    turn = np.random.default_rng(1).permutation(WIDTH)
    body = cut(keyed.mapInArrow(lambda it: _vectors(it, turn), "key string, dims array<int>, values array<double>, sets array<string>, ones array<string>"))
    few = F.size("sets") == 0
    sets = body.select("key", F.explode("sets").alias("list"))
    ones = cut(body.select("key", F.explode("ones").alias("list"), few.alias("few")))
    meet = lambda a, b, test: a.select(F.col("key").alias("a"), "list", *a.columns[2:]).join(b, "list").where(test)
    asked = meet(sets, sets.withColumnRenamed("key", "b"), "a < b").select("a", "b")
    short = meet(ones.where("few").drop("few"), ones.select(F.col("key").alias("b"), "list", F.col("few").alias("both")), "a <> b AND (NOT both OR a < b)")
    asked = asked.unionByName(short.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    side = lambda c: body.select(F.col("key").alias(c), F.col("dims").alias(f"{c}_dims"), F.col("values").alias(f"{c}_values"))
    both = asked.join(side("a"), "a").join(side("b"), "b").select(F.lit(0).alias("org_id"), F.col("b").alias("key"), F.lit(0).alias("at"), F.col("a").alias("center"), F.lit(0).alias("center_at"), "a_dims", "a_values", "b_dims", "b_values")
    found = both.mapInArrow(_cosines, "org_id int, key string, at int, center string, center_at int, cosine double")
    return found.where(F.col("cosine") >= least).select(F.col("center").alias("a"), F.col("key").alias("b"), F.round("cosine", 9).alias("cosine"))


def summary(resolved: DataFrame) -> DataFrame:
    """How many mentions each way of matching resolved."""
    return resolved.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("org_id", "entity_id").alias("entities"))
