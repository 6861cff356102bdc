"""Answers about claims: intents, the claims that answer them, their timing in speech, and sentences for reasons.

Wording is this library's own. Each handler gives one row or none.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import LEGAL_FORMS
from claimloom.operators.graph import severity
from claimloom.sources.durable import cut

#: Least probability of an intent, fallbacks of a transcript's confidence.
LEAST, HEARD, UNHEARD = 0.60, 0.85, 0.0
#: What each reason of routing means.
REASONS = {
    "ownership_cycle": "both parties own each other in a ring",
    "funds_cycle": "money comes back to where it started",
    "shared_address": "both parties have one address",
    "common_signatory": "one person signs for both parties",
    "multi_relation": "the parties are tied in several ways",
}


def reason_sentence(reasons: Column) -> Column:
    """One sentence from comma-joined reasons; unknown ones are left out."""
    words = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    said = F.array_compact(F.transform(F.split(reasons, ","), lambda r: F.try_element_at(words, r)))
    n = F.size(said)
    joined = F.when(n > 1, F.concat(F.array_join(F.slice(said, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(said, -1))).otherwise(F.array_join(said, ""))
    return F.when(n > 0, F.concat(F.lit("Raised because "), joined, F.lit("."))).otherwise("Nothing beyond the ordinary was found.")


def failure_note(note: Column, predicted: Column, truth: Column, degraded: Column, resolved_by: Column) -> Column:
    """A stored note, if any, and what was seen in this run."""
    seen = F.concat(F.lit("Seen: "), predicted, F.lit(" for "), truth)
    how = F.when(degraded, "; no second opinion came").when(resolved_by == "second_opinion", "; after a second opinion").otherwise("")
    return F.concat_ws(" ", note, F.concat(seen, how, F.lit(".")))


def fitted_intents(utterances: DataFrame, features: int = 4096) -> PipelineModel:
    """A classifier of intents from utterances (text, intent): TF-IDF of words and word pairs, then logistic regression without an intercept.

    Words and pairs are looked up in what was learnt, the ``features`` commonest ones, not hashed: one never heard says nothing.
    """
    stages = [
        StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}']+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=40, regParam=0.01, fitIntercept=False, probabilityCol="p"),
    ]
    return Pipeline(stages=stages).fit(utterances)


def intents(model: PipelineModel, heard: DataFrame, least: float = LEAST) -> DataFrame:
    """``heard`` (text) with its likeliest intent, ``unknown`` below the least probability."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = model.transform(heard.withColumn("intent", F.lit(model.stages[0].labels[0])))
    p = F.array_max(vector_to_array("p"))
    return out.select("text", F.when(p >= least, F.get(labels, F.col("prediction").cast("int"))).otherwise("unknown").alias("intent"), F.round(p, 6).alias("probability"))


def most_relevant(claims: DataFrame, entity_id: int | None = None) -> DataFrame:
    """The most severe claim, then the surest, then the newest, of one entity or of all."""
    if entity_id is not None:
        claims = claims.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    rank = F.struct(severity(F.col("routing")), "confidence", "created_at", -F.col("claim_id"))
    return claims.agg(F.max_by(F.struct("claim_id", "relation", "routing", "confidence"), rank).alias("c")).where("c IS NOT NULL").select("c.*")


def first_match(names: DataFrame, weight: str = "weight", key: str = "entity_id") -> DataFrame:
    """The name of greatest weight, the smallest id on a tie."""
    return names.agg(F.max_by(F.struct(*names.columns), F.struct(weight, -F.col(key))).alias("m")).where("m IS NOT NULL").select("m.*")


def answered(intent: str, claims: DataFrame, entity_id: int | None = None) -> DataFrame:
    """One row of ``answer`` for an intent. The seven: explain, worst, count, flagged, entity, escalated, unsure."""
    of = claims if entity_id is None else claims.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    number = lambda test, text: of.agg(F.format_string(text, F.count_if(test)).alias("answer"))
    told = lambda found: found.select(F.format_string("Claim %d, %s, is %s with confidence %.2f.", "claim_id", "relation", "routing", "confidence").alias("answer"))
    handlers = {
        "explain": lambda: told(most_relevant(claims, entity_id)),
        "worst": lambda: told(most_relevant(claims)),
        "count": lambda: number(F.lit(True), "There are %d claims."),
        "flagged": lambda: number(F.col("routing") != "auto_file", "%d claims need a look."),
        "entity": lambda: number(F.lit(True), "It is in %d claims."),
        "escalated": lambda: number(F.col("routing") == "escalate", "%d claims are escalated."),
        "unsure": lambda: number(F.col("vacuity") >= 0.625, "%d claims rest on little evidence."),
    }
    if intent not in handlers:
        return claims.sparkSession.createDataFrame([("Please ask in other words.",)], "answer string")
    return handlers[intent]()


def briefing_scope(claims: DataFrame, scope: str) -> DataFrame:
    """Claims that a briefing is about: escalated, flagged (all but those filed) or all."""
    tests = {"escalated": F.col("routing") == "escalate", "flagged": F.col("routing") != "auto_file", "all": F.lit(True)}
    if scope not in tests:
        raise ValueError(f"scope must be one of {', '.join(tests)}")
    return claims.where(tests[scope])


def heard_confidence(logprobs: Column, text: Column) -> Column:
    """Of a transcript: exp of the mean log-probability within 0 and 1; without any, a fallback by whether there is text."""
    mean = F.try_divide(F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x), F.size(logprobs))
    fallback = F.when(F.length(F.trim(text)) > 0, HEARD).otherwise(UNHEARD)
    return F.coalesce(F.when(F.size(logprobs) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(mean)))), fallback)


def segment_times(full: Column, segment: Column, starts: Column, ends: Column, after: Column) -> Column:
    """When a segment of a text is spoken, in milliseconds, from the seconds of each character; null if it does not occur after ``after``."""
    at = F.locate(segment, full, 1) if isinstance(after, int) and after == 0 else F.instr(F.substring(full, after + 1, F.length(full)), segment) + after
    found = F.instr(F.substring(full, after + 1, F.length(full)), segment) > 0
    start = F.round(F.get(starts, (at - 1).cast("int")) * 1000).cast("long")
    end = F.round(F.get(ends, (at + F.length(segment) - 2).cast("int")) * 1000).cast("long")
    return F.when(found, F.struct(start.alias("start_ms"), end.alias("end_ms")))


#: A word in more names than this is common: names are then grouped by the common words that they have.
COMMON = 1000
_WORDS = r"[a-z0-9]+"


def spoken_of(questions: DataFrame, names: DataFrame, common: int = COMMON) -> DataFrame:
    """question_id and entity_id: for each question (question_id, text) the entity whose name shares most letters with it.

    ``names`` (entity_id, name) has every name and alias. Whole words count, by their length and as often as the name has them,
    those of legal forms do not; the smallest entity_id wins a tie, and a question without a shared word has no row. Names are looked up by
    their rarer words; names that share only common words with a question are alike if they have the same ones, and one of them stands for all.
    """
    said = questions.select("question_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORDS})"))).alias("heard"))
    forms = F.array(*[F.lit(w) for w in LEGAL_FORMS])
    words = F.filter(F.regexp_extract_all(F.lower("name"), F.lit(f"({_WORDS})")), lambda w: ~F.array_contains(forms, w))
    known = cut(names.select("entity_id", words.alias("words")).where(F.size("words") > 0).distinct())
    each = known.select("entity_id", "words", F.explode(F.array_distinct("words")).alias("word"))
    often = cut(each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > common).select("word"))
    asked = said.select("question_id", "heard", F.explode("heard").alias("word"))
    score = lambda held: F.aggregate(F.filter(held, lambda w: F.array_contains("heard", w)), F.lit(0), lambda a, w: a + F.length(w))
    rare = asked.join(each.join(often, "word", "left_anti"), "word").select("question_id", "entity_id", score(F.col("words")).alias("score"))
    held = each.join(often, "word").withColumn("times", F.size(F.filter("words", lambda w: w == F.col("word"))))
    alike = held.groupBy("entity_id", "words").agg(F.array_sort(F.collect_list(F.struct("word", "times"))).alias("shared"))  # of one name
    stands = cut(alike.groupBy("shared").agg(F.min("entity_id").alias("entity_id")))
    usual = asked.join(stands.select("entity_id", "shared", F.explode("shared.word").alias("word")), "word")
    weight = F.aggregate(F.filter("shared", lambda s: F.array_contains("heard", s["word"])), F.lit(0).cast("int"), lambda a, s: a + F.length(s["word"]) * s["times"])
    found = rare.unionByName(usual.select("question_id", "entity_id", weight.alias("score")))
    return found.groupBy("question_id").agg(F.max_by("entity_id", F.struct("score", -F.col("entity_id"))).alias("entity_id"))


def _facts(claims: DataFrame, *keys: str) -> DataFrame:
    rank = F.struct(severity(F.col("routing")), "confidence", "created_at", -F.col("claim_id"))
    counts = {"n": F.lit(True), "n_flagged": F.col("routing") != "auto_file", "n_escalated": F.col("routing") == "escalate", "n_unsure": F.col("vacuity") >= 0.625}
    return claims.groupBy(*keys).agg(*[F.count_if(t).alias(k) for k, t in counts.items()], F.max_by(F.struct("claim_id", "relation", "routing", "confidence"), rank).alias("top"))


def answer_all(questions: DataFrame, model: PipelineModel, names: DataFrame, claims: DataFrame, least: float = LEAST) -> DataFrame:
    """question_id, intent, entity_id and answer of every question (question_id, text), all in one plan.

    Each is classified (``unknown`` below ``least``), matched with an entity, and handed to its intent's handler by joins with
    the facts of all claims and of the entities that are asked for. ``entity`` and ``explain`` are about the entity; the others are too, if
    one is named, but for ``worst``. A question about an entity that is not named, or that no claim has, gets an answer that says so.
    """
    heard = cut(questions.join(intents(model, questions.select("text").distinct(), least).select("text", "intent"), "text").join(spoken_of(questions, names), "question_id", "left").select("question_id", "intent", "entity_id"))
    about = heard.select("entity_id").where("entity_id IS NOT NULL").distinct()
    ends = claims.withColumn("entity_id", F.explode(F.array_distinct(F.array("subject_id", "object_id")))).join(about, "entity_id", "left_semi")
    whole = _facts(claims).withColumnsRenamed({c: f"all_{c}" for c in ("n", "n_flagged", "n_escalated", "n_unsure", "top")})
    rows = heard.join(_facts(ends, "entity_id"), "entity_id", "left").join(F.broadcast(whole))  # one row
    named, known = F.col("entity_id").isNotNull(), F.col("n").isNotNull()
    number = lambda c, text: F.format_string(text, F.when(named, F.coalesce(c, F.lit(0))).otherwise(F.col(f"all_{c}")))
    told = lambda top: F.format_string("Claim %d, %s, is %s with confidence %.2f.", top["claim_id"], top["relation"], top["routing"], top["confidence"])
    none, whom = F.lit("No claim is about that."), F.lit("I did not catch whom you mean.")
    handlers = {
        "explain": F.when(~named, whom).when(~known, none).otherwise(told(F.col("top"))),
        "worst": F.when(F.col("all_top").isNull(), none).otherwise(told(F.col("all_top"))),
        "count": number("n", "There are %d claims."),
        "flagged": number("n_flagged", "%d claims need a look."),
        "entity": F.when(~named, whom).otherwise(F.format_string("It is in %d claims.", F.coalesce("n", F.lit(0)))),
        "escalated": number("n_escalated", "%d claims are escalated."),
        "unsure": number("n_unsure", "%d claims rest on little evidence."),
    }
    answer = F.lit("Please ask in other words.")
    for intent, said in handlers.items():
        answer = F.when(F.col("intent") == intent, said).otherwise(answer)
    return rows.select("question_id", "intent", "entity_id", answer.alias("answer"))
