"""What the third round's findings asked for: results on larger and odd inputs, each against a plain form of the same."""

import math
import random
import time

import pytest

from claimloom.operators import answers, entities, evals, matching, views
from claimloom.plans import requests

MENTION = "document_id long, sent int, position long, surface string, entity_type string"


def plain_pairs(rows, most):
    spots = {}
    for d, s, p, w, k in rows:
        if k in matching.ARGUMENT_TYPES and p is not None and w is not None:
            spots.setdefault((d, s), []).append((p, w))
    out = []
    for spot, held in spots.items():
        met = sorted((p, q) for p, v in held for q, w in held if p != q and v != w)
        out += [(*spot, p, q, turn + 1) for turn, (p, q) in enumerate(met[:most])]
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3, 24])
def test_bounded_candidate_pairs_equal_all_pairs(spark, most):
    rng, rows = random.Random(most), []
    for sent in range(60):
        places, surfaces = rng.choice([2, 5, 40]), rng.choice([1, 2, 3, 30])
        for _ in range(rng.choice([1, 5, 30, 90])):
            surface = "often" if rng.random() < 0.5 else f"w{rng.randrange(surfaces)}"
            rows.append((1, sent, rng.randrange(places), surface, rng.choice(["ORG", "PERSON", "ACCOUNT"])))
    rows += [(2, 0, k, "often", "ORG") for k in range(200)] + [(2, 0, 300, "other", "ORG"), (2, 0, 0, "other", "ORG"), (2, 0, None, "x", "ORG"), (2, 0, 5, None, "ORG")]
    found = matching.candidate_pairs(spark.createDataFrame(rows, MENTION), most)
    assert sorted(tuple(r) for r in found.select("document_id", "sent", "subject", "object", "turn").collect()) == plain_pairs(rows, most)


def test_a_sentence_with_many_mentions_gives_no_square_of_them(spark):
    mentions = spark.range(60_000).selectExpr("1L AS document_id", "0 AS sent", "id AS position", "concat('w', id % 50) AS surface", "'ORG' AS entity_type")
    begun = time.time()
    found = matching.candidate_pairs(mentions).collect()
    assert [(r.subject, r.object) for r in sorted(found, key=lambda r: r.turn)] == [(0, k) for k in range(1, 25)]
    assert time.time() - begun < 60  # 3.6e9 pairs before


def test_words_that_were_never_learnt_say_nothing_in_any_number(spark):
    model = answers.fitted_intents(spark.createDataFrame([(t, k) for k, texts in requests.UTTERANCES.items() for t in texts], "text string, intent string"))
    heard = spark.createDataFrame([(f"zebra umbrella Entity {k}",) for k in range(2500)], "text string")
    assert [r.intent for r in answers.intents(model, heard, 0.3).select("intent").distinct().collect()] == ["unknown"]


def test_a_page_of_a_sorted_table(spark):
    rows = [(k, None if k % 3 == 0 else k * 7 % 5 / 2) for k in range(200)]
    t = spark.createDataFrame(rows, "id long, v double")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for page in (0, 1, 57, 150, 200, 500):
        assert [tuple(r) for r in views.table_sorted(t, "v", True, "id", page).collect()] == order[:page]
    assert [tuple(r) for r in views.table_sorted(t, "v", True, "id").collect()] == order
    assert views.table_sorted(t.limit(0), "v", True, "id", 5).count() == 0


def test_prefixes_of_names_with_copies(spark, monkeypatch):
    monkeypatch.setattr(entities, "BLOCK", 3)
    names = ["acme", "acme ltd", "acme ltd bonn", "acme  ltd", "acme ", "abc", "abc d", "", None, "other name"]
    rows = [(k, names[k % len(names)]) for k in range(80)]
    split = {k: n.split(" ") for k, n in rows if n is not None}
    plain = sorted((a, b) for a, v in split.items() for b, w in split.items() if len(v[0]) >= 4 and len(v) < len(w) and w[: len(v)] == v)
    df = spark.createDataFrame(rows, "id long, name string")
    assert sorted(tuple(r) for r in entities.prefix_matches(df).collect()) == plain
    more = spark.createDataFrame([(1, "acme"), (2, "acme ltd bonn")], "id long, name string")
    assert sorted(tuple(r) for r in entities.prefix_matches(df, more).collect()) == sorted((a, 2) for a, v in split.items() if v in (["acme"], ["acme", "ltd"]))


def test_prefixes_where_keys_pass_a_million(spark, tmp_path):
    from claimloom.plans import language

    part = spark.createDataFrame([(1_200_000, "small ring", "LARGE"), (7, "Small Ring", "ECONOMY")], "p_partkey long, p_name string, p_type string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(tuple(r) for r in language.prefix_matches(spark, str(tmp_path)).collect()) == [(7, 1_000_007), (7, 2_200_000), (1_200_000, 1_000_007), (1_200_000, 2_200_000)]


def test_tokens_of_a_long_text_leave_in_batches(spark, monkeypatch):
    from claimloom.functions import tokens as K

    texts = ["It isn't so. We don't know! Why? " * 50, None, "", "One. (Two.) three", "Mr. A. went\nOn and\non."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted((k, *row) for k, text in enumerate(texts) for row in K.tokenized(text))
    monkeypatch.setattr(K, "ROWS", 7)
    found = K.tokens(docs)
    assert found.columns == ["doc_id", "sent", "tok_idx", "surface", "char_start", "char_end"]
    assert sorted(tuple(r) for r in found.collect()) == plain
    assert sorted(map(tuple, K.sentences_in(docs).collect())) == sorted(map(tuple, K.sentences(found).collect()))


def test_variants_of_long_texts_leave_in_batches(spark, monkeypatch):
    from claimloom.operators import fuzz

    texts = [f"We ask Acme about deal {k}. The price is big. A quick answer helps." * 20 for k in range(60)]
    df = spark.createDataFrame([(k, t, 0, 20, ["Acme"]) for k, t in enumerate(texts)], "claim_id long, text string, char_start int, char_end int, names array<string>")
    whole = sorted((r.claim_id, r.perturbation, r.text) for r in fuzz.variants(df).collect())
    frames = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: frames.extend(f(iter([self.toPandas()]))))
    monkeypatch.setattr(fuzz, "CHARS", 20_000, raising=False)
    fuzz.variants(df)
    assert sorted((r.claim_id, r.perturbation, r.text) for f in frames for r in f.itertuples()) == whole
    assert max(f.text.str.len().sum() for f in frames) < 40_000


def test_temperature_equals_a_plain_search(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    z, y = rng.normal(size=(400, 6)) * 3, rng.integers(0, 6, 400)
    y[:250] = z[:250].argmax(1)
    df = spark.createDataFrame([(row.tolist(), int(k)) for row, k in zip(z, y, strict=True)] + [([1.0] * 5, 2), (None, 1), ([0.0] * 6, None)], "z array<double>, target int")

    def loss(t):
        s = z / t
        return np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y])

    grid = np.exp(np.linspace(np.log(0.25), np.log(5.0), 20_001))
    best = grid[np.argmin([loss(t) for t in grid])]
    assert evals.fitted_temperature(df, "target") == pytest.approx(best, rel=2e-3)
    assert evals.fitted_temperature(df.limit(0), "target") == 1.0 and evals.fitted_temperature(df.where("target IS NULL"), "target") == 1.0


def test_places_no_phrase_can_begin_with_are_passed_over(spark):
    from claimloom.operators import extraction

    gazetteer = {"the": "WORD", "the end": "END", "New York": "PLACE", "": "NONE"}
    words = [["the", "end", "the,", "New", "York.", "x"], ["Anew", "then", "the"], [], None, ["", "the"], ["New York", "the end;"]]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k long, words array<string>")
    for known in (gazetteer, {k: v for k, v in gazetteer.items() if k}):
        found = {r.k: [(s["start"], s["end"], s["kind"]) for s in r.spans or []] for r in extraction.greedy_spans(df, known).collect()}
        assert found == {0: [(0, 2, "END"), (2, 3, "WORD"), (3, 5, "PLACE")], 1: [(2, 3, "WORD")], 2: [], 3: [], 4: [(1, 2, "WORD")], 5: [(0, 1, "PLACE"), (1, 2, "END")]}


def test_renames_of_a_name_that_stands_very_often_and_texts_of_names_alone():
    from claimloom.operators import extraction, fuzz

    begun, text = time.time(), "Acme Ltd " * 20_000
    edits = fuzz.edits_of("rename", text, 0, 4, ["Acme", "Acme Ltd", "me"], 0, 1, "rename", 0)
    assert [a for a, _, _ in edits] == list(range(0, len(text), 9)) and {text[a:b] for a, b, _ in edits} == {"Acme"}
    assert list(extraction.stated("Aa " * 20_000)) == []
    assert time.time() - begun < 20  # all pairs of their places before


def test_claims_are_found_between_marks_as_in_the_whole_text():
    from claimloom.operators import extraction

    rng, bits = random.Random(2), ["Acme", "A&owns", "owns", "is owned by", "paid", "B Co", "We", "Éa", " ", ". ", "!", "?\n", "\n", "note", "signs for", "wired funds to", "X", "7"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", " "]) for _ in range(rng.randrange(25))) for _ in range(3000)]
    plain = [[(m.start(), m.end()) for m in extraction._STATED.finditer(t)] for t in texts]
    assert [[f[4:] for f in extraction.stated(t)] for t in texts] == plain and sum(map(len, plain)) > 500


def test_offsets_far_into_a_long_text_and_odd_ones(spark):
    from pyspark.sql import functions as F

    from claimloom.operators import spans

    begun = time.time()
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words é of a text "), 60_000).alias("text"))
    assert spans.broken_offsets(spans.words(long), long).count() == 0
    assert time.time() - begun < 60  # each word was looked for from the text's beginning before
    docs = spark.createDataFrame([(1, "abc déf"), (2, None), (3, ""), (1, "abc xyz"), (None, "abc")], "doc_id long, text string")
    rows = [(d, s, e, w) for d in (1, 2, 3, 4, None) for s in (None, -3, -1, 0, 4, 9) for e in (-1, 0, 3, 7, 20) for w in ("abc", "déf", "", None)]
    asked = spark.createDataFrame(rows, "doc_id long, char_start long, char_end long, surface string")
    plain = asked.join(docs, "doc_id").where(F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("surface")).drop("text")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, spans.broken_offsets(asked, docs).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_islands_of_odd_tags(spark):
    from claimloom.operators import spans

    tags = {1: "B-ORG I-ORG O I-ORG I-PERSON I-PERSON B-PERSON", 2: "I- O I- I-", 3: "O O", 4: "B-ORG O I-"}
    rows = [(d, k, t, 0.5) for d, line in tags.items() for k, t in enumerate(line.split(" "))]
    found = spans.islands(spark.createDataFrame(rows, "doc_id long, tok_idx int, tag string, conf double"))
    assert sorted((r.doc_id, r.tok_start, r.tok_end, r.kind) for r in found.collect()) == [
        (1, 0, 2, "ORG"), (1, 3, 4, "ORG"), (1, 4, 6, "PERSON"), (1, 6, 7, "PERSON"), (2, 0, 1, ""), (2, 2, 4, ""), (4, 0, 1, "ORG"), (4, 2, 3, ""),
    ]


def test_peeled_edges_keep_every_cycle(spark):
    from claimloom.operators.strong import peeled, strong_components

    rng = random.Random(8)
    edges = {("a", rng.randrange(300), rng.randrange(300)) for _ in range(260)} | {("b", k, k + 1) for k in range(90)} | {("c", 5, 5), ("c", 5, 6), ("c", 7, 5), ("c", 8, 9), ("c", 9, 8)}
    df = spark.createDataFrame(sorted(edges), "relation string, src long, dst long")
    left = peeled(df, ("relation",))
    kept = {tuple(r) for r in left.collect()}
    part = {(r.relation, r.node): r.component for r in strong_components(df, ("relation",)).collect()}
    own = {(k, a, b) for k, a, b in edges if part[k, a] == part[k, b]}
    assert own <= kept and len(kept) < len(edges) / 2 and {e for e in kept if e[0] == "c"} == {("c", 5, 5), ("c", 8, 9), ("c", 9, 8)}
    assert peeled(df.limit(0), ("relation",)).count() == 0


def test_dissonance_of_arrays_of_any_size(spark):
    from claimloom.functions import trust

    rng = random.Random(4)
    rows = [(k, [rng.random() * 9 for _ in range(k % 7 + 1)]) for k in range(200)] + [(200, None), (201, [0.0] * 6), (202, [1.0, None])]

    def plain(e):
        if e is None or None in e:
            return None
        b = [x / (sum(e) + len(e)) for x in e]
        rest = lambda i: [c for j, c in enumerate(b) if j != i]
        return sum(x * sum(c * (1 - abs(x - c) / (x + c + 1e-10)) for c in rest(i)) / (sum(rest(i)) + 1e-10) for i, x in enumerate(b))

    found = spark.createDataFrame(rows, "k int, e array<double>").select("k", trust.dissonance("e").alias("d")).collect()
    assert {r.k: r.d for r in found} == {k: pytest.approx(plain(e), abs=1e-12) for k, e in rows}


def test_ablations_that_ask_the_same_of_a_sentence_share_their_figures(spark, capsys):
    """many runs of few sentences against a plain reading of each; who asks for no routing does not pay for it."""
    from claimloom.operators import ablation, routing

    rng, relations = random.Random(12), ("NONE", "OWNED_BY", "INVOICED")
    spans = [(1, 0, 50), (1, 60, 90), (2, 0, 50)]
    claims = [(k, *rng.choice(spans), k % 5 + 10, k % 7 + 20, rng.choice(["OWNED_BY", "INVOICED", "SIGNATORY_OF", "SHARES_ADDRESS_WITH"]), 0.5) for k in range(60)]
    places = {(*c[1:4], e): rng.randrange(3) for c in claims for e in c[4:6] if rng.random() < 0.95}
    arcs = [(*s, a, b, rng.choice([None, -1.0, 0.5, 3.0]), [rng.uniform(-4, 4) if rng.random() < 0.95 else None for _ in relations]) for s in spans[:2] for a in range(3) for b in range(3)]
    masks = [["1->0"], ["1->0", "2->0"], ["0->1", "0->1"], ["0->1", "2->1", "1->2"], ["0->2", "1->2"], ["9->0", "1->1"], [], None]
    runs = [(k, rng.randrange(63), rng.choice(["zero", "uniform", "uniform", "zero", "half", None]), rng.choice(masks)) for k in range(400)]
    span = "document_id long, char_start int, char_end int"
    given = spark.createDataFrame(claims, f"claim_id long, {span}, subject_id long, object_id long, relation string, confidence double")
    members = spark.createDataFrame([], "relation string, node long")
    tables = [
        spark.createDataFrame(runs, "run_id long, claim_id long, mode string, masked array<string>"), given, spark.createDataFrame([(*k[:3], n, k[3]) for k, n in places.items()], f"{span}, node int, entity_id long"),
        spark.createDataFrame(arcs, f"{span}, src int, dst int, score double, values array<double>"), relations, members,
    ]
    found = ablation.ablate(*tables)
    added = {r.claim_id: r.added for r in routing.additions(given, given, members).collect()}
    by_id = {c[0]: c for c in claims}

    def read(parties, into, weigh):
        logits = []
        for k in range(len(relations)):
            of = []
            for node in parties:
                w = weigh(into[node])
                whole = sum(x for x in w if x is not None)
                of.append(sum(x * a[6][k] for x, a in zip(w, into[node], strict=True) if x is not None and a[6][k] is not None) / whole if whole else 0.0)
            logits.append(sum(of) / len(of))
        e = [max(z, 0) + math.log1p(math.exp(-abs(z))) for z in logits]
        return relations[logits.index(max(logits))], (max(e) + 1) / (sum(e) + len(e)), len(e) / (sum(e) + len(e))

    rows = {r.run_id: r for r in found.collect()}
    assert len(rows) == len(runs)
    for run, claim, mode, masked in runs:
        r, c = rows[run], by_id.get(claim)
        into = {}
        for a in arcs:
            if c and a[:3] == c[1:4] and a[3] != a[4]:
                into.setdefault(a[4], []).append(a)
        ends = [places.get((*c[1:4], e)) for e in c[4:6]] if c else []
        known = {f"{a[3]}->{a[4]}" for x in into.values() for a in x}
        odd = sorted(set(masked or ()) - known)
        why = (
            "no such claim" if c is None else "no sentence at this span" if not into else "a party is not in the sentence" if None in ends else "unknown mode" if mode not in ("zero", "uniform")
            else "nothing masked" if not masked else "unknown edges: " + ",".join(odd) if odd else None
        )
        assert r.refused == why and r.claim_id == claim
        if why:
            assert r.confidence_before is r.relation_after is r.routing_before is r.verdict is None
            continue

        def shares(node):
            top = max((a[5] for a in node if a[5] is not None), default=None)
            e = [None if a[5] is None else math.exp(a[5] - top) for a in node]
            whole = sum(x for x in e if x is not None)
            return [None if x is None else x / whole for x in e]

        def left(node):
            off = 0.0 if mode == "zero" else 1 / len(node)
            return [off if f"{a[3]}->{a[4]}" in masked else w for w, a in zip(shares(node), node, strict=True)]

        for when, weigh in (("before", shares), ("after", left)):
            relation, confidence, vacuity = read(sorted(set(ends)), into, weigh)
            risk = max(0.0, min(1.0, added[claim] * (0.5 + 0.5 * confidence)))
            assert r[f"relation_{when}"] == relation and r[f"routing_{when}"] == ("escalate" if risk >= 0.8 else "flag" if risk >= 0.6 else "auto_file")
            assert (r[f"confidence_{when}"], r[f"vacuity_{when}"]) == (pytest.approx(confidence, abs=2e-6), pytest.approx(vacuity, abs=2e-6))
    capsys.readouterr()
    found.select("run_id", "refused", "confidence_after").explain()
    assert capsys.readouterr().out.count("Join") == 2  # of what is asked with sentences, of runs with what is found
