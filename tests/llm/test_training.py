"""The training-data operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, hamming_search, html_extract, language_id, license_scan, mixing, quality, setjoin, substring_dedup, wavelet

SPACE = "[^\x20\x09-\x0d]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n int, token string, gram string, size string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, null, empty and long texts, ties, and columns whose names clash."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "É", "ß", "The"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    out = [None, "", " \n\t ", "one", "one two", "One Two", "one two three", "Was " * 90, "mit license", "MIT  License, x. Apache-License and the GNU general public license mit license"]
    base = text(200)
    for _ in range(6):
        words = base.split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = "edit"
        out.append(" ".join(words))
    out += [base, base, text(30) + "\n" + passage + "\n" + text(30), passage, text(19), text(20), text(21), text(5000), base.upper(), "a" * 20000]
    out += [text(rng.randrange(1, 60)) + " " + passage for _ in range(12)]
    return [(i, t, "en" if i % 3 else None, ["b", "a", None, "hot", "hot"][i % 5], 0, "x", 1, "t", "g", "s") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    found = {r.doc_id: r for r in df.collect()}
    return found


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, rows, batches):
    found = by_id(substring_dedup.dedup(docs, batches))
    seen = set()
    for i, t, *_ in rows:
        w = re.findall(SPACE, t or "")
        out = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                out[s : s + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, gone in zip(w, out, strict=True) if not gone)
        assert tuple(found[i]) == (i, len(w), sum(out), hashlib.sha256(kept.encode()).hexdigest())


def test_substring_index_compacts_and_takes_repeated_rows(spark, docs, none, rows):
    index = substring_dedup.Index(spark, fan_in=2)
    parts = [docs.where(F.col("doc_id") % 4 == 0).withColumn("doc_id", F.col("doc_id") + k * 1000) for k in range(4)]
    results = []
    for k, part in enumerate(parts):
        history = none if not k else parts[0] if k == 1 else parts[0].union(parts[1]) if k == 2 else parts[0].union(parts[1]).union(parts[2])
        results.append({r.doc_id % 1000: r for r in index.add(part, history).collect()})
    assert len(index.runs) <= 2
    for i, r in results[3].items():  # all windows came before
        assert r.n_removed == (r.n_words if r.n_words >= 20 else 0)
        assert results[0][i].n_words == r.n_words
    twice = substring_dedup.dedup(docs.where("doc_id = 10").union(docs.where("doc_id = 10")), 1).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_removed == 0


def test_substring_dedup_takes_rows_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (None, None), (1, text), (2, text)]
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()))
    assert found == [(False, 1, 30, 0), (False, 2, 30, 30), (True, 0, 0, 0), (True, 0, 30, 0)]
    assert substring_dedup.dedup(spark.createDataFrame(rows[:2], "doc_id long, text string")).count() == 2


def test_held_out_languages_and_quality(spark):
    """What the registered queries predict for the rows that they did not learn from."""
    from claimloom.llm import queries

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.op2_language_id(spark, folder).where("held_out").join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    assert len(found) > 100 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    found = queries.op6_quality(spark, folder).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.predicted for r in found if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def brute_components(rows, width=3, percent=90):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(SPACE, lower(t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    return {i: (len(sets[i]), top[i]) for i in sets}


def test_jaccard_join(docs, rows):
    found = {i: (r.n_shingles, r.component_id) for i, r in by_id(setjoin.join(docs)).items()}
    want = brute_components(rows)
    assert found == want
    assert max(collections.Counter(c for _, c in want.values()).values()) > 3


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_blocks_lose_no_link(spark, docs, rows, monkeypatch, width, percent):
    """Lists of many blocks, more leaders than are asked, a hot shingle, and a star whose arms link with its centre alone."""
    for name, value in {"BLOCK": 4, "FIRST_LISTS": 1, "LEADERS": 2, "HOT": 8, "TOGETHER": 3, "DECODED": 100}.items():
        monkeypatch.setattr(setjoin, name, value)
    rng = random.Random(6)
    centre = [f"c{k}" for k in range(120)]
    star = [" ".join(centre)]
    for _ in range(40):
        w = list(centre)
        for k in rng.sample(range(120), rng.randrange(1, 6)):
            w[k] = f"x{rng.randrange(10**6)}"
        star.append(" ".join(w))
    shared = [" ".join(["very common words of all"] * 3 + [f"own{rng.randrange(9)}" for _ in range(rng.randrange(1, 4))]) for _ in range(30)]
    more = [(100 + k, t) for k, t in enumerate(star + shared)] + [(r[0], r[1]) for r in rows]
    found = {i: (r.n_shingles, r.component_id) for i, r in by_id(setjoin.join(spark.createDataFrame(more, "doc_id long, text string"), width, percent)).items()}
    assert found == brute_components(more, width, percent)


def test_jaccard_takes_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (None, None), (7, text), (7, text), (9, text + " w1 w2"), (9, "another text of its own"), (11, "another text of its own")]
    found = collections.Counter(tuple(r) for r in setjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == {(None, 38, None): 1, (None, 0, None): 1, (7, 38, 7): 2, (9, 40, 7): 1, (9, 3, 7): 1, (11, 3, 7): 1}


def test_mixing(docs, rows):
    found = by_id(mixing.mix(docs, block=7))
    size = {i: len(re.findall(SPACE, t or "")) for i, t, *_ in rows}
    of = {r[0]: r[3] for r in rows}
    names = sorted({s for s in of.values() if s is not None}) + [None]
    total = {s: sum(n for i, n in size.items() if of[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, still = {}, float(sum(total.values())), set(names)
    while still:
        share = {s: left * weight[s] / sum(weight[x] for x in still) for s in still}
        over = {s for s in still if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
        left -= sum(target[s] for s in over)
        still -= over
    for s in names:
        assert sum(r.taken for i, r in found.items() if of[i] == s) == pytest.approx(target[s], abs=1)
    for i, r in found.items():
        assert (r.size, r.source_size) == (size[i], total[of[i]]) and r.target == pytest.approx(target[of[i]]) and r.taken <= 3 * r.size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_equals_its_sql(spark, sf):
    """The SQL draws the same points, so the slots of every document are the method's."""
    import duckdb

    from claimloom.llm import queries

    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    columns = ["doc_id", "size", "source_size", "taken", "first_slot", "last_slot"]
    want = sorted(duck.sql(f"select {', '.join(columns)} from ({queries.OP3_SQL})").fetchall())
    assert sorted(tuple(r) for r in queries.op3_mix_sources(spark, f"/root/testdata/{sf}").select(*columns).collect()) == want
    assert sum(r[4] is not None for r in want) > 0.5 * len(want)


def test_the_first_slots_hold_the_sources_in_their_shares(spark):
    plan = spark.createDataFrame([("a", 0, 100_000, 50_000.0, 50_000), ("b", 1, 100_000, 30_000.0, 30_000), (None, 2, 7_000, 20_000.0, 20_000)], "source string, place int, source_size long, target double, words long")
    slots = mixing.schedule(plan, block=100).collect()
    for upto in (50, 200, 900):
        n = collections.Counter(r.place for r in slots if r.slot < upto)
        assert [abs(n[k] - upto * share) <= 3 for k, share in enumerate((0.5, 0.3, 0.2))] == [True] * 3


def test_license_scan(docs, rows):
    found = by_id(license_scan.scan(docs))
    for i, t, *_ in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_scan_finds_all_notices_and_a_hot_one(spark):
    notice = {label: [words for other, words, _ in license_scan.TEMPLATES if other == label] for label, _, _ in license_scan.TEMPLATES}
    mit, bsd, apache = notice["mit"][1], notice["bsd"][0], notice["apache"][1]
    rest = " ".join(w for _, words, _ in license_scan.TEMPLATES for w in sorted(words.split()))
    texts = {1: f"{mit} x {bsd}", 2: f"{mit}. {bsd}. {apache}", 3: f"{rest} filler {mit}", 4: "no notice", 5: None, 6: mit.replace("granted free of charge", "granted at some price")}
    rows = [*texts.items(), *[(k, f"a text {notice['cc-by'][0]} of its own {k}") for k in range(100, 150)], *[(k, f"the {k}") for k in range(200, 300)]]
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    assert [found[k][0] for k in (1, 2, 4, 5)] == ["bsd,mit", "apache,bsd,mit", "", ""]
    assert "mit" in found[3][0].split(",") and found[2][1] == pytest.approx(1) and found[6][0] == "mit" and 0.6 < found[6][1] < 1
    assert all(found[k] == ("cc-by", pytest.approx(1)) for k in range(100, 150))


def test_license_labels_equal_brute_force(spark):
    """Every template whole, cut in half, with words between, and several in one file."""
    rng = random.Random(12)
    texts = [words for _, words, _ in license_scan.TEMPLATES]
    texts += [" ".join(w.split()[: len(w.split()) // 2]) for w in texts[:]] + [w.replace(" the ", " the very ") for w in texts[:]]
    texts += ["; ".join(rng.sample(texts[: len(license_scan.TEMPLATES)], rng.randrange(2, 7))) for _ in range(20)] + ["none at all", "the software"]
    rows = list(enumerate(texts))
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    idf = license_scan.weights(spark.createDataFrame(rows, "doc_id long, text string"))
    for i, text in rows:
        w = re.findall("[a-z0-9]+", text)
        line, labels, best = f" {' '.join(w)} ", set(), 0.0
        for label, words, keys in license_scan.TEMPLATES:
            own = words.split()
            total = sum(idf[x] for x in own)
            got = max(sum(idf[x] for k, x in enumerate(own) if 0 <= s + k < len(w) and w[s + k] == x) for s in range(-len(own), len(w)))
            if all(f" {k} " in line for k in keys) and got >= license_scan.COVERAGE * total:
                labels.add(label)
                best = max(best, got / total)
        labels |= {label for p, label in license_scan.BASE.items() if f" {p} " in line}
        base = license_scan.BASE_SCORE if any(f" {p} " in line for p in license_scan.BASE) else 0.0
        assert found[i] == (",".join(sorted(labels)), pytest.approx(max(best, base))), text


def test_wavelet_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(wavelet.tokenizer_path()), 0
    found = by_id(wavelet.encode_and_read(docs, limit=500))
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_equals_tokenizer_on_odd_white_space():
    from tokenizers import Tokenizer

    rng, plain, mine = random.Random(1), Tokenizer.from_file(wavelet.tokenizer_path()), wavelet.Encoder(wavelet.tokenizer_path())
    parts = ["a", "b ", "  ", "\n", "\n ", "\t", "é", "'s", "1", "!", " ", "word", "<|endoftext|>", "\xa0", "\r\n", "ß.", "日本", "x\ny"]
    more = parts + ["'", "don't.", "...", "W.\nX", "***", "\x1e", "\x85", "\xad", "\u2028", "ʰ,", "Ω.", "٣.", "\u00b2;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["".join(rng.choice(more) for _ in range(rng.randrange(14))) for _ in range(6000)] + [None]
    ids, sizes = mine(pa.array(texts, pa.string()))
    for text, found in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert [*plain.encode(text or "", add_special_tokens=False).ids, 0] == found.tolist()


def test_encoder_forgets_and_keeps_pieces(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE", 60)
    rng, mine, fresh = random.Random(2), wavelet.Encoder(wavelet.tokenizer_path()), wavelet.Encoder(wavelet.tokenizer_path())
    for _ in range(30):
        texts = pa.array([" ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(9)) for _ in range(5)])
        fresh._clear()
        assert [x.tolist() for x in mine(texts)] == [x.tolist() for x in fresh(texts)]


def test_encoder_asks_the_library_for_new_pieces_only(monkeypatch):
    """Words that are known do not count as new ones, so a slice full of them makes the encoder forget nothing."""
    monkeypatch.setattr(wavelet, "CACHE", 100)
    mine = wavelet.Encoder(wavelet.tokenizer_path())
    learnt, learn = [], mine._learn
    monkeypatch.setattr(mine, "_learn", lambda pieces: (learnt.extend(map(str, pieces)), learn(pieces))[1])
    texts = pa.array([" ".join(f"w{k}" for k in range(60)), None, "", "w3 w4"])
    once = mine(texts)
    n = len(learnt)
    assert n and [x.tolist() for x in mine(texts)] == [x.tolist() for x in once] and len(learnt) == n


def test_encoder_equals_tokenizer_on_words_of_letters():
    from tokenizers import Tokenizer

    rng, plain, mine = random.Random(4), Tokenizer.from_file(wavelet.tokenizer_path()), wavelet.Encoder(wavelet.tokenizer_path())
    assert mine.merger is not None
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ\xc0\xd6\xd8\xf6\xf8\xff\u0100\u01bb\u01c5\u024f"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    ids, sizes = mine(pa.array(texts))
    for text, found in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert [*plain.encode(text, add_special_tokens=False).ids, 0] == found.tolist()


def test_shards_hold_vocabularies_over_16_bits():
    ids = np.random.default_rng(1).integers(0, 200_000, 300_000).astype(np.uint32)
    shard = wavelet.Shard(wavelet.build(ids, np.array([5, 6]), np.array([7, 300_000])))
    assert shard.ids().tolist() == ids.tolist() and shard.ends.tolist() == [7, 300_000] and shard.doc_ids.tolist() == [5, 6]
    shard = wavelet.Shard(shard.file)
    assert shard.access(250_000) == ids[250_000] and len(shard.inflated) <= 2 * shard.levels
    assert shard.count(int(ids[9])) == (ids == ids[9]).sum()


@pytest.mark.parametrize("n", [0, 1, 64, 511, 513, 3000])
def test_shards_answer_from_their_planes(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    shard = wavelet.Shard(wavelet.build(ids, np.array([5]), np.array([n])))
    assert shard.ids().tolist() == ids.tolist() and shard.count(1 << 20) == 0
    for at in range(0, n, 61):
        token = int(ids[at])
        assert shard.access(at) == token and shard.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_decontamination(spark, docs, none):
    item = " ".join(f"item{k}" for k in range(30))
    edited = item.split()
    edited[4], edited[25] = "x", "y"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short item"), (5, item)], "item_id long, text string")
    extra = [(500, "pre " * 9 + item.upper() + " post"), (501, " ".join(edited[:15] + ["new"] + edited[15:])), (502, "a short, item."), (503, " ".join(item.split()[:18])), (504, None)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id): (r.first_word, r.n_edits) for r in decontaminate.find(more, bench).collect()}
    assert found == {(500, 1): (9, 0), (500, 5): (9, 0), (501, 1): (0, 3), (501, 5): (0, 3), (502, 4): (1, 0)}
    assert decontaminate.find(more, bench.limit(0)).count() == 0


def test_decontamination_recall_on_edited_items():
    rng = np.random.default_rng(0)
    vocabulary = [f"v{k}" for k in range(5000)]
    items = [" ".join(rng.choice(vocabulary, 30)) for _ in range(200)]
    index, texts = decontaminate.Items(list(range(200)), items), []
    for item in items:
        w = item.split()
        for _ in range(3):
            w[rng.integers(len(w))] = "edit"
        texts.append(" ".join(rng.choice(vocabulary, 40)) + " " + " ".join(w))
    assert len({(r, k) for r, k, _, _ in index.leaks(pa.array(texts)) if r == k}) >= 190


def test_decontamination_misses_nothing_at_any_length():
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(n) for n in range(1, 41) for _ in range(3)] + [["a", "b"] * 6, ["x"] * 10, ["c"] * 9 + ["d"]]
    texts = []
    for item in items:
        for share in (0, 0.1, 0.2):
            w = list(item)
            for _ in range(int(share * len(item))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["edit"], [w[k], "edit"]])
            texts.append(some(rng.randrange(0, 30)) + w + some(rng.randrange(0, 30)))

    def brute(item, text):
        """Least (edits, first word) of all runs of ``text``, by the plain table of edit distances."""
        cost = [(0, j) for j in range(len(text) + 1)]
        for i, word in enumerate(item):
            new = [(i + 1, 0)]
            for j, other in enumerate(text):
                new.append(min((cost[j][0] + (word != other), cost[j][1]), (cost[j + 1][0] + 1, cost[j + 1][1]), (new[j][0] + 1, new[j][1])))
            cost = new
        return min(cost)

    want = set()
    for r, text in enumerate(texts):
        for k, item in enumerate(items):
            if len(set(item) & set(text)) >= 0.5 * len(set(item)):
                edits, where = brute(item, text)
                if edits <= len(item) // 5:
                    want.add((r, k, where, edits))
    assert all((3 * k + j, k) in {(r, i) for r, i, _, _ in want} for k in range(len(items)) for j in range(3))
    assert set(decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items]).leaks(pa.array([" ".join(x) for x in texts]))) == want


def test_hamming_search_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:180] = x[7]
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [1.0]), (902, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    code = {r.vec_id: np.int64(r.code).view(np.uint64) for r in hamming_search.codes(df).collect()}
    assert set(code) == set(range(300))
    asked = hamming_search.codes(df).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = collections.defaultdict(list)
    for r in hamming_search.search(df, asked, k=5).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.distance, r.vec_id))
    for q in range(0, 300, 20):
        assert found[q] == sorted((int(np.bitwise_count(code[q] ^ c)), i) for i, c in code.items())[:5]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p><b>First  long
paragraph of the text that goes on for a while.<br><p>No.</p><p>Another paragraph, with <i>mark</i>up and&nbsp;more words in it.</p><div class="comments"><p>I agree with all of this, and at some length too.</p></div></article>
<form><p>Name</p></form><aside class=sidebar>More</aside><footer>&copy; x</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (5, "u", "plain text only"), (6, "u", "<p>cut off in the mid"), (1, "u", PAGE)]
    found = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    text = "Head & tail First long paragraph of the text that goes on for a while. No. Another paragraph, with markup and more words in it."
    assert found[0] == found[1] == (1, text, len(text))
    assert [t for _, t, _ in found[2:]] == ["", "", "", "plain text only", "cut off in the mid"]


def test_main_text_keeps_the_whole_article():
    long = "A sentence of some length that a reader would miss. "
    body, end = (long * 40).strip(), "The end."
    # Headline, intro and ending around a long division; a section of 8 %; the other dense part of a page without an article.
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>Intro.</p><div><p>{body}</p><p>{body}</p></div><p>{end}</p></article></body>"
    assert html_extract.main_text(page) == f"Head Intro. {body} {body} {end}"
    small = (long * 3).strip()
    assert html_extract.main_text(f"<main><section><p>{body}</p></section><section><p>{small}</p></section></main>") == f"{body} {small}"
    menu = "<ul>" + "<li><a href=/>Home</a>" * 9 + "</ul>"
    less = (long * 25).strip()
    assert html_extract.main_text(f"<body><div>{menu}</div><section><div>{f'<p>{body}</p>' * 8}</div><div><p>{less}</p></div></section></body>") == " ".join([body] * 8 + [less])
    # Elements that close without an end tag.
    assert html_extract.main_text(f"<head><title>T</title><meta charset=utf-8><body><p>{body}") == body
    assert html_extract.main_text(f"<head><title>T</title>{body}") == body
    assert html_extract.main_text(f"<body><div><p class=ad>Buy<p>{body}<p>{end}</div>") == f"{body} {end}"
    assert html_extract.main_text(f"<body><ul><li class=share>Post it<li>{body}<ul><li class=ad>Buy</ul><li>{end}</ul>") == f"{body} {end}"
    assert html_extract.main_text(f"<body><dl><dt class=promo>Buy<dd>{body}</dl><table><tr><td class=ad>Buy<td>{body}<tr class=nav><td>x<tr><td>{end}</table>") == f"{body} {body} {end}"
    # A furniture word within a longer name.
    assert html_extract.main_text(f"<body class=comment-open><div class='has-sidebar'><p>{body}</p></div><div class=sidebar><p>{body}</p></div></body>") == body
    links = "<a href=/a>One</a> <a href=/b>Two</a>"
    assert html_extract.main_text(f"<body><article><div class=top-nav><p>{links}</div><p>{body}</p><p>{body}</p><ul id=share-story><li>{links}</ul></article>") == f"{body} {body}"


def test_main_text_takes_time_in_proportion_and_empty_tables(spark):
    import time

    n, began = 50_000, time.process_time()
    assert html_extract.main_text("<div>text here" * n) == " ".join(["text here"] * n)
    assert html_extract.main_text("<div class=post-ad>some text here" * n) == " ".join(["some text here"] * n)
    assert html_extract.main_text("<p>x</b></i>" * n) == " ".join("x" * n)
    assert html_extract.main_text("<p>" * n + "</b>" * n) == ""
    assert time.process_time() - began < 60
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_quality_separates_junk_and_scores_every_row(spark, docs):
    rng = random.Random(8)
    good = lambda: ". ".join(" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(9)).capitalize() for _ in range(6)) + "."
    junk = lambda: " ".join("BUY!!" for _ in range(60))
    rows = [(i, good() if i % 4 else junk(), int(i % 4 > 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(table.select("doc_id", "text"), table.select("doc_id", "quality"), quality.fold(F.col("doc_id"), 5) != 0)
    scored = quality.score(table, model).collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == bool(r.quality) for r in scored]) > 0.97
    assert all(0 <= r.score <= 1 for r in quality.score(docs.select("doc_id", "text"), model).collect())
    assert quality.train(table.select("doc_id", "text"), table.select("doc_id", "quality").limit(0), F.lit(True)) is None


def test_language_id_learns_and_leaves_letterless_texts_open(spark, docs):
    rng = random.Random(3)
    words = {"en": "the and with that from have this which".split(), "de": "der und mit dass von haben dieser welche".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(5, 80))), k) for i, k in enumerate(["en", "de"] * 150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.train(table, quality.fold(F.col("doc_id"), 4) != 2)
    held = language_id.identify(table, network).join(table.select("doc_id", "lang"), "doc_id").where(quality.fold(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "É")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.identify(odd, network).orderBy("doc_id").collect()] == [True, True, True, False]
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_empty_tables(spark, none):
    for out in (substring_dedup.dedup(none), setjoin.join(none), mixing.mix(none), license_scan.scan(none), wavelet.encode_and_read(none), language_id.identify(none, None), quality.score(none.select("doc_id", "text"), None)):
        assert out.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert hamming_search.search(vectors, hamming_search.codes(vectors).withColumnRenamed("vec_id", "query_id")).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    leak = spark.createDataFrame([(700, "x " + " ".join(f"item{k}" for k in range(30)), "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    now = docs.select("doc_id", "text", "lang", "source", "n_chars").union(leak)
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, folder)
        now.write.parquet(f"{folder}/s{k}")
        now = spark.read.parquet(f"{folder}/s{k}")
        if k < 4:
            assert now.columns == columns
        if k == 1:
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in now.collect()} == {c for _, c in brute_components(rows, corpus_pipeline.WIDTH, corpus_pipeline.PERCENT).values()}
        if k == 2:
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()} == {700}
        if k == 3:
            mixed = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(before).collect() if r.size}
            assert collections.Counter(r.doc_id for r in now.collect()) == collections.Counter({i: n for i, n in mixed.items() if n})
    assert now.count() == spark.read.parquet(f"{folder}/s3").count()


def test_pipeline_stages_take_awkward_rows(spark, tmp_path):
    """Null ids, repeated rows, columns that are named as the stages' own, and empty tables."""
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    text = " ".join(f"w{k}" for k in range(50))
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, times int, time int, turn int, mixed_id int"
    own = ("en", "a", 1, 0.5, 7, 8, 9, 10)
    rows = [(None, text, *own), (None, "x " + item, *own), (1, text, *own), (1, text, *own), (2, text + " more", *own), (3, "own words here", *own), (4, None, *own), (5, "", *own), (6, item, *own)]
    docs = spark.createDataFrame(rows, kinds)
    ids = lambda df: collections.Counter(r.doc_id for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns and collections.Counter(map(tuple, good.collect())) == collections.Counter(map(tuple, docs.collect()))
    kept = stages["n-gram Jaccard join"](spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == {None: 2, 1: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    clean = stages["benchmark decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and ids(clean) == {None: 1, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    mixed = stages["mixing sources to target weights"](spark, docs, folder)
    assert mixed.columns == docs.columns and ids(mixed) == {None: 2, 1: 2, 2: 1, 3: 1, 6: 1} and {tuple(r)[2:] for r in mixed.collect()} == {own}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


@pytest.mark.parametrize("n", [5, 10, 15, 20, 40, 60])
def test_walks_reach_their_recall(n):
    """With a fifth of the words edited, one repetition or more proposes the item; a repetitive item too."""
    rng = random.Random(n)
    items, windows = [], []
    for k in range(120):
        w = [rng.choice("abc" if k % 4 == 0 else [f"v{j}" for j in range(3000)]) for _ in range(n)]
        edited = list(w)
        for _ in range(int(decontaminate.MOST_EDITS * n)):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], ["edit"], [edited[at], "edit"]])
        items.append(" ".join(w))
        windows.append(" ".join((edited + [f"o{j}" for j in range(n)])[:n]))
    own, other = (decontaminate.words_of(pa.array(x)) for x in (items, windows))
    cut = lambda x: decontaminate.Items._windows(x[0], x[1][:-1], x[1][1:], n)
    met = np.zeros(len(items), bool)
    for repeat in range(decontaminate.REPEATS):
        met |= decontaminate.signatures(cut(own), repeat) == decontaminate.signatures(cut(other), repeat)
    assert met.mean() >= decontaminate.RECALL
    assert (decontaminate.signatures(cut(own), 0) == decontaminate.signatures(cut(own), 0)).all()


def test_class_prior_comes_from_unlabelled_scores():
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.8):
        good, bad = (lambda n: rng.normal(1, 1, n)), (lambda n: rng.normal(-1.5, 1, n))
        mixed_scores = np.concatenate([good(int(8000 * prior)), bad(int(8000 * (1 - prior)))])
        assert abs(quality.estimated_prior(good(4000), mixed_scores) - prior) < 0.08
