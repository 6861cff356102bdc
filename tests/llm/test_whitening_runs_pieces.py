"""Whitening, periodic runs and sentence pieces against brute force, awkward rows included."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import piece_bpe, queries, runs, whitening

WORD = "[^\x20\x09-\x0d]+"
EXTRA = ", h long, ids string, runs string, width int, score string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, s + size - p)) for p in range(1, q)):
                out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    w = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def texts():
    r = random.Random(5)
    out = [None, "", " \n\t", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "x " * 400, "é  ß é\x1cq " * 9, "a" * 60_000, "one\ntwo\x0bthree"]
    for _ in range(260):
        unit = [r.choice("abcd") for _ in range(r.randrange(1, 9))]
        w = [r.choice("abcdefgh") for _ in range(r.randrange(0, 40))] + unit * r.randrange(1, 9) + [r.choice("ab") for _ in range(r.randrange(0, 40))]
        out.append(" ".join(w))
    out += [out[7], " ".join(f"w{r.randrange(5000)}" for _ in range(6000))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "i", "r", 2, "s") for i, t in enumerate(texts())]
    rows += [(3, "b b b b b b b", 1, "i", "r", 2, "s")] * 2 + [(None, "c d c d c d c d c", 1, "i", "r", 2, "s"), (-7, "y " * 50, 1, "i", "r", 2, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)


@pytest.fixture
def folder(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_runs_of_words_equal_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        w = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(0, 60))]
        if w and r.random() < 0.6:
            w = w[: r.randrange(len(w))] + [r.randrange(4) for _ in range(r.randrange(1, 8))] * r.randrange(1, 8) + w
        assert runs.runs_of_stretch(w) == brute_runs(w)


def test_ordered_sets_keep_their_order_over_many_lists():
    r = random.Random(1)
    order = list(range(5000))
    r.shuffle(order)
    ends, seen = runs.Ends(), set()
    for x in order:
        before, after = ends.add(x)
        assert before == max((y for y in seen if y < x), default=-1) if len(seen) % 97 == 0 else True
        assert after == min((y for y in seen if y > x), default=-1) if len(seen) % 97 == 0 else True
        seen.add(x)
    assert list(ends) == sorted(order) and ends.size == 5000 and len(ends.lists) > 3


def test_periodic_runs(spark, docs, folder):
    found = [tuple("" if x is None else x for x in r) for r in queries.op12_periodic_runs(spark, folder).fillna({"doc_id": -(2**60)}).collect()]
    expected = []
    for row in docs.collect():
        w = planted_words(row.doc_id, row.text)
        rs = brute_runs(w)
        gone = {i for s, size, q in rs for i in range(s + q, s + size)}
        best = min(rs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if rs else ("", "", "")
        milli = 1000 * best[1] // best[2] if rs else ""
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in rs)
        expected.append((row.doc_id if row.doc_id is not None else -(2**60), len(rs), *best, milli, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_runs_of_an_empty_table(docs):
    assert runs.find(docs.where("false")).collect() == []


def reference_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())


def test_pieces_equal_the_library(spark, docs, folder):
    library = reference_library()
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_piece_bpe(spark, folder).collect())
    expected = []
    for row in docs.collect():
        ids = library.encode(row.text or "", add_eos=True)
        expected.append((str(row.doc_id), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert found == sorted(expected)
    assert piece_bpe.decode(piece_bpe.encode(docs.where("false"))).collect() == []


def test_any_text_and_any_ids_as_the_library_has_them():
    library, model, r = reference_library(), piece_bpe.model_of(piece_bpe.model_path()), random.Random(2)
    odd = ["", "a", " a", "  a b  ", "\n\t x\0y", "▁x", "▁▁ q", "日本語のテキスト", "🙂🙃é", "é", "<s></s><unk><0x0A>", "a" * 3000, " " * 333, "ab" * 500, "�", " ⁇ ", "ACGT" * 2000]
    odd += ["".join(r.choice("abcdeé \n▁日ſ🙂.,'\"0129AZ\x00\x7f") for _ in range(r.randrange(0, 200))) for _ in range(500)]
    odd += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x3000), r.randrange(0xE000, 0x110000)])) for _ in range(r.randrange(0, 60))) for _ in range(500)]
    odd += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]
    ids, counts = model.encode(odd)
    ends = np.cumsum(counts)
    decoded = model.decode(ids, counts)
    for k, text in enumerate(odd):
        expected = library.encode(text, add_eos=True)
        assert ids[ends[k] - counts[k] : ends[k]].tolist() == expected
        assert decoded[k] == library.decode(expected)
    for _ in range(1000):
        any_ids = [r.choice([r.randrange(3, 259), r.randrange(0, 32000), r.choice([29871, 0, 1, 2])]) for _ in range(r.randrange(0, 12))]
        assert model.decode(np.array(any_ids, np.int32), np.array([len(any_ids)]))[0] == library.decode(any_ids)


def test_merges_that_make_a_better_pair_stay_in_order():
    """A model in which a merge makes a pair of a better score; against merging one pair after the other."""

    def model_of(pieces):
        number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
        field = lambda k, v: number(k << 3 | 2) + number(len(v)) + v
        out = b""
        for text, score, kind in pieces:
            out += field(1, field(1, text.encode()) + number(2 << 3 | 5) + np.float32(score).tobytes() + number(3 << 3) + number(kind))
        return piece_bpe.Model(out + field(2, number(3 << 3) + number(2) + number(35 << 3) + number(1)) + field(3, number(3 << 3) + number(1) + number(4 << 3) + number(0)))

    r = random.Random(8)
    for _ in range(60):
        names = list(dict.fromkeys(["".join(r.choice("abc▁") for _ in range(r.randrange(2, 6))) for _ in range(14)]))
        scores = {n: -float(r.randrange(1, 9)) for n in names}
        model = model_of([("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256)), *((c, -99.0, 1) for c in "abc▁"), *((n, s, 1) for n, s in scores.items())])
        for _ in range(20):
            text = "".join(r.choice("abc ") for _ in range(r.randrange(1, 40)))
            now = list("▁" + text.replace(" ", "▁"))
            while True:
                best = min(((-scores[a + b], i) for i, (a, b) in enumerate(zip(now, now[1:], strict=False)) if a + b in scores), default=None)
                if best is None:
                    break
                i = best[1]
                now[i : i + 2] = [now[i] + now[i + 1]]
            ids, _ = model.encode([text])
            assert [model.pieces[i] for i in ids[:-1]] == now


VECTORS = [
    (1, [0.5, -1.25, 3.0, 0.1], "a"), (2, [0.25, 2.0, -0.013, 7.5], "b"), (3, [-0.1, 0.2, 0.3, 0.4], "c"), (4, None, "d"), (5, [1.0, None, 2.0, 3.0], "e"), (6, [float("nan"), 1.0, 2.0, 3.0], "f"),
    (7, [float("inf"), 1.0, 2.0, 3.0], "g"), (8, [], "h"), (9, [1.0, 2.0], "i"), (1, [0.5, -1.25, 3.0, 0.1], "a"), (None, [4.0, 4.0, -4.0, 1.0], "j"), (10, [0.01, 0.015, -9.0, 2.0], "k"), (11, [3.5, 1.5, 1.0, -2.0], "l"),
]


def brute_whitening(rows):
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)
    return y, n, v, values[order], vectors[:, order]


def test_whitening(spark):
    frame = spark.createDataFrame([(a, b, c, c) for a, b, c in VECTORS], "vec_id long, embedding array<float>, component string, width string").repartition(3)
    rows = [[float(np.float32(c)) for c in v] for _, v, _ in VECTORS if v and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    y, n, v, values, vectors = brute_whitening(rows)
    found = whitening.whiten(frame).collect()
    assert len(found) == 4 * n and {r.n for r in found} == {n}
    assert sorted(int(r.deviation) for r in found if r.component == 1) == sorted(sum(c * c for c in r) for r in y)
    for k in range(4):
        mine = sorted(r.whitened for r in found if r.component == k + 1)
        theirs = np.array(y, float) / n @ vectors[:, k] / np.sqrt(values[k])
        assert mine == pytest.approx(sorted(theirs), rel=1e-9) or mine == pytest.approx(sorted(-theirs), rel=1e-9)
        assert all(r.explained == pytest.approx(values[k] / np.trace(v)) for r in found if r.component == k + 1)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    assert whitening.whiten(frame.where("false")).collect() == []
    assert [r.whitened for r in whitening.whiten(frame.where("vec_id = 3")).collect()] == [None] * 4


def test_products_of_limbs_are_exact():
    r = random.Random(4)
    for most in (3, 10**6, 2**45, 2**61, 10**30):
        y = np.array([[r.randrange(-most, most + 1) for _ in range(5)] for _ in range(40)], object)
        exact = y.T.dot(y)
        assert (whitening.exact_gram(y if most > 2**62 else y.astype(np.int64)) == exact).all()


def test_large_entries_and_constant_dimensions(spark):
    frame = spark.createDataFrame([(i, [1e30 * (i % 3), float(i), 5.0]) for i in range(7)], "vec_id long, embedding array<double>")
    found = whitening.whiten(frame).collect()
    y, n, v, values, _ = brute_whitening([[1e30 * (i % 3), float(i), 5.0] for i in range(7)])
    assert len(found) == 21 and {r.deviation for r in found if r.vec_id == 1} == {None}  # beyond 38 digits
    assert {r.whitened is None for r in found if r.component == 3} == {True}
    assert sum({r.component: r.explained for r in found}.values()) == pytest.approx(1)


def test_whitening_of_the_test_table(spark):
    found = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes)["deviation"] == "bigint" and found.count() == 500 * 32
    assert found.agg({"identity_error": "max"}).first()[0] < 1e-9


def test_a_doc_id_on_very_many_rows_does_not_grow_the_samples(spark):
    from claimloom.llm import language_id, quality
    from claimloom.llm.common import one_of_each

    rows = [(k % 2, f"some words of text {k}", "en") for k in range(4000)] + [(k, "eine Zeile mit Worten", "de") for k in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = docs.select("doc_id").where("doc_id < 2").distinct()
    assert len(quality._sampled(docs, ids)) == 2
    assert one_of_each(docs, ["lang", "text"]).count() == 12
    network = language_id.train(docs, F.lit(True))
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs.where("doc_id > 1"), network).collect()}
    assert set(found) == set(range(2, 12))


def test_items_whose_edits_all_stand_before_what_is_unchanged():
    import pyarrow as pa

    from claimloom.llm import decontaminate

    r = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    for n, change in ((10, "in"), (30, "in"), (30, "out"), (100, "in"), (100, "out")):
        items = [[r.choice(words) for _ in range(n)] for _ in range(25)]
        texts = []
        for item in items:
            w = list(item)
            for _ in range(n // 5):
                if change == "in":
                    w.insert(r.randrange(0, n // 4 + 1), r.choice(words))
                else:
                    del w[r.randrange(0, len(w) // 3)]
            texts.append(" ".join([r.choice(words) for _ in range(20)] + w + [r.choice(words) for _ in range(20)]))
        found = decontaminate.Items(list(range(25)), [" ".join(x) for x in items]).leaks(pa.array(texts))
        assert len({row for row, item, *_ in found if row == item}) >= 24


def test_pages_inside_a_form_and_text_beside_the_region():
    from claimloom.llm.html_extract import main_text

    p = "<p>This is a long paragraph with many words in it, so that it is dense text on this page, really.</p>"
    said = "This is a long paragraph with many words in it, so that it is dense text on this page, really."
    assert main_text(f"<body><form id=page><div class=nav><a>x</a></div><article>{p * 3}<p>Short.</p></article><input></form></body>") == " ".join([said] * 3 + ["Short."])
    assert main_text(f"<body><div class=menu><a>m</a></div><h1>The headline</h1><div>{p * 3}</div><div><p>Last.</p></div><form><p>Your mail please</p></form></body>") == " ".join(["The headline", *[said] * 3, "Last."])
