"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by the non-negative
unbiased risk ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with an estimated class
prior ``pi``. The prior comes from the unlabelled texts: a first network tells positives from
unlabelled texts, and on held-out halves of both the share of unlabelled texts above a score,
over the share of positives above it, bounds the prior from above wherever the cut lies; the least of
these bounds, with a margin for chance, is the estimate. Labels 0 are never read. Features are shares and rates of a whole text (repetition, case,
symbols, word and line shapes), worked out for many texts at once from their bytes.

Fitting sees a bounded sample, ``POSITIVES`` and ``UNLABELLED`` documents in the
order of a hash of doc_id; scoring covers every text. The driver holds the sample's
features only.

Defined results: a null text is scored as an empty one; without a positive every
score is 0.5; repeated rows get one row each; a document that any label calls good is a
positive; an empty table gives an empty result; other input columns are not read: ``score``
passes them on, but for one that is named score, whose place the result takes, and
``accepted`` passes on all of them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import offsets_of, one_of_each, slices
from claimloom.llm.kernels import word_bounds, word_hashes

#: Documents in the sample: trusted positives, and texts taken as unlabelled.
POSITIVES, UNLABELLED = 6_000, 8_000
#: A text counts as good from this score on.
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE = 16, 40, 512, 0.01
_KINDS = np.zeros((256, 7), np.float32)
for _at, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:", b"!?", b"#$%&*|@<>{}[]\\^~_=+", range(128, 256))):
    _KINDS[list(_bytes), _at] = 1


def features(column: pa.Array) -> np.ndarray:
    """One row of shares and rates for each text."""
    offsets, raw = offsets_of(column)
    rows = len(column)
    starts, ends, first = word_bounds(raw, offsets)
    n_words, n_bytes = np.diff(first).astype(np.float64), np.diff(offsets).astype(np.float64)
    words, some = np.maximum(n_words, 1), np.maximum(n_bytes, 1)

    def by_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[edges[1:]] - total[edges[:-1]]

    columns = [by_row(_KINDS[:, k][raw], offsets) / some for k in range(_KINDS.shape[1])]
    lines = by_row(raw == 10, offsets) + 1
    lengths = (ends - starts).astype(np.float64)
    if len(starts):
        row = np.repeat(np.arange(rows), np.diff(first))
        hashes = word_hashes(raw, starts, ends, lower=True)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((hashes, row))
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        capital = (raw[starts] >= 65) & (raw[starts] <= 90)
        last = raw[ends - 1]
        letter = lambda b: (b >= 128) | ((b | 32) >= 97) & ((b | 32) <= 122)
        bare = (lengths == 1) & ~letter(raw[starts])
        distinct = by_row(new, first)
    else:
        again = capital = bare = np.zeros(0, bool)
        last, distinct = np.zeros(0, np.uint8), np.zeros(rows)
        letter = lambda b: np.zeros(len(b), bool)
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
    odd = ~letter(last) & ~np.isin(last, np.frombuffer(b".,;:!?)\"'0123456789", np.uint8))
    mean = by_row(lengths, first) / words
    columns += [
        by_row(again, first) / words,
        distinct / words,
        np.log1p(words / np.maximum(distinct, 1)),
        by_row(capital, first) / words,
        by_row(stop, first) / words,
        by_row(odd, first) / words,
        by_row(bare, first) / words,
        by_row(last == 33, first) / words,
        mean / 10,
        np.sqrt(np.maximum(0, by_row(lengths**2, first) / words - mean**2)) / 10,
        np.log1p(n_words) / 10,
        np.log1p(n_words / lines) / 10,
        (n_words == 0).astype(np.float64),
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        hidden = np.tanh(z @ self.w1 + self.b1)
        return z, hidden, hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x)[2], -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 1.0) -> float:
    """The least ratio of the shares of both above a score, in which chance is allowed for on either side.

    ``positive`` and ``unlabelled`` are scores of a classifier that told the two apart on other texts.
    """
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    chance = margin * (np.sqrt(np.log(40) / (2 * len(positive))) + np.sqrt(np.log(40) / (2 * len(unlabelled))))
    best = int(np.argmin((u + chance) / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Model:
    """Minimise the non-negative risk with the logistic loss by Adam on mini-batches; without a prior, tell both apart."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    d = both.shape[1]
    model = Model(both.mean(0), both.std(0) + 1e-3, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))
    names = ("w1", "b1", "w2", "b2")
    state = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in names}
    step = 0

    def slopes(x: np.ndarray, grad_out: np.ndarray) -> dict[str, np.ndarray]:
        z, hidden, _ = model.margin(x)
        back = np.outer(grad_out, model.w2) * (1 - hidden**2)
        return {"w1": z.T @ back, "b1": back.sum(0), "w2": hidden.T @ grad_out, "b2": grad_out.sum(keepdims=True)}

    per = max(1, -(-len(unlabelled) // BATCH))
    for _ in range(EPOCHS):
        order_u = np.array_split(rng.permutation(len(unlabelled)), per)
        for u in order_u:
            xp, xu = positive[rng.integers(0, len(positive), BATCH)], unlabelled[u]
            up, uu = model.score(xp), model.score(xu)
            # Logistic losses: -log s for the positive sign, -log(1 - s) for the negative.
            negative = 0.0 if prior is None else -np.log1p(-np.minimum(uu, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(up, 1 - 1e-9)).mean()
            if prior is None:
                gp, gu = (up - 1) / len(xp), uu / len(xu)
            elif negative >= 0:
                gp = prior * ((up - 1) - up) / len(xp)
                gu = uu / len(xu)
            else:  # ascend on the negative part alone until it is a risk again
                gp, gu = prior * up / len(xp), -uu / len(xu)
            a, b = slopes(xp, gp), slopes(xu, gu)
            step += 1
            for k in names:
                g = a[k] + b[k] + (1e-4 * getattr(model, k) if k[0] == "w" else 0)
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(model, k)[...] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32()))], names=["x"])


def _sampled(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the texts whose ids are in ``ids``, a bounded sample: one row of each doc_id, however many share it."""
    texts = one_of_each(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"), ["text"]).select("text")
    rows = texts.mapInArrow(_features, "x array<float>").toArrow().column("x").combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1)[np.lexsort(flat.reshape(len(rows), -1).T)] if len(rows) else np.zeros((0, 1), np.float32)


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model | None:
    """A model from the labels of rows where ``allowed`` (an expression of doc_id) holds."""
    turn = F.xxhash64(F.col("doc_id"))
    trusted = labels.where(allowed & F.col("doc_id").isNotNull() & (F.col("quality") == 1)).select("doc_id").distinct()
    trusted = trusted.orderBy(turn, "doc_id").limit(POSITIVES)
    others = docs.where(allowed & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(turn, "doc_id").limit(UNLABELLED)
    positive, unlabelled = _sampled(docs, trusted), _sampled(docs, others)
    if not len(positive) or not len(unlabelled):
        return None
    a, b = (x[np.random.default_rng(3).permutation(len(x))] for x in (positive, unlabelled))
    if min(len(a), len(b)) < 4:
        return fit(positive, unlabelled, 0.5)
    apart = fit(a[::2], b[::2], None)
    return fit(positive, unlabelled, estimated_prior(apart.score(a[1::2]), apart.score(b[1::2])))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` without text, and ``score``; the text is read only here."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = model.score(features(part.column("text"))) if model else np.full(part.num_rows, 0.5)
                keep = [i for i, n in enumerate(part.schema.names) if n not in ("score",)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(s, pa.float64())], names=[*[part.schema.names[i] for i in keep], "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "score")
    return docs.mapInArrow(scored, f"{fields}, score double")


def accepted(docs: DataFrame, model: Model | None, least: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more, with all columns as they are."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(features(part.column("text"))) >= least)) if model else part

    return docs.mapInArrow(kept, docs.schema)
