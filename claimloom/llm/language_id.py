"""Language identification by a byte convolutional network trained in numpy.

Bytes of fixed-length windows are embedded, passed through filters of several
widths, rectified, max-pooled over the window and classified by a softmax. A
document's windows cover its whole text; its prediction is the mean of their
probabilities, weighted by the bytes in each window.

Training takes ``WINDOWS`` windows of each of a bounded sample of labelled documents
(``SAMPLE``, in the order of a hash of doc_id), at even steps through the whole text and cut in
the tasks; prediction reads texts only.

Defined results: a null text or one without a letter is ``und`` with score 0, as is
every text when no labelled document is at hand; repeated rows get one row each; an
empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import offsets_of, one_of_each, slices
from claimloom.llm.kernels import ranges

#: Labelled documents, and windows of each, that training sees.
SAMPLE, WINDOWS = 3_000, 3
#: Bytes of a window, of an embedding; filter widths, filters of each width.
LENGTH, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
EPOCHS, BATCH, RATE = 4, 64, 0.004
UNKNOWN = "und"


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows as byte values plus one (0 pads), their rows and sizes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // LENGTH)
    row = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[:-1][row] + (ranges(np.zeros(len(counts), np.int64), counts) * LENGTH)
    length = np.minimum(LENGTH, offsets[1:][row] - starts)
    out = np.zeros((len(row), LENGTH), np.int16)
    inside = np.arange(LENGTH) < length[:, None]
    out[inside] = raw[ranges(starts, length)].astype(np.int16) + 1
    return out, row, length


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray = field(init=False)
    filters: list[np.ndarray] = field(init=False)
    bias: np.ndarray = field(init=False)
    out: np.ndarray = field(init=False)
    out_bias: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(11)
        f32 = np.float32
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(f32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(f32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), f32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(self.langs))).astype(f32)
        self.out_bias = np.zeros(len(self.langs), f32)

    def _columns(self, x: np.ndarray, width: int) -> np.ndarray:
        """The embedded bytes under each place of a filter, one row for each place."""
        n = LENGTH - width + 1
        return np.lib.stride_tricks.as_strided(x, (len(x), n, width * EMBED), (x.strides[0], x.strides[1], x.itemsize)).reshape(-1, width * EMBED)

    def forward(self, ids: np.ndarray, keep: bool = False) -> tuple:
        x = self.embed[ids]
        pooled, where, cols = [], [], []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            c = self._columns(x, width)
            y = (c @ f).reshape(len(ids), -1, FILTERS)
            if keep:
                at = y.argmax(1)
                pooled.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
                where.append(at)
                cols.append(c.reshape(len(ids), -1, width * EMBED))
            else:
                pooled.append(y.max(1))
        h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        return (p, h, where, cols) if keep else (p,)

    def fit(self, ids: np.ndarray, target: np.ndarray, epochs: int = EPOCHS) -> None:
        rng = np.random.default_rng(5)
        params = [self.embed, *self.filters, self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // BATCH)):
                p, h, where, cols = self.forward(ids[at], keep=True)
                g = p.copy()
                g[np.arange(len(at)), target[at]] -= 1
                g /= len(at)
                gh = (g @ self.out.T) * (h > 0)
                ge, gf = np.zeros_like(self.embed), []
                for k, width in enumerate(WIDTHS):
                    part = gh[:, k * FILTERS : (k + 1) * FILTERS]
                    picked = np.take_along_axis(cols[k], where[k][:, :, None], 1)
                    gf.append(np.einsum("nfc,nf->cf", picked, part))
                    spread = part[:, :, None] * self.filters[k].T[None]
                    for o in range(width):
                        bytes_at = np.take_along_axis(ids[at], where[k] + o, 1)
                        np.add.at(ge, bytes_at, spread[:, :, o * EMBED : (o + 1) * EMBED])
                ge[0] = 0
                step += 1
                for p_, g_, m, v in zip(params, [ge, *gf, gh.sum(0), h.T @ g, g.sum(0)], first, second, strict=True):
                    m += 0.1 * (g_ - m)
                    v += 0.001 * (g_ * g_ - v)
                    p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its mean probability for each text."""
        offsets, raw = offsets_of(column)
        total = np.zeros((len(column), len(self.langs)))
        ids, row, size = windows(raw, offsets)
        for at in range(0, len(ids), 256):
            p = self.forward(ids[at : at + 256])[0]
            np.add.at(total, row[at : at + 256], p * size[at : at + 256, None])
        total /= np.maximum(1, np.diff(offsets))[:, None]
        best = total.argmax(1)
        return [self.langs[k] for k in best], total[np.arange(len(best)), best]


def _lettered(column: pa.Array) -> np.ndarray:
    offsets, raw = offsets_of(column)
    plain = (raw | 32 >= 97) & (raw | 32 <= 122)
    have = np.concatenate([[0], np.cumsum(plain)])
    out = have[offsets[1:]] > have[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``WINDOWS`` windows of each text, at even steps through all of it."""
    for batch in batches:
        for part in slices(batch):
            offsets, raw = offsets_of(part.column("text"))
            ids, row, _ = windows(raw, offsets)
            counts = np.bincount(row, minlength=part.num_rows)
            take = np.minimum(counts, WINDOWS)
            of, nth = np.repeat(np.arange(len(take)), take), ranges(np.zeros(len(take), np.int64), take)
            at = (np.cumsum(counts) - counts)[of] + nth * counts[of] // np.maximum(1, take[of])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * LENGTH), pa.array(ids[at].ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), part.column("lang").take(pa.array(of)), pa.array(nth), flat], names=["doc_id", "lang", "nth", "window"])


def train(docs: DataFrame, allowed: Column) -> Network | None:
    """A network from the texts and languages of rows where ``allowed`` holds."""
    turn = F.xxhash64(F.col("doc_id"))
    usable = docs.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    chosen = usable.select("doc_id").distinct().orderBy(turn, "doc_id").limit(SAMPLE)
    # One row of each doc_id, so that repeated ones do not grow the sample.
    texts = one_of_each(usable.join(F.broadcast(chosen), "doc_id", "left_semi"), ["lang", "text"])
    kind = dict(docs.dtypes)["doc_id"]
    rows = texts.mapInArrow(_drawn, f"doc_id {kind}, lang string, nth long, window array<smallint>").toArrow()
    if not len(rows):
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("nth", "ascending")])
    ids = rows.column("window").combine_chunks().flatten().to_numpy().reshape(-1, LENGTH)
    langs = sorted(set(rows.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    network = Network(langs)
    network.fit(ids, np.array([number[x] for x in rows.column("lang").to_pylist()]))
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                column = part.column("text")
                known = _lettered(column) if network else np.zeros(len(column), bool)
                langs, scores = network.predict(column) if network else ([UNKNOWN] * len(column), np.zeros(len(column)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x if k else UNKNOWN for x, k in zip(langs, known, strict=True)], pa.string()), pa.array(np.where(known, np.clip(scores, 0, 1), 0.0))],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(predicted, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
