"""SentencePiece BPE, encoding and decoding, by vectorised merge rounds.

A slice of texts becomes one flat array of code points. It is cut into words where
two characters meet that stand beside each other in no piece, so nothing can merge
across a cut; every different word of the slice is merged once. In a round each word finds
the best rank among its pairs of symbols (a segmented minimum), all its pairs of that rank
merge at once, leftmost first where they overlap, and the arrays are compacted; words
without a pair that merges leave. Only pairs beside a merge are looked up again.

Merging all pairs of the best rank at once equals merging them one after the other as
long as a merge makes no pair of the same or a better rank. The merged pieces
after which that can happen are found when the model is loaded, and of those a word
merges only its leftmost one in a round, so the result is the sequential one for any model.

Symbols that are no piece are spelled in bytes. Decoding joins the pieces, drops the
blank that encoding puts in front, and reads runs of byte pieces as UTF-8, each byte that is not as
U+FFFD.

Defined results: a null text is empty; an empty text holds the end id alone and decodes to
an empty text; every row is encoded by itself, so repeated rows, null and repeated doc_ids
give rows of their own; an empty table gives no rows; input columns other than doc_id and
text are not read. Models with a normaliser's table, user-defined or unused pieces,
or without byte fallback are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm.common import slices
from claimloom.llm.kernels import mixed, powers, ranges

#: Fixed values of the model file: field numbers and kinds of pieces; the mark that stands for a blank.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLANK = "▁"
REPLACEMENT = "�".encode()
#: Text that is encoded together, in bytes.
TEXT_BYTES = 2 << 20
#: Slots of the table that says which characters stand beside each other in a piece.
BESIDE_BITS = 22
NEVER = np.iinfo(np.int32).max


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """The pieces of a model file, with the tables that the merge rounds look into."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds, trainer, normaliser = [], [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or normaliser.get(2) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("a BPE model with byte fallback, without a normaliser's table and user-defined pieces is needed")
        if normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("the model must keep white space, put a blank in front and escape blanks")
        self.size, self.end = len(self.pieces), trainer.get(42, 2)
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_of = np.full(self.size, -1, np.int16)
        for i in (i for i, k in enumerate(kinds) if k == BYTE):
            value = int(self.pieces[i][3:5], 16)
            self.byte_ids[value], self.byte_of[i] = i, value
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        # Equal scores share a rank; the best score has rank 0.
        levels = -np.array(scores, np.float64)
        self.rank = np.unique(levels, return_inverse=True)[1].astype(np.int32)
        self._tables(normal)
        self._spelling(normal)

    def symbol(self, text: str, normal: dict[str, int]) -> int | None:
        """A symbol's number: its id, or the code point after all ids for a character that is no piece."""
        return normal.get(text, self.size + ord(text) if len(text) == 1 else None)

    def _tables(self, normal: dict[str, int]) -> None:
        pairs: dict[int, int] = {}
        self.risky = np.zeros(self.size, bool)
        beside, characters = set(), {}
        for piece, i in normal.items():
            if len(piece) == 1:
                characters[ord(piece)] = i
            beside.update(zip(map(ord, piece), map(ord, piece[1:]), strict=False))
            for k in range(1, len(piece)):
                left, right = self.symbol(piece[:k], normal), self.symbol(piece[k:], normal)
                if left is None or right is None:
                    continue
                pairs[(left << 32) | right] = i
                for part in (left, right):  # a merge into ``part`` may make this pair
                    if part < self.size and len(self.pieces[part]) > 1 and self.rank[i] <= self.rank[part]:
                        self.risky[part] = True
        keys = np.array(sorted(pairs), np.int64)
        # Pairs in slots of a hash, so that a look-up starts near its end.
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.merged = keys[order], np.array([pairs[k] for k in keys.tolist()], np.int32)[order]
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max()) if len(keys) else 0
        self.beside = np.zeros(1 << BESIDE_BITS, bool)
        if beside:
            both = np.array(sorted(beside), np.int64)
            self.beside[_beside_slot(both[:, 0], both[:, 1])] = True
        self.of_character = np.arange(0x110000, dtype=np.int32) + self.size
        self.of_character[list(characters)] = list(characters.values())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _spelling(self, normal: dict[str, int]) -> None:
        """What each id decodes to: normal pieces with blanks, bytes as they are, nothing for the others."""
        spelled = [b""] * self.size
        for piece, i in normal.items():
            spelled[i] = piece.replace(BLANK, " ").encode()
        for i in np.flatnonzero(self.byte_of >= 0).tolist():
            spelled[i] = bytes([self.byte_of[i]])
        self.spelled_ends = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.blank_first = np.zeros(self.size, bool)
        self.blank_first[[i for p, i in normal.items() if p.startswith(BLANK)]] = True
        self.unknown = np.zeros(self.size, bool)
        self.unknown[[i for i, p in enumerate(self.pieces) if p == "<unk>"]] = True

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges into, or -1."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        at, stop = self.first[slot], self.first[slot + 1]
        for _ in range(self.deepest):
            open_ = np.flatnonzero(at < stop)
            if not len(open_):
                break
            places = at[open_]
            hit = self.keys[places] == keys[open_]
            out[open_[hit]] = self.merged[places[hit]]
            at[open_] += 1
            at[open_[hit]] = stop[open_[hit]]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text's end id included, and the number of ids of each."""
        rows = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(r) for r in rows], np.int64)
        row_starts = np.cumsum(lengths) - lengths
        out_counts = np.ones(len(texts), np.int64)
        if not len(points):
            return np.full(len(texts), self.end, np.int32), out_counts
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.beside[_beside_slot(points[:-1], points[1:])]
        cut[row_starts[lengths > 0]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(points)))
        which, of_word = _distinct(points, starts, sizes)
        ids, counts = self._merge(points[ranges(starts[which], sizes[which])], sizes[which])
        id_starts = np.cumsum(counts) - counts
        flat = ids[ranges(id_starts[of_word], counts[of_word])]
        # Ids of each row: the words whose first character is in it.
        word_ends = np.concatenate([[0], np.cumsum(counts[of_word])])
        edges = word_ends[np.searchsorted(starts, np.append(row_starts, len(points)))]
        out_counts += np.diff(edges)
        out = np.full(int(out_counts.sum()), self.end, np.int32)
        out[ranges(np.cumsum(out_counts) - out_counts, out_counts - 1)] = flat
        return out, out_counts

    def _merge(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and their number for each word, by merge rounds."""
        symbols, word = self.of_character[points], np.repeat(np.arange(len(sizes)), sizes)
        made = np.full(len(symbols), -1, np.int32)  # what each symbol and the next merge into
        same = word[1:] == word[:-1]
        made[:-1][same] = self.pair(symbols[:-1][same], symbols[1:][same])
        rank = np.where(made >= 0, self.rank[made], NEVER)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.append(heads, len(symbols)))
            best = np.minimum.reduceat(rank, heads)
            ended = np.repeat(best == NEVER, counts)
            if ended.any():
                done.append((word[ended], symbols[ended]))
                symbols, word, made, rank = (x[~ended] for x in (symbols, word, made, rank))
                if not len(symbols):
                    break
                counts, best = counts[best < NEVER], best[best < NEVER]
            chosen = np.flatnonzero(rank == np.repeat(best, counts))
            # Of overlapping pairs every second one of a chain merges, from the left.
            fresh = np.concatenate([[True], np.diff(chosen) > 1])
            chain = np.flatnonzero(fresh)
            chosen = chosen[(np.arange(len(chosen)) - chain[np.cumsum(fresh) - 1]) % 2 == 0]
            risky = self.risky[made[chosen]]
            if risky.any():  # of a word with such a merge only the leftmost
                first = np.concatenate([[True], word[chosen][1:] != word[chosen][:-1]])
                alone = np.zeros(int(word[-1]) + 1, bool)
                alone[word[chosen[risky]]] = True
                chosen = chosen[first | ~alone[word[chosen]]]
            symbols[chosen] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            now = (np.cumsum(keep) - 1)[chosen]
            symbols, word, made, rank = (x[keep] for x in (symbols, word, made, rank))
            touched = np.unique(np.concatenate([now, now[now > 0] - 1]))
            made[touched] = -1
            inner = touched[touched + 1 < len(symbols)]
            inner = inner[word[inner] == word[inner + 1]]
            made[inner] = self.pair(symbols[inner], symbols[inner + 1])
            rank[touched] = np.where(made[touched] >= 0, self.rank[made[touched]], NEVER)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return self._spelled_out(symbols[order], word[order], len(sizes))

    def _spelled_out(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: a character that is no piece gives a byte piece for each of its UTF-8 bytes."""
        points = symbols - self.size
        width = np.where(points < 0, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        out = np.repeat(symbols, width)
        other = np.flatnonzero(points >= 0)
        if len(other):
            data = np.frombuffer(points[other].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            out[ranges((np.cumsum(width) - width)[other], width[other])] = self.byte_ids[data]
        return out, np.bincount(word, weights=width, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each row of ids."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= self.size):
            raise ValueError("an id that the model has not")
        width = np.diff(self.spelled_ends)[ids]
        data = self.spelled[ranges(self.spelled_ends[ids], width)].tobytes()
        ends = np.concatenate([[0], np.cumsum(width)])
        rows = np.concatenate([[0], np.cumsum(counts)])
        edges = ends[rows].tolist()
        lead = self._blank_dropped(ids, rows, width)
        strange = np.zeros(len(counts), bool)
        # Unknown ids, and ids that say nothing between bytes, which do not join then.
        odd = np.flatnonzero(self.unknown[ids] | ((width == 0) & (np.append(self.byte_of[ids[1:]], -1) >= 0)))
        strange[np.searchsorted(rows, odd, "right") - 1] = True
        out = []
        for k in range(len(counts)):
            row = data[edges[k] + lead[k] : edges[k + 1]]
            try:
                if strange[k]:
                    raise UnicodeDecodeError("utf-8", b"", 0, 0, "an unknown id")
                out.append(row.decode())
            except UnicodeDecodeError:
                out.append(self._decode_slowly(ids[rows[k] : rows[k + 1]]))
        return out

    def _blank_dropped(self, ids: np.ndarray, rows: np.ndarray, width: np.ndarray) -> list[int]:
        """1 where the first id of a row that says anything begins with a blank, else 0."""
        said = np.flatnonzero(width > 0)
        first = np.searchsorted(said, rows[:-1])
        within = first < np.searchsorted(said, rows[1:])
        lead = np.zeros(len(rows) - 1, np.int64)
        lead[within] = self.blank_first[ids[said[first[within]]]]
        return lead.tolist()

    def _decode_slowly(self, ids: np.ndarray) -> str:
        """One row with bytes that are not UTF-8, or unknown ids: piece by piece."""
        out, held, started = [], b"", False
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.byte_of[i] >= 0:
                held += bytes([self.byte_of[i]])
                continue
            while held:
                size = next((n for n in (1, 2, 3, 4) if _is_utf8(held[:n])), 0)
                out.append(held[:size].decode() if size else REPLACEMENT.decode())
                held, started = held[size or 1 :], True
            if i < 0:
                break
            said = " ⁇ " if self.unknown[i] else self.spelled[self.spelled_ends[i] : self.spelled_ends[i + 1]].tobytes().decode()
            if not started and self.blank_first[i]:
                said = said[1:]
                started = True
            started = started or bool(said)
            out.append(said)
        return "".join(out)


def _is_utf8(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _beside_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A slot for two characters; two pairs in one slot only leave a cut out."""
    return ((left * 0x9E3779B1 + right * 0x85EBCA6B) >> 7) & ((1 << BESIDE_BITS) - 1)


def _distinct(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal words, and the number of each word's set.

    Words are sorted by a hash, and every word is compared with the first of its hash; if one
    differs, each word stands for itself.
    """
    up, down = powers(0xD1B54A32D192ED03 | 1, len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: len(points)], out=total[1:])
    keys = mixed((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(np.uint64))
    _, which, of_word = np.unique(keys, return_index=True, return_inverse=True)
    alike = which[of_word]
    if (sizes != sizes[alike]).any() or (points != points[ranges(starts[alike], sizes)]).any():
        return np.arange(len(starts)), np.arange(len(starts))
    return which, of_word


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for batch in batches:
        for part in slices(batch, limit=TEXT_BYTES):
            ids, counts = model.encode([t or "" for t in part.column("text").to_pylist()])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + TEXT_BYTES // 4, "right")) - 1)
            texts = model.decode(flat[offsets[start] : offsets[stop]], np.diff(offsets[start : stop + 1]))
            piece = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
            start = stop


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>, the end id last) of each text of ``docs`` (doc_id, text)."""
    path = path or model_path()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the ids stand for, as ``decoded``."""
    path = path or model_path()
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, path), "doc_id long, ids array<int>, decoded string")
