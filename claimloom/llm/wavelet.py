"""Token ids as wavelet matrices: one compressed, queryable file for each shard.

Documents are range-partitioned by doc_id, encoded, and cut into shards of a
bounded number of ids. A shard is stored as the bit-planes of a wavelet matrix: at
each level the ids are stably parted by their next bit, highest first, and the
plane keeps those bits. Counts of ones before each 512-bit block give constant-time
rank, so a shard answers ``access``, ``rank``, ``count`` and ``select`` from its
planes alone.

Shards are rows of a Parquet table (file format below), which Spark writes to and
reads from any store; no executor opens a local path.

    header   8 x int64, little-endian: magic, ids, documents, levels, pages of a plane, 3 reserved
    zeros    levels x int64: zeros in each plane
    places   (frames + 1) x int64: where each frame starts in the file, and the file's end
    frames   levels x pages: PAGE bytes of a plane each, bits in little-endian order
             levels: (ceil(ids / 512) + 1) x uint32, ones before each block of a plane
             1: documents x int64 ends of the documents within the shard, documents x int64 doc_id

Each frame is compressed with zstd by itself, so a rank inflates one page of each plane.

Defined results: a null text is empty; an empty text holds the end id alone; rows
with the same doc_id are ordered by text; a null doc_id comes first; an empty table gives no shards and
no rows. Input columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from claimloom.llm.common import shared_folder, slices, small
from claimloom.llm.kernels import ranges

MAGIC = 0x324D57
#: Bytes of a plane that are compressed together; a multiple of a block.
PAGE = 1 << 14
BLOCK = 512
#: Ids in a shard; a document with more has a shard of its own.
SHARD_IDS = 1 << 20
#: Rows of the dictionary of encoded pieces that a task keeps.
CACHE = 400_000
END = 0
#: Between the pieces of a text; the name of the piece that holds the end id.
CUT, _END_PIECE = "\x1e", "\x1e\x1e"
#: A Latin letter and an ASCII mark after it, an apostrophe excepted; a line feed between two plain characters; a piece of plain characters.
MARKED = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:-@\[-`{-~])"
FED = r"([!-~\x{A1}-\x{24F}])\n([!-~\x{A1}-\x{24F}])"
PLAIN = r"^ ?[!-~\x{A1}-\x{24F}]+$"
#: A word of letters alone.
LETTERS = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
#: Text whose pieces are looked up together.
PIECE_BYTES = 8 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The bytes of a text as the characters that a byte-level vocabulary writes them with.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MAPPED = np.array([b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)], np.uint16)


class Encoder:
    """``tokenizers`` behind a bounded dictionary of pieces.

    The byte-level pre-tokenizer always cuts before a space (except inside a run of
    white space), between a letter and a mark after it, and around a line feed between
    two other characters. A text is cut at those places, so that its pieces encode
    alike wherever they stand; as words recur, most pieces are looked up (all of a slice in
    one Arrow call) and only new ones go to the library. A text with a space beside other white space, with a special
    token's string or with the cutting mark itself is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work to the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._encode(["\n"])[0]
        text = self.tokenizer.to_str()
        kind = json.loads(text)
        cuts = kind["pre_tokenizer"] or {}
        self.merger = None
        if kind["normalizer"] is None and cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"]:
            # The same model for words that are cut and written byte by byte already.
            self.merger = Tokenizer.from_str(text)
            self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(chr(_MAPPED[10]))
            vocab = self.tokenizer.get_vocab()
            self.spelled = np.zeros(max(vocab.values()) + 1, np.int64)
            self.spelled[list(vocab.values())] = [len(x) for x in vocab]
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.ends, self.odd, self.uses = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool), np.zeros(1 << 14, np.int32)
        self.used = self.filled = 0
        self._add(pa.array([_END_PIECE]), np.array([END], self.dtype), np.ones(1, np.int64))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> None:
        """Encode new pieces: words of letters alone as they are, other plain ones some hundreds at a time, as the lines of one text."""
        pieces = self._learn_plain(self._learn_words(pieces))
        if len(pieces):
            rest = pieces.to_pylist()
            found = self._encode(rest)
            odd = [p[:1] == " " and (len(p) == 1 or p[1].isspace()) for p in rest]
            self._add(pieces, np.array([i for x in found for i in x], self.dtype), np.array([len(x) for x in found], np.int64), odd)

    def _learn_words(self, pieces: pa.Array) -> pa.Array:
        """The pre-tokenizer leaves a word of letters whole, so the model gets it at once; gives the other pieces.

        Where a word ends among the tokens is known from how many bytes each token stands for.
        """
        if self.merger is None:
            return pieces
        whole = pc.match_substring_regex(pieces, LETTERS)
        words = pieces.filter(whole)
        if not len(words):
            return pieces
        lines = words.to_pylist()
        texts = [_MAPPED[np.frombuffer("\n".join(lines[k : k + 100]).encode(), np.uint8)].tobytes().decode("utf-16-le") for k in range(0, len(lines), 100)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.merger.encode_batch_fast(texts, add_special_tokens=False)), self.dtype)
        bytes_after, ends = np.cumsum(self.spelled[flat]), np.cumsum(pc.binary_length(words).to_numpy())
        stops = np.searchsorted(bytes_after, ends) + 1
        if stops[-1] != len(flat) or not np.array_equal(bytes_after[stops - 1], ends):  # a vocabulary without some byte
            return pieces
        self._add(words, flat, np.diff(stops, prepend=0))
        return pieces.filter(pc.invert(whole))

    def _learn_plain(self, pieces: pa.Array) -> pa.Array:
        """A line feed between two plain pieces is a token of its own; gives the other pieces."""
        plain = pc.match_substring_regex(pieces, PLAIN)
        fit = pieces.filter(plain)
        if len(self.feed) != 1 or not len(fit):
            return pieces
        lines, tokens = fit.to_pylist(), []
        for x in self._encode(["\n".join(lines[k : k + 400]) for k in range(0, len(lines), 400)]):
            tokens += x
            tokens += self.feed
        flat = np.array(tokens, self.dtype)
        breaks = np.flatnonzero(flat == self.feed[0])
        if len(breaks) != len(lines):  # a vocabulary that joins line feeds with letters
            return pieces
        self._add(fit, np.delete(flat, breaks), np.diff(breaks, prepend=-1) - 1)
        return pieces.filter(pc.invert(plain))

    def _add(self, pieces: pa.Array, flat: np.ndarray, lengths: np.ndarray, odd: list[bool] | bool = False) -> None:
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.used + len(pieces) + 1 > len(self.ends):
            self.ends, self.odd, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.odd, self.uses))
        self.ids[self.filled : self.filled + len(flat)] = flat
        now = slice(self.used + 1, self.used + 1 + len(pieces))
        self.ends[now] = self.filled + np.cumsum(lengths)
        self.odd[now] = odd
        self.uses[now] = 0
        self.known = pa.concat_arrays([self.known, pieces])
        self.used, self.filled = self.used + len(pieces), self.filled + len(flat)

    def _trim(self) -> None:
        """Forget the pieces that were met in one batch only; all of them, if the rest are many."""
        number = np.flatnonzero(self.uses[2 : self.used + 1] > 1) + 2  # the first piece is the end's
        old, old_ids, old_ends, old_odd = self.known, self.ids, self.ends, self.odd
        self._clear()
        if 0 < len(number) < CACHE * 3 // 4:
            starts, lengths = old_ends[number - 1], old_ends[number] - old_ends[number - 1]
            self._add(old.take(pa.array(number - 1)), old_ids[ranges(starts, lengths)], lengths, old_odd[number])
            self.uses[2 : self.used + 1] = 1

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece; new ones are learnt."""
        if self.used > CACHE:
            self._trim()
        found = pc.index_in(pieces, value_set=self.known)
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        number = found.fill_null(-1).to_numpy().astype(np.int64) + 1
        if len(missing):
            strange, before = pieces.take(pa.array(missing)), self.used
            self._learn(strange.unique())
            number[missing] = pc.index_in(strange, value_set=self.known.slice(before)).to_numpy() + before + 1
        met = np.zeros(self.used + 1, bool)
        met[number] = True
        self.uses[: self.used + 1] += met
        return number

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column (null: empty), each with the end id, and how many each text has."""
        texts = pc.fill_null(column, "")
        cut = pc.replace_substring_regex(texts, MARKED, r"\1" + CUT + r"\2")
        cut = pc.replace_substring_regex(cut, FED, r"\1" + CUT + "\n" + CUT + r"\2")
        split = pc.split_pattern(pc.replace_substring(cut, " ", CUT + " "), CUT)
        firsts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        number = np.insert(self._numbers(split.flatten().cast(pa.string())), firsts[1:], 1)
        firsts = firsts[:-1] + np.arange(len(texts))
        starts = self.ends[number - 1]
        lengths = self.ends[number] - starts
        flat = self.ids[ranges(starts, lengths)]
        sizes = np.add.reduceat(lengths, firsts)
        whole = np.logical_or.reduceat(self.odd[number], firsts)
        for mark in (CUT, *self.special):
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(whole)
        if len(at):
            stops, parts, done = np.concatenate([[0], np.cumsum(sizes)]), [], 0
            for i, ids in zip(at.tolist(), self._encode(texts.take(pa.array(at)).to_pylist()), strict=True):
                parts += [flat[done : stops[i]], np.array([*ids, END], self.dtype)]
                done, sizes[i] = stops[i + 1], len(ids) + 1
            flat = np.concatenate([*parts, flat[done:]])
        return flat, sizes


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for a worker: later tasks find their words known."""
    return Encoder(path)


def build(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of one shard."""
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length()) if n else 1
    pages = max(1, -(-n // (8 * PAGE)))
    planes, ranks, zeros = [], [], []
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels - 1, -1, -1):
        ones = (now & now.dtype.type(1 << level)) != 0
        padded = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
        packed = np.packbits(ones, bitorder="little")
        padded[: len(packed)] = packed
        counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        planes += [padded[k * PAGE : (k + 1) * PAGE] for k in range(pages)]
        ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
        zeros.append(n - int(ones.sum()))
        bits, rows = pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(packed)]), pa.array(now)
        now = np.concatenate([rows.filter(pc.invert(bits)).to_numpy(), rows.filter(bits).to_numpy()])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    frames = [squeeze(x.tobytes()) for x in (*planes, *ranks, np.concatenate([ends, doc_ids]).astype(np.int64))]
    head = np.array([MAGIC, n, len(doc_ids), levels, pages, 0, 0, 0, *zeros], np.int64)
    places = len(head.tobytes()) + 8 * (len(frames) + 1) + np.cumsum([0, *map(len, frames)])
    return b"".join([head.tobytes(), places.astype(np.int64).tobytes(), *frames])


class Shard:
    """A shard opened from its file; every method works on the bit-planes, of which only the pages it needs are inflated."""

    def __init__(self, file: bytes):
        magic, self.n, self.docs, self.levels, self.pages, *_ = np.frombuffer(file, np.int64, 8).tolist()
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.zeros = np.frombuffer(file, np.int64, self.levels, 64)
        self.places = np.frombuffer(file, np.int64, self.levels * (self.pages + 1) + 2, 64 + 8 * self.levels)
        self.file, self.inflated = file, {}

    def _frame(self, k: int, dtype) -> np.ndarray:
        if k not in self.inflated:
            self.inflated[k] = zstandard.ZstdDecompressor().decompress(self.file[self.places[k] : self.places[k + 1]])
        return np.frombuffer(self.inflated[k], dtype)

    @property
    def ends(self) -> np.ndarray:
        return self._frame(self.levels * (self.pages + 1), np.int64)[: self.docs]

    @property
    def doc_ids(self) -> np.ndarray:
        return self._frame(self.levels * (self.pages + 1), np.int64)[self.docs :]

    def _bit(self, level: int, at: int) -> int:
        page, byte = divmod(at >> 3, PAGE)
        return int(self._frame(level * self.pages + page, np.uint8)[byte] >> (at & 7)) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones before position ``at`` of a plane."""
        block = at // BLOCK
        count = int(self._frame(self.levels * self.pages + level, np.uint32)[block])
        if at % BLOCK:
            page, first = divmod(block * (BLOCK // 8), PAGE)
            plane, last = self._frame(level * self.pages + page, np.uint8), first + (at % BLOCK >> 3)
            count += int(np.bitwise_count(plane[first:last]).sum())
            count += (int(plane[last]) & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0
        return count

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value, at = value << 1 | bit, int(self.zeros[level]) + ones if bit else at - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._ones(level, start), self._ones(level, stop)
            start, stop = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if token >> (self.levels - 1 - level) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token among positions start to stop."""
        if token >> self.levels:
            return 0
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of a token, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            rank, lo, hi = at - (int(self.zeros[level]) if bit else 0), 0, self.n
            while lo < hi:  # the position after which rank + 1 such bits have passed
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                lo, hi = (lo, mid) if (ones if bit else mid + 1 - ones) > rank else (mid + 1, hi)
            at = lo
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids in order, by undoing the levels from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([self._frame(level * self.pages + k, np.uint8) for k in range(self.pages)])
            ones = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(now)
            zeros = int(self.zeros[level])
            before[~ones], before[ones] = now[:zeros], now[zeros:] | now.dtype.type(1 << (self.levels - 1 - level))
            now = before
        return now


def _shards(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def cut() -> pa.RecordBatch:
        ids, lengths, docs = (np.concatenate(x) for x in zip(*held, strict=True))
        file = build(ids, docs, np.cumsum(lengths))
        return pa.RecordBatch.from_arrays([pa.array(docs[:1]), pa.array([len(ids)], pa.int64()), pa.array([file], pa.binary())], names=["first_doc", "n_ids", "file"])

    for batch in batches:
        for part in slices(batch, limit=PIECE_BYTES):
            docs = part.column("doc_id").cast(pa.int64()).fill_null(_NULL).to_numpy()
            ids, lengths = encoder(part.column("text"))
            ends, start = np.concatenate([[0], np.cumsum(lengths)]), 0
            while start < len(docs):
                stop = int(np.searchsorted(ends, ends[start] + limit - size, "right")) - 1
                if stop <= start and held:  # the next document does not fit
                    yield cut()
                    held, size = [], 0
                    continue
                stop = max(stop, start + 1)
                held.append((ids[ends[start] : ends[stop]], lengths[start:stop], docs[start:stop]))
                size += int(ends[stop] - ends[start])
                start = stop
    if held:
        yield cut()


_NULL = -(2**63)


def write_shards(docs: DataFrame, path: str, tokenizer: str, limit: int = SHARD_IDS, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order to a table of shards at ``path``.

    The shards' order is that of (part, piece): partitions hold rising ranges of doc_id.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select("doc_id", "text")
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(lambda it: _shards(it, tokenizer, limit), "first_doc long, n_ids long, file binary")
        .withColumn("shard", F.monotonically_increasing_id())
        .write.mode("overwrite")
        .parquet(path)
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, file in zip(batch.column("start").to_pylist(), batch.column("file"), strict=True):
            shard = Shard(file.as_py())
            raw = shard.ids().astype("<u4").tobytes()
            ends = shard.ends
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            shard.inflated.clear()
            crc = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            docs = shard.doc_ids
            ids = pa.array(docs, mask=docs == _NULL)
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts + start), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """What the files at a path hold: doc_id, start, n_tokens, ids_crc32 for each document."""
    # One number for each shard: the ids of all shards before it.
    sizes = shards.select("shard", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    starts = sizes.select("shard", before.alias("start"))
    return shards.join(small(starts), "shard").select("start", "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, limit: int = SHARD_IDS) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and return what is read back from them."""
    path = f"{shared_folder(docs.sparkSession)}/shards"
    write_shards(docs, path, tokenizer or tokenizer_path(), limit)
    return read_shards(docs.sparkSession.read.schema("first_doc long, n_ids long, file binary, shard long").parquet(path))
