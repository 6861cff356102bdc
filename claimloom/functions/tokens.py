"""Tokens and sentences of a text as a table function: ``SELECT ... FROM documents, LATERAL tokens_of(text)``.

A token is a number with its inner marks, a word, or any other character that is no white space; a
contraction is cut before its ending. Offsets count code points, so every token slices back to its surface.
A sentence ends at a full stop, exclamation or question mark, and closing marks right after it, where white space
and then a capital, a digit or an opening mark follow; a stop after an abbreviation or a single letter ends none. A line
break ends a segment too, unless the line goes on.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructField, StructType

#: Words after which a broken line goes on, in their order; characters that may open a segment.
GOES_ON = "and or but of to for with by from in on at the a an as that which than per".split()
OPENERS = "([{$“\"'"
#: Marks that end a sentence, that may close one, and words that a full stop after them shortens.
ENDS, CLOSERS = ".!?", ")]}\"'”’"
SHORTENED = "mr mrs ms dr prof st no nr vs etc inc ltd co corp approx fig jan feb mar apr jun jul aug sep sept oct nov dec".split()
SPACE = " \\t\\n\\x0B\\f\\r"
#: Numbers, words with inner apostrophes, white space, and single marks.
PATTERN = re.compile(rf"[0-9]+(?:[.,:/][0-9]+)*|[^\W_]+(?:['’][^\W_]+)*|[{SPACE}]+|(?:[^\w{SPACE}]|_)")
CONTRACTED = re.compile(r"(.+?)(n['’]t|['’](?:s|re|ve|ll|d|m))", re.IGNORECASE | re.DOTALL)


def pieces(text: str) -> Iterator[tuple[str, int, bool, bool]]:
    """Surface, start, whether white space stands before, and whether a line feed is in it."""
    gap = broke = False
    for m in PATTERN.finditer(text):
        surface, at = m[0], m.start()
        if surface[0] in " \t\n\x0b\f\r":
            gap, broke = True, "\n" in surface
            continue
        short = ("'" in surface or "’" in surface) and CONTRACTED.fullmatch(surface)
        for part in short.groups() if short else (surface,):
            yield part, at, gap, broke
            at += len(part)
            gap = broke = False


def begins(before: list[str], surface: str, gap: bool, broke: bool) -> bool:
    """Whether a token begins a sentence; ``before`` has the last three tokens, the nearest first."""
    if not gap or "a" <= surface[0] <= "z" or not (surface[0] in OPENERS or surface[0] in "0123456789" or unicodedata.category(surface[0]) == "Lu"):
        return False
    last, second, third = before
    if broke and last.casefold() not in GOES_ON and last[-1:] not in (",", "-", "/"):
        return True
    if last in CLOSERS and last and second in ENDS and second:
        last, second = second, third
    if last not in ENDS or not last:
        return False
    return last != "." or not (second.lower() in SHORTENED or len(second) == 1 and second.isalpha())


def tokenized(text: str | None) -> Iterator[tuple[int, int, str, int, int]]:
    """Sentence, place, surface, start and end of each token of a text; none of a null one."""
    sent, before = 0, ["", "", ""]
    for k, (surface, at, gap, broke) in enumerate(pieces(text or "")):
        sent += k > 0 and begins(before, surface, gap, broke)
        yield sent, k, surface, at, at + len(surface)
        before = [surface, *before[:2]]


SCHEMA = "sent int, tok_idx int, surface string, char_start int, char_end int"


class TokensOf:
    """The table function; it holds nothing from row to row."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str, int, int]]:
        yield from tokenized(text)


def register(spark: SparkSession) -> None:
    """Make ``tokens_of(text)`` known to the session's SQL."""
    spark.udtf.register("tokens_of", udtf(TokensOf, returnType=SCHEMA, useArrow=True))


#: Rows that leave a task at once, about.
ROWS = 50_000


def flat(text: str | None) -> tuple[list[int], list[int], list[str], list[int], list[int]]:
    """What ``tokenized`` gives, as columns from one loop: a word without marks that may begin no sentence costs no call."""
    sents, surfaces, starts, ends = [], [], [], []
    at = sent = 0
    gap = broke = False
    last = second = third = ""
    for piece in PATTERN.findall(text or ""):
        first = piece[0]
        if first in " \t\n\x0b\f\r":
            gap, broke = True, "\n" in piece
            at += len(piece)
            continue
        short = CONTRACTED.fullmatch(piece) if "'" in piece or "’" in piece else None
        for surface in short.groups() if short else (piece,):
            if gap and not "a" <= first <= "z" and surfaces and begins([last, second, third], surface, gap, broke):
                sent += 1
            sents.append(sent)
            surfaces.append(surface)
            starts.append(at)
            at += len(surface)
            ends.append(at)
            last, second, third = surface, last, second
            gap = broke = False
    return sents, list(range(len(surfaces))), surfaces, starts, ends


def sentence_spans(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Number, start of the first token and end of the last one of each sentence of a text, as columns."""
    sents, _, _, starts, ends = flat(text)
    heads = np.flatnonzero(np.diff(np.asarray(sents, np.int32), prepend=-1))
    return list(range(len(heads))), [starts[k] for k in heads], [ends[k - 1] for k in [*heads[1:], len(sents)]] if sents else []


def _spread(documents: DataFrame, key: str, schema: str, columns_of: Callable[[str | None], tuple[list, ...]]) -> DataFrame:
    """The rows of each text beside its key, as columns from batch to batch; a long text leaves in several batches."""
    out = StructType([StructField(key, documents.schema[key].dataType), *StructType.fromDDL(schema)])
    names, kinds = out.names, [{"int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()] for f in out.fields[1:]]

    def made(keys: pa.Array, places: list[int], held: list[list]) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(c, k) for c, k in zip(held, kinds, strict=True)]
        whole = pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int32())), *columns], names=names)
        yield from (whole.slice(at, ROWS) for at in range(0, len(places), ROWS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            places, held = [], [[] for _ in kinds]
            for place in range(len(texts)):
                found = columns_of(texts[place].as_py())
                for column, more in zip(held, found, strict=True):
                    column += more
                places += [place] * len(found[0])
                if len(places) >= ROWS:
                    yield from made(keys, places, held)
                    places, held = [], [[] for _ in kinds]
            yield from made(keys, places, held)

    return documents.select(key, "text").mapInArrow(spread, out)


def tokens(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each token of ``text``: the key, sent, tok_idx, surface, char_start and char_end; those of the table function, which the session's SQL knows then too."""
    register(documents.sparkSession)
    return _spread(documents, key, SCHEMA, flat)


def sentences(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each sentence's span from its first token to its last: the key, sent, sent_start, sent_end."""
    return tokens.groupBy(key, "sent").agg(F.min("char_start").alias("sent_start"), F.max("char_end").alias("sent_end"))


def sentences_in(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``sentences`` of the tokens of ``text``, one row for each leaving the task; rows of one key are one text's."""
    found = _spread(documents, key, "sent int, char_start int, char_end int", sentence_spans)
    return sentences(found, key)
