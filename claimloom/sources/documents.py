"""Readers of document files and idempotent sinks.

PDF is not read: no public reader of it is installed here.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import media_type
from claimloom.operators.spans import pieces, starts_of

#: Characters of a document at most.
MOST_CHARS = 2_000_000

SCHEMA = "path string, media_type string, title string, text string, content_sha string"


def decoded(data: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252, else UTF-8 with replacements."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def plain_html(html: str) -> str:
    page = _Text()
    page.feed(html)
    page.close()
    return " ".join(" ".join(page.parts).split())


def csv_lines(text: str) -> str:
    """Rows as lines, cells joined by a bar; empty cells and rows of them are dropped, a line feed inside a cell becomes a blank.

    The dialect is guessed from the beginning: a comma, semicolon or tab, and quotes.
    """
    try:
        dialect: type[csv.Dialect] = csv.Sniffer().sniff(text[:4096], delimiters=",;\t")
    except csv.Error:
        dialect = csv.excel
    rows = csv.reader(io.StringIO(text, newline=""), dialect)
    lines = [" | ".join(cell.replace("\n", " ") for cell in row if cell) for row in rows]
    return "\n".join(line for line in lines if line)


def mail_text(data: bytes) -> tuple[str, str | None]:
    """Five headers, a blank line and the plain body (else the text of the HTML one), and the subject.

    Folded headers become one line; what cannot be parsed is left out, so a broken mail keeps the rest.
    """
    mail = email.message_from_bytes(data, policy=email.policy.default)
    heads = {}
    for name in ("From", "To", "Cc", "Date", "Subject"):
        try:
            value = " ".join(str(mail[name] or "").split())
        except (ValueError, LookupError, TypeError, AttributeError, IndexError):
            value = ""
        if value:
            heads[name] = value
    try:
        body = mail.get_body(("plain", "html"))
        content = body.get_content() if body else ""
        content = plain_html(content) if body and body.get_content_type() == "text/html" else content
    except (ValueError, LookupError, TypeError, AttributeError):
        raw = mail.get_payload(decode=True) if not mail.is_multipart() else None
        content = decoded(raw) if isinstance(raw, bytes) else ""
    return "\n".join([*(f"{k}: {v}" for k, v in heads.items()), "", content.strip()]), heads.get("Subject")


def extracted(data: bytes, kind: str) -> tuple[str, str | None]:
    """The text of a file, and its own title where it has one."""
    if kind == "text/csv":
        return csv_lines(decoded(data)), None
    if kind == "message/rfc822":
        return mail_text(data)
    return (plain_html(decoded(data)) if kind == "text/html" else decoded(data)), None


def read(spark: SparkSession, path: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """Text, CSV, mail and HTML files: path, media_type, title, text, content_sha, row_offsets and error, one row for each file.

    A file that cannot be used keeps a row that says why: ``unsupported``, ``unreadable``, ``empty`` or ``too long``; it
    has no text then. ``row_offsets`` are the character ranges of a CSV file's rows.
    """
    return texts_of(spark.read.format("binaryFile").load(path), most_chars)


def texts_of(files: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """The same of files that are read already (path, content), a batch or a stream."""
    known = files.select("path", media_type(F.col("path"), F.lit(None).cast("string")).alias("media_type"), "content")

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for data, kind in zip(f.pop("content"), f["media_type"], strict=True):
                try:
                    text, title = extracted(bytes(data), kind) if kind else (None, None)
                    error = None if kind else "unsupported"
                except (ValueError, LookupError, csv.Error, AssertionError):
                    text, title, error = None, None, "unreadable"
                if text is not None:
                    error = "empty" if not text.strip() else "too long" if len(text) > most_chars else None
                rows.append((None if error else text, title, error))
            f["text"], f["own"], f["error"] = zip(*rows, strict=True) if rows else ([], [], [])
            yield f

    read = known.mapInPandas(texts, "path string, media_type string, text string, own string, error string")
    title = F.substring(F.coalesce("own", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)), 1, 200)
    lines = F.when(F.col("media_type") == "text/csv", F.split("text", "\n"))
    spans_of = F.transform(F.arrays_zip(lines.alias("v"), starts_of(F.transform(lines, lambda x: F.length(x))).alias("s")), lambda r: F.struct(r["s"].alias("char_start"), (r["s"] + F.length(r["v"])).alias("char_end")))
    return read.select("path", "media_type", title.alias("title"), "text", F.sha2("text", 256).alias("content_sha"), spans_of.alias("row_offsets"), "error")


def csv_offsets(text: DataFrame) -> DataFrame:
    """Lines of each text with their character ranges."""
    return pieces(text, F.split("text", "\n"), ["doc_id"], "line", "value").drop("value")


def new_documents(incoming: DataFrame, known: DataFrame, key: str = "content_sha") -> DataFrame:
    """Incoming documents whose content is new, once each."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def replaced(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with all rows of the keys in ``new`` replaced: writing it twice changes nothing."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row for each key, the new one where there is one."""
    columns = [c for c in stored.columns if c != key]
    joined = stored.alias("s").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    has = F.col("n._new").isNotNull()
    return joined.select(key, *[F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns])
