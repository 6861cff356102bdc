"""Column builders for names, citations and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that a company name may end in.
LEGAL_FORMS = "ag bv co company corp corporation gmbh group holding holdings inc incorporated limited llc llp lp ltd nv partners plc pte pty sa sarl spa srl".split()
#: Patterns of the anchored weak labels.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
WEAK_LABELS = (
    ("MONEY", r"^\$\d[\d,]*(\.\d{2})?\z"),
    ("DATE", rf"^(\d{{1,2}} ({MONTHS}) \d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|({SHORT_MONTHS}) \d{{1,2}}, \d{{4}})\z"),
    ("ACCOUNT", r"^((INV|AP|ACCT)-\d{3,6}(-X)?|REF/\d{3,6}/[A-Z]|PO \d{4,8})\z"),
)
#: What letters fold to beyond their lower case, as far as Latin letters come of it; a blank stands for a mark that no name keeps.
FOLDS = {"ß": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": " n", "ǰ": "j ", "ẖ": "h ", "ẗ": "t ", "ẘ": "w ", "ẙ": "y ", "ẚ": "a "}


def folded(text: Column) -> Column:
    """Case folded, exact for all that becomes a Latin letter."""
    out = F.lower(text)
    for letter, others in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(others))
    return out


def normalized_name(name: Column) -> Column:
    """Case folded, runs of other characters as one space, all legal forms at the end dropped: a name of nothing else is empty."""
    line = F.trim(F.regexp_replace(folded(name), "[^0-9a-z& ]+", " "))
    line = F.regexp_replace(line, r"\s+", " ")
    return F.regexp_replace(line, rf"((^|\s+)({'|'.join(LEGAL_FORMS)}))+$", "")


def trigrams(text: Column) -> Column:
    """All runs of three characters of the text between two spaces."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.when(F.length(padded) >= 3, F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1) identifier of ``name`` in the hyphenated namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def sanitized(text: Column, most: int = 400) -> Column:
    """One line without control or format characters or the marks that delimit a quotation, cut at ``most`` with an ellipsis."""
    line = F.regexp_replace(F.translate(text, "\r\n\t", "   "), r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]", "")
    line = F.trim(F.regexp_replace(line, " +", " "))
    for mark in "<>":  # three in a row open or close the quoted text
        line = F.replace(line, F.lit(mark * 3), F.lit(" ".join(mark * 3)))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def stripped_html(html: Column) -> Column:
    """Tags as spaces, for pages whose tags are balanced."""
    return F.regexp_replace(html, "<[^>]*>", " ")


def weak_label(surface: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in reversed(WEAK_LABELS):
        out = F.when(surface.rlike(pattern), label).otherwise(out)
    return out


def media_type(filename: Column, declared: Column) -> Column:
    """The declared type without its charset if it is supported, else by file extension; null if neither."""
    kinds = {"txt": "text/plain", "csv": "text/csv", "eml": "message/rfc822", "html": "text/html", "htm": "text/html"}
    plain = F.trim(F.lower(F.split(declared, ";")[0]))
    by_name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))]
    return F.coalesce(F.when(plain.isin(*set(kinds.values())), plain), by_name)


def received_at(raw: Column) -> Column:
    """An ISO time; one without a zone is UTC, one that is no time is null."""
    zoned = F.when(raw.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), raw).otherwise(F.concat(raw, F.lit("Z")))
    return F.try_to_timestamp(zoned)
