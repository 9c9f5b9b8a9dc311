"""String expressions whose semantics differ between engines, in one place."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries: Java's ``\b`` also counts non-ASCII letters.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: A 36-character identifier.
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def trim_all(c: Column) -> Column:
    """Strips every kind of white space, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def word(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries."""
    return f"{START}(?:{pattern}){END}"


def any_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def natural_key(doc_no: Column) -> Column:
    """Orders dotted numbers by value: numeric segments are padded, others follow them as text."""
    return F.transform(F.split(doc_no, r"\."), lambda s: F.when(s.rlike("^[0-9]+$"), F.lpad(s, 10, "0")).otherwise(s))


def terms(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def literal(text: str) -> str:
    """A regular expression that matches ``text`` alone, for Java and Python alike."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)
