"""Ranked full-text search: postings, a query language, BM25, filters, snippets and highlights.

Ranking is Okapi BM25 (k1 = 1.2, b = 0.75) for each field, times the field's and the term's boost. Corpus
statistics come from all documents; scopes, phrases and exclusions filter without changing scores. An index is a
table of postings made for the search, or one that is kept (``search_index.Stored``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from coppice.functions.text import UUID, escape_html, literal, terms

if TYPE_CHECKING:
    from coppice.operators.search_index import Stored

K1, B = 1.2, 0.75
#: Boosts by field.
BOOSTS = {"title": 10.0, "doc_no": 5.0, "type": 2.0, "content": 1.0}
#: Names of the fields in a match reason, in its order.
REASONS = (("title", "title"), ("doc_no", "doc number"), ("type", "type"), ("content", "content"))
LEAD, WINDOW, PAGE = 60, 160, 500
#: Characters of a term that its deletion variants are made from.
PREFIX = 7
#: For ``functions.text.terms`` in the bytes of a text in lower case: all others are blanks. And terms to a batch of postings.
_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
HELD = 1 << 16
#: Shapes of words that get special treatment.
TICKER = re.compile(r"[a-z]{0,2}[A-Z]{2,}[0-9]*")
HEX_PREFIX = re.compile(r"0[xX][0-9a-fA-F]*")
REGISTRY_ID = re.compile(r"[A-Z][A-Z0-9_]{2,}")


@dataclass(frozen=True)
class Term:
    """One search term: its field (any if None), how it matches, its boost, and whether it must or must not occur."""

    text: str
    field: str | None = None
    prefix: bool = False
    edits: int = 0
    boost: float = 1.0
    presence: str = "may"


@dataclass
class Query:
    terms: list[Term] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    scope: str | None = None
    type: str | None = None
    id: str | None = None
    registry_id: str | None = None
    #: Whether the words can't be read even as prefixes, so that nothing is found.
    nothing: bool = False

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys([*(t.text for t in self.terms if t.presence != "not"), *self.phrases]))


def parse(text: str) -> Query:
    """Query language: words, ``"phrase"``, ``field:word``, ``in:PREFIX``, ``type:"two words"``, ``word*``, ``~N``, ``^N``, ``+``, ``-``.

    Upper-case tickers of 3 to 8 characters are phrases too, unless excluded; a bare hexadecimal prefix is a
    wildcard. If some word does not follow the syntax (an operator or field without a word), each is tried once more
    with ``*`` behind it; if that does not follow it either (a field that there is none of, a number of edits or a
    boost that is no number), the query finds nothing.
    """
    q = Query()
    trimmed = text.strip()
    if re.fullmatch(UUID, trimmed, re.IGNORECASE):
        q.id = trimmed.lower()
        return q
    if REGISTRY_ID.fullmatch(trimmed):
        q.registry_id = trimmed
    for m in re.finditer(r"(?<!\w)in:(\S+)", text, re.IGNORECASE):
        q.scope = m.group(1).upper()  # the last one wins
    text = re.sub(r"(?<!\w)in:\S+", " ", text, flags=re.IGNORECASE)
    for m in re.finditer(r'(?<!\w)type:"([^"]+)"', text, re.IGNORECASE):
        q.type = m.group(1)
    text = re.sub(r'(?<!\w)type:"[^"]+"', " ", text, flags=re.IGNORECASE)
    q.phrases = [p.strip() for p in re.findall(r'"([^"]+)"', text) if p.strip()]
    words = re.sub(r'"([^"]+)"', r" \1 ", text).split()
    read = [_word(w) for w in words]
    if None in read:
        read = [_word(f"{w}*") for w in words]
        q.nothing = None in read
    for w, parts in zip(words, read, strict=True):
        sign, name, body, star, edits, boost, behind = parts or [""] * 7
        bare = body if not name else ""
        if sign != "-" and 3 <= len(bare) <= 8 and TICKER.fullmatch(bare) and bare not in q.phrases:
            q.phrases.append(bare)
        presence = {"+": "must", "-": "not"}.get(sign, "may")
        numbered = bool(edits or boost)
        wild = bool(star or behind and not numbered) or (len(words) == 1 and HEX_PREFIX.fullmatch(w) is not None)
        tokens = re.findall(r"[a-z0-9]+", body.lower()) or [""] * (not body and wild)
        q.terms += [Term(token, name or None, wild and not edits, int(edits or 0), float(boost or 1), presence) for token in tokens]
        if behind and numbered:  # a wildcard behind a number is a term of its own
            q.terms.append(Term("", prefix=True))
    return q


_TERM = re.compile(r"([+-]?)(?:(title|type|doc_no|content):)?([^:~^]*?)(\*?)(?:~(\d+))?(?:\^(\d+(?:\.\d+)?))?(\*?)")


def _word(w: str) -> tuple | None:
    """Sign, field, body, wildcard, edits, boost and what is behind them of a word; none if it does not follow the syntax."""
    m = _TERM.fullmatch(w)
    return m.groups() if m and (m[3] or m[4] or m[7]) else None


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, dl, term, tf``: occurrences of each term in each field, and the field's length in terms.

    Each row is a document of its own. Terms are counted where the text is, in Arrow batches: no shuffle.
    """
    rows = docs.select(key, *(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).cast("binary").alias(f"_f{i}") for i, f in enumerate(fields)))
    schema = StructType([docs.select(key).schema[0], *(StructField(n, t) for n, t in (("field", StringType()), ("dl", LongType()), ("term", StringType()), ("tf", LongType())))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, f in enumerate(fields):
                for at, sizes, lengths, words, numbers in _counted(batch.column(i + 1)):
                    rows_of = np.repeat(at, sizes)
                    columns = [pa.array([f], type=pa.string()).take(pa.array(np.zeros(len(words), dtype=np.int64))), pa.array(np.repeat(lengths, sizes)), pa.array(words, type=pa.binary()).cast(pa.string()), pa.array(numbers, type=pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_of)), *columns], names=schema.names)

    return rows.mapInArrow(count, schema)


def _counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[int]]]:
    """Places of the texts that have terms, how many different ones and how many in all; the terms and their counts, text after text."""
    at, sizes, lengths, words, numbers = [], [], [], [], []
    for place, text in enumerate(texts):
        found = Counter(text.as_py().translate(_BYTES).split())
        if found:
            at.append(place)
            sizes.append(len(found))
            lengths.append(found.total())
            words += found.keys()
            numbers += found.values()
        if len(words) >= HELD:
            yield np.array(at), np.array(sizes), np.array(lengths, dtype=np.int64), words, numbers
            at, sizes, lengths, words, numbers = [], [], [], [], []
    if words:
        yield np.array(at), np.array(sizes), np.array(lengths, dtype=np.int64), words, numbers


def field_stats(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``field, n, avgdl``: documents and mean length in terms; one pass over the texts."""
    size = lambda f: F.size(terms(F.coalesce(F.col(f).cast("string"), F.lit(""))))
    one = docs.agg(F.count("*").alias("n"), *(F.avg(size(f)).alias(f"_{f}") for f in fields))
    return one.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("avgdl")) for f in fields))).alias("s")).select("s.field", "n", "s.avgdl")


def dictionary(index: DataFrame) -> DataFrame:
    """``field, term, df``: documents that hold each term."""
    return index.groupBy("field", "term").agg(F.count("*").alias("df"))


def vocabulary(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``dictionary`` straight from the texts: different terms of each, counted once; no postings are made."""
    held = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.array_distinct(terms(F.coalesce(F.col(f).cast("string"), F.lit("")))).alias("ts")) for f in fields))).alias("f")
    return docs.select(held).select("f.field", F.explode("f.ts").alias("term")).groupBy("field", "term").agg(F.count("*").alias("df"))


def deletion_variants(text: str, edits: int) -> list[str]:
    """What is left of the first ``PREFIX`` characters after so many deletions at most.

    Two words within so many edits have one of these in common, so they meet by equality.
    """
    found = level = {text[:PREFIX]}
    for _ in range(edits):
        level = {v[:i] + v[i + 1 :] for v in level for i in range(len(v))}
        found = found | level
    return sorted(found)


def variants_of(words: DataFrame, edits: int) -> DataFrame:
    """``term, variant`` of the terms in ``words``: the column form of ``deletion_variants``."""
    less = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(PREFIX))))
    level = F.array(F.substring("term", 1, PREFIX))
    found = level
    for _ in range(min(edits, PREFIX)):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda v: v != ""), less)))
        found = F.array_union(found, level)
    return words.select("term", F.explode(found).alias("variant"))


def entries_of(query: Query, of: Callable[[Term], DataFrame], spark: SparkSession) -> DataFrame:
    """``field, term, df, q, boost, presence``: the dictionary entries that ``of`` gives each of the query's terms."""
    out = None
    for i, t in enumerate(query.terms):
        found = of(t)
        if t.field:
            found = found.where(F.col("field") == t.field)
        part = found.select("field", "term", "df", F.lit(i).alias("q"), F.lit(t.boost).alias("boost"), F.lit(t.presence).alias("presence"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "field string, term string, df long, q int, boost double, presence string")


def matching_terms(words: DataFrame, query: Query) -> DataFrame:
    """Dictionary entries that some term of the query matches: ``field, term, df, q, boost, presence``.

    Wildcards are tried on the dictionary, whose size is the vocabulary's, not on the postings. Edits are: terms of
    about the same length meet the searched one by a deletion variant, and only those are measured.
    """

    def of(t: Term) -> DataFrame:
        if not t.edits:
            return words.where(F.col("term").startswith(t.text) if t.prefix else F.col("term") == t.text)
        size = F.length("term")
        alike = words.where(size.between(len(t.text) - t.edits, len(t.text) + t.edits))
        near = variants_of(alike.select("term").distinct(), t.edits).where(F.col("variant").isin(deletion_variants(t.text, t.edits))).select("term").distinct()
        return alike.join(near.where(F.levenshtein("term", F.lit(t.text)) <= t.edits), "term")

    return entries_of(query, of, words.sparkSession)


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def score(index: DataFrame | Stored, stats: DataFrame | None, query: Query, key: str, boosts: dict[str, float] | None = None) -> DataFrame:
    """``key, score, fields, matched``: documents in which a term occurs, every ``+`` term does and no ``-`` term does.

    A stored index brings its own statistics.
    """
    boosts = boosts or BOOSTS
    table = F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv))
    if isinstance(index, DataFrame):
        if not any(t.prefix or t.edits for t in query.terms):
            index = index.where(F.col("term").isin(*{t.text for t in query.terms}))
        found = index.join(matching_terms(dictionary(index), query), ["field", "term"])
    else:
        stats = index.stats
        found = index.held(query).join(index.entries(query), ["field", "term"])
    if query.nothing:
        found = found.where(F.lit(False))
    found = found.join(F.broadcast(stats), "field")  # one row to a field
    part = bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl")) * F.coalesce(F.element_at(table, F.col("field")), F.lit(1.0)) * F.col("boost")
    wanted = F.col("presence") != "not"
    out = found.groupBy(key).agg(
        F.sum(F.when(wanted, part)).alias("score"),
        F.collect_set(F.when(wanted, F.col("field"))).alias("fields"),
        F.collect_set(F.when(wanted, F.col("term"))).alias("matched"),
        F.collect_set("q").alias("_q"),
    )
    for i, t in enumerate(query.terms):
        if t.presence == "must":
            out = out.where(F.array_contains("_q", i))
        elif t.presence == "not":
            out = out.where(~F.array_contains("_q", i))
    return out.where("score is not null").drop("_q")


def in_scope(doc_no: Column, prefix: str) -> Column:
    return (F.upper(doc_no) == prefix.upper()) | F.upper(doc_no).startswith(f"{prefix.upper()}.")


def has_phrases(phrases: list[str], *columns: Column) -> Column:
    out = F.lit(True)
    for p in phrases:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(c).contains(p.lower()), F.lit(False))
        out = out & hit
    return out


def match_reason(fields: Column, phrases: bool = False) -> Column:
    return F.concat_ws(" + ", *(F.when(F.array_contains(fields, f), label) for f, label in REASONS), *[F.lit("exact phrase")] * phrases)


def snippet(content: Column, words: list[str] | Column, lead: int = LEAD, window: int = WINDOW) -> Column:
    """``window`` characters from ``lead`` before the earliest word; the head if none occurs; empty without words.

    words: the same for all rows, or an array of each row's own.
    """
    if isinstance(words, list):
        words = F.array(*(F.lit(w) for w in words)).cast("array<string>")
    at = F.array_min(F.filter(F.transform(words, lambda w: F.instr(F.lower(content), F.lower(w))), lambda i: i > 0))
    start = F.greatest(F.lit(0), at - 1 - lead)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(content, start + 1, F.lit(window)), F.when(start + window < F.length(content), "…").otherwise(""))
    empty = (F.coalesce(content, F.lit("")) == "") | (F.size(words) == 0)
    return F.when(empty, "").when(at.isNull(), F.concat(F.substring(content, 1, window), F.lit("…"))).otherwise(cut)


def head(content: Column, window: int = WINDOW) -> Column:
    return F.concat(F.substring(content, 1, window), F.when(F.length(content) > window, "…").otherwise(""))


def highlight(text: Column, words: list[str] | Column) -> Column:
    """Escaped text with each word of two characters or more, to its end, in ``<mark>``; words as in ``snippet``."""
    safe = escape_html(text)
    if isinstance(words, list):
        usable = [literal(w) + r"\w*" for w in words if len(w) >= 2]
        return F.regexp_replace(safe, "(?i)(" + "|".join(usable) + ")", "<mark>$1</mark>") if usable else safe
    quoted = F.transform(F.filter(words, lambda w: F.length(w) >= 2), lambda w: F.concat(F.regexp_replace(w, r"([^A-Za-z0-9_\s])", r"\\$1"), F.lit(r"\w*")))
    pattern = F.concat(F.lit("(?i)("), F.array_join(quoted, "|"), F.lit(")"))
    return F.when(F.size(quoted) > 0, F.regexp_replace(safe, pattern, F.lit("<mark>$1</mark>"))).otherwise(safe)


def tiered(ranked: DataFrame, registry_hits: DataFrame, key: str) -> DataFrame:
    """Merge of ranked hits (``key, score``) with registry hits (``key``): both, registry only (score 2), ranked only."""
    r, c = ranked.withColumn("_r", F.lit(True)), registry_hits.select(key).distinct().withColumn("_c", F.lit(True))
    both = r.join(c, key, "full_outer")
    tier = F.when(F.col("_r") & F.col("_c"), 1).when(F.col("_c"), 2).otherwise(3)
    return both.withColumn("tier", tier).withColumn("score", F.coalesce("score", F.lit(2.0))).drop("_r", "_c")


def page(hits: DataFrame, number: int = 0, size: int = PAGE) -> DataFrame:
    return hits.offset(number * size).limit(size)


def hits(nodes: DataFrame, index: DataFrame | Stored, stats: DataFrame | None, text: str | Query, addresses: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Search results in their order: ``key, tier, score, doc_no, title, type, title_html, snippet, match_reason``.

    addresses: ``address, registry_name``, for queries that are a registry id and nodes with ``address_refs``.
    Snippets begin near, and marks are on, the terms that a row matched and the query's words; a node found by
    its registry name alone has its head and no marks.
    """
    q = parse(text) if isinstance(text, str) else text
    plain = escape_html(F.col("title"))
    if q.id:
        one = nodes.where(F.lower(F.col(key)) == q.id).withColumn("score", F.lit(1.0)).withColumn("tier", F.lit(3))
        return one.select(key, "tier", "score", "doc_no", "title", "type", plain.alias("title_html"), head(F.col("content")).alias("snippet"), F.lit("").alias("match_reason"))
    ranked, named = score(index, stats, q, key), F.lit(False)
    if q.registry_id and addresses is not None and not q.nothing:
        of = addresses.where(F.col("registry_name") == q.registry_id).select(F.col("address").alias("_a"))
        found = nodes.select(key, F.explode("address_refs").alias("_a")).join(of, "_a").select(key, F.lit(True).alias("_named")).distinct()
        ranked, named = ranked.join(found, key, "full_outer"), F.coalesce("_named", F.lit(False))
    keep = F.col("score").isNotNull() & has_phrases(q.phrases, F.col("title"), F.col("content"))
    if q.scope:
        keep &= in_scope(F.col("doc_no"), q.scope)
    if q.type:
        keep &= F.lower("type") == q.type.lower()
    tier = F.when(keep & named, 1).when(named, 2).when(keep, 3)
    out = ranked.join(nodes.select(key, "doc_no", "title", "type", "content", "ord"), key).withColumn("tier", tier).where("tier is not null")
    words = F.array_distinct(F.concat(F.array_sort("matched"), F.array(*(F.lit(w) for w in q.words)).cast("array<string>")))
    alone = F.col("tier") == 2
    why = match_reason(F.col("fields"), bool(q.phrases))
    reason = F.when(alone, "registry").when(F.col("tier") == 1, F.concat(F.lit("registry + "), why)).otherwise(why)
    title = F.when(alone, plain).otherwise(highlight(F.col("title"), words))
    cut = F.when(alone, escape_html(head(F.col("content")))).otherwise(highlight(snippet(F.col("content"), words), words))
    out = out.withColumn("score", F.when(alone, 2.0).otherwise(F.col("score")))
    return out.orderBy("tier", F.desc("score"), "ord").select(key, "tier", "score", "doc_no", "title", "type", title.alias("title_html"), cut.alias("snippet"), reason.alias("match_reason"))
