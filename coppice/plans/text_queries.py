"""Search, extraction and vector queries over the standard tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from coppice.operators import extraction as X
from coppice.operators import history as D
from coppice.operators import parsing as P
from coppice.operators import search as S
from coppice.operators import vectors as V
from coppice.operators import search_index as I
from coppice.operators.tools import Tools
from coppice.sources import readers, scratch, sinks, views
from coppice.sources.tables import load, spread

K = 20


def _documents(spark, d):
    return load(spark, d, "documents")


#: Folders of the indexes that this application has made, by table folder and name.
_INDEXES: dict[tuple[str, str, str], str] = {}


def _index(spark, d, name, batches, fields, key="doc_id"):
    """A stored index of the given batches, made at its first use and kept while the application runs."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _INDEXES:
        path = scratch.folder(spark, f"index-{name}")
        for docs in batches():
            I.add(docs, key, fields, path)
        _INDEXES[at] = path
    return I.open_index(spark, _INDEXES[at], key)


def _texts(spark, d):
    return _index(spark, d, "texts", lambda: [_documents(spark, d)], ["text"])


def _corpus(spark, d):
    return _index(spark, d, "corpus", lambda: [views.corpus(spark, d)], ["title", "type", "content"])


def _rank(index, query, boosts):
    hits = S.score(index, None, S.parse(query), "doc_id", boosts)
    return hits.select("doc_id", F.round("score", 6).alias("score"), "fields")


def _bm25_sql(view, boosts, rules):
    """rules: (term, field or None, boost)."""
    fields = list(boosts)
    tokens = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, regexp_extract_all(lower(coalesce({f}, '')), '[a-z0-9]+') AS ts FROM {view}" for f in fields)
    values = ", ".join(f"('{t}', {'NULL' if f is None else repr(f)}, {b}::DOUBLE)" for t, f, b in rules)
    weights = ", ".join(f"('{f}', {b}::DOUBLE)" for f, b in boosts.items())
    return f"""
tok AS ({tokens}),
st AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM tok GROUP BY field),
p AS (SELECT doc_id, field, len(ts) AS dl, unnest(ts) AS term FROM tok),
tf AS (SELECT doc_id, field, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
q(term, qfield, boost) AS (VALUES {values}),
w(field, weight) AS (VALUES {weights}),
part AS (SELECT tf.doc_id, tf.field, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * weight * boost AS s
  FROM tf JOIN df USING (field, term) JOIN q ON q.term = tf.term AND (qfield IS NULL OR qfield = tf.field) JOIN st USING (field) JOIN w USING (field))"""


QUERIES = {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


@query(f"WITH {_bm25_sql('documents', {'text': 1.0}, [(t, None, 1) for t in ('license', 'public', 'token', 'version')])} SELECT doc_id, round(sum(s), 6) AS score FROM part GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {K}")
def bm25_search(spark, d):
    return _rank(_texts(spark, d), "license public token version", {"text": 1.0}).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(K)


@query(f"WITH {views.CORPUS_SQL}, {_bm25_sql('corpus', {'title': 10.0, 'type': 2.0, 'content': 1.0}, [('the', 'title', 2), ('license', None, 1), ('de', 'type', 1)])} SELECT doc_id, round(sum(s), 6) AS score FROM part GROUP BY doc_id")
def bm25_fielded_boost(spark, d):
    return _rank(_corpus(spark, d), "title:the^2 license type:de", S.BOOSTS).select("doc_id", "score")


@query(f"WITH {views.CORPUS_SQL}, {_bm25_sql('corpus', {'title': 10.0, 'type': 2.0, 'content': 1.0}, [('the', None, 1), ('fr', None, 1)])} SELECT doc_id, concat_ws(' + ', CASE WHEN bool_or(field = 'title') THEN 'title' END, CASE WHEN bool_or(field = 'type') THEN 'type' END, CASE WHEN bool_or(field = 'content') THEN 'content' END) AS reason FROM part GROUP BY doc_id")
def match_reason(spark, d):
    hits = _rank(_corpus(spark, d), "the fr", S.BOOSTS)
    return hits.select("doc_id", S.match_reason(F.col("fields")).alias("reason"))


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%public license%' AND lower(text) LIKE '%version%'")
def search_phrase_filter(spark, d):
    q = S.parse('"public license" "version"')
    return _documents(spark, d).where(S.has_phrases(q.phrases, F.col("text"))).select("doc_id")


@query(f"WITH {views.OUTLINE_SQL} SELECT id, doc_no FROM outline WHERE doc_no = 'A.1' OR doc_no LIKE 'A.1.%'")
def search_scope_prefix(spark, d):
    return views.outline(spark, d).where(S.in_scope(F.col("doc_no"), S.parse("in:a.1").scope)).select("id", "doc_no")


_TERMS_SQL = "t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM documents)"


@query(f"WITH {_TERMS_SQL} SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 20")
def term_dictionary_df(spark, d):
    return S.vocabulary(_documents(spark, d), ["text"]).where("df >= 20").select("term", "df")


@query(f"WITH {_TERMS_SQL} SELECT term, count(*) AS df FROM t WHERE term LIKE 'licen%' OR term LIKE 'vers%' GROUP BY term")
def search_wildcard_terms(spark, d):
    words = S.vocabulary(_documents(spark, d), ["text"])
    return S.matching_terms(words, S.parse("licen* vers*")).select("term", "df").distinct()


@query(f"WITH {_TERMS_SQL} SELECT term, count(*) AS df FROM t WHERE levenshtein(term, 'licence') <= 2 GROUP BY term")
def search_fuzzy_terms(spark, d):
    words = S.vocabulary(_documents(spark, d), ["text"])
    return S.matching_terms(words, S.parse("licence~2")).select("term", "df")


@query(f"WITH {_TERMS_SQL} SELECT DISTINCT doc_id FROM t a WHERE term = 'license' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.term = 'mit')")
def search_exclude_terms(spark, d):
    return S.score(_texts(spark, d), None, S.parse("+license -mit"), "doc_id", {"text": 1.0}).select("doc_id")


_FOUR = [(t, None, 1) for t in ("license", "public", "token", "version")]


@query(f"WITH {_bm25_sql('documents', {'text': 1.0}, _FOUR)} SELECT doc_id, round(sum(s), 6) AS score FROM part GROUP BY doc_id")
def bm25_segments(spark, d):
    """An index made of a batch of documents for each language (and one without), searched as one."""
    docs = _documents(spark, d)
    languages = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    index = _index(spark, d, "segments", lambda: [docs.where(F.col("lang").eqNullSafe(F.lit(x))) for x in languages], ["text"])
    return _rank(index, "license public token version", {"text": 1.0}).select("doc_id", "score")


@query(f"WITH {_TERMS_SQL}, f AS (SELECT 'fuzzy' AS kind, term, count(*) AS df FROM t WHERE levenshtein(term, 'licence') <= 2 GROUP BY term UNION ALL SELECT 'wildcard', term, count(*) FROM t WHERE starts_with(term, 'licen') GROUP BY term UNION ALL SELECT 'exact', term, count(*) FROM t WHERE term = 'token' GROUP BY term) SELECT * FROM f")
def index_dictionary_entries(spark, d):
    """What a query's words stand for, looked up in the stored dictionary."""
    kinds = F.element_at(F.array(F.lit("fuzzy"), F.lit("wildcard"), F.lit("exact")), F.col("q") + 1)
    return _texts(spark, d).entries(S.parse("licence~2 licen* token")).select(kinds.alias("kind"), "term", "df")


@query(f"WITH {_TERMS_SQL}, h AS (SELECT term FROM t WHERE levenshtein(term, 'licence') <= 2 OR starts_with(term, 'vers')) SELECT doc_id, count(*) AS n_terms FROM t JOIN (SELECT DISTINCT term FROM h) USING (term) GROUP BY doc_id")
def search_stored_terms(spark, d):
    """Documents by a fuzzy word and a wildcard, each with the number of different terms that it matched."""
    hits = S.score(_texts(spark, d), None, S.parse("licence~2 vers*"), "doc_id", {"text": 1.0})
    return hits.select("doc_id", F.size("matched").cast("long").alias("n_terms"))


@query("""WITH r AS (SELECT doc_id, 1.0::DOUBLE AS s FROM documents WHERE lower(text) LIKE '%license%'), c AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT coalesce(r.doc_id, c.doc_id) AS doc_id, CASE WHEN r.doc_id IS NOT NULL AND c.doc_id IS NOT NULL THEN 1 WHEN c.doc_id IS NOT NULL THEN 2 ELSE 3 END AS tier, coalesce(r.s, 2.0::DOUBLE) AS score
FROM r FULL OUTER JOIN c ON r.doc_id = c.doc_id""")
def search_tier_merge(spark, d):
    ranked = _documents(spark, d).where(S.has_phrases(["license"], F.col("text"))).select("doc_id", F.lit(1.0).alias("score"))
    return S.tiered(ranked, load(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "tier", "score")


@query("""WITH p AS (SELECT doc_id, text, least(nullif(instr(lower(text), 'license'), 0), nullif(instr(lower(text), 'token'), 0)) AS i FROM documents),
s AS (SELECT *, greatest(0, i - 61) AS st FROM p)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' WHEN i IS NULL THEN substr(text, 1, 160) || '…'
  ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || substr(text, st + 1, 160) || CASE WHEN st + 160 < length(text) THEN '…' ELSE '' END END AS snippet FROM s""")
def search_snippet(spark, d):
    return _documents(spark, d).select("doc_id", S.snippet(F.col("text"), ["license", "token"]).alias("snippet"))


@query(f"WITH {views.CORPUS_SQL} SELECT doc_id, regexp_replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '(the\\w*|and\\w*)', '<mark>\\1</mark>', 'gi') AS html FROM corpus")
def search_highlight(spark, d):
    return views.corpus(spark, d).select("doc_id", S.highlight(F.col("title"), ["the", "and"]).alias("html"))


# -- parsing ----------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
s AS (SELECT *, length(line) <= 40 AS h, sum((length(line) <= 40)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS seg FROM l)
SELECT doc_id, seg::BIGINT AS seg, min(n)::INT AS first, max(n)::INT AS last, md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT h), '')) AS body FROM s WHERE seg > 0 GROUP BY doc_id, seg""")
def doc_segments(spark, d):
    lines = P.lines(_documents(spark, d), "doc_id").withColumn("is_heading", F.length("line") <= 40)
    return P.segments(lines, "doc_id").select("doc_id", "seg", "first", "last", F.md5("body").alias("body"))


def _uuid_sql(text):
    return f"substr(md5({text}), 1, 8) || '-' || substr(md5({text}), 9, 4) || '-' || substr(md5({text}), 13, 4) || '-' || substr(md5({text}), 17, 4) || '-' || substr(md5({text}), 21, 12)"


@query(f"WITH {views.OUTLINE_SQL} SELECT {_uuid_sql('id')} AS id, doc_no, title, type, depth, CASE WHEN up IS NOT NULL THEN {_uuid_sql('up')} END AS parent_id, content, (row_number() OVER (ORDER BY ord) - 1)::INT AS ord FROM outline")
def parse_large_text(spark, d):
    """The whole outline as the lines of one text, parsed in blocks of lines: headings, parents, contents, order."""
    nodes = views.outline(spark, d)
    heading = F.concat(F.repeat(F.lit("#"), F.col("depth")), F.lit(" "), "doc_no", F.lit(" - "), "title", F.lit(" ["), "type", F.lit("]  <!-- UUID: "), F.expr(_uuid_sql("id")), F.lit(" -->"))
    rows = nodes.select(F.lit("all").alias("text"), F.floor(F.col("ord") / 1000).alias("block"), F.posexplode(F.array(heading, "content")).alias("at", "line"), "ord")
    parsed = P.parse_lines(rows.withColumn("n", F.col("ord") * 2 + F.col("at")), "text")
    return parsed.select("id", "doc_no", "title", "type", "depth", "parent_id", "content", "ord")


@query("SELECT 'c,' || c_custkey AS key, '{\"' || c_name || '\", }' AS label, c_mktsegment AS chain, [c_name, 'a\"b,]'] AS roles FROM customer")
def json_map_round_trip(spark, d):
    """Customers written as JSON objects of 500 members, with brackets, quotes and commas in their strings, and read again in blocks."""
    rows = load(spark, d, "customer").selectExpr("concat('c,', c_custkey) AS key", "concat('{\"', c_name, '\", }') AS label", "c_mktsegment AS chain", "array(c_name, 'a\"b,]') AS roles", "c_custkey div 500 AS file")
    path = scratch.folder(spark, "maps")
    sinks.json_objects(rows, "key", "file", path)
    return readers.json_map(spark, path, "struct<label: string, chain: string, roles: array<string>>").select("key", "value.*")


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_content_hash(spark, d):
    hashed = D.with_hash(views.corpus(spark, d).where("content is not null"))
    return hashed.groupBy(F.col("content_hash").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


# -- extraction -------------------------------------------------------------------------------------------------

HEX40 = r"(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])"
EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def _found(spark, d, pattern, kind):
    rows = X.first_by_key(X.occurrences(_documents(spark, d).where("text is not null"), "doc_id", "text", pattern, kind), "doc_id")
    return rows.select("doc_id", F.col("address").alias("found"), F.col("pos").cast("long").alias("pos"))


def _found_sql(pattern, where="true"):
    return f"SELECT DISTINCT doc_id, found, instr(text, found) - 1 AS pos FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{pattern}')) AS found FROM documents) WHERE {where}"


@query(_found_sql("[0-9a-f]{40,}", "length(found) = 40"))
def extract_hex_tokens(spark, d):
    return _found(spark, d, HEX40, "hex")


@query(f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS found FROM documents")
def extract_emails(spark, d):
    return _found(spark, d, EMAIL, "email").select("doc_id", "found")


@query(f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{IPV4}')) AS found FROM documents")
def extract_ipv4(spark, d):
    return _found(spark, d, IPV4, "ip").select("doc_id", "found")


@query(f"""WITH m AS (SELECT DISTINCT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '{EMAIL}')) AS found FROM documents
 UNION ALL SELECT DISTINCT doc_id, 'ip', unnest(regexp_extract_all(text, '{IPV4}')) FROM documents)
SELECT found, count(*) AS refs, min(doc_id) AS first_doc, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM m GROUP BY found""")
def merge_mentions(spark, d):
    rows = _found(spark, d, EMAIL, "email").withColumn("kind", F.lit("email")).unionByName(_found(spark, d, IPV4, "ip").withColumn("kind", F.lit("ip")))
    return rows.groupBy("found").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


TAGS = {"licence": ["(?i)licen[cs]e"], "mail": ["@"], "loud": ["[A-Z]{6,}"], "number": ["[0-9]{6,}"], "mit": ["MIT"]}


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p[0]}') THEN '{t}' END" for t, p in TAGS.items()) + ") AS tags FROM documents")
def multi_label_tags(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(X.tags_of(F.col("text"), TAGS), ",").alias("tags"))


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hs FROM pages), u AS (SELECT page_id, unnest(range(len(hs))) AS i, unnest(hs) AS target FROM h),
f AS (SELECT page_id, target, min(i) AS i FROM u GROUP BY ALL) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, target FROM f""")
def extract_links(spark, d):
    return X.links(load(spark, d, "pages"), "page_id", "html", r'href="([^"]+)"')


@query("""WITH a AS (SELECT 'c' || c_custkey AS address, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS registry, n_name AS own, r_name AS verified FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT address, coalesce(registry, own, verified) AS label, array_to_string(list_sort(list_filter(list_distinct([registry, own, verified]), lambda x: x IS NOT NULL AND x <> coalesce(registry, own, verified))), ',') AS aliases FROM a""")
def enrich_label_priority(spark, d):
    """Customers as addresses: a registry of those in building, the nation as their own label, the region as verified name."""
    c, n, r = (load(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    address = F.concat(F.lit("0x"), F.col("c_custkey").cast("string"))
    empty = F.array().cast("array<string>")
    addresses = rows.select(address.alias("address"), F.lit("ethereum").alias("chain"), F.lit("").alias("explorer_url"), F.col("n_name").alias("label"), empty.alias("roles"), empty.alias("aliases"), empty.alias("tokens"))
    registry = rows.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("name"), address.alias("address"), F.lit(0).alias("ord"))
    verified = rows.select(F.lit(1).alias("chain_id"), address.alias("address"), F.col("r_name").alias("contract_name"), F.lit(False).alias("is_proxy"), F.lit("").alias("implementation"))
    out = X.enrich(addresses, registry, verified)
    return out.select(F.regexp_replace("address", "^0x", "c").alias("address"), "label", F.array_join("aliases", ",").alias("aliases"))


# -- vectors ----------------------------------------------------------------------------------------------------


def _probe(spark, d):
    vectors = load(spark, d, "embeddings")
    found = vectors.where("vec_id = 0").select("embedding").first()
    return vectors, [float(x) for x in found[0]] if found else []


_DOT = "list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def vec_topk(spark, d):
    vectors, q = _probe(spark, d)
    return V.top_k(vectors, q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def vec_topk_typed(spark, d):
    vectors, q = _probe(spark, d)
    return V.top_k(vectors, q, 10, where=F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT label, count(*) AS n FROM (SELECT label FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 50) GROUP BY label")
def vec_nearest_label_vote(spark, d):
    vectors, q = _probe(spark, d)
    return V.top_k(vectors, q, 50).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def vec_normalize_norms(spark, d):
    v = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.norm(V.normalised(v)), 6).alias("unit"))


@query(f"""WITH {views.OUTLINE_SQL} SELECT a.id, substr(array_to_string(list_filter([a.doc_no || ' - ' || a.title || ' [' || a.type || ']', b.doc_no || ' - ' || b.title, c.doc_no || ' - ' || c.title, a.content], lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10)), 1, 5000) AS embed_text
FROM outline a LEFT JOIN outline b ON a.up = b.id LEFT JOIN outline c ON b.up = c.id""")
def chunk_embed_text(spark, d):
    nodes = P.heading_parent(views.outline(spark, d), "root")
    return V.embed_text(nodes).select("id", "embed_text")


def line_diff_near_copies(spark, d):
    """Diffs of each turn to the one before it in its conversation."""
    from pyspark.sql import Window as W

    turns = load(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("new"), F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("old"))
    return turns.where("old is not null").select("conv_id", "turn", D.line_diff_udf("old", "new").alias("diff"))


QUERIES["line_diff_near_copies"] = (line_diff_near_copies, None)


# -- the assembled search ---------------------------------------------------------------------------------------

_PART = """'P.' || p_partkey AS doc_no, p_name AS title, p_type || ' Part' AS type,
 'Brand ' || p_brand || ' & size ' || p_size || CASE p_partkey % 3 WHEN 0 THEN ' in USDS' WHEN 1 THEN ' in stUSDS' ELSE '' END || ' at 0x' || md5('p' || p_partkey) AS content"""
_PART_ID = "substr(md5(P), 1, 8) || '-' || substr(md5(P), 9, 4) || '-' || substr(md5(P), 13, 4) || '-' || substr(md5(P), 17, 4) || '-' || substr(md5(P), 21, 12)".replace("P", "'p' || p_partkey")
_PART_SQL = f"parts AS (SELECT {_PART_ID} AS doc_id, {_PART}, p_partkey FROM part)"
_FIELDS = {"title": 10.0, "doc_no": 5.0, "type": 2.0, "content": 1.0}


def _hits(spark, d, text, addresses=None):
    parts = spread(load(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    nodes = parts.selectExpr(f"{_PART_ID} AS id", *_split_columns(_PART), "p_partkey AS ord", "array('a' || p_partkey % 7) AS address_refs")
    q = S.parse(text)
    index = None if q.id else _index(spark, d, "parts", lambda: [nodes], list(_FIELDS), "id")  # an identifier needs none
    return S.hits(nodes, index, None, q, addresses)


def _split_columns(sql):
    """The columns of ``_PART``: each ends in `` AS name``."""
    return [c.strip(" ,\n") for c in re.findall(r".+? AS \w+,?", sql, re.DOTALL)]


def _hits_sql(rules, where="true", reason=True):
    """SQL of hits without a registry: id, score, reason."""
    why = "concat_ws(' + ', CASE WHEN bool_or(field = 'title') THEN 'title' END, CASE WHEN bool_or(field = 'doc_no') THEN 'doc number' END, CASE WHEN bool_or(field = 'type') THEN 'type' END, CASE WHEN bool_or(field = 'content') THEN 'content' END)"
    return f"WITH {_PART_SQL}, {_bm25_sql('parts', _FIELDS, rules)} SELECT doc_id AS id, 3 AS tier, round(sum(s), 6) AS score, {why} AS match_reason FROM part JOIN parts USING (doc_id) WHERE {where} GROUP BY doc_id"


def _scored(hits):
    return hits.select("id", "tier", F.round("score", 6).alias("score"), "match_reason")


@query(f"WITH {_PART_SQL} SELECT doc_id AS id, 3 AS tier, 1.0::DOUBLE AS score, doc_no, title, type, title AS title_html, content AS snippet, '' AS match_reason FROM parts WHERE p_partkey = 5")
def search_by_id(spark, d):
    """An identifier as the query (in capitals) finds its node alone."""
    m = hashlib.md5(b"p5").hexdigest().upper()
    return _hits(spark, d, f" {m[:8]}-{m[8:12]}-{m[12:16]}-{m[16:20]}-{m[20:]} ")


@query(_hits_sql([("widget", None, 1)], "lower(type) = 'economy part'"))
def search_by_type(spark, d):
    return _scored(_hits(spark, d, 'type:"ECONOMY Part" widget'))


@query(_hits_sql([("usds", None, 1)]).replace("'content' END) AS match_reason", "'content' END, 'exact phrase') AS match_reason"))
def search_ticker(spark, d):
    """A ticker must occur as it is spelt, whatever its case."""
    return _scored(_hits(spark, d, "USDS"))


@query(f"WITH {_PART_SQL} SELECT doc_id AS id, 'content' AS match_reason FROM parts WHERE content LIKE '% 0x1%'")
def search_hex_prefix(spark, d):
    return _hits(spark, d, "0x1").select("id", "match_reason")


@query(f"WITH {_PART_SQL} SELECT doc_id AS id, CASE WHEN p_partkey % 7 = 3 THEN 2 END AS tier, 2.0::DOUBLE AS score, 'registry' AS match_reason FROM parts WHERE p_partkey % 7 = 3")
def search_registry_name(spark, d):
    """A registered name finds the nodes that refer to its address."""
    addresses = spark.createDataFrame([("a3", "QQQ_ONE"), ("a4", "QQQ_TWO")], "address string, registry_name string")
    return _scored(_hits(spark, d, "QQQ_ONE", addresses))


@query(f"WITH {_PART_SQL} SELECT 'title: giz' AS q, doc_id AS id FROM parts UNION ALL SELECT '+ giz', doc_id FROM parts WHERE title LIKE '%giz%' UNION ALL SELECT '-', doc_id FROM parts WHERE false")
def search_prefix_retry(spark, d):
    """Words that do not follow the syntax are tried with a wildcard behind them; an unknown field then finds nothing."""
    tried = {"title: giz": "title: giz", "+ giz": "+title:giz* +", "nofield:widg giz": "nofield:widg giz", "giz~": "giz~"}
    rows = [_hits(spark, d, text).select(F.lit(q).alias("q"), "id") for q, text in tried.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(f"""WITH {_PART_SQL} SELECT doc_id AS id, regexp_replace(title, '((?:sise|bran)\\w*)', '<mark>\\1</mark>', 'gi') AS title_html,
 regexp_replace(replace(CASE WHEN length(content) > 160 THEN substr(content, 1, 160) || '…' ELSE content END, '&', '&amp;'), '((?:brand|size|sise|bran)\\w*)', '<mark>\\1</mark>', 'gi') AS snippet FROM parts""")
def search_marked_terms(spark, d):
    """Marks are on the terms that a wildcard and a fuzzy word matched."""
    return _hits(spark, d, "sise~1 bran*").select("id", "title_html", "snippet")


@query(f"WITH {_PART_SQL}, {_bm25_sql('parts', _FIELDS, [('widget', 'title', 1)])}, r AS (SELECT doc_id, sum(s) AS s FROM part GROUP BY doc_id) SELECT doc_id AS id, title, replace(title, 'widget', '<mark>widget</mark>') AS title_html, replace(content, '&', '&amp;') || '…' AS snippet FROM r JOIN parts USING (doc_id) ORDER BY s DESC, p_partkey LIMIT 5 OFFSET 5")
def search_page(spark, d):
    """The second page of five hits, with marked titles and snippets."""
    return S.page(_hits(spark, d, "title:widget"), 1, 5).select("id", "title", "title_html", "snippet")


_NODE_SQL = "n AS (SELECT vec_id::VARCHAR AS id, 'V.' || vec_id AS doc_no, 'vector ' || vec_id AS title, 'label ' || label AS type, CASE WHEN vec_id > 0 THEN (vec_id // 2)::VARCHAR END AS parent_id, repeat('text ', 100) || vec_id AS content, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) / (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FROM embeddings WHERE vec_id = 0) AS s FROM embeddings)"


@query(f"WITH {_NODE_SQL} SELECT n.id, round(n.s, 4) AS score, n.doc_no, n.title, n.type, p.doc_no AS parent_doc_no, p.title AS parent_title, substr(n.content, 1, 400) AS snippet FROM n LEFT JOIN n p ON p.id = n.parent_id WHERE n.type = 'label 3' ORDER BY n.s DESC, n.id LIMIT 10")
def search_tool(spark, d):
    """The search tool: the query's embedding is brought to unit length, hits of one type come with their parent."""
    rows = load(spark, d, "embeddings")
    nodes = rows.selectExpr("string(vec_id) AS id", "'V.' || vec_id AS doc_no", "'vector ' || vec_id AS title", "'label ' || label AS type", "case when vec_id > 0 then string(vec_id div 2) end AS parent_id", "repeat('text ', 100) || vec_id AS content", "vec_id AS ord")
    _, q = _probe(spark, d)
    return Tools(nodes, rows.selectExpr("string(vec_id) AS id", "embedding"), lambda _: [3 * x for x in q]).search("what", 10, "label 3")


@query(f"WITH {_NODE_SQL} SELECT n.id, round(n.s, 3) AS score, n.doc_no, n.title, n.type, p.doc_no AS parent_doc_no, p.title AS parent_title, substr(n.content, 1, 280) || '…' AS snippet FROM n LEFT JOIN n p ON p.id = n.parent_id ORDER BY n.s DESC, n.id LIMIT 8")
def search_command(spark, d):
    """The command line's search: eight hits, scores to three places, contents cut after 280 characters."""
    rows = load(spark, d, "embeddings")
    nodes = rows.selectExpr("string(vec_id) AS id", "'V.' || vec_id AS doc_no", "'vector ' || vec_id AS title", "'label ' || label AS type", "case when vec_id > 0 then string(vec_id div 2) end AS parent_id", "repeat('text ', 100) || vec_id AS content")
    _, q = _probe(spark, d)
    return V.command_search(rows.selectExpr("string(vec_id) AS id", "embedding"), nodes, V.unit(q))


@query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def vec_topk_of_each(spark, d):
    """The ten nearest of each vector whose number is divisible by 100, against all vectors, in one job."""
    vectors = load(spark, d, "embeddings")
    return V.top_k_of_each(vectors, vectors.where("vec_id % 100 = 0"), 10).select("query", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT count(*) FILTER (WHERE length(text) >= 5000) AS n FROM documents")
def chunks_cut(spark, d):
    return V.truncated(_documents(spark, d).select(F.substring("text", 1, V.MOST_CHARS).alias("embed_text")))
