"""Hierarchy, graph and history queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import docno
from coppice.functions.text import natural_key
from coppice.operators import graph as G
from coppice.operators import hierarchy as H
from coppice.operators import history as D
from coppice.operators import parsing as P
from coppice.sources import views
from coppice.sources.tables import load
from coppice.streaming import snapshots

QUERIES = {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def _nodes(spark, d):
    return P.heading_parent(views.outline(spark, d), "root")


_UUID = lambda c: f"substr(md5({c}), 1, 8) || '-' || substr(md5({c}), 9, 4) || '-' || substr(md5({c}), 13, 4) || '-' || substr(md5({c}), 17, 4) || '-' || substr(md5({c}), 21, 12)"


@query(f"WITH {views.OUTLINE_SQL} SELECT {_UUID('id')} AS id, doc_no, title, type, depth, {_UUID('up')} AS parent_id, content FROM outline")
def parse_outline(spark, d):
    """The outline written as Markdown, one document to a region, and parsed again."""
    m = F.md5("id")
    uuid = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))
    line = F.concat(F.repeat(F.lit("#"), F.col("depth")), F.lit(" "), F.col("doc_no"), F.lit(" - "), F.col("title"), F.lit(" ["), F.col("type"), F.lit("]  <!-- UUID: "), uuid, F.lit(" -->"), F.when(F.col("content") != "", F.concat(F.lit("\n\n"), F.col("content"))).otherwise(""))
    texts = views.outline(spark, d).groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return P.parse(texts, "root").select("id", "doc_no", "title", "type", "depth", "parent_id", "content")


@query(f"""WITH {views.OUTLINE_SQL}, w AS (SELECT *, max({{'ord': ord, 'depth': depth, 'id': id}}) FILTER (WHERE depth <= 1) OVER b AS p1, max({{'ord': ord, 'depth': depth, 'id': id}}) FILTER (WHERE depth <= 2) OVER b AS p2
FROM outline WINDOW b AS (PARTITION BY root ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN depth = 2 AND p1.depth = 1 THEN p1.id WHEN depth = 3 AND p2.depth = 2 THEN p2.id END AS parent_id FROM w""")
def heading_parent(spark, d):
    return _nodes(spark, d).select("id", "parent_id")


@query(f"""WITH {views.OUTLINE_SQL} SELECT o.id, p.id AS docno_parent_id FROM outline o LEFT JOIN outline p ON o.depth > 1 AND p.doc_no = regexp_replace(o.doc_no, '\\.[^.]+$', '')""")
def docno_parent(spark, d):
    return H.docno_parent(_nodes(spark, d)).select("id", "docno_parent_id")


@query(f"WITH {views.OUTLINE_SQL} SELECT up AS parent_id, count(*) AS n, string_agg(id, ',' ORDER BY ord) AS ids FROM outline WHERE up IS NOT NULL GROUP BY up")
def children_index(spark, d):
    return H.children(_nodes(spark, d)).select("parent_id", "n", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {views.OUTLINE_SQL} SELECT id, 2 AS level, 'r' || root AS ancestor_id FROM outline WHERE depth >= 2 UNION ALL SELECT id, 3, up FROM outline WHERE depth = 3")
def ancestors(spark, d):
    return H.ancestors(_nodes(spark, d)).select("id", "level", "ancestor_id")


@query(f"WITH {views.OUTLINE_SQL} SELECT doc_no, len(string_split(doc_no, '.'))::INT - 1 AS depth, least(greatest(len(string_split(doc_no, '.'))::INT - 1, 1), 17) AS clamped FROM outline")
def semantic_depth(spark, d):
    depth = docno.semantic_depth(F.col("doc_no"))
    return _nodes(spark, d).select("doc_no", depth.alias("depth"), docno.clamp_depth(depth).alias("clamped"))


@query(f"""WITH RECURSIVE {views.OUTLINE_SQL}, walk AS (
  SELECT id, 1 AS level, lpad(ord::VARCHAR, 12, '0') AS path FROM outline WHERE up IS NULL
  UNION ALL SELECT o.id, w.level + 1, w.path || '/' || lpad(o.ord::VARCHAR, 12, '0') FROM outline o JOIN walk w ON o.up = w.id)
SELECT id, level, path FROM walk""")
def preorder_flatten(spark, d):
    return H.preorder(_nodes(spark, d)).select("id", "level", "path")


@query(f"WITH {views.OUTLINE_SQL} SELECT o.id FROM outline o LEFT JOIN outline p ON o.up = p.id WHERE o.depth <= 2 OR p.title < 'C'")
def visible_rows(spark, d):
    """Roots and nations are open to view, customers only below nations before C."""
    nodes = _nodes(spark, d)
    expanded = nodes.where("depth = 1 or (depth = 2 and title < 'C')").select("id")
    return H.visible(H.preorder(nodes), expanded).select("id")


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT a.conv_id * 1000 + a.turn AS target, b.conv_id * 1000 + b.turn AS id, CASE WHEN b.rn < a.rn THEN 'above' WHEN b.rn > a.rn THEN 'below' ELSE 'self' END AS section, abs(b.rn - a.rn)::INT AS pos
FROM t a JOIN t b USING (conv_id) WHERE abs(b.rn - a.rn) <= 2""")
def neighbors_window(spark, d):
    turns = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("group"), "turn")
    rows = H.neighbours(turns.withColumn("parent", F.lit(None).cast("long")), turns, 2, "group", "turn").where("section in ('above', 'self', 'below')")
    return rows.select("target", "id", "section", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {views.OUTLINE_SQL} SELECT o.id, o.doc_no, o.title, p.doc_no AS parent_doc_no, p.title AS parent_title FROM outline o LEFT JOIN outline p ON o.up = p.id WHERE o.doc_no = 'A.1.1'")
def node_get(spark, d):
    nodes = _nodes(spark, d)
    one = H.get(nodes, "A.1.1").select("id")
    return H.project(nodes, include_content=False).join(one, "id", "left_semi").select("id", "doc_no", "title", "parent_doc_no", "parent_title")


@query(f"WITH {views.OUTLINE_SQL} SELECT id, title FROM outline WHERE depth = 1")
def scopes(spark, d):
    return H.scopes(_nodes(spark, d)).select("id", "title")


@query(f"WITH {views.OUTLINE_SQL} SELECT doc_no, array_to_string(list_transform(string_split(doc_no, '.'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN lpad(s, 10, '0') ELSE s END), '.') AS key FROM outline")
def natural_sort_docno(spark, d):
    return _nodes(spark, d).select("doc_no", F.array_join(natural_key(F.col("doc_no")), ".").alias("key"))


@query(f"WITH {views.OUTLINE_SQL} SELECT id, CASE WHEN length(title) > 9 THEN substr(title, 1, 8) || '…' ELSE title END AS short FROM outline")
def short_titles(spark, d):
    return _nodes(spark, d).select("id", H.shorten_title(F.col("title"), 9).alias("short"))



# -- graph ------------------------------------------------------------------------------------------------------


@query(f"""WITH {views.RELATIONS_SQL}, {views.NAMED_SQL}, e AS (SELECT *, 'out' AS direction FROM relations WHERE from_id = 'n1' UNION ALL SELECT *, 'in' FROM relations WHERE to_id = 'n1')
SELECT from_id, to_id, edge_type, direction, a.name AS from_label, b.name AS to_label FROM e LEFT JOIN named a ON a.id = from_id LEFT JOIN named b ON b.id = to_id WHERE edge_type NOT IN ('parent_of')""")
def graph_in_out_edges(spark, d):
    rows = G.edges_of(views.relations(spark, d), views.named(spark, d), "n1")
    return G.shown(rows, ("parent_of",)).select("from_id", "to_id", "edge_type", "direction", "from_label", "to_label")


@query(f"""WITH RECURSIVE {views.RELATIONS_SQL}, walk AS (SELECT 'r1' AS id, 0 AS distance UNION SELECT from_id, distance + 1 FROM walk JOIN relations ON to_id = walk.id WHERE distance < 3)
SELECT id, min(distance) AS distance FROM walk GROUP BY id""")
def graph_bfs_subgraph(spark, d):
    return G.subgraph(views.relations(spark, d), "r1", 3, "in")[0].select("id", "distance")


@query(f"WITH {views.RELATIONS_SQL}, a AS (SELECT from_id AS id, count(*) AS o FROM relations GROUP BY 1), b AS (SELECT to_id AS id, count(*) AS i FROM relations GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM a FULL JOIN b ON a.id = b.id")
def graph_degree(spark, d):
    return G.degree(views.relations(spark, d))


@query(f"WITH {views.RELATIONS_SQL}, {views.NAMED_SQL}, v AS (SELECT id, type FROM named UNION SELECT from_id, from_type FROM relations WHERE from_id NOT IN (SELECT id FROM named)) SELECT type, count(*) AS n FROM v GROUP BY type")
def graph_vertices(spark, d):
    return G.vertices(views.named(spark, d), views.relations(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {views.OUTLINE_SQL} SELECT from_id, to_id, edge_type FROM (
 SELECT up AS from_id, id AS to_id, 'parent_of' AS edge_type FROM outline WHERE up IS NOT NULL
 UNION ALL SELECT id || 'd', id, 'active_data_for' FROM outline WHERE depth = 2
 UNION ALL SELECT id || 'd', id, 'cites' FROM outline WHERE false)""")
def graph_derived_edges(spark, d):
    """The outline with an active-data document below each nation."""
    base = _nodes(spark, d).select("id", "doc_no", "title", "type", "depth", "parent_id", "content", "ord")
    extra = base.where("depth = 2").select(F.concat("id", F.lit("d")).alias("id"), F.concat("doc_no", F.lit(".0.6.1")).alias("doc_no"), "title", F.lit("Active Data").alias("type"), F.lit(3).alias("depth"), F.lit(None).cast("string").alias("parent_id"), "content", "ord")
    return G.derive_edges(base.unionByName(extra)).select("from_id", "to_id", "edge_type")


# -- history ----------------------------------------------------------------------------------------------------

_CHANGES_SQL = f"""{views.REVISIONS_SQL}, changes AS (
SELECT coalesce(n.id, o.id) AS id, coalesce(n.seq, o.seq + 1) AS seq, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM revisions n FULL JOIN (SELECT * FROM revisions WHERE seq < (SELECT max(seq) FROM revisions)) o ON n.id = o.id AND n.seq = o.seq + 1
WHERE o.id IS NULL OR n.id IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash OR n.title IS DISTINCT FROM o.title)"""


@query(f"WITH {_CHANGES_SQL} SELECT id, seq::BIGINT AS seq, change FROM changes")
def snapshot_stream(spark, d):
    """The same changes from a stream that keeps each node's last snapshot as state, stopped and started again half-way."""
    return snapshots.replay(views.revisions(spark, d)).select("id", "seq", "change")


@query(f"WITH {_CHANGES_SQL} SELECT id, seq, change FROM changes")
def snapshot_diff(spark, d):
    return D.snapshot_diff(views.revisions(spark, d))


@query(f"WITH {_CHANGES_SQL} SELECT id, count(*) AS n FROM changes GROUP BY id")
def history_manifest(spark, d):
    return D.manifest(D.snapshot_diff(views.revisions(spark, d)))


@query(f"WITH {_CHANGES_SQL} SELECT id, seq, change, (DATE '2024-01-01' + seq)::VARCHAR AS date FROM changes WHERE id = 1")
def history_timeline(spark, d):
    rows = D.snapshot_diff(views.revisions(spark, d)).withColumn("date", F.date_add(F.lit("2024-01-01"), F.col("seq")).cast("string"))
    return D.timeline(rows, "id", 1).select("id", "seq", "change", "date")


@query(f"WITH {_CHANGES_SQL}, m AS (SELECT id, count(*) AS n FROM changes WHERE seq <= 15 GROUP BY id UNION ALL SELECT id, count(*) FROM changes WHERE seq > 15 GROUP BY id) SELECT id, sum(n)::BIGINT AS n FROM m GROUP BY id")
def history_resume(spark, d):
    """A manifest built in two runs, the second after a checkpoint."""
    rows = D.snapshot_diff(views.revisions(spark, d))
    return D.merge_manifests(D.manifest(rows.where("seq <= 15")), D.manifest(rows.where("seq > 15")))


_STOP = ", ".join(f"'{w}'" for w in D.STOP_WORDS)
_TOK = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


@query(f"""WITH {views.CORPUS_SQL}, n AS (SELECT doc_id, {_TOK('title')} AS t FROM corpus), b AS (SELECT item_id, {_TOK("array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ')")} AS t, {_TOK('text')} AS dt FROM benchmark),
s AS (SELECT doc_id, item_id, len(list_intersect(n.t, b.t)) / len(n.t)::DOUBLE + least(len(list_intersect(n.t, b.dt)) / len(n.t)::DOUBLE * 0.4, 0.2) AS score FROM n, b WHERE len(n.t) > 0 AND len(b.t) > 0)
SELECT doc_id, arg_min(item_id, (-score, item_id)) AS item_id, round(max(score), 6) AS score FROM s WHERE score >= 0.35 GROUP BY doc_id""")
def bullet_best_match(spark, d):
    """Benchmark items as bullets (their first twelve words the title) for documents as changed nodes."""
    nodes = views.corpus(spark, d).select(F.lit(1).alias("change"), "doc_id", "title")
    title = F.array_join(F.slice(F.split("text", " "), 1, 12), " ")
    bullets = load(spark, d, "benchmark").select(F.lit(1).alias("change"), F.col("item_id").alias("pos"), title.alias("title"), F.col("text").alias("description"))
    return D.best_bullets(nodes, bullets, "change", "doc_id").select("doc_id", F.col("pos").alias("item_id"), F.round("score", 6).alias("score"))
