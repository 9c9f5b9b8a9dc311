import random

import pytest
from pyspark.sql import functions as F

from coppice.functions import docno
from coppice.functions.text import natural_key
from coppice.operators import graph as G
from coppice.operators import hierarchy as H
from coppice.operators import parsing as P

NODE = "ord int, depth int, id string"


def test_heading_parent_with_a_skipped_level(spark):
    rows = [(0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 2, "d"), (4, 4, "e"), (5, 3, "f"), (6, 1, "g"), (7, 3, "h")]
    got = {r.id: r.parent_id for r in P.heading_parent(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {"a": None, "b": "a", "c": "b", "d": "a", "e": None, "f": "d", "g": None, "h": None}


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["`x`"], "`x`"),
        (["`a", "b", "c`", "d"], "```\na\nb\nc\n```\nd"),
        (["`a", "b"], "```\na\nb\n```"),
        (["`"], ""),
        (["```js", "x", "```"], "```\n``js\nx\n``\n```"),
        (["`foo` bar"], "```\nfoo` bar\n```"),
    ],
)
def test_clean_lines(lines, want):
    assert P.clean_lines(lines) == want


def test_parse_a_document(spark):
    u = "0123456789ab-cdef-0123-4567-89abcdef0123"[:36]
    ids = [f"{i}{u[1:]}" for i in range(3)]
    text = f"dropped\n# A.1 - One [Scope]  <!-- UUID: {ids[0]} -->\n\nfirst\n## A.1.2 - Two [Article]  <!-- UUID: {ids[1]} -->\n`a\nb`\n## A.1.3 - Three - x [Core]  <!-- UUID: {ids[2]} -->"
    table = spark.createDataFrame([(1, text), (2, "no heading"), (3, None), (4, "")], "doc int, text string")
    got = {r.id: r for r in P.parse(table, "doc").collect()}
    assert {i: (r.doc_no, r.title, r.type, r.depth, r.parent_id, r.content, r.ord) for i, r in got.items()} == {
        ids[0]: ("A.1", "One", "Scope", 1, None, "first", 0),
        ids[1]: ("A.1.2", "Two", "Article", 2, ids[0], "```\na\nb\n```", 1),
        ids[2]: ("A.1.3", "Three - x", "Core", 2, ids[0], "", 2),
    }


CASES = {
    "A.1": (1, "0,1", None),
    "A.1.2": (2, "0,1,2", "A.1"),
    "A.1.2.0.3.1": (3, "0,1,2,3,3,3", "A.1.2"),
    "A.1.2.0.4.1": (3, "0,1,2,3,3,3", "A.1.2"),
    "A.1.2.0.4.1.1.1": (4, "0,1,2,3,3,3,4,4", "A.1.2.0.4.1"),
    "A.1.2.0.4.1.1.1.var1": (5, "0,1,2,3,3,3,4,4,5", "A.1.2.0.4.1.1.1"),
    "A.1.8.1.2.2": (5, "0,1,2,3,4,5", None),
    "A.1.8.1.2.2.0.6.1": (6, "0,1,2,3,4,5,6,6,6", "A.1.8.1.2.2"),
    "NR-3": (1, "1", None),
}


def test_depths_and_parents_by_number(spark):
    rows = [(n, n, "t", 1, None, i) for i, n in enumerate(CASES)]
    nodes = spark.createDataFrame(rows, "id string, doc_no string, title string, depth int, parent_id string, ord int")
    got = {r.doc_no: r for r in H.docno_parent(nodes).withColumn("d", docno.semantic_depth(F.col("doc_no"))).withColumn("s", F.array_join(docno.segment_depths(F.col("doc_no")), ",")).collect()}
    assert {n: (r.d, r.s, r.docno_parent_id) for n, r in got.items()} == CASES
    one = spark.createDataFrame([("NR-3", "A.1.2"), ("NR-3", None), ("A.1.2.0.4.1.1", None)], "a string, b string")
    assert [r[0] for r in one.select(docno.semantic_depth(F.col("a"), F.col("b"))).collect()] == [3, 1, 4]


def test_natural_order(spark):
    names = ["NR-3", "A.10", "A.2.var2", "A.2", "A.2.0.6.1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["A.2", "A.2.0.6.1", "A.2.var2", "A.10", "NR-3"]


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("a", "A.1", None, 0), ("b", "A.1.1", "a", 1), ("c", "A.1.2", "a", 2), ("d", "A.1.2.1", "c", 3), ("e", "A.1.3", "a", 4), ("f", "A.2", None, 5)]
    return spark.createDataFrame(rows, "id string, doc_no string, parent_id string, ord int").withColumn("title", F.col("id")).withColumn("depth", F.size(F.split("doc_no", r"\.")) - 1)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_walks(spark, tree):
    order = [(r.id, r.level) for r in H.preorder(tree).orderBy("path").collect()]
    assert order == [("a", 1), ("b", 2), ("c", 2), ("d", 3), ("e", 2), ("f", 1)]
    only = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert ids(H.visible(H.preorder(tree), only("a"))) == ["a", "b", "c", "e", "f"]
    assert ids(H.visible(H.preorder(tree), only("c"))) == ["a", "f"]
    assert ids(H.auto_expanded(tree, "c", only("b", "f"))) == ["a", "c", "e", "f"]
    assert ids(H.expand_to(tree, only("d"))) == ["a", "c"]
    assert ids(H.deep_hidden(tree, only("a"), depth=2)) == ["d"]
    assert {r.id: [c.doc_no for c in r.chain] for r in H.parent_chain(tree).collect()}["d"] == ["A.1.2", "A.1"]


def test_neighbours(spark, tree):
    one = lambda w, i="c": {(r.section, r.pos, r.id) for r in H.neighbours(tree, spark.createDataFrame([(i,)], "id string"), w).collect()}
    assert one(8) == {("self", 0, "c"), ("above", 1, "b"), ("below", 1, "e"), ("parent", 0, "a"), ("child", 1, "d")}
    assert one(0) == {("self", 0, "c"), ("parent", 0, "a")}
    assert one(None) == one(8) and one(2) <= one(8)
    assert one(1, "a") == {("self", 0, "a"), ("below", 1, "f"), ("child", 1, "b")}
    with pytest.raises(ValueError):
        one(33)
    assert H.get(tree, "A.1.2").first().id == "c" and H.get(tree, "d").first().id == "d" and H.get(tree, "x").isEmpty()


def test_titles(spark):
    row = spark.range(1).select(
        H.shorten_title(F.lit("The Governance of the Implementation Parameters"), 60).alias("a"), H.shorten_title(F.lit("Parameters and Configuration"), 60, 1.0).alias("b"), H.shorten_title(F.lit("Plain words here"), 8).alias("c"),
        H.fit_breadcrumbs(F.array(*[F.lit("Operational Requirements")] * 7), 90).alias("d"), H.fit_breadcrumbs(F.array(F.lit("The Requirements")), 3).alias("e"),
    ).first()
    assert row.a == "Governance Impl. Parameters" and row.b == "Params. Config." and row.c == "Plain w…"
    assert row.d == ["Oper. Reqs."] * 7 or len(row.d) == 7
    assert row.e == ["The Requirements"]


def test_graph(spark):
    edges = spark.createDataFrame([("1", "2"), ("2", "1"), ("2", "3"), ("3", "4"), ("1", "1")], "from_id string, to_id string").selectExpr("*", "'doc' from_type", "'doc' to_type", "'cites' edge_type")
    names = spark.createDataFrame([("2", "two", "Two", "doc")], "id string, slug string, name string, type string")
    far = lambda d, way="out": {r.id: r.distance for r in G.subgraph(edges, "1", d, way)[0].collect()}
    assert far(3) == {"1": 0, "2": 1, "3": 2, "4": 3} and far(1) == {"1": 0, "2": 1} and far(1, "in") == {"1": 0, "2": 1}
    assert set(far(1)) <= set(far(2)) and G.subgraph(edges, "1", 1)[1].count() == 3
    assert G.subgraph(edges, "nobody", 2)[0].isEmpty() and G.edges_of(edges, names, "nobody").isEmpty()
    got = {(r.direction, r.other_id, r.other_label) for r in G.other_end(G.edges_of(edges, names, "1")).collect()}
    assert got == {("out", "2", "Two"), ("in", "2", "Two"), ("out", "1", "1"), ("in", "1", "1")}
    assert [r.direction for r in G.entity(names, edges, "two").collect()] == ["out", "out", "in"]
    assert {r.id: (r.out_degree, r.in_degree) for r in G.degree(edges).collect()} == {"1": (2, 2), "2": (2, 1), "3": (1, 1), "4": (0, 1)}


def test_derived_edges(spark):
    u = "18ac7dd3-c646-4352-9b0d-d01a2932d7d1"
    rows = [(u, "A.1", "Core", None, "The Operational Facilitator for X is `Ann`. See", 0), ("b", "A.1.0.3.1", "Annotation", None, f"[x]({u}) [y]({u})", 1), ("c", "A.1.0.6.2", "Active Data", u, "- one\n- two", 2)]
    nodes = spark.createDataFrame(rows, "id string, doc_no string, type string, parent_id string, content string, ord int")
    mentions = spark.createDataFrame([("b", "0xa", "base")], "id string, address string, chain string")
    got = {(r.from_id, r.to_id, r.edge_type) for r in G.derive_edges(nodes, mentions).collect()}
    assert got == {(u, "c", "parent_of"), ("b", u, "cites"), ("b", u, "annotates"), ("c", u, "active_data_for"), (u, "operational_facilitator:Ann", "defines_entity"), ("b", "0xa:base", "mentions")}
    assert [(r.pos, r.name) for r in G.listed_entities(nodes).collect()] == [(0, "one"), (1, "two")]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_lines_in_blocks_parse_like_texts(spark, size):
    rng = random.Random(size)
    texts = []
    for t in range(4):
        lines = []
        for i in range(120):
            if rng.random() < 0.4:
                lines.append(f"{'#' * rng.randrange(1, 7)} A.{i} - Title {i} [Core]  <!-- UUID: {t:08x}-0000-0000-0000-{i:012x} -->")
            else:
                lines.append(rng.choice(["", "text", "`code", "end`", "# no heading", " x "]))
        texts.append((t, "\n".join(lines)))
    texts.append((9, ""))
    table = spark.createDataFrame(texts, "doc int, text string")
    rows = P.lines(table, "doc").withColumn("block", F.floor(F.col("n") / size))
    want = sorted(map(tuple, P.parse(table, "doc").collect()))
    assert len(want) > 100 and sorted(map(tuple, P.parse_lines(rows, "doc").collect())) == want


def test_batches_of_a_table_of_several_partitions(spark):
    at = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(at, "false")  # small partitions stay apart, as large ones do
    try:
        rows = spark.range(0, 60_000, 1, 2).select(((F.col("id") * 7_919) % 60_000).alias("k"))
        wrong = P.batches_of(rows, "k", 500).where(F.col("batch") != F.floor(F.col("k") / 500))
        assert wrong.count() == 0
    finally:
        spark.conf.unset(at)


def test_costly_rows_of_a_small_file_are_spread(spark):
    from coppice.plans import document_queries as Q

    for name in ("supporting_depths", "line_diffs"):
        assert Q.QUERIES[name][0](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
