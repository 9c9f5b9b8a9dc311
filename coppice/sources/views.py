"""Views over the standard tables that stand for outlines, corpora, graphs and revisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.sources.tables import load


def _ord(r, n, c):
    return (r + 1) * 10**14 + (n + 1) * 10**11 + c


def outline(spark: SparkSession, d: str) -> DataFrame:
    """``root, id, doc_no, title, type, depth, ord, content``: regions, their nations, their customers."""
    region, nation, customer = (load(spark, d, t) for t in ("region", "nation", "customer"))
    zero = F.lit(0).cast("long")

    def node(rows: DataFrame, prefix: str, key: str, number, name: str, kind: str, depth: int, order, content) -> DataFrame:
        return rows.select(F.col("r").alias("root"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), number.alias("doc_no"), F.col(name).alias("title"), F.lit(kind).alias("type"), F.lit(depth).alias("depth"), order.alias("ord"), content.alias("content"))

    one = lambda c: (F.col(c) + 1).cast("string")
    r = region.withColumn("r", F.col("r_regionkey").cast("long"))
    n = nation.withColumn("r", F.col("n_regionkey").cast("long"))
    c = customer.join(n.select("r", "n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        node(r, "r", "r_regionkey", F.concat(F.lit("A."), one("r")), "r_name", "Region", 1, _ord(F.col("r"), zero - 1, zero), F.lit(""))
        .unionByName(node(n, "n", "n_nationkey", F.concat(F.lit("A."), one("r"), F.lit("."), one("n_nationkey")), "n_name", "Nation", 2, _ord(F.col("r"), F.col("n_nationkey").cast("long"), zero), F.lit("Alignment Conserver Changes")))
        .unionByName(node(c, "c", "c_custkey", F.concat(F.lit("A."), one("r"), F.lit("."), one("c_nationkey"), F.lit("."), one("c_custkey")), "c_name", "Customer", 3, _ord(F.col("r"), F.col("c_nationkey").cast("long"), F.col("c_custkey") + 1), F.col("c_mktsegment")))
    )


OUTLINE_SQL = """
outline AS (
  SELECT r_regionkey::BIGINT AS root, 'r' || r_regionkey AS id, 'A.' || (r_regionkey + 1) AS doc_no, r_name AS title, 'Region' AS type, 1 AS depth,
         (r_regionkey + 1)::BIGINT * 100000000000000 AS ord, '' AS content, NULL::VARCHAR AS up FROM region
  UNION ALL
  SELECT n_regionkey::BIGINT, 'n' || n_nationkey, 'A.' || (n_regionkey + 1) || '.' || (n_nationkey + 1), n_name, 'Nation', 2,
         (n_regionkey + 1)::BIGINT * 100000000000000 + (n_nationkey + 1)::BIGINT * 100000000000, 'Alignment Conserver Changes', 'r' || n_regionkey FROM nation
  UNION ALL
  SELECT n_regionkey::BIGINT, 'c' || c_custkey, 'A.' || (n_regionkey + 1) || '.' || (c_nationkey + 1) || '.' || (c_custkey + 1), c_name, 'Customer', 3,
         (n_regionkey + 1)::BIGINT * 100000000000000 + (c_nationkey + 1)::BIGINT * 100000000000 + c_custkey + 1, c_mktsegment, 'n' || c_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, title, type, content``: documents with their first line as the title."""
    return load(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("lang").alias("type"), F.col("text").alias("content"))


CORPUS_SQL = "corpus AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, lang AS type, text AS content FROM documents)"


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the property graph: member_of, parent_of, placed_by, supplied_by."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda t, a, at, b, bt, kind: load(spark, d, t).select(a.alias("from_id"), F.lit(at).alias("from_type"), b.alias("to_id"), F.lit(bt).alias("to_type"), F.lit(kind).alias("edge_type"))
    return (
        edge("customer", name("c", "c_custkey"), "customer", name("n", "c_nationkey"), "nation", "member_of")
        .unionByName(edge("nation", name("n", "n_nationkey"), "nation", name("r", "n_regionkey"), "region", "parent_of"))
        .unionByName(edge("orders", name("o", "o_orderkey"), "order", name("c", "o_custkey"), "customer", "placed_by"))
        .unionByName(edge("lineitem", name("o", "l_orderkey"), "order", name("s", "l_suppkey"), "supplier", "supplied_by"))
    )


RELATIONS_SQL = """
relations AS (
  SELECT 'c' || c_custkey AS from_id, 'customer' AS from_type, 'n' || c_nationkey AS to_id, 'nation' AS to_type, 'member_of' AS edge_type FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'nation', 'r' || n_regionkey, 'region', 'parent_of' FROM nation
  UNION ALL SELECT 'o' || o_orderkey, 'order', 'c' || o_custkey, 'customer', 'placed_by' FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'order', 's' || l_suppkey, 'supplier', 'supplied_by' FROM lineitem)
"""


def named(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the graph: ``id, slug, name, type``."""
    one = lambda t, p, k, n, kind: load(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lower(n).alias("slug"), F.col(n).alias("name"), F.lit(kind).alias("type"))
    return one("region", "r", "r_regionkey", "r_name", "region").unionByName(one("nation", "n", "n_nationkey", "n_name", "nation")).unionByName(one("customer", "c", "c_custkey", "c_name", "customer")).unionByName(one("supplier", "s", "s_suppkey", "s_name", "supplier"))


NAMED_SQL = """
named AS (
  SELECT 'r' || r_regionkey AS id, lower(r_name) AS slug, r_name AS name, 'region' AS type FROM region
  UNION ALL SELECT 'n' || n_nationkey, lower(n_name), n_name, 'nation' FROM nation
  UNION ALL SELECT 'c' || c_custkey, lower(c_name), c_name, 'customer' FROM customer
  UNION ALL SELECT 's' || s_suppkey, lower(s_name), s_name, 'supplier' FROM supplier)
"""


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """``id, seq, content_hash, title``: each user's last event of each day (days since 2024-01-01)."""
    e = load(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("id"), F.datediff("ts", F.lit("2024-01-01")).alias("seq")).agg(F.max_by(F.struct("event_type", "props"), F.struct("ts", "event_id")).alias("x"))
    return last.select("id", "seq", F.md5(F.coalesce("x.props", F.lit(""))).alias("content_hash"), F.col("x.event_type").alias("title"))


REVISIONS_SQL = """
revisions AS (
  SELECT user_id AS id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS seq,
         md5(coalesce(arg_max(props, (ts, event_id)), '')) AS content_hash, arg_max(event_type, (ts, event_id)) AS title
  FROM events GROUP BY 1, 2)
"""
