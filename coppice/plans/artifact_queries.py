"""Queries over artifacts that they write from the standard tables and read again: registries, lookups, vectors, proposals."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from coppice.operators import parsing as P
from coppice.sources import readers, scratch, sinks
from coppice.sources.tables import load

QUERIES = {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


@query("""WITH r AS (SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'v1.' || c_custkey ELSE '0xA' || c_custkey END AS address, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS ord FROM customer)
SELECT name, lower(address) AS address, ord FROM r WHERE address LIKE '0x%'""")
def registry_from_files(spark, d):
    """A registry file for each nation, name to address; versions among them are no addresses, and a missing file is empty."""
    rows = load(spark, d, "customer").selectExpr("c_nationkey", "c_name", "CASE WHEN c_custkey % 3 = 0 THEN 'v1.' || c_custkey ELSE '0xA' || c_custkey END AS address")
    members = F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_name", "address"))))
    path = scratch.folder(spark, "registries")
    rows.groupBy("c_nationkey").agg(F.to_json(members).alias("value")).write.partitionBy("c_nationkey").text(path)
    found = readers.registry(spark, path)
    missing = readers.or_empty(lambda: readers.registry(spark, f"{path}-none"), found.schema, spark)
    return found.unionByName(missing)


def _source(chain_id: int, address: str) -> str:
    """A lookup service: some calls fail, some sources are not published."""
    n = int(address[2:])
    if n % 5 == 0:
        raise ConnectionError(address)
    return json.dumps({"status": "1", "result": [{"ContractName": f"C{n}", "ABI": readers.UNVERIFIED if n % 3 == 0 else "[]", "Proxy": str(n % 2), "Implementation": f"0xAB{n}" if n % 2 else "", "SourceCode": "s"}]})


@query("""SELECT 1 AS chain_id, '0x' || s_suppkey AS address, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'C' || s_suppkey END AS contract_name, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN '' ELSE '[]' END AS abi,
 s_suppkey % 5 <> 0 AND s_suppkey % 2 = 1 AS is_proxy, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 2 = 1 THEN '0xab' || s_suppkey ELSE '' END AS implementation, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 's' END AS source_code FROM supplier WHERE s_suppkey % 4 <> 0""")
def source_lookups(spark, d):
    """What the cache lacks is asked for; failed calls and unpublished sources give empty fields."""
    wanted = load(spark, d, "supplier").selectExpr("1L AS chain_id", "'0x' || s_suppkey AS address", "s_suppkey")
    cache = wanted.where("s_suppkey % 4 = 0").select("chain_id", "address")
    answers = readers.fetch(readers.cache_misses(wanted.unionByName(wanted), cache), _source, pause=0)
    return answers.select(*readers.lookup_entry(F.col("chain_id").cast("int"), F.col("address"), F.col("response")))


@query("""WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS id, round((length(p_name) / sqrt(length(p_name) * length(p_name) + 1.0))::FLOAT::DOUBLE, 4) AS x, round((1 / sqrt(length(p_name) * length(p_name) + 1.0))::FLOAT::DOUBLE, 4) AS y,
 'm' AS model, 2 AS dim, n.n AS count, true AS normalized FROM part, n""")
def embedded_chunks(spark, d):
    """Chunks embedded in batches by a service, brought to unit length, stored with one row about them, and read again."""
    chunks = load(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS embed_text")
    path = scratch.folder(spark, "vectors")
    sinks.vectors(readers.embed(chunks, lambda texts: [[float(len(t)), 1.0] for t in texts], 2), path, "m", 2)
    meta = spark.read.parquet(f"{path}/meta").select("model", "dim", "count", "normalized")
    at = lambda i: F.round(F.col("embedding")[i].cast("double"), 4)
    return spark.read.parquet(f"{path}/chunks").select("id", at(0).alias("x"), at(1).alias("y")).join(F.broadcast(meta), how="cross")  # one row


@query("""SELECT c_custkey::INT AS number, c_name AS title, (c_custkey % 4)::INT AS review_count, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::INT AS approval_count FROM customer""")
def staged_proposals(spark, d):
    """Proposals staged as JSON lines: reviews are counted, and approvals among them."""
    rows = load(spark, d, "customer")
    review = F.transform(F.slice(F.array(F.lit("APPROVED"), F.lit("APPROVED"), F.lit("COMMENTED")), F.lit(1), (F.col("c_custkey") % 4).cast("int")), lambda s: F.struct(s.alias("state")))
    path = scratch.folder(spark, "proposals")
    rows.select(F.col("c_custkey").alias("number"), F.col("c_name").alias("title"), F.lit("b").alias("body"), (F.col("c_custkey") % 4).alias("review_count"), review.alias("reviews")).write.json(path)
    return readers.proposals(spark, path).select("number", "title", "review_count", "approval_count")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch FROM orders")
def call_batches(spark, d):
    """Orders in batches of 500, in their keys' order."""
    return P.batches_of(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500).select("o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("SELECT c_nationkey AS id, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1")
def history_sink(spark, d):
    """Entries merged with stored ones by key and written, and the manifest beside them; a second merge changes nothing."""
    rows = load(spark, d, "customer").selectExpr("c_nationkey AS id", "md5(c_mktsegment) AS commit_hash", "c_custkey")
    path = scratch.folder(spark, "history")
    keys = rows.select("id", "commit_hash")
    sinks.merge_history(keys.where("false"), keys.where("commit_hash < '8'"), f"{path}/1")
    sinks.merge_history(spark.read.parquet(f"{path}/1/entries"), keys, f"{path}/2")
    return sinks.merge_history(spark.read.parquet(f"{path}/2/entries"), keys, f"{path}/3")
