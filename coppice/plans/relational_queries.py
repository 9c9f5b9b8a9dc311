"""Report, profile and state queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators import chainstate as C
from coppice.operators import extraction as X
from coppice.operators import parsing as P
from coppice.operators import reports as R
from coppice.sources import sinks, views
from coppice.sources.tables import load

QUERIES = {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def _entities(spark, d):
    """Nations are prime agents, regions executors, suppliers members of a region."""
    n, r, s = (load(spark, d, t) for t in ("nation", "region", "supplier"))
    one = lambda t, p, k, name, kind, sub: t.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), F.lit(sub).alias("subtype"))
    return one(n, "n", "n_nationkey", "n_name", "agent", "prime").unionByName(one(r, "r", "r_regionkey", "r_name", "agent", "executor")).unionByName(one(s, "s", "s_suppkey", "s_name", "org", "member"))


def _edges(spark, d):
    n, s = load(spark, d, "nation"), load(spark, d, "supplier")
    accord = n.where("n_nationkey % 5 <> 4").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("from_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to_id"), F.lit("executor_accord").alias("edge_type"), F.lit(None).cast("string").alias("meta"), F.col("n_nationkey").cast("long").alias("ord"))
    role = F.expr("case s_suppkey % 4 when 0 then '{\"role\": \"core facilitator\"}' when 1 then '{\"role\": \"govops\"}' when 2 then '{bad' end")
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    member = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).where("n_regionkey <> 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("from_id"), region.alias("to_id"), F.lit("member_of").alias("edge_type"), role.alias("meta"), F.col("s_suppkey").alias("ord"))
    return accord.unionByName(member)


_CHAIN_SQL = """
m AS (SELECT s_suppkey, s_name, n_regionkey AS reg, s_suppkey % 4 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 3),
f AS (SELECT reg, arg_min(s_name, s_suppkey) AS name FROM m WHERE k = 0 GROUP BY reg),
g AS (SELECT reg, arg_min(s_name, s_suppkey) AS name FROM m WHERE k = 1 GROUP BY reg),
chain AS (SELECT n_name AS agent_name, r_name AS executor_name, f.name AS facilitator_name, g.name AS govops_name
  FROM nation LEFT JOIN region ON n_nationkey % 5 <> 4 AND r_regionkey = n_regionkey LEFT JOIN f ON f.reg = r_regionkey LEFT JOIN g ON g.reg = r_regionkey)
"""
_CHAIN = ("agent_name", "executor_name", "facilitator_name", "govops_name")


@query(f"WITH {_CHAIN_SQL} SELECT * FROM chain")
def agent_chain_left(spark, d):
    return R.agent_chain(_entities(spark, d), _edges(spark, d)).select(*_CHAIN)


@query(f"WITH {_CHAIN_SQL} SELECT * FROM chain WHERE executor_name IS NOT NULL AND facilitator_name IS NOT NULL")
def agent_chain_inner(spark, d):
    return R.agent_chain(_entities(spark, d), _edges(spark, d), inner=True).select(*_CHAIN)


def _active(spark, d):
    """Nations are controllers below ``A.6.1.1.<region>``, suppliers of them responsible, customers their data."""
    n, s, c = (load(spark, d, t) for t in ("nation", "supplier", "customer"))
    number = F.concat(F.lit("A.6.1.1."), (F.col("n_regionkey") + 1).cast("string"), F.lit("."), (F.col("n_nationkey") + 1).cast("string"))
    control = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), number.alias("doc_no"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, "by Alignment Conserver").otherwise("direct").alias("content"))
    below = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(number, F.lit(".0.6."), (F.col("c_custkey") + 1).cast("string")).alias("doc_no"), F.col("c_name").alias("title"), F.lit("").alias("content"))
    responsible = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("from_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("to_id"), F.lit("responsible_for").alias("edge_type"), F.lit(None).cast("string").alias("meta"), F.col("s_suppkey").alias("ord"), F.array(F.lit("doc")).alias("sources"))
    chains = R.agent_chain(_entities(spark, d), _edges(spark, d)).join(n, F.col("agent_name") == F.col("n_name")).groupBy("n_regionkey").agg(F.min_by(F.struct("executor_name", "facilitator_name", "govops_name"), "n_nationkey").alias("x"))
    table = F.create_map(*(F.lit(x) for i, kv in enumerate(list(X.AGENT_PREFIXES.values())[:5]) for x in (i, kv)))
    chains = chains.select(F.element_at(table, F.col("n_regionkey")).alias("agent_name"), "x.*")
    return R.active_data(responsible, _entities(spark, d), control.unionByName(below), chains)


_AGENTS = ", ".join(f"({i}, '{a}')" for i, a in enumerate(list(X.AGENT_PREFIXES.values())[:5]))
_ACTIVE_SQL = f"""{_CHAIN_SQL}, ag(reg, agent) AS (VALUES {_AGENTS}),
ch AS (SELECT n_regionkey AS reg, arg_min(chain, n_nationkey) AS x FROM chain JOIN nation ON n_name = agent_name GROUP BY 1),
docs AS (SELECT c_nationkey, string_agg('A.6.1.1.' || (n_regionkey + 1) || '.' || (c_nationkey + 1) || '.0.6.' || (c_custkey + 1), '; ' ORDER BY c_custkey) AS active FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
active AS (SELECT 'A.6.1.1.' || (n_regionkey + 1) || '.' || (n_nationkey + 1) AS doc_no, s_name AS entity_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Alignment Conserver Changes' ELSE 'Direct Edit' END AS process,
  agent, x.executor_name AS executor_name, x.facilitator_name AS facilitator_name, x.govops_name AS govops_name, coalesce(active, '') AS active, n_name AS title
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN ag ON ag.reg = n_regionkey LEFT JOIN ch ON ch.reg = n_regionkey LEFT JOIN docs ON docs.c_nationkey = n_nationkey)"""


@query(f"WITH {_ACTIVE_SQL} SELECT doc_no, entity_name, process, agent, executor_name, facilitator_name, govops_name, active FROM active")
def active_data_report(spark, d):
    return _active(spark, d).select("doc_no", "entity_name", "process", "agent", "executor_name", "facilitator_name", "govops_name", F.array_join("active_docs", "; ").alias("active"))


@query(f"""WITH {_ACTIVE_SQL} SELECT doc_no AS "Controller Doc", title AS "Title", process AS "Process", coalesce(agent, 'Governance') AS "Agent", coalesce(executor_name, '') AS "Executor Agent", coalesce(facilitator_name, '') AS "Facilitator", coalesce(govops_name, '') AS "GovOps", entity_name AS "Responsible Party", active AS "Active Data" FROM active""")
def csv_report(spark, d):
    return R.csv_rows(_active(spark, d))


@query(f"WITH {_ACTIVE_SQL} SELECT DISTINCT name FROM (SELECT unnest([entity_name, executor_name, facilitator_name, govops_name]) AS name FROM active) WHERE name IS NOT NULL")
def distinct_editors(spark, d):
    return R.editors(_active(spark, d))


@query(f"WITH {_ACTIVE_SQL} SELECT DISTINCT agent FROM active")
def report_agents(spark, d):
    return R.agents(_active(spark, d), tuple(X.AGENT_PREFIXES.values()))


@query(f"WITH {_ACTIVE_SQL} SELECT doc_no, entity_name FROM active WHERE agent = 'Grove' AND 'AMERICA' IN (entity_name, executor_name, facilitator_name, govops_name)")
def optional_filters(spark, d):
    return R.filtered(_active(spark, d), "Grove", "AMERICA").select("doc_no", "entity_name")


@query(f"""WITH {_CHAIN_SQL} SELECT o_orderkey AS doc_no, facilitator_name, executor_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN chain ON agent_name = n_name WHERE facilitator_name IS NOT NULL""")
def row_facilitators(spark, d):
    """Orders as responsibilities of their customer's nation."""
    n = load(spark, d, "nation")
    rows = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("doc_no"), F.col("n_name").alias("agent"), F.lit(None).cast("array<string>").alias("agents"))
    chains = R.agent_chain(_entities(spark, d), _edges(spark, d), inner=True)
    return R.row_facilitators(rows, chains).join(chains.select("facilitator_id", "facilitator_name").distinct(), "facilitator_id").select("doc_no", "facilitator_name", "executor_name")


@query("SELECT o_orderpriority AS category, upper(o_orderpriority) AS label, count(*) AS n FROM orders GROUP BY ALL")
def category_groups(spark, d):
    labels = {k: k.upper() for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")}
    return R.by_category(load(spark, d, "orders").withColumnRenamed("o_orderpriority", "category"), labels)


@query(f"""WITH {views.OUTLINE_SQL} SELECT 'type' AS facet, type AS value, count(*) AS n FROM outline GROUP BY type UNION ALL SELECT 'depth', depth::VARCHAR, count(*) FROM outline GROUP BY depth UNION ALL SELECT 'empty', 'content', count(*) FROM outline WHERE content = ''""")
def outline_profile(spark, d):
    return P.profile(views.outline(spark, d))


@query("SELECT 'type' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'depth', least(length(text) // 1000, 9)::VARCHAR, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'empty', 'content', count(*) FROM documents WHERE coalesce(text, '') = ''")
def corpus_profile(spark, d):
    docs = load(spark, d, "documents").select(F.col("lang").alias("type"), F.least(F.floor(F.length("text") / 1000), F.lit(9)).alias("depth"), F.col("text").alias("content"))
    return P.profile(docs)


@query("""SELECT 'total' AS facet, unnest(['labelled', 'registered', 'verified', 'proxy', 'unverified', 'all']) AS value, unnest([count(*), count(*) FILTER (WHERE c_mktsegment = 'BUILDING'), count(*) FILTER (WHERE c_acctbal > 0), count(*) FILTER (WHERE c_acctbal > 5000), count(*) FILTER (WHERE c_acctbal <= 0 AND c_nationkey <> 0), count(*)]) AS n FROM customer
UNION ALL SELECT 'chain', CASE WHEN c_nationkey = 0 THEN 'solana' ELSE 'ethereum' END, count(*) FROM customer GROUP BY 2""")
def address_profile(spark, d):
    c = load(spark, d, "customer")
    rows = c.select(F.when(F.col("c_nationkey") == 0, "solana").otherwise("ethereum").alias("chain"), F.col("c_name").alias("label"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("registry_name"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("verified_name"), (F.col("c_acctbal") > 0).alias("is_contract"), (F.col("c_acctbal") > 5000).alias("is_proxy"))
    return X.address_profile(rows)


_STATE_SQL = "st AS (SELECT 'u' || user_id AS address, event_type AS fn, arg_max(json_extract_string(props, '$.k'), event_id) AS v, arg_max(event_type <> 'refund' AND value >= 5, event_id) AS ok FROM events GROUP BY 1, 2)"


def _state(spark, d):
    """Events as calls: the type is the function, the value the result, small values are reverted calls."""
    e = load(spark, d, "events")
    results = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("address"), F.col("event_type").alias("fn"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("pos"), F.when((F.col("event_type") != "refund") & (F.col("value") >= 5), "success").otherwise("failure").alias("status"))
    return C.state_long(results)


@query(f"WITH {_STATE_SQL} SELECT address, fn, CASE WHEN ok THEN v END AS value, CASE WHEN ok THEN 'success' ELSE 'reverted' END AS status FROM st")
def state_long_pivot(spark, d):
    return _state(spark, d)


@query(f"WITH {_STATE_SQL} SELECT address, string_agg(fn || '=' || coalesce(CASE WHEN ok THEN v END, 'null'), ',' ORDER BY fn) AS nested FROM st GROUP BY address")
def state_nested(spark, d):
    entries = F.map_entries("values")
    return C.state_nested(_state(spark, d)).select("address", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",").alias("nested"))


@query(f"WITH {_STATE_SQL} SELECT count(*) FILTER (WHERE ok AND v IS NOT NULL) AS succeeded, count(*) FILTER (WHERE NOT ok OR v IS NULL) AS failed FROM st")
def state_counts(spark, d):
    return C.success_counts(_state(spark, d))


@query("SELECT DISTINCT 'c' || o_custkey AS address FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def proxy_distinct_antijoin(spark, d):
    """Open orders as proxies of their customers, customers in credit as the cache."""
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    proxies = load(spark, d, "orders").where("o_orderstatus = 'O'").select(F.lit(True).alias("is_proxy"), name("o_custkey").alias("implementation"))
    cache = load(spark, d, "customer").where("c_acctbal > 0").select(F.lit(1).alias("chain_id"), name("c_custkey").alias("address"))
    return X.missing_implementations(proxies, cache)


@query("SELECT c_custkey, CASE WHEN length(c_name) > 0 THEN substr(c_name, 1, 6) || '…' || right(c_name, 4) END AS short FROM customer")
def short_addresses(spark, d):
    return load(spark, d, "customer").select("c_custkey", C.short_address(F.col("c_name")).alias("short"))


@query("""SELECT to_json({'content': [{'type': 'text', 'text': to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR}]})::VARCHAR AS text FROM customer""")
def tool_results(spark, d):
    """Customers as items of the tool protocol."""
    return sinks.tool_result(load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"))
