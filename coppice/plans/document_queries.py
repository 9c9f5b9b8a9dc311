"""Queries over texts made from the standard tables: addresses, links, controllers, calls, diffs and outline state.

Each text is built by an SQL expression that both engines evaluate; the SQL counterpart says what the operator
must find in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import docno
from coppice.operators import chainstate as C
from coppice.operators import extraction as X
from coppice.operators import mentions as M
from coppice.operators import graph as G
from coppice.operators import hierarchy as H
from coppice.operators import history as D
from coppice.operators import parsing as P
from coppice.operators import reports as R
from coppice.sources import views
from coppice.sources.tables import load, spread

QUERIES = {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def _customers(spark, d, *columns):
    return load(spark, d, "customer").selectExpr(*columns)


def _joined(*columns):
    return [F.array_join(c, ",").alias(c) for c in columns]


HEX = lambda c: f"(md5({c}) || substr(md5({c} || 'x'), 1, 8))"
ADDRESS = lambda c: f"('0x' || {HEX(c)})"
BASE58 = lambda c: f"translate(md5({c}) || substr(md5({c} || 'x'), 1, 12), '0', 'z')"
UUID = lambda c: f"(substr(md5({c}), 1, 8) || '-' || substr(md5({c}), 9, 4) || '-' || substr(md5({c}), 13, 4) || '-' || substr(md5({c}), 17, 4) || '-' || substr(md5({c}), 21, 12))"
OWN, SHOUTED = ADDRESS("c_name"), f"('0x' || upper({HEX('c_name')}))"
NL = "chr(10)"

# -- addresses --------------------------------------------------------------------------------------------------

_TEXT = f"""CASE c_custkey % 5
 WHEN 0 THEN 'Funds move on Arbitrum in USDS and DAI. The address of the ' || c_mktsegment || ' Treasury Fund is ' || {SHOUTED} || '.'
 WHEN 1 THEN 'Owner: Grove Vault,' || {NL} || {BASE58('c_name')} || ' holds SPK'
 WHEN 2 THEN '| Name | Address |' || {NL} || '|---|---|' || {NL} || '| ' || c_name || ' | ' || {OWN} || ' |'
 WHEN 3 THEN 'On Polygon the executor uses ' || {OWN} || '. ' || repeat('filler ', 60) || 'On Base it uses ' || {OWN} || ' again.'
 ELSE 'Not an address: ' || {OWN} || 'f and 0x1234' END"""


@query(f"""WITH t AS (SELECT *, c_custkey % 5 AS k, {_TEXT} AS content FROM customer),
f AS (SELECT *, CASE k WHEN 1 THEN {BASE58('c_name')} ELSE {OWN} END AS address, ['arbitrum', 'solana', 'ethereum', 'polygon'][k + 1] AS chain FROM t WHERE k < 4)
SELECT c_custkey, address, (instr(content, CASE k WHEN 0 THEN {SHOUTED} ELSE address END) - 1)::INT AS pos, chain,
 CASE k WHEN 0 THEN 'https://arbiscan.io/address/' WHEN 1 THEN 'https://explorer.solana.com/address/' WHEN 2 THEN 'https://etherscan.io/address/' ELSE 'https://polygonscan.com/address/' END || address AS explorer_url,
 ['treasury', 'grove,vault', '', 'executor'][k + 1] AS roles, CASE k WHEN 0 THEN c_mktsegment || ' Treasury Fund' WHEN 1 THEN 'Grove Vault' WHEN 2 THEN c_name END AS label, ['USDS,DAI', 'SPK', '', ''][k + 1] AS tokens FROM f""")
def addresses_in_text(spark, d):
    """Both kinds of addresses with chain, roles, label (prose and table) and tokens; the first occurrence counts."""
    nodes = _customers(spark, d, "c_custkey", f"{_TEXT} AS content", "c_custkey AS ord")
    return M.extract_addresses(nodes, "c_custkey").select("c_custkey", "address", "pos", "chain", "explorer_url", "label", *_joined("roles", "tokens"))


_PHRASES = f"""CASE c_custkey % 8
 WHEN 0 THEN 'mainnet entry: address on the Arbitrum One is '
 WHEN 1 THEN 'from the Team ' || c_mktsegment || chr(39) || 's address is '
 WHEN 2 THEN 'reward address for the Pool ' || c_custkey || ' is '
 WHEN 3 THEN 'on avax, Keeper ' || c_mktsegment || ' at address '
 WHEN 4 THEN 'Operator - Omega ' || c_mktsegment || ' '
 WHEN 5 THEN 'with **Gamma ' || c_mktsegment || '**: '
 WHEN 6 THEN 'aave and chainlink with Spark feed '
 ELSE 'uniswap pool of sUSDS, USDS and sUSDS ' END || {OWN} || CASE c_custkey % 8 WHEN 4 THEN ' for SPK' ELSE '.' END"""


@query(f"""SELECT c_custkey, {OWN} AS address, (instr({_PHRASES}, '0x') - 1)::INT AS pos, CASE c_custkey % 8 WHEN 0 THEN 'arbitrum' WHEN 3 THEN 'avalanche' ELSE 'ethereum' END AS chain,
 CASE c_custkey % 8 WHEN 1 THEN 'Team ' || c_mktsegment WHEN 2 THEN 'Pool ' || c_custkey WHEN 3 THEN 'Keeper ' || c_mktsegment WHEN 4 THEN 'Omega ' || c_mktsegment WHEN 5 THEN 'Gamma ' || c_mktsegment END AS label,
 CASE c_custkey % 8 WHEN 6 THEN 'spark' WHEN 7 THEN 'external' ELSE '' END AS roles, CASE c_custkey % 8 WHEN 4 THEN 'SPK' WHEN 7 THEN 'sUSDS,USDS' ELSE '' END AS tokens FROM customer""")
def address_phrases(spark, d):
    """The explicit chain phrase against nearer names, the other ways of naming in prose, and outside tags beside aligned ones."""
    nodes = _customers(spark, d, "c_custkey", f"{_PHRASES} AS content", "c_custkey AS ord")
    return M.extract_addresses(nodes, "c_custkey").select("c_custkey", "address", "pos", "chain", "label", *_joined("roles", "tokens"))


_NATION = ADDRESS("'n' || c_nationkey")
_SHARED = f"""CASE c_custkey % 3 WHEN 0 THEN 'On Gnosis. ' WHEN 1 THEN 'On Base. ' ELSE '' END || 'The address of the ' || CASE c_custkey % 2 WHEN 0 THEN 'Spark ' || c_mktsegment || ' Desk' ELSE 'Multisig' END || ' is ' || {_NATION}"""
_MENTIONS_SQL = f"""m AS (SELECT c_custkey, c_nationkey, {_NATION} AS address, CASE c_custkey % 3 WHEN 0 THEN 'gnosis' WHEN 1 THEN 'base' END AS chain,
 CASE c_custkey % 2 WHEN 0 THEN 'Spark ' || c_mktsegment || ' Desk' ELSE 'Multisig' END AS label, CASE c_custkey % 2 WHEN 0 THEN 'spark' ELSE 'multisig' END AS role FROM customer)"""


def _shared(spark, d):
    return M.extract_addresses(_customers(spark, d, "c_custkey", f"{_SHARED} AS content", "c_custkey AS ord"), "c_custkey")


@query(f"""WITH {_MENTIONS_SQL},
g AS (SELECT address, coalesce(arg_min(chain, c_custkey) FILTER (chain IS NOT NULL), 'ethereum') AS chain, list(DISTINCT label) AS labels, list(DISTINCT role) AS roles, count(*) AS refs,
 coalesce(first(label ORDER BY length(label) DESC, label) FILTER (label <> 'Multisig'), 'Multisig') AS label FROM m GROUP BY address)
SELECT address, chain, label, array_to_string(list_sort(list_filter(labels, lambda x: x <> label)), ',') AS aliases, array_to_string(list_sort(roles), ',') AS roles, refs,
 CASE chain WHEN 'gnosis' THEN 'https://gnosisscan.io/address/' WHEN 'base' THEN 'https://basescan.org/address/' ELSE 'https://etherscan.io/address/' END || address AS explorer_url FROM g""")
def addresses_merged(spark, d):
    """One row for each nation's address that its customers' texts mention."""
    return X.merge_addresses(_shared(spark, d)).select("address", "chain", "label", "refs", "explorer_url", *_joined("aliases", "roles"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN {OWN} WHEN {OWN} < {_NATION} THEN {OWN} || ',' || {_NATION} ELSE {_NATION} || ',' || {OWN} END AS address_refs FROM customer""")
def address_references(spark, d):
    """Texts' own and nations' addresses as sorted references."""
    text = f"CASE WHEN c_custkey % 4 = 0 THEN 'none' WHEN c_custkey % 4 = 1 THEN {OWN} ELSE {OWN} || ' ' || {_NATION} || ' ' || {OWN} END"
    nodes = _customers(spark, d, "c_custkey", f"{text} AS content", "c_custkey AS ord")
    return X.address_refs(nodes, M.extract_addresses(nodes, "c_custkey"), "c_custkey").select("c_custkey", *_joined("address_refs"))


_HASH = "('0x' || md5(c_name) || md5(c_name || 'y'))"
_LINKED = f"CASE c_custkey % 3 WHEN 0 THEN 'Paid. Transaction Hash: ' || {_HASH} || '.' WHEN 1 THEN 'see ' || {OWN} || ' and ' || {BASE58('c_name')} ELSE 'none' END"


@query(f"""SELECT c_custkey, 24::INT AS pos, {_HASH} AS found, 'tx' AS kind, 'https://etherscan.io/tx/' || {_HASH} AS url FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 4, {OWN}, 'evm', CASE WHEN c_custkey % 2 = 0 THEN 'https://own.example/' || c_custkey ELSE 'https://etherscan.io/address/' || {OWN} END FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, 51, {BASE58('c_name')}, 'base58', 'https://etherscan.io/address/' || {BASE58('c_name')} FROM customer WHERE c_custkey % 3 = 1""")
def auto_links(spark, d):
    """Transaction hashes and addresses with their links; even customers' addresses are known."""
    known = _customers(spark, d, f"{OWN} AS address", "'https://own.example/' || c_custkey AS explorer_url", "c_custkey").where("c_custkey % 2 = 0")
    return X.auto_links(_customers(spark, d, "c_custkey", f"{_LINKED} AS content"), known, "c_custkey")


@query(f"""SELECT c_custkey, c_custkey % 3 <> 1 AS math, CASE c_custkey % 3 WHEN 0 THEN 'cost $x$ to ' WHEN 1 THEN 'cost $ 5 to ' ELSE 'cost $$y$$ to ' END || '[' || {OWN} || '](https://etherscan.io/address/' || {OWN} || ')' AS linked FROM customer""")
def math_and_linked_text(spark, d):
    rows = _customers(spark, d, "c_custkey", f"CASE c_custkey % 3 WHEN 0 THEN 'cost $x$ to ' WHEN 1 THEN 'cost $ 5 to ' ELSE 'cost $$y$$ to ' END || {OWN} AS t")
    return rows.select("c_custkey", X.has_math(F.col("t")).alias("math"), X.linked_text(F.col("t")).alias("linked"))


_ID = lambda k: UUID(f"('c' || ({k}))")
_NODE = f"SELECT {_ID('c_custkey')} AS id, 'A.' || c_custkey AS doc_no, c_name AS title, c_custkey FROM customer"


@query(f"""WITH n AS ({_NODE}) SELECT a.id, 0 AS pos, b.id AS target, b.doc_no AS target_doc_no, b.title AS target_title FROM n a JOIN n b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 4 = 0
UNION ALL SELECT a.id, 2, a.id, a.doc_no, a.title FROM n a WHERE a.c_custkey % 4 = 0""")
def resolved_links(spark, d):
    """Links to the next customer, to nothing and to oneself; the second mention of a target does not count."""
    text = f"CASE WHEN c_custkey % 4 = 0 THEN 'see [x](' || {_ID('c_custkey + 1')} || '), [gone](' || {UUID('c_name')} || '), [y](' || {_ID('c_custkey')} || ') and [x](' || {_ID('c_custkey + 1')} || ')' ELSE 'none' END"
    nodes = _customers(spark, d, f"{_ID('c_custkey')} AS id", "'A.' || c_custkey AS doc_no", "c_name AS title", f"{text} AS content")
    return X.resolve_links(X.links(nodes), nodes)


# -- controllers ------------------------------------------------------------------------------------------------

_AGENTS = "[" + ", ".join(f"'{a}'" for a in X.AGENT_PREFIXES.values()) + ", NULL]"


@query(f"""WITH c AS (SELECT c_custkey AS k, c_name, {_AGENTS}[c_custkey % 9 + 1] AS agent FROM customer)
SELECT 'c' || k AS id, 'A.6.1.1.' || (k % 9 + 1) || '.' || k AS doc_no, CASE WHEN k % 4 = 0 THEN 'Distribution Reward Payments' ELSE c_name END AS title, CASE WHEN k % 3 = 0 THEN 'Alignment Conserver Changes' ELSE 'Direct Edit' END AS process, agent,
 CASE k % 3 WHEN 0 THEN CASE agent WHEN 'Spark' THEN 'Fac One' WHEN 'Grove' THEN 'Fac Two' ELSE 'Operational Facilitator' END WHEN 1 THEN 'Soter Labs' ELSE 'Unknown' END AS entity_name,
 ['Operational Facilitator', 'Operational GovOps', 'Unknown'][k % 3 + 1] AS entity_role, CASE WHEN k % 4 = 0 THEN 'Agents' END AS context FROM c""")
def controllers_index(spark, d):
    """Controllers with responsible party, process, agent and the context of generic titles."""
    content = "CASE c_custkey % 3 WHEN 0 THEN 'The Responsible Party is the Operational Facilitator. Update Process: must follow the protocol for `Alignment Conserver Changes`.' WHEN 1 THEN 'Responsible Party: Operational GovOps' ELSE '' END"
    rows = _customers(spark, d, "'c' || c_custkey AS id", "'A.6.1.1.' || (c_custkey % 9 + 1) || '.' || c_custkey AS doc_no", "CASE WHEN c_custkey % 4 = 0 THEN 'Distribution Reward Payments' ELSE c_name END AS title", "'Active Data Controller' AS type", f"{content} AS content", "c_custkey AS ord")
    top = spark.createDataFrame([("top", "A.6.1.1", "Agents Instance Configuration Document", "Core", "", -1)], "id string, doc_no string, title string, type string, content string, ord long")
    facilitators = spark.createDataFrame([("Spark", "Fac One"), ("Grove", "Fac Two")], "agent string, operational_facilitator string")
    return R.controllers(rows.withColumn("ord", F.col("ord").cast("long")).unionByName(top), facilitators).select("id", "doc_no", "title", "process", "agent", "entity_name", "entity_role", "context")


def _responsible(spark, d):
    rows = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    agents = F.when(F.col("c_custkey") % 3 == 0, F.array("n_name", F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))))
    return rows.select(F.col("c_name").alias("doc_no"), F.when(F.col("c_custkey") % 3 == 1, F.col("n_name")).alias("agent"), agents.alias("agents"))


@query("SELECT c_name AS doc_no FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 <> 2")
def responsibilities_of_agent(spark, d):
    """Rows of one agent that some agent with the facilitator carries; each third nation has the facilitator F0."""
    chains = load(spark, d, "nation").select(F.col("n_name").alias("agent_name"), F.concat(F.lit("F"), (F.col("n_nationkey") % 3).cast("string")).alias("facilitator_name"))
    return R.responsibilities(_responsible(spark, d), chains, "NATION_3", "F0").select("doc_no")


@query("""SELECT n_name AS agent FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 2 UNION SELECT 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0""")
def all_agents(spark, d):
    return R.all_agents(_responsible(spark, d))


# -- contract state ---------------------------------------------------------------------------------------------

_ABI = '[{"type":"function","name":"total","stateMutability":"view","inputs":[]},{"type":"function","name":"of","stateMutability":"view","inputs":[{"name":"a","type":"address"}]},{"type":"event","name":"E"},{"type":"function","name":"cap","stateMutability":"pure","inputs":[]},{"type":"function","name":"set","stateMutability":"nonpayable","inputs":[]}]'
_IMPL = '[{"type":"function","name":"impl","stateMutability":"view","inputs":[]}]'
_S = ADDRESS("s_name")


@query(f"""WITH s AS (SELECT *, {_S} AS address FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0)
SELECT address, s_name AS registry_name, 0 AS pos, 'impl' AS fn FROM s WHERE s_suppkey % 6 = 0
UNION ALL SELECT address, s_name, 0, 'total' FROM s WHERE s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0 UNION ALL SELECT address, s_name, 3, 'cap' FROM s WHERE s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0""")
def state_calls(spark, d):
    """Calls of registered addresses on ethereum: the implementation's interface for proxies, no functions with arguments."""
    s = load(spark, d, "supplier")
    impl = ADDRESS("'i' || s_suppkey")
    addresses = s.selectExpr(f"{_S} AS address", "CASE WHEN s_suppkey % 5 = 0 THEN 'base' ELSE 'ethereum' END AS chain", "CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS registry_name", "s_suppkey % 3 = 0 AS is_proxy", f"{impl} AS implementation")
    cache = s.where("s_suppkey % 2 = 0").selectExpr(f"{_S} AS address").withColumn("abi", F.lit(_ABI)).unionByName(s.where("s_suppkey % 6 = 0").selectExpr(f"{impl} AS address").withColumn("abi", F.lit(_IMPL)))
    return C.calls(C.with_abi(C.readable(addresses), cache.withColumn("chain_id", F.lit(1))))


_BIG = "115792089237316195423570985008687907853269984665640564039457584007913129639935"


@query(f"""SELECT c_custkey, c_name || ', 1, a, —, ' || c_custkey || ', , true, {_BIG}, {{"b":[1,null,"x"],"a":{{"z":1.50}}}}' AS shown,
 '{{"n":"' || c_custkey || '","a":["' || c_nationkey || '",null],"f":0.5,"s":"x"}}' AS stored FROM customer""")
def state_nested_values(spark, d):
    """Arrays in arrays by their members, objects with the order of their keys, numbers of 256 bits; and longs stored as text."""
    rows = load(spark, d, "customer")
    value = F.concat(F.lit('["'), "c_name", F.lit('", [1, ["a", null, ['), F.col("c_custkey").cast("string"), F.lit(f']]], [], true, {_BIG}, {{"b": [1, null, "x"], "a": {{"z": 1.50}}}}]'))
    nested = F.struct(F.col("c_custkey").cast("long").alias("n"), F.array(F.col("c_nationkey").cast("long"), F.lit(None)).alias("a"), F.lit(0.5).alias("f"), F.lit("x").alias("s")).alias("v")
    table = rows.select("c_custkey", value.alias("json"), nested)
    return table.select("c_custkey", C.format_value(F.col("json")).alias("shown"), C.serialise(F.col("v"), table.schema["v"].dataType).alias("stored"))


@query("""SELECT c_name AS address, CASE c_custkey % 7 WHEN 0 THEN '12' WHEN 1 THEN c_name || ', ' || c_mktsegment WHEN 2 THEN c_mktsegment WHEN 3 THEN '{"a":1}' END AS shown FROM customer WHERE c_custkey % 7 < 4""")
def state_display(spark, d):
    """Results as shown: null, zero and empty ones and separators are left out; arrays are written with all members."""
    rows = load(spark, d, "customer")
    k = F.col("c_custkey") % 7
    value = F.when(k == 0, "12").when(k == 1, C.serialise(F.array("c_name", "c_mktsegment"))).when(k == 2, F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).when(k == 3, '{"a":1}').when(k == 4, C.ZERO).when(k == 5, "1")
    state = rows.select(F.col("c_name").alias("address"), F.when(k == 5, C.SKIPPED[0]).otherwise("total").alias("fn"), value.alias("value"))
    return C.shown(state).select("address", C.format_value(F.col("value")).alias("shown"))


@query(f"""SELECT c_custkey AS id, 0 AS pos, {_NATION} AS address, n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS total FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_custkey, 1, {OWN}, NULL, NULL FROM customer""")
def node_state(spark, d):
    """References of customers to their nation's address and their own, with facts and fetched values."""
    n = load(spark, d, "nation").selectExpr(f"{ADDRESS(chr(39) + 'n' + chr(39) + ' || n_nationkey')} AS address", "n_name", "n_nationkey")
    refs = _customers(spark, d, "c_custkey AS id", f"array({_NATION}, {OWN}) AS address_refs")
    state = n.where("n_nationkey % 2 = 0").select("address", F.lit("total").alias("fn"), F.col("n_name").alias("value"))
    return C.node_state(refs, n.select("address", F.col("n_name").alias("label")), state).select("id", "pos", "address", "label", F.element_at("values", "total").alias("total"))


# -- graph ------------------------------------------------------------------------------------------------------


@query(f"""WITH {views.RELATIONS_SQL}, {views.NAMED_SQL}, e AS (SELECT *, 'out' AS direction FROM relations WHERE from_id = 'n3' UNION ALL SELECT *, 'in' FROM relations WHERE to_id = 'n3')
SELECT from_id, to_id, edge_type, direction, a.name AS from_label, b.name AS to_label FROM e LEFT JOIN named a ON a.id = from_id LEFT JOIN named b ON b.id = to_id WHERE (SELECT slug FROM named WHERE id = 'n3') = 'nation_3'""")
def graph_entity(spark, d):
    """Edges of the entity of a slug."""
    return G.entity(views.named(spark, d), views.relations(spark, d), "nation_3").select("from_id", "to_id", "edge_type", "direction", "from_label", "to_label")


@query(f"""WITH {views.RELATIONS_SQL}, {views.NAMED_SQL} SELECT from_id, to_id, direction, other_id, coalesce(name, substr(other_id, 1, 8)) AS other_label FROM (
SELECT from_id, to_id, 'out' AS direction, to_id AS other_id FROM relations WHERE from_id = 'c7' UNION ALL SELECT from_id, to_id, 'in', from_id FROM relations WHERE to_id = 'c7') LEFT JOIN named ON id = other_id""")
def graph_other_end(spark, d):
    """The other end of a customer's edges; orders have no name and go by their id."""
    return G.other_end(G.edges_of(views.relations(spark, d), views.named(spark, d), "c7")).select("from_id", "to_id", "direction", "other_id", "other_label")


@query(f"""WITH {views.RELATIONS_SQL}, n AS (SELECT 'r1' AS id UNION SELECT from_id FROM relations WHERE to_id = 'r1' UNION SELECT b.from_id FROM relations a JOIN relations b ON b.to_id = a.from_id WHERE a.to_id = 'r1')
SELECT from_id, to_id, edge_type FROM relations WHERE from_id IN (FROM n) AND to_id IN (FROM n)""")
def graph_subgraph_edges(spark, d):
    """All edges among the nodes within two steps into a region."""
    return G.subgraph(views.relations(spark, d), "r1", 2, "in")[1].select("from_id", "to_id", "edge_type")


@query(f"""WITH {views.RELATIONS_SQL} SELECT 'n1' AS id, 0 AS distance UNION ALL SELECT DISTINCT to_id, 1 FROM relations WHERE from_id = 'n1' UNION ALL SELECT DISTINCT from_id, 1 FROM relations WHERE to_id = 'n1'""")
def graph_neighbours(spark, d):
    return G.neighbours(views.relations(spark, d), "n1", "both")[0]


_PROSE = "CASE n_nationkey % 5 WHEN 0 THEN 'The Operational Facilitator for ' || n_name || ' is `Fac ' || n_nationkey || '`.' WHEN 1 THEN 'Operational GovOps for ' || n_name || ' is Ops.' WHEN 2 THEN 'The Facilitator for ' || n_name || ' is `C`.' WHEN 3 THEN 'GovOps for ' || n_name || ' is `G`.' ELSE 'nothing' END"


@query("""SELECT 'n' || n_nationkey AS doc_id, ['operational_facilitator', 'govops', 'core_facilitator', 'core_govops'][n_nationkey % 5 + 1] AS kind, CASE n_nationkey % 5 WHEN 0 THEN 'Fac ' || n_nationkey WHEN 1 THEN 'Ops' WHEN 2 THEN 'C' ELSE 'G' END AS name FROM nation WHERE n_nationkey % 5 < 4""")
def named_entities(spark, d):
    return G.named_entities(load(spark, d, "nation").selectExpr("'n' || n_nationkey AS id", "'Core' AS type", f"{_PROSE} AS content"))


@query("SELECT 'n' || n_nationkey AS doc_id, 0 AS pos, n_name AS name FROM nation UNION ALL SELECT 'n' || n_nationkey, 1, 'region ' || n_regionkey FROM nation")
def listed_entities(spark, d):
    return G.listed_entities(load(spark, d, "nation").selectExpr("'n' || n_nationkey AS id", "'Active Data' AS type", "'List:' || chr(10) || '- ' || n_name || chr(10) || 'text' || chr(10) || '* region ' || n_regionkey AS content"))


@query(f"""WITH n AS (SELECT {UUID("('n' || n_nationkey)")} AS id, {UUID("('n' || (n_nationkey + 1))")} AS nxt, {UUID("('a' || n_nationkey)")} AS a, {UUID("('b' || n_nationkey)")} AS b, * FROM nation)
SELECT a AS from_id, id AS to_id, 'annotates' AS edge_type FROM n UNION ALL SELECT b, id, 'active_data_for' FROM n UNION ALL SELECT id, b, 'parent_of' FROM n
UNION ALL SELECT id, nxt, 'cites' FROM n WHERE nxt IN (SELECT id FROM n) UNION ALL SELECT id, 'core_govops:G' || n_nationkey, 'defines_entity' FROM n
UNION ALL SELECT id, '0x1:base', 'mentions' FROM n UNION ALL SELECT id, 'r' || n_regionkey, 'member_of' FROM n""")
def graph_derived_edge_types(spark, d):
    """All kinds of edges that documents imply: annotations, active data, citations, entities, mentions, members."""
    n = load(spark, d, "nation")
    own = UUID("('n' || n_nationkey)")
    core = n.selectExpr(f"{own} AS id", "'A.' || (n_nationkey + 1) AS doc_no", "'Core' AS type", "CAST(NULL AS STRING) AS parent_id", f"'GovOps for x is `G' || n_nationkey || '`. [next](' || {UUID(chr(40) + chr(39) + 'n' + chr(39) + ' || (n_nationkey + 1))')} || ')' AS content", "n_nationkey AS ord")
    notes = n.selectExpr(f"{UUID(chr(40) + chr(39) + 'a' + chr(39) + ' || n_nationkey)')} AS id", "'A.' || (n_nationkey + 1) || '.0.3.1' AS doc_no", "'Annotation' AS type", "CAST(NULL AS STRING) AS parent_id", "'' AS content", "n_nationkey AS ord")
    data = n.selectExpr(f"{UUID(chr(40) + chr(39) + 'b' + chr(39) + ' || n_nationkey)')} AS id", "'A.' || (n_nationkey + 1) || '.0.6.2' AS doc_no", "'Active Data' AS type", f"{own} AS parent_id", "'' AS content", "n_nationkey AS ord")
    mentions = core.select("id", F.lit("0x1").alias("address"), F.lit("base").alias("chain"))
    members = n.selectExpr(f"{own} AS entity_id", "'r' || n_regionkey AS agent_id", "'m' AS role")
    return G.derive_edges(core.unionByName(notes).unionByName(data), mentions, members).select("from_id", "to_id", "edge_type")


# -- outline ----------------------------------------------------------------------------------------------------


def _nodes(spark, d):
    return P.heading_parent(views.outline(spark, d), "root")


_TAILS = (".0.3.1", ".0.4.2", ".0.4.2.1.1", ".0.4.2.1.1.var1", ".0.6.3", ".7")
_TAIL_VALUES = ", ".join(f"('{t}', {n}, '{s}')" for t, n, s in zip(_TAILS, (0, 0, 1, 2, 0, 0), ("000", "000", "00011", "000112", "000", "0"), strict=True))


@query(f"""WITH {views.OUTLINE_SQL}, t(tail, more, seg) AS (VALUES {_TAIL_VALUES}), b AS (SELECT doc_no, len(string_split(doc_no, '.')) AS n FROM outline)
SELECT doc_no || tail AS doc_no, (n + more)::INT AS depth, array_to_string(list_transform(range(n), lambda i: i::VARCHAR) || list_transform(string_split_regex(seg, ''), lambda x: (n + x::INT)::VARCHAR), ',') AS segments FROM b, t""")
def supporting_depths(spark, d):
    """Depths of supporting documents below each node of the outline: instance, tenet, scenario and variation."""
    rows = spread(views.outline(spark, d).select("doc_no")).withColumn("_tail", F.explode(F.array(*(F.lit(x) for x in _TAILS)))).select(F.concat("doc_no", "_tail").alias("doc_no"))
    return rows.select("doc_no", docno.semantic_depth(F.col("doc_no")).alias("depth"), F.array_join(docno.segment_depths(F.col("doc_no")), ",").alias("segments"))


@query("""WITH t(tail, up) AS (VALUES ('', NULL), ('.0.3.1', ''), ('.0.4.2', ''), ('.0.4.2.1.1', '.0.4.2'), ('.0.4.2.1.1.var1', '.0.4.2.1.1'), ('.0.6.3', ''), ('.7', ''), ('.7.8', '.7'))
SELECT 'A.1.' || n_nationkey || tail AS id, CASE WHEN up IS NOT NULL THEN 'A.1.' || n_nationkey || up ELSE 'head' END AS parent FROM nation, t UNION ALL SELECT 'NR-' || n_nationkey, 'head' FROM nation""")
def docno_parent_of_supporting(spark, d):
    """Parents by number of instances, tenets, scenarios, variations and research notes (which keep their heading's)."""
    tails = F.explode(F.array(*(F.lit(x) for x in ("", *_TAILS, ".7.8"))))
    n = load(spark, d, "nation")
    rows = n.select(F.concat(F.lit("A.1."), F.col("n_nationkey").cast("string")).alias("_b"), "n_nationkey").withColumn("_t", tails).select(F.concat("_b", "_t").alias("doc_no"), "n_nationkey")
    rows = rows.unionByName(n.select(F.concat(F.lit("NR-"), F.col("n_nationkey").cast("string")).alias("doc_no"), "n_nationkey"))
    nodes = rows.select(F.col("doc_no").alias("id"), "doc_no", F.lit("head").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord"))
    return H.docno_parent(nodes).select("id", F.col("docno_parent_id").alias("parent"))


@query(f"WITH {views.OUTLINE_SQL} SELECT id FROM outline WHERE depth = 1 UNION SELECT 'n' || c_nationkey FROM customer WHERE c_custkey % 10 = 0")
def expanded_ids(spark, d):
    """What is open at first, and what must be open to show some customers."""
    nodes = _nodes(spark, d)
    return H.initially_expanded(nodes).unionByName(H.expand_to(nodes, nodes.where("depth = 3 and cast(substring(id, 2) as long) % 10 = 0"))).distinct()


@query("SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) AND n_nationkey <> 3 UNION ALL SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'c1'")
def auto_expanded_ids(spark, d):
    """A selected nation's family, but for the nation itself, which was toggled, and a toggled customer."""
    return H.auto_expanded(_nodes(spark, d), "n3", spark.createDataFrame([("n3",), ("c1",)], "id string"))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey % 2 = 1")
def deep_hidden_ids(spark, d):
    nodes = _nodes(spark, d)
    return H.deep_hidden(nodes, nodes.where("depth < 3 and (depth = 1 or cast(substring(id, 2) as int) % 2 = 0)").select("id"), 3).select("id")


@query(f"""WITH {views.OUTLINE_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY ord) AS rn FROM outline), me AS (SELECT * FROM f WHERE id IN ('n4', 'c8'))
SELECT me.id AS target, CASE WHEN f.rn < me.rn THEN 'above' WHEN f.rn > me.rn THEN 'below' ELSE 'self' END AS section, abs(f.rn - me.rn)::INT AS pos, f.id FROM me JOIN f ON f.up = me.up
UNION ALL SELECT id, 'parent', 0, up FROM me UNION ALL SELECT me.id, 'child', f.rn::INT, f.id FROM me JOIN f ON f.up = me.id""")
def context_unbounded(spark, d):
    """All siblings and children of two nodes."""
    nodes = _nodes(spark, d)
    return H.neighbours(nodes, nodes.where("id in ('n4', 'c8')"), None).select("target", "section", F.col("pos").cast("int").alias("pos"), "id")


@query("""SELECT n_nationkey, n_name || ' > x' AS two, 'Gov. ' || n_name || ' Parameters > b > ' || n_name AS three FROM nation""")
def breadcrumbs(spark, d):
    """Two titles stay as they are, three are shortened by one word each."""
    n = load(spark, d, "nation")
    long = F.concat(F.lit("Governance of the "), "n_name", F.lit(" Parameters"))
    crumbs = lambda *t: F.array_join(H.fit_breadcrumbs(F.array(*t), 80), " > ")
    return n.select("n_nationkey", crumbs(F.col("n_name"), F.lit("x")).alias("two"), crumbs(long, F.lit("b"), F.col("n_name")).alias("three"))


_WIDTHS = (220, 180, 150, 90, 75, 60)
_CRUMB = lambda s, m: f"(CASE WHEN length({s}) > {m} THEN substr({s}, 1, {m - 1}) || '…' ELSE {s} END)"
_SEVEN = lambda m: f"array_to_string([{_CRUMB('s2', m)} FOR x IN range(7)], ' > ')"


@query(f"""WITH n AS (SELECT n_nationkey, 'Gov. Parameters ' || n_name || ' Alpha Beta' AS s1, 'Gov. Params. ' || n_name || ' Alpha Beta' AS s2 FROM nation), w AS (SELECT unnest([{', '.join(map(str, _WIDTHS))}]) AS width)
SELECT n_nationkey, width::INT AS width, array_to_string([{_CRUMB('s1', 48)} FOR x IN range(4)], ' > ') AS four, array_to_string([{_CRUMB('s2', 36)} FOR x IN range(6)], ' > ') AS six,
 CASE {' '.join(f'WHEN length({_SEVEN(m)}) <= width THEN {_SEVEN(m)}' for m in (26, 22, 16, 10, 8))} ELSE {_SEVEN(6)} END AS seven FROM n, w""")
def breadcrumb_tiers(spark, d):
    """Four, six and seven titles, and seven at widths that each of the steps fits first."""
    rows = load(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Governance Parameters of the "), "n_name", F.lit(" Alpha Beta")).alias("title"), F.explode(F.array(*map(F.lit, _WIDTHS))).alias("width"))
    crumbs = lambda n: F.array_join(H.fit_breadcrumbs(F.array_repeat("title", n), F.col("width")), " > ")
    return rows.select("n_nationkey", "width", crumbs(4).alias("four"), crumbs(6).alias("six"), crumbs(7).alias("seven"))


@query(f"WITH {views.OUTLINE_SQL} SELECT id FROM outline WHERE id IN ('r0', 'n5') OR id = (SELECT up FROM outline WHERE id = 'n5')")
def deep_expanded_ids(spark, d):
    """The way to a node that lies as deep as children stay hidden: its parents from there on."""
    nodes = _nodes(spark, d)
    below = nodes.where("id = 'n5'").select(F.lit("x").alias("id"), F.concat("doc_no", F.lit(".9")).alias("doc_no"), F.lit(3).alias("depth"), F.col("id").alias("parent_id"), F.lit(1).cast("long").alias("ord"))
    return H.deep_expanded(nodes.select("id", "doc_no", "depth", "parent_id", "ord").unionByName(below), "x", spark.createDataFrame([("r0",)], "id string"), 2)


@query("SELECT DISTINCT 'n' || c_nationkey AS id FROM customer")
def deep_parents(spark, d):
    return H.with_deep_children(_nodes(spark, d), 3)


# -- history ----------------------------------------------------------------------------------------------------


def _flat(diff):
    seg = lambda s: F.concat(s["op"], F.lit("["), s["text"], F.lit("]"))
    return F.array_join(F.transform(diff, lambda r: F.concat(r["op"], F.coalesce(r["text"], F.lit("")), F.coalesce(F.array_join(F.transform(r["segs"], seg), ""), F.lit("")))), "|")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '=same|~=[The limit of ' || c_name || ' is ]-[' || c_custkey || ']+[' || (c_custkey + 1) || ']=[ units]|=end' WHEN 1 THEN '=b|=c|-' || c_name || '|=d|=e|…|=u|=v|+x' ELSE '' END AS diff FROM customer""")
def line_diffs(spark, d):
    """Line and word diffs: a changed word in a changed line; a removed and an added line with two lines around them."""
    old = "CASE c_custkey % 3 WHEN 0 THEN 'same' || chr(10) || 'The limit of ' || c_name || ' is ' || c_custkey || ' units' || chr(10) || 'end' WHEN 1 THEN concat_ws(chr(10), 'a', 'b', 'c', c_name, 'd', 'e', 'f', 'u', 'v') ELSE 'x' END"
    new = "CASE c_custkey % 3 WHEN 0 THEN 'same' || chr(10) || 'The limit of ' || c_name || ' is ' || (c_custkey + 1) || ' units' || chr(10) || 'end' WHEN 1 THEN concat_ws(chr(10), 'a', 'b', 'c', 'd', 'e', 'f', 'u', 'v', 'x') ELSE 'x' END"
    rows = spread(_customers(spark, d, "c_custkey", "c_name")).selectExpr("c_custkey", f"{old} AS old", f"{new} AS new")
    return rows.select("c_custkey", _flat(D.line_diff_udf("old", "new")).alias("diff"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN array_to_string(list_transform(range(20), lambda i: '+' || n_name || i::VARCHAR), '|') || '|…' ELSE '+' || n_name END AS diff FROM nation""")
def whole_diffs(spark, d):
    """An added content: the first twenty lines of twenty-five, or all of one."""
    text = F.when(F.col("n_nationkey") % 2 == 0, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.concat("n_name", i.cast("string"))), "\n")).otherwise(F.col("n_name"))
    return load(spark, d, "nation").select("n_nationkey", _flat(D.whole_diff(text, "+")).alias("diff"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::INT END AS pr FROM customer""")
def pr_numbers(spark, d):
    return _customers(spark, d, "c_custkey", "CASE c_custkey % 4 WHEN 1 THEN 'Fix (#12) later' WHEN 3 THEN 'Plain' ELSE 'Update ' || c_name || ' (#' || c_custkey || ')' END AS m").select("c_custkey", D.pr_number(F.col("m")).alias("pr"))


@query("""SELECT c_custkey AS number, 0 AS pos, c_name AS title, 'takes ' || c_mktsegment AS description FROM customer UNION ALL SELECT c_custkey, 1, 'Second', 'x - y' FROM customer""")
def proposal_bullets(spark, d):
    return D.bullets(_customers(spark, d, "c_custkey AS number", "'Intro' || chr(10) || '- **' || c_name || '** — takes ' || c_mktsegment || chr(10) || '- plain' || chr(10) || '* **Second** - x - y ' AS body"), "number", "body")


@query("""SELECT c_custkey AS id, (c_custkey // 100 + 1)::INT AS seq, '2024-05-06' AS date, substr(md5('h' || (c_custkey // 100 + 1)), 1, 7) AS commit_hash, CASE c_custkey % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'added' ELSE 'removed' END AS change, (c_custkey // 100 + 1)::INT AS pr, 'Rise' AS pr_title,
 CASE c_custkey % 3 WHEN 0 THEN c_name ELSE NULL END AS summary, CASE c_custkey % 3 WHEN 0 THEN 'word ' || c_custkey ELSE NULL END AS description, CASE c_custkey % 3 WHEN 0 THEN '~=[limit ]-[1]+[2]' WHEN 1 THEN '+limit 2' ELSE '-limit 1' END AS diff FROM customer""")
def history_entries(spark, d):
    """Entries of a commit for each hundred customers, each with its proposal: bullets named after the changed documents, others without a match."""
    k = F.col("c_custkey") % 3
    c = load(spark, d, "customer").withColumn("seq", (F.expr("c_custkey div 100") + 1).cast("int"))
    title = F.when(k == 0, F.col("c_name")).otherwise("zzz qqq").alias("title")
    old = c.where(k != 1).select(F.col("c_custkey").alias("id"), (F.col("seq") - 1).alias("seq"), title, F.lit("limit 1").alias("content"))
    nodes = old.unionByName(c.where(k != 2).select(F.col("c_custkey").alias("id"), "seq", title, F.lit("limit 2").alias("content")))
    changes = c.select(F.col("c_custkey").alias("id"), "seq", F.when(k == 0, "modified").when(k == 1, "added").otherwise("removed").alias("change"))
    commits = c.select("seq").distinct().selectExpr("seq", "md5('h' || seq) AS hash", "'2024-05-06T01:02:03Z' AS ts", "'Rise (#' || seq || ')' AS message")
    bullet = F.concat(F.lit("- **"), "c_name", F.lit("** — word "), F.col("c_custkey").cast("string"))
    body = c.where(k == 0).groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list(bullet)), "\n").alias("body"))  # a hundred customers
    prs = body.select(F.col("seq").alias("number"), F.lit("Rise").alias("title"), F.lit("me").alias("author"), F.lit("u").alias("url"), "body", *(F.lit(n).alias(x) for n, x in ((1, "review_count"), (0, "approval_count"), (2, "comment_count"))))
    return D.entries(changes, commits, prs, nodes).select("id", "seq", "date", "commit_hash", "change", "pr", "pr_title", "summary", "description", _flat(F.col("diff")).alias("diff"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a' || chr(10) || '```' || chr(10) || c_name || chr(10) || 'y' || chr(10) || '```' WHEN 1 THEN '`' || c_name || '`' || chr(10) || 'b'
 WHEN 2 THEN '```' || chr(10) || 'open ' || c_name || chr(10) || '```' WHEN 3 THEN c_name || ' `x` z' ELSE c_name END AS content FROM customer""")
def fenced_contents(spark, d):
    """Blocks that a lone backtick opens become fences, closed or not; code within a line, and all else, stays."""
    shapes = "CASE c_custkey % 5 WHEN 0 THEN 'a' || chr(10) || '`' || c_name || chr(10) || 'y`' WHEN 1 THEN '`' || c_name || '`' || chr(10) || 'b' WHEN 2 THEN '`open ' || c_name WHEN 3 THEN '  ' || c_name || ' `x` z' || chr(10) ELSE c_name || chr(10) || chr(10) END AS content"
    return P.clean_content(_customers(spark, d, "c_custkey", shapes))


@query("""SELECT 'c' || c_custkey AS id, md5(c_name) AS commit_hash FROM customer WHERE c_custkey <= 20 OR c_custkey > 60""")
def history_upsert(spark, d):
    """Commits after a checkpoint, some of them stored already, merged by key: nothing goes in twice."""
    commits = _customers(spark, d, "md5(c_name) AS hash", "c_custkey AS seq")
    last = commits.where("seq = 60").first()
    new = D.after_checkpoint(commits, last["hash"]).selectExpr("'c' || seq AS id", "hash AS commit_hash")
    stored = commits.where("seq <= 20 or seq between 61 and 80").selectExpr("'c' || seq AS id", "hash AS commit_hash")
    return D.upsert(stored, new.unionByName(new))
