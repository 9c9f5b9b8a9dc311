"""Relational reports: chains of responsibility, controllers' active data, filters and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.functions.text import natural_key
from coppice.operators import extraction as X

# Names that stand for roles, not parties.
ROLE_NAMES = ("Operational Facilitator", "Core Facilitator", "Operational GovOps", "Core GovOps", "Support Facilitators", "Unknown")
EXECUTOR_PREFIX = r"(?i)^(Operational|Core Council) Executor Agent\s+"
GOVERNANCE = "Governance"
HEADER = ("Controller Doc", "Title", "Process", "Agent", "Executor Agent", "Facilitator", "GovOps", "Responsible Party", "Active Data")


def _first(edges: DataFrame, by: str) -> DataFrame:
    return edges.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy("ord"))).where("_rn = 1").drop("_rn")


def agent_chain(entities: DataFrame, edges: DataFrame, inner: bool = False) -> DataFrame:
    """Prime agents with their first executor, its first facilitator and first govops member.

    entities: ``id, name, type, subtype``; edges: ``from_id, to_id, edge_type, meta, ord``. A member's role is in
    the edge's JSON, malformed JSON has none. ``inner`` drops agents without an executor or a facilitator.
    """
    name = lambda prefix: entities.select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"))
    primes = entities.where("type = 'agent' and subtype = 'prime'").select(F.col("id").alias("agent_id"), F.col("name").alias("agent_name"))
    accord = _first(edges.where("edge_type = 'executor_accord'"), "from_id").select(F.col("from_id").alias("agent_id"), F.col("to_id").alias("executor_id"))
    role = F.get_json_object("meta", "$.role")
    members = edges.where("edge_type = 'member_of'").select("ord", F.col("from_id").alias("member_id"), F.col("to_id").alias("executor_id"), role.alias("role"))
    facilitator = _first(members.where(F.col("role").contains("facilitator")), "executor_id").select("executor_id", F.col("member_id").alias("facilitator_id"))
    govops = _first(members.where("role = 'govops'"), "executor_id").select("executor_id", F.col("member_id").alias("govops_id"))
    how = "inner" if inner else "left"
    out = primes.join(accord, "agent_id", how).join(name("executor"), "executor_id", how).join(facilitator, "executor_id", how).join(name("facilitator"), "facilitator_id", how)
    out = out.join(govops, "executor_id", "left").join(name("govops"), "govops_id", "left")
    return out.select("agent_id", "agent_name", "executor_id", F.regexp_replace("executor_name", EXECUTOR_PREFIX, "").alias("executor_name"), "facilitator_id", "facilitator_name", "govops_id", "govops_name")


def prefixes_before(doc_no: Column, marker: str = ".0.6.") -> Column:
    """Every prefix of a number that ``marker`` follows, so that a prefix join is an equi-join."""
    pieces = F.split(doc_no, marker.replace(".", r"\."), -1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.when(F.size(pieces) > 1, F.array_join(F.slice(pieces, F.lit(1), i), marker)))


def active_data(edges: DataFrame, entities: DataFrame, nodes: DataFrame, chains: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One row for each responsibility edge to a known controller, with its active-data documents in natural order.

    The result names a controller's documents once for each of its edges, so only narrow rows are joined and sorted.
    The documents come last, from a broadcast table that names each once, and no wide row is shuffled or sorted.
    """
    below = nodes.select("doc_no", F.explode(prefixes_before(F.col("doc_no"))).alias("_up")).where("_up is not null")
    who = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("_name"), F.col("type").alias("_type"))
    rows = edges.where("edge_type = 'responsible_for'").select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("id"), F.element_at("sources", 1).alias("source"))
    rows = rows.join(nodes.select("id", "doc_no", "title", "content"), "id").join(who, "entity_id", "left")
    rows = rows.withColumn("agent", X.agent_of(F.col("doc_no"), prefixes)).join(chains.withColumnRenamed("agent_name", "agent"), "agent", "left")
    rows = rows.withColumn("process", classify_process(F.col("content"))).drop("content")
    # A fixed number of ranges, as few bytes of narrow rows become many; ids split the edges of one controller.
    by, parts = (natural_key(F.col("doc_no")), "entity_id"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = rows.where(F.monotonically_increasing_id() >= 0)  # true of all: Spark takes a sort out that only a join is above
    docs = below.groupBy("_up").agg(F.array_sort(F.collect_list(F.struct(natural_key(F.col("doc_no")).alias("k"), "doc_no"))).alias("_d"))
    docs = docs.select("_up", F.transform("_d", lambda d: d["doc_no"]).alias("active_docs"))
    return rows.join(F.broadcast(docs), F.col("doc_no") == F.col("_up"), "left").select(
        "id", "doc_no", "title", F.coalesce("_name", F.lit("Unknown")).alias("entity_name"), "entity_id", F.coalesce("_type", F.lit("unknown")).alias("entity_type"),
        "process", "agent", "executor_name", "facilitator_name", "govops_name", F.coalesce("active_docs", F.array().cast("array<string>")).alias("active_docs"), "source",
    )


def classify_process(content: Column) -> Column:
    return F.when(content.rlike("(?i)alignment conserver"), "Alignment Conserver Changes").otherwise("Direct Edit")


def agents(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``agent``: those that occur, governance (null) first and then in the given order."""
    rank = F.array_position(F.array(*(F.lit(x) for x in (GOVERNANCE, *order))), F.col("agent"))
    return rows.select(F.coalesce("agent", F.lit(GOVERNANCE)).alias("agent")).distinct().where(rank > 0).orderBy(rank)


def editors(rows: DataFrame, columns: tuple[str, ...] = ("executor_name", "facilitator_name", "govops_name"), roles: tuple[str, ...] = ROLE_NAMES) -> DataFrame:
    """``name``: distinct parties that are no role, and distinct names of the chain's columns, sorted."""
    own = rows.where(~F.col("entity_name").isin(*roles)).select(F.col("entity_name").alias("name"))
    others = rows.select(F.explode(F.array(*columns)).alias("name")).where("name is not null and name <> ''")
    return own.unionByName(others).distinct().orderBy("name")


def filtered(rows: DataFrame, agent: str | None = None, entity: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if agent is not None:
        keep &= F.col("agent").isNull() if agent == GOVERNANCE else F.col("agent").eqNullSafe(F.lit(agent))
    if entity is not None:
        keep &= F.coalesce(F.array_contains(F.array(*(F.coalesce(c, F.lit("")) for c in ("entity_name", "executor_name", "facilitator_name", "govops_name"))), entity), F.lit(False))
    return rows.where(keep)


def agents_of(rows: DataFrame) -> Column:
    """A row's agents: the array if it has one, else the single agent, else none."""
    single = F.when(F.col("agent").isNotNull(), F.array("agent")).otherwise(F.array().cast("array<string>"))
    return F.coalesce("agents", single)


def responsibilities(rows: DataFrame, chains: DataFrame, agent: str | None = None, facilitator: str | None = None) -> DataFrame:
    """Rows of an agent, and rows of which some agent has the facilitator (a semi-join)."""
    out = rows if agent is None else rows.where(F.array_contains(agents_of(rows), agent))
    if facilitator is not None:
        names = chains.where(F.col("facilitator_name") == facilitator).select(F.col("agent_name").alias("_a"))
        hits = out.select("doc_no", F.explode(agents_of(out)).alias("_a")).join(names, "_a", "left_semi").select("doc_no").distinct()
        out = out.join(hits, "doc_no", "left_semi")
    return out


def by_category(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """``label, n``: categories that occur, in the labels' order."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    rank = F.array_position(F.array(*(F.lit(k) for k in labels)), F.col("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n")).where(rank > 0).orderBy(rank).select("category", F.element_at(table, F.col("category")).alias("label"), "n")


def row_facilitators(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """``doc_no, facilitator_id, executor_name``: distinct facilitators of each row, the first agent's chain wins."""
    each = rows.select("doc_no", F.posexplode(agents_of(rows)).alias("_pos", "agent_name")).join(chains, "agent_name")
    return each.groupBy("doc_no", "facilitator_id").agg(F.min_by("executor_name", "_pos").alias("executor_name"), F.min("_pos").alias("pos"))


def all_agents(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(agents_of(rows)).alias("agent")).distinct()


def controllers(nodes: DataFrame, facilitators: DataFrame) -> DataFrame:
    """Active-data controllers with party, process, agent and context, in natural order."""
    rows = nodes.where("type = 'Active Data Controller'").select("id", "doc_no", "title", X.party_of(F.col("content")).alias("party"), X.process_of(F.col("content")).alias("process"), X.agent_of(F.col("doc_no")).alias("agent"))
    return X.title_context(X.resolve_party(rows, facilitators), nodes).drop("party").orderBy(natural_key(F.col("doc_no")))


def csv_rows(rows: DataFrame) -> DataFrame:
    """The export's columns under their headings; Spark's writer quotes and escapes them."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    columns = ("doc_no", "title", "process", F.coalesce("agent", F.lit(GOVERNANCE)), empty("executor_name"), empty("facilitator_name"), empty("govops_name"), "entity_name", F.array_join("active_docs", "; "))
    return rows.select(*((F.col(c) if isinstance(c, str) else c).alias(h) for c, h in zip(columns, HEADER, strict=True)))
