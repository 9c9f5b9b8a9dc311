"""Property graph over edge tables: resolution, neighbours, bounded subgraphs and edge derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import docno
from coppice.operators.extraction import links
from coppice.sources.scratch import settled

EDGE = "from_id string, from_type string, to_id string, to_type string, edge_type string, sources array<string>, meta string"
#: Edge types that panels hide.
HIDDEN = ("parent_of", "mentions", "proxies_to", "cites")


def vertices(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and the ends of edges that are no entity: ``id, type, name``."""
    ends = edges.select(F.col("from_id").alias("id"), F.col("from_type").alias("type")).unionByName(edges.select(F.col("to_id").alias("id"), F.col("to_type").alias("type")))
    extra = ends.groupBy("id").agg(F.min("type").alias("type")).join(entities.select("id"), "id", "left_anti")
    return entities.select("id", "type", "name").unionByName(extra.withColumn("name", F.lit(None).cast("string")))


def resolve(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``from_label`` and ``to_label``, the names of entities."""
    a = entities.select(F.col("id").alias("from_id"), F.col("name").alias("from_label"))
    b = entities.select(F.col("id").alias("to_id"), F.col("name").alias("to_label"))
    return edges.join(a, "from_id", "left").join(b, "to_id", "left")


def edges_of(edges: DataFrame, entities: DataFrame, node: str) -> DataFrame:
    """Out and in edges of a node with labels and ``direction``; none if it is unknown. A loop is both."""
    out = edges.where(F.col("from_id") == node).withColumn("direction", F.lit("out"))
    return resolve(out.unionByName(edges.where(F.col("to_id") == node).withColumn("direction", F.lit("in"))), entities)


def entity(entities: DataFrame, edges: DataFrame, slug: str) -> DataFrame:
    """Edges of the entity of this slug, out first."""
    me = entities.where(F.col("slug") == slug).select(F.col("id").alias("_me"))
    out = edges.join(me, F.col("from_id") == F.col("_me")).withColumn("direction", F.lit("out"))
    into = edges.join(me, F.col("to_id") == F.col("_me")).withColumn("direction", F.lit("in"))
    return resolve(out.unionByName(into).drop("_me"), entities).orderBy(F.desc("direction"), "edge_type", "from_id", "to_id")


def distances(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """``root, id, distance``: nodes within ``depth`` steps of each root; a frontier join with an anti-join on visited."""
    out = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    into = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    step = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    seen = frontier = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("distance"))
    for d in range(1, depth + 1):
        reached = frontier.join(step, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        # Written, so that a round does not run those before it again; only nodes reached are made distinct, not edges.
        frontier = settled(reached.join(seen, ["root", "id"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, root: str, depth: int = 1, direction: str = "out") -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` steps and all edges among them; both empty if no edge knows the root."""
    known = edges.where((F.col("from_id") == root) | (F.col("to_id") == root)).select(F.lit(root).alias("id")).limit(1)
    nodes = distances(edges, known, depth, direction).select("id", "distance")
    a, b = nodes.select(F.col("id").alias("from_id")), nodes.select(F.col("id").alias("to_id"))
    return nodes, edges.join(a, "from_id", "left_semi").join(b, "to_id", "left_semi")


def neighbours(edges: DataFrame, root: str, direction: str = "out") -> tuple[DataFrame, DataFrame]:
    return subgraph(edges, root, 1, direction)


def degree(edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree``; parallel edges count."""
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("i"))
    return out.join(into, "id", "full_outer").select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def cited_by(resolved: DataFrame) -> DataFrame:
    return resolved.where((F.col("direction") == "in") & (F.col("edge_type") == "cites"))


def shown(resolved: DataFrame, hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    return resolved.where(~F.col("edge_type").isin(*hidden))


def other_end(resolved: DataFrame) -> DataFrame:
    """Adds ``other_id`` and ``other_label``, which falls back to the id's first eight characters."""
    out = F.col("direction") == "out"
    other: Column = F.when(out, F.col("to_id")).otherwise(F.col("from_id"))
    return resolved.withColumn("other_id", other).withColumn("other_label", F.coalesce(F.when(out, F.col("to_label")).otherwise(F.col("from_label")), F.substring(other, 1, 8)))


# Phrases that name an entity.
ENTITY_RULES = (
    ("operational_facilitator", r"The Operational Facilitator for .+? is `?([^`.\n]+)`?"),
    ("govops", r"Operational GovOps for .+? is `?([^`.\n]+)`?"),
    ("core_facilitator", r"The Facilitator for .+? is `?([^`.\n]+)`?"),
    ("core_govops", r"(?<!Operational )GovOps for .+? is `?([^`.\n]+)`?"),
)


def named_entities(nodes: DataFrame) -> DataFrame:
    """``doc_id, kind, name``: entities that core nodes' prose names."""
    rules = F.array(*(F.struct(F.lit(k).alias("kind"), F.when(F.col("content").rlike(p), F.trim(F.regexp_extract("content", p, 1))).alias("name")) for k, p in ENTITY_RULES))
    return nodes.where(F.col("type") == "Core").select(F.col("id").alias("doc_id"), F.explode(rules).alias("r")).where("r.name is not null").select("doc_id", "r.*")


def listed_entities(nodes: DataFrame) -> DataFrame:
    """``doc_id, pos, name``: list items of active-data nodes."""
    items = F.regexp_extract_all("content", F.lit(r"(?m)^[-*]\s+(.+)$"), F.lit(1))
    return nodes.where(F.col("type") == "Active Data").select(F.col("id").alias("doc_id"), F.posexplode(items).alias("pos", "name"))


def derive_edges(nodes: DataFrame, mentions: DataFrame | None = None, members: DataFrame | None = None, parent: str = "parent_id") -> DataFrame:
    """Edges that the nodes imply: parent_of, cites, annotates, active_data_for, defines_entity; mentions and member_of if given.

    mentions: ``id, address, chain``. members: ``entity_id, agent_id, role``.
    """
    none, no_meta = F.array().cast("array<string>"), F.lit(None).cast("string")

    def edge(a: Column, at: str, b: Column, bt: str, kind: str, meta: Column = no_meta) -> list[Column]:
        return [a.alias("from_id"), F.lit(at).alias("from_type"), b.alias("to_id"), F.lit(bt).alias("to_type"), F.lit(kind).alias("edge_type"), none.alias("sources"), meta.alias("meta")]

    index = nodes.groupBy(F.col("doc_no").alias("_no")).agg(F.max_by("id", "ord").alias("_to"))
    out = nodes.where(F.col(parent).isNotNull()).select(*edge(F.col(parent), "doc", F.col("id"), "doc", "parent_of"))
    known = nodes.select(F.col("id").alias("target"))
    out = out.unionByName(links(nodes).join(known, "target", "left_semi").select(*edge(F.col("id"), "doc", F.col("target"), "doc", "cites")))
    for directory, kind in (("3", "annotates"), ("6", "active_data_for")):
        rows = nodes.where(F.col("doc_no").rlike(rf"\.0\.{directory}\.[0-9]+$")).withColumn("_no", docno.drop_last(F.col("doc_no"), 3)).join(index, "_no")
        out = out.unionByName(rows.select(*edge(F.col("id"), "doc", F.col("_to"), "doc", kind)))
    named = named_entities(nodes).select(*edge(F.col("doc_id"), "doc", F.concat_ws(":", "kind", "name"), "entity", "defines_entity"))
    out = out.unionByName(named)
    if mentions is not None:
        out = out.unionByName(mentions.select(*edge(F.col("id"), "doc", F.concat_ws(":", "address", "chain"), "address", "mentions")))
    if members is not None:
        out = out.unionByName(members.select(*edge(F.col("entity_id"), "entity", F.col("agent_id"), "entity", "member_of", F.to_json(F.struct("role")))))
    return out
