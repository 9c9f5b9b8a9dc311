"""Hierarchies of numbered nodes: parents, ancestors, order, neighbours and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.functions import docno
from coppice.functions.text import natural_key
from coppice.sources.scratch import settled


def docno_index(nodes: DataFrame) -> DataFrame:
    """``doc_no, id``: the last node of each number."""
    return nodes.groupBy("doc_no").agg(F.max_by("id", "ord").alias("id"))


def docno_parent(nodes: DataFrame) -> DataFrame:
    """Adds ``docno_parent_id``, found by number with the heading parent (``parent_id``) as the last resort."""
    index = docno_index(nodes)
    d = F.col("doc_no")
    p = docno.parts(d)
    size = F.size(p)
    at = lambda k: F.when(size >= k, F.element_at(p, -k))
    supporting = (size >= 4) & (at(3) == "0") & at(2).isin(*docno.SUPPORTING)
    tenet = F.when((size >= 3) & (at(2) == "1") & docno.drop_last(d, 2).rlike(r"\.0\.4\.[0-9]+$"), docno.drop_last(d, 2))
    keyed = nodes.withColumn("_var", at(1).startswith("var")).withColumn("_tenet", F.when(~at(1).startswith("var") & ~supporting, tenet))
    keyed = keyed.withColumn("_up", F.when(F.col("_var"), docno.drop_last(d, 1)).when(supporting, docno.drop_last(d, 3)).otherwise(docno.drop_last(d, 1)))
    first = index.select(F.col("doc_no").alias("_tenet"), F.col("id").alias("_tenet_id"))
    second = index.select(F.col("doc_no").alias("_up"), F.col("id").alias("_up_id"))
    joined = keyed.join(first, "_tenet", "left").join(second, "_up", "left")
    parent = F.when(docno.is_research(d), F.col("parent_id")).when(size > 2, F.coalesce("_tenet_id", "_up_id", "parent_id"))
    return joined.withColumn("docno_parent_id", parent).select(*nodes.columns, "docno_parent_id")


def children(nodes: DataFrame, parent: str = "parent_id", limit: int | None = None) -> DataFrame:
    """``parent, ids``: children in order; ``limit`` keeps the first ones without collecting the rest."""
    rows = nodes.where(F.col(parent).isNotNull())
    if limit is not None:
        rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy(parent).orderBy("ord"))).where(F.col("_rn") <= limit)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
    return rows.groupBy(parent).agg(ids.alias("ids"), F.count("*").alias("n"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """``id, level, ancestor_id, ancestor_doc_no``: the nodes at the number's prefixes of two segments or more."""
    index = docno_index(nodes).select(F.col("doc_no").alias("ancestor_doc_no"), F.col("id").alias("ancestor_id"))
    p = docno.parts(F.col("doc_no"))
    rows = nodes.where(~docno.is_research(F.col("doc_no")) & (F.size(p) > 2)).select("id", p.alias("p"), F.explode(F.sequence(F.lit(2), F.size(p) - 1)).alias("level"))
    return rows.withColumn("ancestor_doc_no", docno.join(F.slice("p", F.lit(1), F.col("level")))).join(index, "ancestor_doc_no").select("id", "level", "ancestor_id", "ancestor_doc_no")


def parent_chain(nodes: DataFrame, hops: int = 3, parent: str = "parent_id") -> DataFrame:
    """Adds ``chain``: titles and numbers of up to ``hops`` parents, the nearest first."""
    up = nodes.select(F.col("id").alias("_id"), F.col("doc_no").alias("_no"), F.col("title").alias("_title"), F.col(parent).alias("_next"))
    out = nodes.withColumn("chain", F.array().cast("array<struct<doc_no: string, title: string>>")).withColumn("_at", F.col(parent))
    for _ in range(hops):
        out = out.join(up, F.col("_at") == F.col("_id"), "left")
        found = F.array(F.struct(F.col("_no").alias("doc_no"), F.col("_title").alias("title")))
        out = out.withColumn("chain", F.when(F.col("_id").isNotNull(), F.concat("chain", found)).otherwise(F.col("chain"))).withColumn("_at", F.col("_next")).drop("_id", "_no", "_title", "_next")
    return out.drop("_at")


def preorder(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Adds ``level`` (1 at roots), ``path`` and ``semantic_depth``; sorting by ``path`` gives the outline's order.

    Pointers double: after round k a row knows its path over 2 ** k levels, so the rounds are few however
    deep the outline is. Rows that only a cycle leads to are left out: a round in which no further row reaches
    its root shows that none will.
    """
    me = F.lpad(F.col("ord").cast("string"), 12, "0")
    steps = nodes.select("id", F.col(parent).alias("_up"), F.lit(1).alias("level"), me.alias("path"))
    steps, left = settled(steps), None
    while (open_ := steps.where("_up is not null").count()) and open_ != left:
        left = open_
        above = steps.select(F.col("id").alias("_a"), F.col("_up").alias("_next"), F.col("level").alias("_l"), F.col("path").alias("_p"))
        steps = steps.join(above, F.col("_up") == F.col("_a"), "left").select(
            "id", F.col("_next").alias("_up"), (F.col("level") + F.coalesce("_l", F.lit(0))).alias("level"), F.concat_ws("/", "_p", "path").alias("path")
        )
        steps = settled(steps)
    up = nodes.select(F.col("id").alias("_pid"), F.col("doc_no").alias("_pn"))
    out = nodes.join(steps.where("_up is null").drop("_up"), "id").join(up, F.col(parent) == F.col("_pid"), "left")
    return out.withColumn("semantic_depth", docno.semantic_depth(F.col("doc_no"), F.col("_pn"))).drop("_pid", "_pn")


def visible(outline: DataFrame, expanded: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Rows of ``preorder`` all of whose ancestors are in ``expanded`` (column ``id``)."""
    steps = outline.select("id", "path", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.col("level")), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/")), lambda x: x != F.col("path"))).alias("above"))
    at = outline.select(F.col("path").alias("above"), F.col("id").alias("above_id"))
    hidden = steps.join(at, "above").join(expanded.select(F.col("id").alias("above_id")), "above_id", "left_anti").select("id").distinct()
    return outline.join(hidden, "id", "left_anti")


def initially_expanded(nodes: DataFrame, depth: int = 1) -> DataFrame:
    return nodes.where(F.col("depth") <= depth).select("id")


def expand_to(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids that must be expanded for ``targets`` (column ``id``) to be visible."""
    return ancestors(nodes).join(targets.select("id"), "id", "left_semi").select(F.col("ancestor_id").alias("id")).distinct()


def auto_expanded(nodes: DataFrame, selected: str, toggled: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The selected node, its parent and siblings, exclusive-or the toggled ids."""
    me = nodes.where(F.col("id") == selected).select(F.col(parent).alias("_p")).limit(1)
    family = nodes.join(me, F.col(parent).eqNullSafe(F.col("_p"))).select("id")
    base = family.unionByName(me.select(F.col("_p").alias("id"))).where("id is not null").distinct()
    t = toggled.select("id").distinct()
    return base.exceptAll(t).unionByName(t.exceptAll(base))


def deep_hidden(nodes: DataFrame, expanded: DataFrame, depth: int = 6, parent: str = "parent_id") -> DataFrame:
    """Nodes of ``depth`` or deeper whose parent is not expanded."""
    return nodes.where(F.col("depth") >= depth).join(expanded.select(F.col("id").alias(parent)), parent, "left_anti")


def deep_expanded(nodes: DataFrame, selected: str, expanded: DataFrame, depth: int = 6, parent: str = "parent_id") -> DataFrame:
    """``expanded`` (column ``id``) and, if the selected node is of ``depth`` or deeper, the parents on its way up to that depth."""
    at = nodes.where((F.col("id") == selected) & (F.col("depth") >= depth)).select("id", "depth")
    path = ancestors(nodes).join(at.select("id"), "id", "left_semi").select(F.col("ancestor_id").alias("id")).join(nodes.select("id", "depth"), "id").unionByName(at)
    deep = path.where(F.col("depth") >= depth).join(nodes.select("id", F.col(parent).alias("_p")), "id").where("_p is not null")
    return expanded.select("id").unionByName(deep.select(F.col("_p").alias("id"))).distinct()


def with_deep_children(nodes: DataFrame, depth: int = 6, parent: str = "parent_id") -> DataFrame:
    """``id`` of the nodes that have a child of ``depth`` or deeper."""
    return nodes.where((F.col("depth") >= depth) & F.col(parent).isNotNull()).select(F.col(parent).alias("id")).distinct()


def neighbours(nodes: DataFrame, targets: DataFrame, window: int | None = 8, group: str = "parent_id", order: str = "ord", key: str = "id") -> DataFrame:
    """``target, section, pos, id``: parent, siblings up to ``window`` above and below, first ``window`` children.

    section is parent, above, self, below or child; pos counts from the target outwards (children from 1).
    """
    if window is not None and not 0 <= window <= 32:
        raise ValueError("window must lie between 0 and 32")
    most = window if window is not None else (1 << 31) - 1
    wanted = targets.select(F.col(key).alias("target"))
    # Only the families of the targets are ranked.
    mine = nodes.join(wanted, F.col(key) == F.col("target"))
    family = nodes.join(mine.select(F.col(group).alias("_g")).distinct(), F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    ranked = family.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(order)))
    me = ranked.join(wanted, F.col(key) == F.col("target")).select("target", F.col(group).alias("_g"), F.col("_rn").alias("_t"))
    gap = F.col("_rn") - F.col("_t")
    near = F.col(group).eqNullSafe(F.col("_g")) & (F.abs(gap) <= most)
    if window is not None:
        # Bands of window + 1 ranks: a target meets its own band and those beside it, not the whole family.
        band = F.floor(F.col("_t") / (window + 1))
        me = me.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
        ranked = ranked.withColumn("_in", F.floor(F.col("_rn") / (window + 1)))
        near &= F.col("_in") == F.col("_band")
    beside = ranked.join(me, near).select("target", F.when(gap < 0, "above").when(gap > 0, "below").otherwise("self").alias("section"), F.abs(gap).alias("pos"), F.col(key).alias("id"))
    above = mine.where(F.col(group).isNotNull()).select("target", F.lit("parent").alias("section"), F.lit(0).alias("pos"), F.col(group).alias("id"))
    kids = nodes.join(wanted, F.col(group) == F.col("target")).withColumn("pos", F.row_number().over(W.partitionBy("target").orderBy(order))).where(F.col("pos") <= most)
    return beside.unionByName(above).unionByName(kids.select("target", F.lit("child").alias("section"), "pos", F.col(key).alias("id")))


def get(nodes: DataFrame, key: str) -> DataFrame:
    """The node of this id, or else the last of this number; no row if there is none."""
    hits = nodes.where((F.col("id") == key) | (F.col("doc_no") == key))
    return hits.orderBy((F.col("id") == key).desc(), F.col("ord").desc()).limit(1)


def project(nodes: DataFrame, include_content: bool = True, parent: str = "parent_id") -> DataFrame:
    """Nodes with their parent's number and title; ``address_refs`` null where empty, content only if asked for."""
    up = nodes.select(F.col("id").alias("_pid"), F.col("doc_no").alias("parent_doc_no"), F.col("title").alias("parent_title"))
    out = nodes.join(up, F.col(parent) == F.col("_pid"), "left").drop("_pid")
    if "address_refs" in nodes.columns:
        out = out.withColumn("address_refs", F.when(F.size("address_refs") > 0, F.col("address_refs")))
    return out if include_content else out.drop("content")


def scopes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("depth") == 1).orderBy("ord")


def natural_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(natural_key(F.col("doc_no")), "ord")


# Words left out of shortened titles, and abbreviations.
STOP_WORDS = ("the", "a", "of", "an", "and", "or", "for", "in", "on", "to", "at", "by", "with", "from")
ABBREVIATIONS = {
    "directory": "Dir.", "directories": "Dirs.", "document": "Doc.", "documents": "Docs.", "configuration": "Config.", "configurations": "Configs.",
    "specification": "Spec.", "specifications": "Specs.", "controller": "Ctrl.", "controllers": "Ctrls.", "primitives": "Prims.", "primitive": "Prim.",
    "instances": "Inst.", "instance": "Inst.", "artifacts": "Artfcts.", "properties": "Props.", "property": "Prop.", "governance": "Gov.",
    "definition": "Def.", "definitions": "Defs.", "ecosystem": "Eco.", "implementation": "Impl.", "implementations": "Impls.", "transformation": "Xform.",
    "transformations": "Xforms.", "transitionary": "Trans.", "customizations": "Customs.", "customization": "Custom.", "accessibility": "A11y.", "reimbursement": "Reimb.",
    "communication": "Comms.", "communications": "Comms.", "responsibilities": "Resps.", "responsibility": "Resp.", "authorization": "Auth.", "infrastructure": "Infra.",
    "determination": "Determ.", "administrative": "Admin.", "accountability": "Acctbl.", "reconciliation": "Recon.", "documentation": "Docs.", "identification": "Ident.",
    "interpolation": "Interp.", "participation": "Partic.", "representation": "Rep.", "classification": "Class.", "incorporation": "Incorp.", "consolidation": "Consol.",
    "qualification": "Qual.", "organizational": "Org.", "comprehensive": "Compr.", "bootstrapping": "Bootstrap.", "distribution": "Distrib.", "management": "Mgmt.",
    "operational": "Oper.", "parameters": "Params.", "parameter": "Param.", "collateral": "Collat.", "foundation": "Fndn.", "information": "Info.",
    "transaction": "Txn.", "transactions": "Txns.", "integration": "Integ.", "integrations": "Integs.", "requirements": "Reqs.", "requirement": "Req.",
    "environment": "Env.", "application": "App.", "applications": "Apps.", "verification": "Verif.", "notification": "Notif.", "notifications": "Notifs.",
}


def shorten_title(title: Column, most: int, ratio: float = 0.5, abbreviations: dict[str, str] | None = None) -> Column:
    """Without stop words; the longest known words abbreviated up to a share of the words; cut with an ellipsis."""
    table = F.create_map(*(F.lit(x) for kv in (abbreviations or ABBREVIATIONS).items() for x in kv))
    stop = r"(?i)(?<![A-Za-z0-9_])(" + "|".join(STOP_WORDS) + r")(?![A-Za-z0-9_])"
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(title, stop, ""), r"\s{2,}", " ")), " ")
    allowed = F.greatest(F.lit(1), F.floor(F.size(words) * F.lit(ratio)).cast("int"))
    known = F.filter(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), F.element_at(table, F.lower(w)).alias("a"))), lambda c: c["a"].isNotNull())
    chosen = F.transform(F.slice(F.array_sort(known), F.lit(1), allowed), lambda c: c["i"])
    short = F.array_join(F.transform(words, lambda w, i: F.when(F.array_contains(chosen, i), F.element_at(table, F.lower(w))).otherwise(w)), " ")
    return F.when(F.length(short) > most, F.concat(F.substring(short, 1, most - 1), F.lit("…"))).otherwise(short)


def fit_breadcrumbs(titles: Column, width: int | Column, separator: str = " / ") -> Column:
    """Titles shortened by tiers of how many there are; beyond six by the first step that fits ``width`` characters."""
    short = lambda most, ratio: F.transform(titles, lambda t: shorten_title(t, most, ratio))
    out = F.when(F.size(titles) <= 2, titles).when(F.size(titles) <= 4, short(48, 0.33)).when(F.size(titles) <= 6, short(36, 0.66))
    for most, ratio in ((26, 0.66), (22, 0.8), (16, 1.0), (10, 1.0), (8, 1.0)):
        out = out.when(F.length(F.array_join(short(most, ratio), separator)) <= width, short(most, ratio))
    return out.otherwise(short(6, 1.0))
