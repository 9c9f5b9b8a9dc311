"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A logged conversation often is a snapshot of a longer one. Each turn gets a rolling hash of all turns up to
it (two 64-bit lanes over position, role and text, folded by exclusive or, so a running window computes it
in one pass); a conversation whose last hash is an inner hash of a longer one is dropped by an anti-join,
and of equal conversations the least id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.llm.common import written

#: One turn as text; ``{role}`` and ``{text}`` stand for the turn's own.
TURN = "<|{role}|>\n{text}\n"


def _render(turn: Column, template: str) -> Column:
    parts = []
    for i, piece in enumerate(template.split("{role}")):
        inner = piece.split("{text}")
        for j, literal in enumerate(inner):
            parts.append(F.lit(literal))
            if j < len(inner) - 1:
                parts.append(turn["_text"])
        if i < len(template.split("{role}")) - 1:
            parts.append(turn["_role"])
    return F.concat(*parts)


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TURN) -> DataFrame:
    """``conv_id, n_turns, kept, rendered``: one row for each conversation, ``rendered`` null where it is dropped.

    Turns go by (turn, role, text), nulls first; a null role or text counts as empty, a null conversation id
    is a conversation of its own. Repeated rows are turns of their own. A conversation is dropped if all its
    (role, text) pairs are the first ones of a longer conversation, or those of one as long with a smaller id
    (null is the smallest). Other columns are not looked at; an empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_col).alias("_conv"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(role_col, F.lit("")).alias("_role"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
    )
    order = W.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    hashed = rows.withColumn("_pos", F.row_number().over(order))
    for lane in (1, 2):
        hashed = hashed.withColumn(f"_h{lane}", F.bit_xor(F.xxhash64(F.lit(lane), "_pos", "_role", "_text")).over(running))
    hashed = written(hashed.select("_conv", "_pos", "_h1", "_h2"), "prefix-hashes")

    state = ["_pos", "_h1", "_h2"]
    last = hashed.groupBy("_conv").agg(F.max_by(F.struct(*state), "_pos").alias("_s")).select("_conv", "_s.*")
    # A hash that some conversation goes on from: equal ones combine before the shuffle.
    inner = hashed.join(last.select("_conv", F.col("_pos").alias("_n")), F.col("_n").eqNullSafe(F.col("_pos")) & hashed["_conv"].eqNullSafe(last["_conv"]), "left_anti").select(*state).distinct()
    maximal = last.join(inner, state, "left_anti")
    # Equal conversations: the least id of each; null ids first.
    stays = maximal.groupBy(*state).agg(F.min(F.struct(F.col("_conv").isNotNull(), F.col("_conv"))).alias("_m")).select(F.col("_m")["_conv"].alias("_kept"))
    kept = last.join(stays, last["_conv"].eqNullSafe(stays["_kept"]), "left_semi").select(F.col("_conv").alias("_k"), F.lit(True).alias("_stays"))

    turn = F.struct(F.col("_turn"), F.col("_role"), F.col("_text"))
    rendered = (
        rows.join(kept, rows["_conv"].eqNullSafe(kept["_k"]))
        .groupBy("_conv")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_turn").isNotNull(), turn.alias("t")))).alias("_turns"))
        .select(F.col("_conv").alias("_r"), F.array_join(F.transform("_turns", lambda t: _render(t["t"], template)), "").alias("rendered"))
    )
    return last.join(rendered, last["_conv"].eqNullSafe(rendered["_r"]), "left").select(
        F.col("_conv").alias(conv_col), F.col("_pos").cast("long").alias("n_turns"), F.col("rendered").isNotNull().alias("kept"), "rendered"
    )


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
p AS (
  SELECT conv_id, pos, role, text,
         md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
l AS (SELECT conv_id, n, h FROM p WHERE pos = n),
i AS (SELECT DISTINCT pos, h FROM p WHERE pos < n),
k AS (SELECT min(conv_id) AS conv_id FROM l WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.pos = l.n AND i.h = l.h) GROUP BY n, h),
r AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) AS rendered FROM p GROUP BY conv_id)
SELECT l.conv_id, l.n AS n_turns, k.conv_id IS NOT NULL AS kept, CASE WHEN k.conv_id IS NOT NULL THEN r.rendered END AS rendered
FROM l LEFT JOIN k USING (conv_id) JOIN r USING (conv_id)
"""
