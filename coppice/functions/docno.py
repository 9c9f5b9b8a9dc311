"""Expressions over dotted document numbers such as ``A.1.2.0.3.1`` or ``NR-3``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second segments of a supporting directory ``.0.x``.
SUPPORTING = ("3", "4", "6")


def parts(doc_no: Column) -> Column:
    return F.split(doc_no, r"\.")


def join(segments: Column) -> Column:
    return F.array_join(segments, ".")


def drop_last(doc_no: Column, n: int) -> Column:
    p = parts(doc_no)
    return F.when(F.size(p) > n, join(F.slice(p, 1, F.greatest(F.size(p) - n, F.lit(1)))))


def is_research(doc_no: Column) -> Column:
    return doc_no.startswith("NR-")


def _pairs(rest: Column) -> Column:
    """Levels below an instance: ``1`` and what follows it are one level together, any other segment is one."""
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("held"))
    done = F.aggregate(
        rest,
        state,
        lambda a, x: F.when(a["held"], F.struct(a["n"].alias("n"), F.lit(False).alias("held"))).otherwise(F.struct((a["n"] + 1).alias("n"), (x == "1").alias("held"))),
    )
    return done["n"]


def _plain_depth(p: Column) -> Column:
    size = F.size(p)
    at = F.when(size >= 3, F.sequence(F.lit(2), size - 1)).otherwise(F.array().cast("array<int>"))
    marker = F.array_max(F.filter(at, lambda i: (F.element_at(p, i) == "0") & F.element_at(p, i + 1).isin(*SUPPORTING)))
    # marker is 1-based: directory at marker, marker + 1; instance at marker + 2.
    rest = F.when(size > marker + 2, F.slice(p, marker + 3, F.greatest(size - marker - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.when(marker.isNull(), size - 1).otherwise(marker - 1 + _pairs(rest))


def semantic_depth(doc_no: Column, parent_doc_no: Column | None = None) -> Column:
    """Depth of a document in the outline: supporting directories and their instance share one level."""

    def numbered(d: Column) -> Column:
        p = parts(d)
        var = F.array_position(F.transform(p, lambda x: x.startswith("var")), True).cast("int")
        before = F.slice(p, 1, F.greatest(var - 1, F.lit(1)))
        return F.when(var > 1, _plain_depth(before) + 1).when(var == 1, F.lit(1)).otherwise(_plain_depth(p))

    research = F.lit(1)
    if parent_doc_no is not None:
        above = F.when(is_research(parent_doc_no), F.lit(1)).otherwise(numbered(parent_doc_no))
        research = F.when(F.coalesce(parent_doc_no, F.lit("")) == "", F.lit(1)).otherwise(above + 1)
    return F.when(is_research(doc_no), research).otherwise(numbered(doc_no))


def segment_depths(doc_no: Column) -> Column:
    """Depth of each segment; the segments of a supporting directory, and of a scenario pair, share one."""
    p = parts(doc_no)
    size = F.size(p)
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("tenet"), F.lit(0).alias("skip"))

    def step(a: Column, i: Column) -> Column:
        x, nxt = F.element_at(p, i), F.when(i < size, F.element_at(p, F.least(i + 1, size)))
        deeper = a["depth"] + 1
        state = lambda depth, tenet, skip: F.struct(F.concat(a["out"], F.array(depth)).alias("out"), depth.alias("depth"), tenet.alias("tenet"), skip.alias("skip"))
        return (
            F.when(a["skip"] > 0, state(a["depth"], a["tenet"], a["skip"] - 1))
            .when(x.startswith("var"), state(deeper, F.lit(False), F.lit(0)))
            .when((x == "0") & (i + 2 <= size) & nxt.isin(*SUPPORTING), state(deeper, nxt == "4", F.lit(2)))
            .when(a["tenet"] & (x == "1") & (i < size), state(deeper, F.lit(False), F.lit(1)))
            .when(i == 1, state(F.lit(0), F.lit(False), F.lit(0)))
            .otherwise(state(deeper, F.lit(False), F.lit(0)))
        )

    return F.when(is_research(doc_no), F.array(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), size), start, step)["out"])


def clamp_depth(depth: Column, most: int = 17) -> Column:
    return F.least(F.greatest(depth, F.lit(1)), F.lit(most))
