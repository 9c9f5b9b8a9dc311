"""Version history: snapshot diffs, line and word diffs, matching of proposals, timelines and increments."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Words that matching ignores.
STOP_WORDS = ("the", "a", "an", "and", "or", "for", "in", "on", "to", "at", "by", "with", "from", "of", "is", "as")
THRESHOLD = 0.35
CONTEXT, HEAD_LINES, BODY_CHARS = 2, 20, 500
#: Rows of an edit table that are kept at each level.
KEPT_ROWS = 64
#: Diffs of a batch that are Python objects at a time.
DIFFS = 64

SEGMENT = T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())])
DIFF = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType()), T.StructField("segs", T.ArrayType(SEGMENT))]))

ARROW_DIFF = pa.list_(pa.field("element", pa.struct([("op", pa.string()), ("text", pa.string()), ("segs", pa.list_(pa.field("element", pa.struct([("op", pa.string()), ("text", pa.string())]))))])))


def with_hash(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("content_hash", F.md5("content"))


def snapshot_diff(snapshots: DataFrame, key: str = "id", seq: str = "seq", columns: tuple[str, ...] = ("content_hash", "title")) -> DataFrame:
    """``key, seq, change``: added, modified (one of ``columns`` differs) or removed, between consecutive snapshots.

    Consecutive numbers of ``seq`` follow each other. Only hashes move: one full outer join on (key, seq).
    """
    last = snapshots.agg(F.max(seq)).first()[0]
    now = snapshots.select(key, F.col(seq).alias("seq"), F.struct(*columns).alias("_now"))
    old = snapshots.where(F.col(seq) < F.lit(last)).select(key, (F.col(seq) + 1).alias("seq"), F.struct(*columns).alias("_old"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_now").isNull(), "removed").when(~F.col("_now").eqNullSafe(F.col("_old")), "modified")
    return now.join(old, [key, "seq"], "full_outer").select(key, "seq", change.alias("change")).where("change is not null")


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Longest-common-subsequence edits; where both are as good, deletions come before insertions.

    Rows of the table are numpy vectors: along a row, the best of the left cell is a running maximum. Only some rows
    are kept, and those between two of them are made again while the path is followed back through them, so that
    memory is in proportion to the shorter way along the table and to the logarithm of the other.
    """
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1  # the path takes every match at the end, so these need no table
    out = [("=", t) for t in a[len(a) - end :][::-1]]
    a, b = a[: len(a) - end], b[: len(b) - end]
    codes: dict[str, int] = {}
    x = [codes.setdefault(t, len(codes)) for t in a]
    y = np.array([codes.setdefault(t, len(codes)) for t in b], dtype=np.int64)
    by = np.argsort(y, kind="stable")
    first = np.searchsorted(y[by], np.arange(len(codes) + 1))

    def below(up: np.ndarray, i: int) -> np.ndarray:
        """Row i of the table, as far as the row above goes."""
        at = by[first[x[i - 1]] : first[x[i - 1] + 1]]
        at = at[at < len(up) - 1]
        row = up.copy()
        row[at + 1] = np.maximum(row[at + 1], up[at] + 1)
        return np.maximum.accumulate(row)

    def follow(top: int, row: np.ndarray, i: int, j: int) -> int:
        """The path from cell (i, j) back to row ``top``, which is given; where it gets there."""
        row = row[: j + 1]
        if i - top > KEPT_ROWS:
            step = -(-(i - top) // KEPT_ROWS)
            kept = [(top, row)]
            for k in range(top + 1, i):
                row = below(row, k)
                if (k - top) % step == 0:
                    kept.append((k, row))
            for k, row in reversed(kept):
                j, i = follow(k, row, i, j), k
            return j
        table = [row]
        for k in range(top + 1, i + 1):
            table.append(below(table[-1], k))
        while i > top:
            if j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append(("=", a[i]))
            elif j and table[i - top][j - 1] >= table[i - top - 1][j]:
                j -= 1
                out.append(("+", b[j]))
            else:
                i -= 1
                out.append(("-", a[i]))
        return j

    left = follow(0, np.zeros(len(b) + 1, dtype=np.int32), len(a), len(b))
    out += [("+", t) for t in b[:left][::-1]]
    return out[::-1]


def word_tokens(text: str) -> list[str]:
    return re.findall(r"\w+|\s+|[^\w\s]", text, re.ASCII)


def word_diff(old: str, new: str) -> list[tuple[str, str]]:
    """Edits between two lines, neighbours of the same kind as one segment."""
    script = edit_script(word_tokens(old), word_tokens(new))
    return [(op, "".join(token for _, token in run)) for op, run in itertools.groupby(script, key=lambda edit: edit[0])]


def _paired(removed: list[str], added: list[str]) -> list[tuple]:
    out: list[tuple] = []
    for old, new in zip(removed, added, strict=False):
        segments = word_diff(old, new)
        if any(op == "=" for op, _ in segments):
            out.append(("~", None, segments))
        else:
            out += [("-", old, None), ("+", new, None)]
    shared = min(len(removed), len(added))
    return out + [("-", t, None) for t in removed[shared:]] + [("+", t, None) for t in added[shared:]]


def line_diff(old: str | None, new: str | None, context: int = CONTEXT) -> list[tuple]:
    """(op, text, segments): changed lines with ``context`` lines around them; ``…`` stands for what is left out."""
    rows: list[tuple] = []
    removed: list[str] = []
    added: list[str] = []
    for op, text in [*edit_script((old or "").split("\n"), (new or "").split("\n")), ("end", "")]:
        if op == "-" and not added:
            removed.append(text)
        elif op == "+":
            added.append(text)
        else:
            rows += _paired(removed, added)
            removed, added = ([text], []) if op == "-" else ([], [])
            if op == "=":
                rows.append(("=", text, None))
    near = {c for i, r in enumerate(rows) if r[0] != "=" for c in range(max(0, i - context), min(len(rows), i + context + 1))}
    out: list[tuple] = []
    for i in sorted(near):
        if out and i - 1 not in near:
            out.append(("…", None, None))
        out.append(rows[i])
    return out


def line_diffs(old: pa.Array, new: pa.Array) -> pa.Array:
    """The diffs of a batch as ``ARROW_DIFF``. Only ``DIFFS`` of them are Python objects at a time: those take many times the bytes."""
    parts = []
    for at in range(0, len(old), DIFFS):
        pairs = zip(old.slice(at, DIFFS).to_pylist(), new.slice(at, DIFFS).to_pylist(), strict=True)
        rows = [[{"op": op, "text": text, "segs": None if segs is None else [{"op": o, "text": t} for o, t in segs]} for op, text, segs in line_diff(a, b)] for a, b in pairs]
        parts.append(pa.array(rows, type=ARROW_DIFF))
    return pa.concat_arrays(parts) if parts else pa.array([], type=ARROW_DIFF)


@F.arrow_udf(DIFF)
def line_diff_udf(old: pa.Array, new: pa.Array) -> pa.Array:
    return line_diffs(old, new)


def whole_diff(content: Column, op: str, most: int = HEAD_LINES) -> Column:
    """An added or removed content as lines of one kind, the first ``most`` and ``…``; null if empty."""
    lines = F.split(content, "\n", -1)
    row = lambda o, t: F.struct(F.lit(o).alias("op"), t.alias("text"), F.lit(None).cast("array<struct<op: string, text: string>>").alias("segs"))
    first = F.transform(F.slice(lines, 1, most), lambda t: row(op, t))
    gap = F.array(row("…", F.lit(None).cast("string")))
    return F.when(F.coalesce(content, F.lit("")) != "", F.when(F.size(lines) > most, F.concat(first, gap)).otherwise(first))


def pr_number(message: Column) -> Column:
    return F.regexp_extract(message, r"\(#([0-9]+)\)\s*$", 1).try_cast("int")


# Fixed value: a bullet of a proposal.
BULLET = r"(?m)^[-*]\s+\*\*(.+?)\*\*\s*[—–-]\s*(.+)"


def bullets(prs: DataFrame, key: str = "number", body: str = "body") -> DataFrame:
    """``key, pos, title, description``: the bullets of a proposal's text."""
    part = lambda g: F.regexp_extract_all(body, F.lit(BULLET), F.lit(g))
    rows = prs.select(key, F.posexplode(F.arrays_zip(part(1).alias("t"), part(2).alias("d"))).alias("pos", "b"))
    return rows.select(key, "pos", F.trim("b.t").alias("title"), F.trim("b.d").alias("description"))


def title_tokens(text: Column) -> Column:
    """Different lower-case words of more than two characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def match_score(bullet: Column, node: Column, description: Column) -> Column:
    """Share of the node title's words in the bullet's title, and up to 0.2 for those in its description."""
    b, n, d = (title_tokens(c) for c in (bullet, node, F.coalesce(description, F.lit(""))))
    share = F.size(F.array_intersect(n, b)) / F.size(n)
    bonus = F.least(F.size(F.array_intersect(n, d)) / F.size(n) * 0.4, F.lit(0.2))
    return F.when((F.size(b) > 0) & (F.size(n) > 0), share + bonus).otherwise(0.0)


def best_bullets(nodes: DataFrame, found: DataFrame, on: str, node: str = "id", threshold: float = THRESHOLD) -> DataFrame:
    """``on, node, pos, summary, description, score``: each changed node's best bullet of its own change.

    nodes: ``on, node, title``. The first of equal bullets wins; scores are those of ``match_score``. Titles with the
    same words are one row, and so are bullets with the same words. A description adds 0.2 at most, so a node's title
    shares at least ``_least`` words with its bullet's title: of its words, rarest among the bullets first, the last
    ``_least - 1`` need no look-up. A pair is looked at once, at its rarest shared word. With a threshold of up to 0.2
    words of the description alone make candidates too. Titles or bullets without words match nothing.
    """
    tokens = lambda c: F.sort_array(title_tokens(F.coalesce(c, F.lit(""))))
    own = nodes.select(on, node, tokens("title").alias("_own"))
    told = found.select(on, "pos", tokens("title").alias("_title"), tokens("description").alias("_text")).groupBy(on, "_title", "_text").agg(F.min("pos").alias("pos"))
    keys = "_title"
    if threshold <= 0.2:
        told, keys = told.where(F.size("_title") > 0).withColumn("_keys", F.array_union("_title", "_text")), "_keys"
    n = F.size("_own")
    least = F.greatest(F.lit(1), F.ceil((F.lit(threshold) - 0.2) * n - 1e-9)).cast("int")
    seen = told.select(on, F.explode(keys).alias("_w")).groupBy(on, "_w").agg(F.count("*").alias("_df"))
    words = own.select(on, "_own").distinct().select(on, "_own", F.explode("_own").alias("_w")).join(seen, [on, "_w"], "left")
    rare = words.groupBy(on, "_own").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_w").alias("w")))).alias("_r"))  # a title's words
    rare = rare.withColumn("_least", least).select(on, "_own", "_least", F.filter(F.slice("_r", F.lit(1), n - F.col("_least") + 1), lambda r: r.df > 0).w.alias("_first"))
    sides = rare.withColumn("_w", F.explode("_first")).join(told.select(on, "pos", *{"_title": 0, keys: 0}, F.explode(keys).alias("_w")), [on, "_w"])
    once = sides.where((F.size(keys) >= F.col("_least")) & (F.array_intersect("_first", keys)[0] == F.col("_w")))
    pairs = once.select(on, "_own", "pos", F.size(F.array_intersect("_own", "_title")).alias("_t")).where(F.col("_t") / n + 0.2 >= threshold)
    bonus = F.least(F.size(F.array_intersect("_own", "_text")) / n * 0.4, F.lit(0.2))
    scored = pairs.join(told.select(on, "pos", "_text"), [on, "pos"]).select(on, "_own", "pos", (F.col("_t") / n + bonus).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy(on, "_own").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("_b")).select(on, "_own", (-F.col("_b.p")).alias("pos"), F.col("_b.score").alias("score"))
    return own.join(best, [on, "_own"]).join(found.select(on, "pos", F.col("title").alias("summary"), "description"), [on, "pos"]).select(on, node, "pos", "summary", "description", "score")


def entries(changes: DataFrame, commits: DataFrame, prs: DataFrame, nodes: DataFrame) -> DataFrame:
    """History entries: ``id, seq, date, commit_hash, change, pr, …, summary, description, diff``.

    changes: ``id, seq, change``; commits: ``seq, hash, ts, message``; prs: ``number, title, author, url, body,
    review_count, approval_count, comment_count``; nodes: ``id, seq, title, content`` of each snapshot.
    """
    now = nodes.select("id", "seq", F.col("title").alias("_nt"), F.col("content").alias("_new"))
    old = nodes.select("id", (F.col("seq") + 1).alias("seq"), F.col("title").alias("_ot"), F.col("content").alias("_old"))
    rows = changes.join(now, ["id", "seq"], "left").join(old, ["id", "seq"], "left").withColumn("title", F.coalesce("_nt", "_ot"))
    rows = rows.join(commits.withColumn("pr", pr_number(F.col("message"))), "seq")
    proposal = prs.select(*(F.col(c).alias(f"pr_{c}") for c in ("number", "title", "author", "url", "body", "review_count", "approval_count", "comment_count")))
    rows = rows.join(proposal, F.col("pr") == F.col("pr_number"), "left")
    found = bullets(prs)
    keyed = rows.where("pr_number is not null").select(F.concat_ws("/", "id", "seq").alias("_key"), F.col("pr_number").alias("number"), "title")
    best = best_bullets(keyed, found, "number", "_key").select("_key", "summary", F.col("description").alias("_d"))
    with_bullets = found.select(F.col("number").alias("_b")).distinct()
    rows = rows.withColumn("_key", F.concat_ws("/", "id", "seq")).join(best, "_key", "left").join(with_bullets, F.col("pr_number") == F.col("_b"), "left")
    plain = F.col("summary").isNull() & F.col("_b").isNull() & (F.coalesce("pr_body", F.lit("")) != "")
    diff = F.when(F.col("change") == "modified", line_diff_udf("_old", "_new")).when((F.col("change") == "added") & (F.col("seq") > F.lit(0)), whole_diff(F.col("_new"), "+")).when(F.col("change") == "removed", whole_diff(F.col("_old"), "-"))
    count = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c.removeprefix("pr_"))
    return rows.select(
        "id", "seq", F.substring("ts", 1, 10).alias("date"), F.substring("hash", 1, 7).alias("commit_hash"), "change", F.col("pr_number").alias("pr"), "pr_title", "pr_author", "pr_url",
        count("pr_review_count"), count("pr_approval_count"), count("pr_comment_count"),
        F.when(plain, F.col("pr_title")).otherwise(F.col("summary")).alias("summary"),
        F.when(plain, F.when(F.length("pr_body") < BODY_CHARS, F.col("pr_body"))).otherwise(F.col("_d")).alias("description"),
        F.when(F.size(diff) > 0, diff).alias("diff"),
    )


def manifest(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def merge_manifests(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.unionByName(b).groupBy(key).agg(F.sum("n").alias("n"))


def timeline(rows: DataFrame, key: str, node: str) -> DataFrame:
    return rows.where(F.col(key) == node).orderBy(F.desc("date"), "seq")


def after_checkpoint(commits: DataFrame, last: str | None) -> DataFrame:
    """Commits after the one of hash ``last``; all of them if it is unknown."""
    if last is None:
        return commits
    at = commits.where(F.col("hash") == last).agg(F.max("seq").alias("_at"))
    return commits.join(F.broadcast(at), F.col("_at").isNull() | (F.col("seq") > F.col("_at"))).drop("_at")  # one row


def upsert(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id", "commit_hash")) -> DataFrame:
    """Existing rows and the new ones whose keys they lack: a run that is repeated changes nothing."""
    return existing.unionByName(new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti"))
