"""Commits and files of a version-control repository, read from its loose objects and pack files.

Objects become rows, a task to a pack or to some loose files; what follows is joins: a path is a join with the trees
for each of its parts, and a commit touches a file if its object there differs from that of each parent.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.sources.readers import or_empty

# Kinds of objects in a pack by number; 6 and 7 are deltas, by place and by id of their base.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_PLACE, BY_ID = 6, 7
#: Bytes of bases that a task keeps, and of objects that it returns at once.
KEPT, BATCH = 64 << 20, 16 << 20


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base: copied runs of the base, and bytes of its own."""
    at = 0
    for _ in range(2):  # the sizes of both
        while delta[at] & 0x80:
            at += 1
        at += 1
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            place = size = 0
            for bit in range(7):
                if op >> bit & 1:
                    value = delta[at]
                    at += 1
                    if bit < 4:
                        place |= value << 8 * bit
                    else:
                        size |= value << 8 * (bit - 4)
            out += base[place : place + (size or 0x10000)]
        else:
            out += delta[at : at + op]
            at += op
    return bytes(out)


class _Pack:
    """Objects of one pack; bases are kept up to ``KEPT`` bytes and read again beyond."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"PACK":
            raise ValueError("not a pack")
        self.data, self.count = data, int.from_bytes(data[8:12], "big")
        self.kept: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.size = 0
        self.places: dict[bytes, int] = {}

    def entry(self, at: int) -> tuple[int, int | bytes | None, bytes, int]:
        """Kind, base, bytes and the place of the next object."""
        begin, head = at, self.data[at]
        kind = head >> 4 & 7
        at += 1
        while head & 0x80:
            head = self.data[at]
            at += 1
        base: int | bytes | None = None
        if kind == BY_PLACE:
            byte = self.data[at]
            at += 1
            back = byte & 0x7F
            while byte & 0x80:
                byte = self.data[at]
                at += 1
                back = (back + 1) << 7 | byte & 0x7F
            base = begin - back
        elif kind == BY_ID:
            base, at = self.data[at : at + 20], at + 20
        reader = zlib.decompressobj()
        out, fed = [], at
        while not reader.eof:
            out.append(reader.decompress(self.data[fed : fed + 65536]))
            fed += 65536
        return kind, base, b"".join(out), min(fed, len(self.data)) - len(reader.unused_data)

    def object(self, at: int) -> tuple[str, bytes] | None:
        """Kind and bytes of the object at a place; none if a base by id has not been seen yet."""
        deltas = []
        while at not in self.kept:
            kind, base, data, _ = self.entry(at)
            if kind in KINDS:
                found = KINDS[kind], data
                break
            deltas.append((at, data))
            if isinstance(base, bytes):
                if base not in self.places:
                    return None
                base = self.places[base]
            at = base
        else:
            found = self.kept[at]
        for place, delta in reversed(deltas):
            found = found[0], apply_delta(found[1], delta)
            at = place
        self.kept[at] = found
        self.size += len(found[1])
        while self.size > KEPT and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1][1])
        return found

    def objects(self) -> Iterator[tuple[str, str, bytes]]:
        at, left = 12, []
        for _ in range(self.count):
            left.append(at)
            at = self.entry(at)[3]
        while left:
            later = []
            for place in left:
                found = self.object(place)
                if found is None:
                    later.append(place)
                    continue
                digest = hashlib.sha1(b"%s %d\0" % (found[0].encode(), len(found[1])) + found[1])
                self.places[digest.digest()] = place
                yield digest.hexdigest(), *found
            if len(later) == len(left):
                raise ValueError("a pack lacks a base")
            left = later


def objects(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("commit", "tree", "blob", "tag")) -> DataFrame:
    """``id, kind, data`` of all objects in a repository's folder (the one that holds ``objects``), each once.

    A pack is read whole by one task, so packs of up to 2 GB; larger repositories are packed in several.
    """

    def loose(data: bytes) -> Iterator[tuple[str, str, bytes]]:
        raw = zlib.decompress(data)
        head, _, body = raw.partition(b"\0")
        yield hashlib.sha1(raw).hexdigest(), head.split(b" ")[0].decode(), body

    def read(of):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for b in batches:
                for content in b.column(0):
                    for row in of(content.as_py()):
                        if row[1] in kinds:
                            rows.append(row)
                            size += len(row[2])
                        if size > BATCH:
                            yield _batch(rows)
                            rows, size = [], 0
            if rows:
                yield _batch(rows)

        return work

    found = None
    for pattern, of in (("objects/[0-9a-f][0-9a-f]/*", loose), ("objects/pack/*.pack", lambda data: _Pack(data).objects())):
        files = or_empty(lambda p=pattern: spark.read.format("binaryFile").load(f"{path}/{p}").select("content"), "content binary", spark)
        part = files.mapInArrow(read(of), "id string, kind string, data binary")
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["id"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], type=pa.binary())], names=["id", "kind", "data"])


def commits(objects: DataFrame) -> DataFrame:
    """``hash, tree, parents, time, ts, message``: time of commit in seconds, the author's date, the subject."""
    text = F.decode("data", "UTF-8")
    rows = objects.where("kind = 'commit'").select(F.col("id").alias("hash"), text.alias("t"))
    head = F.substring_index("t", "\n\n", 1)
    body = F.substring(F.col("t"), F.length(head) + 3, F.length("t"))
    rows = rows.select("hash", head.alias("h"), body.alias("b"))
    one = lambda pattern: F.regexp_extract("h", pattern, 1)
    zone, at = one(r"(?m)^author .*> \d+ ([+-]\d{4})$"), one(r"(?m)^author .*> (\d+) [+-]\d{4}$").cast("long")
    minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")
    shift = F.when(zone.startswith("-"), -minutes).otherwise(minutes) * 60
    utc = F.concat(F.date_add(F.lit("1970-01-01"), F.floor((at + shift) / 86400).cast("int")).cast("string"), F.lit("T"), *_clock(F.pmod(at + shift, F.lit(86400))))
    ts = F.concat(utc, F.when(zone == "+0000", F.lit("+00:00")).otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))))
    subject = F.trim(F.regexp_replace(F.regexp_extract("b", r"^\n*((?:[^\n]+\n?)*)", 1), r"\n", " "))
    return rows.select("hash", one(r"(?m)^tree ([0-9a-f]{40})$").alias("tree"), F.regexp_extract_all("h", F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"), one(r"(?m)^committer .*> (\d+) [+-]\d{4}$").cast("long").alias("time"), ts.alias("ts"), subject.alias("message"))


def _clock(seconds):
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return two(seconds / 3600), F.lit(":"), two(F.pmod(seconds, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(seconds, F.lit(60)))


def tree_entries(objects: DataFrame) -> DataFrame:
    """``tree, name, child`` of all trees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tree, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                while at < len(data):
                    space, end = data.index(b" ", at), data.index(b"\0", at)
                    out.append((tree, data[space + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.string()) for i in range(3)], names=["tree", "name", "child"])

    return objects.where("kind = 'tree'").select("id", "data").mapInArrow(work, "tree string, name string, child string")


def at_path(commits: DataFrame, entries: DataFrame, file: str) -> DataFrame:
    """``commits`` with ``blob``, the id of the object at a path of theirs; null where there is none."""
    rows = commits.withColumn("blob", F.col("tree"))
    for name in file.strip("/").split("/"):
        step = entries.where(F.col("name") == name).select(F.col("tree").alias("_tree"), F.col("child").alias("_child"))
        rows = rows.join(step, F.col("blob") == F.col("_tree"), "left").withColumn("blob", F.col("_child")).drop("_tree", "_child")
    return rows


def log(spark: SparkSession, path: str, file: str) -> DataFrame:
    """``seq, hash, ts, message``: commits that touch a file, the oldest first, numbered from 0.

    A commit touches it if the object there differs from that of each parent (or there is one, and no parent). All
    commits in the repository are looked at, whatever branch they are on; equal times go by hash.
    """
    from coppice.operators.parsing import batches_of

    known = objects(spark, path, ("commit", "tree"))
    rows = at_path(commits(known), tree_entries(known), file)
    blobs = rows.select(F.col("hash").alias("_p"), F.col("blob").alias("_pb"))
    of = rows.select("hash", "blob", F.explode("parents").alias("_p")).join(blobs, "_p").groupBy("hash").agg(F.max(F.col("_pb").eqNullSafe(F.col("blob"))).alias("_same"))
    touched = rows.join(of, "hash", "left").where(~F.coalesce("_same", F.col("blob").isNull()))
    ordered = batches_of(touched.select(F.struct("time", "hash").alias("_o"), "ts", "message"), "_o", 1)
    return ordered.select(F.col("batch").cast("int").alias("seq"), F.col("_o.hash").alias("hash"), "ts", "message")


def file_revisions(spark: SparkSession, path: str, file: str, hashes: DataFrame | None = None) -> DataFrame:
    """``hash, text`` of a file at each commit (of ``hashes``, if given); null where the commit has no such file."""
    known = objects(spark, path, ("commit", "tree"))
    rows = at_path(commits(known), tree_entries(known), file).select("hash", "blob")
    if hashes is not None:
        rows = rows.join(hashes.select("hash"), "hash", "left_semi")
    wanted = rows.select(F.col("blob").alias("id")).distinct()
    texts = objects(spark, path, ("blob",)).join(wanted, "id", "left_semi").select("id", F.decode("data", "UTF-8").alias("text"))
    return rows.join(texts, F.col("blob") == F.col("id"), "left").select("hash", "text")
