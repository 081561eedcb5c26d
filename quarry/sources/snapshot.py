"""Versioned tables of immutable segments.

A table is a list of segments, folders of Parquet that are never changed, and of dead lists. A change appends a segment with the
new rows and a list of the keys that it touched: older rows of those keys are dead, so a change writes what changed and
nothing else. Segments of one size class are merged once there are FAN of them, without their dead rows.

A commit writes its folders, then a manifest with the next number, which is created only if nobody else created that number.
A writer whose number is taken looks at what the others did: where a table that it read has changed, it gets a Conflict
and can start again (attempt); otherwise its change goes on top of theirs. Readers see the manifest of the highest number, and can go on
reading what it names until the commit after the next. Folders are on any file system that Spark reads.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.extract import PARSED

VERSION = 7
# Tables and their columns.
SCHEMAS = {
    "nodes": "id string, type string, content string, hash string",
    "edges": "from_id string, to_id string, relation_type string",
    "neighbours": "term string, neighbour string, weight double",
    "vectors": "id string, dim int, vec array<float>",
    "parsed": PARSED,
    "postings": "term string, id string, tf bigint, positions array<int>",
    "stats": "id string, dl bigint",
}
#: What a change replaces the rows of.
KEYS = {"nodes": "id", "edges": "from_id", "neighbours": "term", "vectors": "id", "parsed": "id", "postings": "id", "stats": "id"}
#: Segments of one size class that are merged, and rows of the smallest class.
FAN, LEAST_ROWS = 4, 1000
#: Dead keys that are broadcast to the readers of a table; more are joined by a shuffle.
BROADCAST_DEAD = 1_000_000
#: Manifests that stay, and times that an attempt starts again.
KEPT, ATTEMPTS = 50, 10


class Conflict(RuntimeError):
    """Another writer changed a table that this one had read."""


class Folder:
    """Small files of a folder on any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        given = self.jvm.org.apache.hadoop.fs.Path(folder)
        # an instance of its own, for check sums of local files are off
        self.fs = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(given.getFileSystem(self.conf).makeQualified(given).toUri(), self.conf)
        self.fs.setWriteChecksum(False)
        self.fs.setVerifyChecksum(False)
        self.root = self.fs.makeQualified(given).toString()
        self.fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file is new; it appears whole, and an existing one stays as it is.

        Local files are linked into place and others renamed without overwriting, which file systems with a name node do at once.
        """
        part, at = self._at(f"{name}.{uuid.uuid4().hex}.part"), self._at(name)
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(part.toUri().getPath(), at.toUri().getPath())
            else:
                none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.conf).rename(part, at, none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self.fs.delete(part, False)

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._at(""))]

    def delete(self, path: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)


def _without_postings(m: dict) -> dict:
    """Indexes from before postings were stored are made anew by the next index()."""
    if "nodes" in m["tables"] and "postings" not in m["tables"]:
        m["meta"]["reindex"] = "1"
    return m


def _with_segments(m: dict) -> dict:
    """A table was one folder."""
    m["tables"] = {name: {"segments": [{"path": path, "seq": 0, "rows": None}], "dead": []} for name, path in m["tables"].items()}
    return m


#: In order: the version that a step leads to, and the step.
MIGRATIONS = [(6, _without_postings), (7, _with_segments)]


def migrated(m: dict) -> dict:
    if m["version"] > VERSION:
        raise ValueError(f"the tables have version {m['version']}; this code reads up to {VERSION}")
    m = {"replaced": [], "number": 0} | m
    for to, step in MIGRATIONS:
        if m["version"] < to:
            m = step(m) | {"version": to}
    return m


def _class(segment: dict) -> int:
    """The size class: FAN times as many rows are one class up."""
    size, rows = 0, (segment["rows"] or 0) // LEAST_ROWS
    while rows >= FAN:
        size, rows = size + 1, rows // FAN
    return size


def due(entry: dict) -> list[dict]:
    """The segments to merge: those of a full size class, or all where most rows could be dead."""
    rows, dead = sum(s["rows"] or 0 for s in entry["segments"]), sum(d["rows"] for d in entry["dead"])
    if len(entry["segments"]) > 1 and (2 * dead > rows or len(entry["dead"]) > FAN * FAN):
        return entry["segments"]
    by: dict[int, list[dict]] = {}
    for s in entry["segments"]:
        by.setdefault(_class(s), []).append(s)
    return next((found for _, found in sorted(by.items()) if len(found) >= FAN), [])


class Snapshots:
    """A folder of tables that the driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Folder(spark, folder)
        self.folder = self.files.root
        self._pinned: dict | None = None
        self._seen: dict[str, dict | None] = {}

    def _manifest(self) -> dict:
        first = self.files.read("current.json")  # of versions before 7
        known = migrated(json.loads(first)) if first else migrated({"version": VERSION, "tables": {}, "meta": {}})
        numbers = [int(m[1]) for n in self.files.names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n))]
        return migrated(json.loads(self.files.read(f"manifest-{max(numbers):012d}.json"))) if numbers else known

    @contextmanager
    def transaction(self):
        """Reads in the block see one state; a commit in it fails with Conflict if another writer changed any table that was read."""
        self._pinned, self._seen = self._manifest(), {}
        try:
            yield
        finally:
            self._pinned, self._seen = None, {}

    def attempt(self, work: Callable, times: int = ATTEMPTS):
        """The result of work, which runs in a transaction, and again after a conflict."""
        for left in reversed(range(times)):
            with self.transaction():
                try:
                    return work()
                except Conflict:
                    if not left:
                        raise

    def _rows(self, path: str, schema: str, seq: int | None = None) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(path)
        return df if seq is None else df.withColumn("_seq", F.lit(seq))

    def _live(self, name: str, entry: dict | None, only: list[dict] | None = None) -> DataFrame:
        """The rows of segments that no later change has touched."""
        if not entry or not entry["segments"]:
            return self.spark.createDataFrame([], SCHEMAS[name])
        key, last = KEYS[name], max((d["seq"] for d in entry["dead"]), default=-1)
        segments = entry["segments"] if only is None else only
        out = None
        for s in segments:
            if s["seq"] >= last:
                part = self._rows(s["path"], SCHEMAS[name])
                out = part if out is None else out.unionByName(part)
        older = None
        for s in segments:
            if s["seq"] < last:
                part = self._rows(s["path"], SCHEMAS[name], s["seq"])
                older = part if older is None else older.unionByName(part)
        if older is not None:
            dead = None
            for d in entry["dead"]:
                part = self._rows(d["path"], "_key string", d["seq"])
                dead = part if dead is None else dead.unionByName(part)
            dead = dead.groupBy("_key").agg(F.max("_seq").alias("_dead"))
            if sum(d["rows"] for d in entry["dead"]) <= BROADCAST_DEAD:
                dead = F.broadcast(dead)
            kept = older.join(dead, older[key] == dead["_key"], "left").filter("_dead is null or _dead <= _seq").drop("_seq", "_key", "_dead")
            out = kept if out is None else out.unionByName(kept)
        return out

    def table(self, name: str) -> DataFrame:
        entry = (self._pinned or self._manifest())["tables"].get(name)
        self._seen[name] = entry
        return self._live(name, entry)

    def _write(self, df: DataFrame, path: str) -> int:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).count()

    def _install(self, edit: Callable[[dict], dict], writes: list[str]) -> None:
        """Creates the next manifest; edit makes it of the one before."""
        while True:
            now = self._manifest()
            watched = {n: e for n, e in self._seen.items() if n in writes or self._pinned}
            for name, entry in watched.items():
                if now["tables"].get(name) != entry:
                    raise Conflict(f"{name} has changed")
            gone, number = now["replaced"], now["number"] + 1
            made = edit(json.loads(json.dumps(now | {"replaced": []}))) | {"number": number, "version": VERSION}
            if self.files.create(f"manifest-{number:012d}.json", json.dumps(made)):
                break
        for name in writes:
            self._seen.pop(name, None)
        if self._pinned:
            self._pinned = made
        for path in gone:
            self.files.delete(path)
        if number > KEPT:
            self.files.delete(f"{self.folder}/manifest-{number - KEPT:012d}.json")

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame]] | None = None, meta: dict[str, str] | None = None, **tables: DataFrame) -> None:
        """All or nothing. tables take the place of the whole ones; changes are new rows and a table of all the keys that they, or nothing, replace."""
        folder, whole, parts = f"{self.folder}/{uuid.uuid4().hex}", {}, {}
        columns = lambda name, df: df.select(*T._parse_datatype_string(SCHEMAS[name]).names)
        for name, df in tables.items():
            whole[name] = {"path": f"{folder}/{name}", "rows": self._write(columns(name, df), f"{folder}/{name}")}
        for name, (delta, touched) in (changes or {}).items():
            rows = self._write(columns(name, delta), f"{folder}/{name}")
            dead = self._write(touched.select(F.col(touched.columns[0]).alias("_key")).distinct(), f"{folder}/{name}-dead")
            parts[name] = {"path": f"{folder}/{name}", "rows": rows}, {"path": f"{folder}/{name}-dead", "rows": dead}

        def edit(m: dict) -> dict:
            seq = m["number"] + 1
            for name, made in whole.items():
                old = m["tables"].get(name) or {"segments": [], "dead": []}
                m["replaced"] += [x["path"] for x in old["segments"] + old["dead"]]
                m["tables"][name] = {"segments": [made | {"seq": seq}], "dead": []}
            for name, (made, dead) in parts.items():
                entry = m["tables"].setdefault(name, {"segments": [], "dead": []})
                if entry["segments"] and dead["rows"]:
                    entry["dead"].append(dead | {"seq": seq})
                if made["rows"] or not entry["segments"]:
                    entry["segments"].append(made | {"seq": seq})
            m["meta"] |= meta or {}
            return m

        self._install(edit, [*whole, *parts])

    def _merge(self, name: str, entry: dict, chosen: list[dict], parts: int | None = None) -> None:
        """One segment, in the order of its key, in place of the chosen ones; dead lists go that have nothing left to kill."""
        self._seen[name] = entry
        df, path = self._live(name, entry, chosen), f"{self.folder}/{uuid.uuid4().hex}/{name}"
        made = {"path": path, "rows": self._write(by_term(df, parts) if name == "postings" else by_key(df, KEYS[name], parts), path), "sorted": True}
        made["seq"] = max(x["seq"] for x in entry["segments"] + entry["dead"])

        def edit(m: dict) -> dict:
            left = [s for s in entry["segments"] if s not in chosen] + [made]
            first = min(s["seq"] for s in left)
            dead = [d for d in entry["dead"] if d["seq"] > first]
            m["replaced"] += [x["path"] for x in chosen + [d for d in entry["dead"] if d["seq"] <= first]]
            m["tables"][name] = {"segments": left, "dead": dead}
            return m

        self._install(edit, [name])

    def merge(self) -> int:
        """Merges what is due, table by table, and returns how often; what another writer changes meanwhile is left for later."""
        n = 0
        for name in list(self._manifest()["tables"]):
            while chosen := due(entry := self._manifest()["tables"][name]):
                try:
                    self._merge(name, entry, chosen)
                    n += 1
                except Conflict:
                    break
        return n

    def get(self, key: str) -> str:
        return (self._pinned or self._manifest())["meta"].get(key, "")

    def put(self, key: str, value: str) -> None:
        self._install(lambda m: m | {"meta": m["meta"] | {key: value}}, [])

    def reset(self) -> None:
        """Drops all tables; meta stays, but for what describes them."""
        gone = [x["path"] for e in self._manifest()["tables"].values() for x in e["segments"] + e["dead"]]
        self._seen = {}
        self._install(lambda m: m | {"tables": {}, "meta": {k: v for k, v in m["meta"].items() if k not in ("docs", "terms", "reindex")}}, [])
        for path in gone:
            self.files.delete(path)

    def optimise(self, target_bytes: int = 128 << 20) -> int:
        """Makes each table one segment in files of about target_bytes, in the order of its key, and returns how many were not so."""
        n = 0
        for name in list(self._manifest()["tables"]):
            entry = self._manifest()["tables"][name]
            if len(entry["segments"]) == 1 and not entry["dead"] and entry["segments"][0].get("sorted"):
                continue
            size = sum(self.files.fs.getContentSummary(self.files.jvm.org.apache.hadoop.fs.Path(s["path"])).getLength() for s in entry["segments"])
            try:
                self._merge(name, entry, entry["segments"], max(1, -(-size // target_bytes)))
                n += 1
            except Conflict:
                continue
        return n


def by_key(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows dealt and sorted by key, so that a reader of few keys skips most files and row groups."""
    dealt = df.repartitionByRange(parts, key) if parts else df.repartitionByRange(key)
    return dealt.sortWithinPartitions(key)


def by_term(postings: DataFrame, parts: int | None = None) -> DataFrame:
    """Postings dealt and sorted by term, so that a reader of few terms skips most files and row groups."""
    dealt = postings.repartitionByRange(parts, "term", "id") if parts else postings.repartitionByRange("term", "id")
    return dealt.sortWithinPartitions("term", "id")
