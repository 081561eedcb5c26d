"""Source-tree scans. Folders are listed by tasks (Spark's file sources skip names that begin with _ or .), files are read
and hashed by tasks as well. A root is a local or mounted folder, which all executors must see, or a URI of a store that
pyarrow knows; other stores are given as a `filesystem`.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import posixpath
import re
import subprocess
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.settle import settled

# Folders that scans skip.
SKIPPED_DIRS = frozenset(".git node_modules vendor .idea .vscode __pycache__".split())
MAX_BYTES = 2 << 20
#: Names that a task lists in the first round of a walk before it hands its other folders on; each round doubles them.
LISTED = 10_000
#: Files that a task reads, about.
READ = 200


IGNORES = ".quarryignore"


def read_ignores(root: str, name: str = IGNORES) -> list[str]:
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            return ignore_lines(f)
    except FileNotFoundError:
        return []


def ignore_lines(lines) -> list[str]:
    return [x.rstrip("/") for line in lines if (x := line.strip()) and not x.startswith("#")]


def glob_matches(pattern: str, path: str) -> bool:
    """Shell globs whose * and ? do not cross a slash."""
    regex = fnmatch.translate(pattern).replace(".*", "[^/]*").replace("(?s:.", "(?s:[^/]")
    return re.match(regex, path) is not None


def ignored(rel: str, patterns: list[str]) -> bool:
    return any(glob_matches(p, os.path.basename(rel)) or glob_matches(p, rel) for p in patterns)


@dataclass
class Tree:
    """The folder `below` (relative, empty for all) of a root. Local paths are resolved; other stores have no links."""

    root: str
    below: str
    filesystem: pafs.FileSystem | None

    @classmethod
    def at(cls, scan_root: str, allowed_root: str | None, filesystem: pafs.FileSystem | None = None) -> Tree:
        allowed, root = allowed_root or scan_root, scan_root
        if filesystem is None and "://" in root and not root.startswith("file://"):
            filesystem, root = pafs.FileSystem.from_uri(root)
            allowed = pafs.FileSystem.from_uri(allowed)[1]
        if filesystem is None:
            allowed, root = (os.path.realpath(re.sub("^file://", "", x)) for x in (allowed, root))
        else:
            allowed, root = (posixpath.normpath(x) for x in (allowed, root))
        base = allowed.rstrip("/") + "/"
        if root != allowed and not root.startswith(base):
            raise ValueError(f"{scan_root} is outside {allowed_root}")
        return cls(allowed, root[len(base) :], filesystem)

    def path(self, rel: str) -> str:
        return f"{self.root.rstrip('/')}/{rel}" if rel else self.root

    def entries(self, rel: str):
        """name, "dir" or "file", bytes, of a folder; links to folders and out of the root are left out."""
        if self.filesystem is not None:
            for x in self.filesystem.get_file_info(pafs.FileSelector(self.path(rel))):
                yield x.base_name, "dir" if x.type == pafs.FileType.Directory else "file", x.size
            return
        with os.scandir(self.path(rel)) as found:
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    yield x.name, "dir", 0
                elif x.is_file() and (not x.is_symlink() or os.path.realpath(x.path).startswith(self.root.rstrip("/") + "/")):
                    yield x.name, "file", x.stat().st_size

    def read(self, rel: str) -> bytes:
        if self.filesystem is not None:
            with self.filesystem.open_input_stream(self.path(rel)) as f:
                return f.read()
        with open(self.path(rel), "rb") as f:
            return f.read()

    def ignores(self) -> list[str]:
        if self.filesystem is None:
            return read_ignores(self.path(self.below))
        name = posixpath.join(self.below, IGNORES)
        if self.filesystem.get_file_info(self.path(name)).type != pafs.FileType.File:
            return []
        return ignore_lines(self.read(name).decode("utf-8", "replace").split("\n"))


def listed(tree: Tree, folders, patterns: list[str], max_bytes: int, most: int):
    """("file", id) of the supported files below folders, and ("dir", folder) of what is not listed once `most` names were."""
    left, waiting = most, deque(folders)
    while waiting:
        folder = waiting.popleft()
        if left <= 0:
            yield "dir", folder
            continue
        for name, kind, size in tree.entries(folder):
            left -= 1
            rel = f"{folder}/{name}" if folder else name
            if ignored(rel[len(tree.below) :].lstrip("/"), patterns):
                continue
            if kind == "dir":
                if name not in SKIPPED_DIRS:
                    waiting.append(rel)
            elif os.path.splitext(name)[1].lower() in T.EXTENSION_TYPES and size <= max_bytes:
                yield "file", rel


def list_files(scan_root: str, allowed_root: str | None = None, max_bytes: int = MAX_BYTES) -> list[tuple[str, str]]:
    """(id, path) of supported files below scan_root, which must lie in allowed_root, as must what links lead to: a small
    tree, walked where this is called."""
    tree = Tree.at(scan_root, allowed_root)
    return sorted((rel, tree.path(rel)) for _, rel in listed(tree, [tree.below], tree.ignores(), max_bytes, 1 << 62))


def walk(spark: SparkSession, tree: Tree, max_bytes: int = MAX_BYTES, most: int = LISTED) -> DataFrame:
    """id of each supported file of a tree.

    A task lists folders until it has seen `most` names and returns those left; they are dealt to the tasks of
    the next round, so wide and deep trees spread over the cluster in few rounds. The driver sees counts only.
    """
    patterns, rounds = tree.ignores(), []
    frontier, tasks = spark.createDataFrame([(tree.below,)], "rel string"), 1
    while tasks:

        def run(batches, most=most):
            for batch in batches:
                rows = listed(tree, list(batch["rel"]), patterns, max_bytes, most)
                while part := [r for _, r in zip(range(READ * 50), rows)]:
                    yield pd.DataFrame(part, columns=["kind", "rel"])

        found = settled(frontier.repartition(tasks).mapInPandas(run, "kind string, rel string"))
        rounds.append(found.filter("kind = 'file'").select(F.col("rel").alias("id")))
        frontier = found.filter("kind = 'dir'").select("rel")
        tasks, most = min(frontier.count(), 4 * spark.sparkContext.defaultParallelism), 2 * most
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionAll(more)
    return out


def scan(spark: SparkSession, scan_root: str, allowed_root: str | None = None, max_bytes: int = MAX_BYTES, filesystem: pafs.FileSystem | None = None) -> DataFrame:
    """id, type, content and hash (SHA-256 of the bytes) of each file, listed and read where the tasks run."""
    tree = Tree.at(scan_root, allowed_root, filesystem)
    ids = walk(spark, tree, max_bytes)

    def read(batches):
        for batch in batches:
            for n in range(0, len(batch), READ):
                part = batch["id"][n : n + READ]
                data = [tree.read(i) for i in part]
                yield pd.DataFrame({"id": part.values, "content": [x.decode("utf-8", "replace") for x in data], "hash": [hashlib.sha256(x).hexdigest() for x in data]})

    parts = max(1, min(10_000, ids.count() // READ))
    return ids.repartition(parts, "id").mapInPandas(read, "id string, content string, hash string").withColumn("type", T.file_type(F.col("id"))).select("id", "type", "content", "hash")


def git_head(root: str) -> str:
    """The commit that HEAD names, by files alone; an empty string for work trees, bare or broken ones."""
    git = os.path.join(root, ".git")
    try:
        with open(os.path.join(git, "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
        if head.startswith("ref:"):
            ref = head[4:].strip()
            try:
                with open(os.path.join(git, ref), encoding="utf-8") as f:
                    head = f.read().strip()
            except FileNotFoundError:
                with open(os.path.join(git, "packed-refs"), encoding="utf-8") as f:
                    head = next((line.split()[0] for line in f if line.rstrip().endswith(" " + ref)), "")
    except (FileNotFoundError, NotADirectoryError):
        return ""
    return head if re.fullmatch("[0-9a-fA-F]{40}", head) else ""


def git_tracked(spark: SparkSession, root: str) -> DataFrame:
    """id of the files that git tracks below root; none outside a work tree."""
    listed = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, check=False)
    names = [x for x in listed.stdout.decode("utf-8", "replace").split("\0") if x] if listed.returncode == 0 else []
    return spark.createDataFrame([(x,) for x in names], "id string")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation cases: every *.json below folder is an array of id, query, ground_truth_files, notes."""
    return spark.read.schema("id string, query string, ground_truth_files array<string>, notes string").option("multiLine", True).json(f"{folder}/*.json")
