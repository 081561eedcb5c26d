"""Code analysis as a table function: files to symbols, imports and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..functions import text as T
from .graph import resolve_calls

PARSED = "id string, symbols array<struct<name:string,type:string,line:int,content:string,calls:array<string>>>, imports array<string>"


def parsed(files: DataFrame, precise: bool = False, parse: Callable[[str, str], tuple[list, list[str]]] | None = None) -> DataFrame:
    """id, symbols and imports of (id, content); one file at a time is in memory beside its batch.

    parse: a parser in place of the built-in ones, from path and source to code.Symbol rows and imports.
    """
    one = parse or (lambda path, source: code.parse(path, source, precise))
    symbol = pa.struct([("name", pa.string()), ("type", pa.string()), ("line", pa.int32()), ("content", pa.string()), ("calls", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents = batch.column("id"), batch.column("content")
            rows = [one(i.as_py(), c.as_py() or "") for i, c in zip(ids, contents, strict=True)]
            symbols = pa.array([[s._asdict() for s in r[0]] for r in rows], pa.list_(symbol))
            yield pa.RecordBatch.from_arrays([ids, symbols, pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["id", "symbols", "imports"])

    return files.select("id", "content").mapInArrow(run, PARSED)


def as_json(found: DataFrame) -> DataFrame:
    """id and symbols as a JSON text of parsed rows."""
    return found.select("id", F.to_json("symbols").alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """id and symbols of (id, json)."""
    return rows.select("id", F.from_json("json", PARSED.split("symbols ")[1].rsplit(", imports", 1)[0]).alias("symbols"))


def outlines(rows: DataFrame, most: int = 60) -> DataFrame:
    """id and outline of the Go files of rows (id, type, content) that declare a package; other rows go through no Python."""
    go = rows.filter((F.col("type") == "go_file") & F.col("content").rlike(r"(?m)^\s*package\s+\w+"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "outline": [code.go_outline(c or "", most) for c in batch["content"]]})

    return go.select("id", "content").mapInPandas(run, "id string, outline string")


def symbols_of(found: DataFrame) -> DataFrame:
    """file, id, name, type, content and calls of the symbols that were parsed."""
    return found.select(F.col("id").alias("file"), F.explode("symbols").alias("s")).select("file", F.concat("file", F.lit(":"), "s.name").alias("id"), "s.name", "s.type", "s.content", "s.calls")


def imports_of(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("file"), F.explode("imports").alias("id"))


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("id").agg(F.min("type").alias("type"), F.min("content").alias("content")).withColumn("hash", F.lit(""))


def import_nodes(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.lit("import").alias("type"), F.lit("").alias("content"), F.lit("").alias("hash"))


def calls_of(symbols: DataFrame) -> DataFrame:
    """caller, file, dir and callee of every call."""
    return symbols.select(F.col("id").alias("caller"), "file", T.directory(F.col("file")).alias("dir"), F.explode("calls").alias("callee"))


def call_edges(called: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of calls among all symbols of their names: to a symbol of the own file, else as resolve_calls has it."""
    own = symbols.select("file", F.col("name").alias("callee"), F.col("id").alias("to_id")).distinct()
    # a file has any number of symbols and calls, which its size does not tell, so nothing is broadcast by estimate
    inside = called.join(own.hint("merge"), ["file", "callee"]).filter("caller <> to_id").select(F.col("caller").alias("from_id"), "to_id", F.lit("calls").alias("relation_type"))
    pending = called.join(own.select("file", "callee").hint("merge"), ["file", "callee"], "left_anti").select("caller", "dir", "callee")
    across = resolve_calls(pending, symbols.select("id", "name", T.directory(F.col("file")).alias("dir")))
    return inside.unionByName(across)


def file_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges from files to their symbols and imports."""
    contains = symbols.select(F.col("file").alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("relation_type"))
    return contains.unionByName(imports.select(F.col("file").alias("from_id"), F.col("id").alias("to_id"), F.lit("imports").alias("relation_type")))


def graph(files: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, content, hash) and edges of files (id, type, content, hash) and what was parsed in them.

    Calls resolve against all symbols, so an incremental run equals a full one.
    """
    symbols, imports = symbols_of(found), imports_of(found)
    nodes = files.select("id", "type", "content", "hash").unionByName(symbol_nodes(symbols)).unionByName(import_nodes(imports.select("id").distinct().join(files.select("id").hint("merge"), "id", "left_anti")))
    return nodes, file_edges(symbols, imports).unionByName(call_edges(calls_of(symbols), symbols)).distinct()


def graph_changes(files: DataFrame, delta: DataFrame, touched: DataFrame, before: DataFrame, now: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What graph makes anew when the files of `touched` (id) came, changed or went: for nodes and edges their new rows, and the
    ids or from_ids whose rows they replace.

    files: ids of all files now; delta: the touched ones that are there, whole; before, now: what is parsed in all files. A call can
    lead elsewhere only where its caller's file or a symbol of the called name changed, so only callers of
    those names are resolved again, among the symbols of the names that they call.
    """
    was, is_now = before.join(touched, "id", "left_semi"), now.join(touched, "id", "left_semi")
    gone, made, every = symbols_of(was), symbols_of(is_now), symbols_of(now)
    names = gone.select("name").union(made.select("name")).distinct()
    imported = imports_of(was).select("id").union(imports_of(is_now).select("id")).union(touched.select("id")).distinct()
    alive = imports_of(now).select("id").join(imported, "id", "left_semi").distinct().join(files.select("id"), "id", "left_anti")
    nodes = delta.select("id", "type", "content", "hash").unionByName(symbol_nodes(made)).unionByName(import_nodes(alive))
    ids = gone.select("id").union(made.select("id"))

    callers = calls_of(every).join(names.withColumnRenamed("name", "callee"), "callee", "left_semi").select(F.col("caller").alias("id"))
    again = callers.union(ids).distinct()
    called = calls_of(every.join(again, "id", "left_semi"))
    wanted = every.join(called.select(F.col("callee").alias("name")).distinct(), "name", "left_semi")
    edges = file_edges(made, imports_of(is_now)).unionByName(call_edges(called, wanted)).distinct()
    return {"nodes": (nodes, ids.union(imported).distinct()), "edges": (edges, again.union(touched.select("id")).distinct())}
