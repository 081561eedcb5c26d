"""Repeated ids and concurrent use: what one row, thread or attempt does never costs another's."""

import os
import re
import threading

from quarry.llm import common, vafile, warc


def test_own_ids_hide_no_candidates(spark):
    rows = [(0, [0.5, 0.25])] * 30 + [(1, [0.5, 0.25]), (2, [0.25, 0.25])] + [(3, [0.125, 0.0])] * 25
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect())
    dot = lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b, strict=True))
    best = sorted(((-dot(rows[0][1], v), i) for i, v in rows if i != 0))[:20]
    want = [(0, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted({(q, n, i, s) for q, n, i, s in got}) == want  # the query's rows all give the same


def test_scratch_spares_other_threads(spark):
    ready, done, held = threading.Event(), threading.Event(), {}

    def other():
        ready.wait(60)
        held["path"] = common.work_dir(spark, "other")
        with common.scratch(spark):
            spark.range(3).write.parquet(inner := common.work_dir(spark, "inner"))
            held["inner"] = inner
        spark.range(3).write.parquet(held["path"])
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with common.scratch(spark):
        own = common.work_dir(spark, "own")
        spark.range(2).write.parquet(own)
        ready.set()
        assert done.wait(120)
    thread.join()
    at = lambda p: os.path.exists(p.removeprefix("file://").removeprefix("file:"))
    assert at(held["path"]) and not at(held["inner"]) and not at(own)
    common.remove(spark, [held["path"]])


def test_attempts_write_files_of_their_own(spark):
    df = spark.createDataFrame([(i, "u", f"<p>{i % 3}</p>") for i in range(9)], "page_id long, url string, html string")
    folder = common.work_dir(spark, "attempts")
    manifest = warc.write(df, folder)
    paths = [r["path"] for r in manifest.collect()]
    assert all(re.search(r"part-\d{5}-\d+-\d{4}\.warc\.gz$", p) for p in paths)
    # what another attempt left is no part of the archive
    fs, root = common.filesystem(folder)
    with fs.open_output_stream(f"{root}/part-00000-999999-0000.warc.gz") as out:
        out.write(b"left by a lost attempt")
    assert warc.read(manifest).count() == 9
