"""Text functions against the shapes they are defined on."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "tokens"),
    [("compression", ["compress"]), ("and the or schema", ["schema"]), ("schema schema definition", ["schema", "definit"]), ("compression compression", ["compress", "compress"]), ("(a) b. cd", ["cd"]), ("", [])],
)
def test_query_tokens(spark, query, tokens):
    assert one(spark, T.tokenise_query(F.col("q")), q=query) == tokens


def test_identifiers(spark):
    assert one(spark, T.split_identifiers(F.col("q")), q="parseHTTPServer v2Parser my_long_name fooBar fooBar") == ["parse", "http", "server", "v2parser", "long", "name", "foo", "bar"]


def test_terms_fold_marks(spark):
    assert one(spark, T.unicode_terms(F.col("q")), q="Élan boost_term, naïve-x 日本語") == ["elan", "boost", "term", "naive", "x", "日本語"]


def test_lines_and_estimates(spark):
    assert one(spark, T.truncate_lines(F.col("q"), 2), q="a\nb\nc\nd") == "a\nb\n... (2 lines omitted)"
    assert one(spark, T.truncate_lines(F.col("q"), 2), q="a\nb") == "a\nb"
    assert [one(spark, T.estimate_tokens(F.col("q")), q=x) for x in ("", "abc", "abcdefgh", "éé")] == [1, 1, 2, 1]


def test_paths(spark):
    assert one(spark, T.directory(F.col("q")), q="a/b/c.go:F") == "a/b"
    assert one(spark, T.directory(F.col("q")), q="c.go") == "(root)"
    assert one(spark, T.file_id(F.col("q")), q="a/b.go:x:F") == "a/b.go:x"
    assert one(spark, T.file_type(F.col("q")), q="a/B.TSX") == "ts_file"
    assert one(spark, T.type_factor(F.col("q"), F.lit("go_file")), q="a_test.go") == 0.5
    assert float(one(spark, T.type_boost(F.col("q")), q="text_file")) == 0.1


def test_augment_round_trip(spark):
    assert one(spark, T.strip_augment(T.augment(F.col("q"), F.lit("src/fileName.py"))), q="some fooBar\n") == "some fooBar\n"
    assert one(spark, T.index_text(F.col("q"), F.lit("src/fileName.py")), q="fooBar") == "foo\nbar\nfile\nname"


def test_compress(spark):
    source = "import os\nx = 1\ndef f():\n    return 1\nclass A:\n    async def g(self): pass\n"
    assert one(spark, T.compress(F.lit("a.py"), F.lit("py_file"), F.col("q")), q=source) == "import os\ndef f():\nclass A:\n    async def g(self): pass"
    assert one(spark, T.compress_hard(F.lit("os"), F.lit("import"), F.col("q")), q="") == "os"


def test_summaries(spark):
    assert one(spark, T.summary_line(F.lit("a.go:F"), F.lit("function"), F.col("q")), q="func F() {\n}") == "[function] a.go:F — func F() {"
    assert one(spark, T.summary_line(F.lit("a/b.py"), F.lit("py_file"), F.col("q")), q="x\ny") == "[python.py] a/b.py (2 lines)"
    assert one(spark, T.file_context(F.col("q"), F.lit(2), 1), q="a\nb\nc\nd") == "     1: a\n>    2: b\n     3: c"
    assert one(spark, T.directory_summary(F.array(*[F.lit(f"d/{c}.go") for c in "edcbaf"]))) == "a, b, c, d, e, …"
