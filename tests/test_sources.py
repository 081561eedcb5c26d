"""Code extraction, scans, snapshots, the engine and streaming."""

import json
import subprocess

import pytest

from quarry.functions import code
from quarry.functions import text as T
from quarry.plans import context
from quarry.plans.engine import Engine
from quarry.sources import files, snapshot
from quarry.streaming import incremental


def names(symbols):
    return [(s.name, s.type) for s in symbols]


def test_python_symbols():
    source = "@cached\n@other(1)\nclass A(Base):\n    def run(self):\n        helper(1)\n        obj.find(x)\n        if (x):\n            pass\n\nasync def go():\n    return run()\n"
    got = code.python_symbols(source)
    assert names(got) == [("A", "class"), ("run", "function"), ("go", "function")]
    assert got[0].content == "@cached\n@other(1)\nclass A(Base):" and got[0].line == 3
    assert got[1].calls == ["helper", "find"]
    assert names(code.python_precise(source)) == names(got) and code.python_precise("def (") == []
    assert code.python_imports("import a, b as c\nfrom x.y import z\n") == ["a", "b as c", "x.y"]


def test_go_symbols():
    source = 'package p\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\ntype T struct {\n\tA int\n}\n\nconst (\n\tC1 = "}" // {\n\tC2 = `{`\n)\n\nfunc (t *T) Run() {\n\tvar local = 1\n\thelper()\n\tfmt.Println(local)\n\thelper()\n}\n\nfunc helper() {}\n'
    got = code.go_symbols(source)
    assert set(names(got)) == {("T", "type"), ("C1", "variable"), ("C2", "variable"), ("Run", "function"), ("local", "variable"), ("helper", "function")}
    assert next(s for s in got if s.name == "Run").calls == ["helper"]
    assert code.go_symbols("package p\nfunc f() {") == []
    assert code.go_imports(source) == ["fmt", "a/b"]
    assert "func (t *T) Run()" in code.go_outline(source) and "helper()\n\tfmt" not in code.go_outline(source)


def test_ts_and_rust_symbols():
    ts = "export interface I {}\nexport default class K {}\ntype X = string\nexport const f = async (a: number) => a\nfunction g() {}\n"
    assert names(code.ts_symbols(ts)) == [("I", "interface"), ("K", "class"), ("X", "type_alias"), ("f", "function"), ("g", "function")]
    imports = "import a from 'x'\n// import b from 'no'\n/* from 'no2' */\nconst t = `import c from 'no3'`\nconst r = require(\"y\")\nimport {\n  d,\n} from './z'\nexport * from '../w'\n"
    assert code.ts_imports(imports) == ["x", "y", "./z", "../w"]
    rust = "pub struct S;\nenum E {}\npub(crate) trait T {}\nimpl S {\n    pub async fn run(&self) {}\n}\n"
    assert names(code.rust_symbols(rust)) == [("S", "struct"), ("E", "enum"), ("T", "trait"), ("S", "impl"), ("run", "function")]


def test_python_built_ins_are_no_calls():
    got = code.python_symbols("def f(x):\n    return open(str(len(g(x))), isinstance(x, h()))\n")
    assert got[0].calls == ["g", "h"]


def test_spaces_before_brackets():
    got = code.python_symbols("def f(x):\n    foo (x) and (bar\t(y) or not (x in (1, 2)))\n    return (x)\n")
    assert got[0].calls == ["foo", "bar"]


def test_declarations_within_a_line():
    got = code.go_symbols("package p\n\nfunc f(a bool) {\n\tif a { const z = 1 }; var y = 2\n}\n")
    assert [(s.name, s.type, s.line, s.content) for s in got if s.name != "f"] == [("y", "variable", 4, "var y = 2"), ("z", "variable", 4, "const z = 1")]


def test_precise_typescript():
    source = """export async function load(a: string): Promise<void> {
  const inner = () => go(a);
  fetch(`x${a}`); this.api.get("q("); new Thing(); if (a) { run(); }
}
export default abstract class Store<T> extends Base {
  private x = make(1);
  handler = () => { skip(); };
  constructor(private a: A) { super(a); this.init(); }
  static async find(id: number): Promise<T> { return await db.find(id); }
  get size() { return count(this); }
  abstract nothing(): void;
}
interface Shape { area(): number }
type Pair<A, B> = [A, B];
export const enum Color { Red }
export const add = (a: number, b: number): number => sum(a, b);
const one = x => two(x), three = 3;
if (a) { function nested() { deep(); } }
"""
    got = code.ts_precise(source)
    assert names(got) == [
        ("load", "function"), ("Store", "class"), ("constructor", "method"), ("find", "method"), ("size", "method"), ("Shape", "interface"), ("Pair", "type_alias"), ("Color", "enum"), ("add", "function"), ("nested", "function"),
    ]
    by = {s.name: s for s in got}
    assert by["load"].calls == ["fetch", "get", "go", "run"] and by["constructor"].calls == ["init"] and by["add"].calls == ["sum"]
    assert (by["size"].line, by["size"].content) == (10, "get size() { return count(this); }")
    assert names(code.ts_precise(source, typed=False)) == [(n, k) for n, k in names(got) if k in ("function", "class", "method")]
    assert code.ts_precise("class {{{ function") == [] and code.ts_precise("") == []


def test_precise_rust():
    source = """pub struct Point { x: i32 }
struct Unit;
enum E<'a> { A(&'a str) }
pub trait Shape { type Out; fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
impl<T: Clone> Shape for Vec<T> where T: Copy { type Out = T;
    fn area(&self) -> f64 { let c = '('; helper(c); crate::util::run(1); println!("x("); Some(2) } }
type Bytes = [u8; 4];
pub async unsafe fn go() { fn inner() { no() } inner(); }
"""
    got = code.rust_precise(source)
    assert names(got) == [
        ("Point", "struct"), ("Unit", "struct"), ("E", "enum"), ("Shape", "trait"), ("twice", "function"), ("Vec<T>", "impl"), ("Out", "type_alias"), ("area", "function"), ("Bytes", "type_alias"), ("go", "function"),
    ]
    by = {s.name: s for s in got}
    assert by["area"].calls == ["Some", "helper", "run"] and by["twice"].calls == ["area"] and by["area"].line == 6 and by["Bytes"].content == "type Bytes = [u8; 4]"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "gen").mkdir()
    (root / "a.go").write_text("package main\n\nfunc RunA() {\n\tRunB()\n}\n")
    (root / "pkg" / "b.go").write_text("package pkg\n\nfunc RunB() {\n\tinner()\n}\n\nfunc inner() {}\n")
    (root / "pkg" / "__init__.py").write_text("import os\n\ndef widget_factory():\n    return 1\n")
    (root / "README.md").write_text("About widgets and gadgets.\n")
    (root / "node_modules" / "x.js").write_text("function no() {}")
    (root / "gen" / "g.py").write_text("def no(): pass")
    (root / "big.txt").write_text("x" * (3 << 20))
    (root / ".quarryignore").write_text("# comment\ngen/\n*.skip.md\n")
    (root / "n.skip.md").write_text("no")
    return root


def test_scan(spark, tree, tmp_path):
    assert [i for i, _ in files.list_files(str(tree))] == ["README.md", "a.go", "pkg/__init__.py", "pkg/b.go"]
    rows = {r["id"]: r for r in files.scan(spark, str(tree)).collect()}
    assert rows["a.go"]["type"] == "go_file" and len(rows["a.go"]["hash"]) == 64
    with pytest.raises(ValueError):
        files.list_files(str(tmp_path), str(tree))
    (tree / "link.md").symlink_to(tmp_path / "outside.md")
    (tmp_path / "outside.md").write_text("no")
    assert "link.md" not in [i for i, _ in files.list_files(str(tree))]
    assert files.glob_matches("a/*.go", "a/b.go") and not files.glob_matches("a*", "a/b.go")


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), str(tree))
    assert "empty" in engine.build_context("widget").message
    assert engine.index() == 4 and engine.index() == 0
    edges = {(r["from_id"], r["to_id"], r["relation_type"]) for r in engine.edges().collect()}
    assert ("pkg/b.go:RunB", "pkg/b.go:inner", "calls") in edges and ("a.go", "a.go:RunA", "contains") in edges
    assert not any(a == "a.go:RunA" and r == "calls" for a, _, r in edges)  # a caller at the root only finds its own directory
    result = engine.build_context("widget factory")
    assert result.nodes[0]["id"] == "pkg/__init__.py" and result.token_estimate > 0
    assert engine.build_context("zzzzz").message
    assert any(line.startswith("[function] pkg/__init__.py:widget_factory") or "pkg/__init__.py" in line for line in engine.search("widget_factory", -1))
    assert {e["to_id"] for e in engine.trace("pkg/b.go", -1)} == {"pkg/b.go:RunB", "pkg/b.go:inner"}
    assert {n["id"] for n in engine.drill_down("pkg").nodes} == {"pkg/__init__.py", "pkg/b.go"} and engine.drill_down("nope").message
    (tree / "pkg" / "b.go").unlink()
    (tree / "README.md").write_text("changed")
    assert engine.index() == 2
    assert not any(r["id"].startswith("pkg/b.go") for r in engine.nodes().collect())
    for bad in ("", "x" * 4097):
        with pytest.raises(ValueError):
            engine.build_context(bad)
    with pytest.raises(ValueError):
        engine.reset()
    engine.reset("yes-delete-all")
    assert engine.status()["nodes"] == 0


def test_engine_keeps_its_index_up_to_date(spark, tree, tmp_path):
    """Identifier parts and phrases are found; after changes the tables are those of a fresh index."""
    (tree / "pkg" / "user.go").write_text("package pkg\n\nfunc getUserHandler() {\n\tfoo.bar(now)\n}\n")
    engine = Engine(spark, str(tmp_path / "index"), str(tree))
    engine.index()
    assert any("pkg/user.go" in line for line in engine.search("user"))
    assert any("pkg/user.go" in line for line in engine.search("foo.bar")) and not engine.search("bar.foo")
    (tree / "pkg" / "user.go").write_text("package pkg\n\nfunc getAccountHandler() {}\n")
    (tree / "pkg" / "b.go").unlink()
    (tree / "c.ts").write_text("export function widget() {}\n")
    assert engine.index() == 3 and not any("[go.go] pkg/user.go" in line for line in engine.search("foo.bar"))
    fresh = Engine(spark, str(tmp_path / "fresh"), str(tree))
    fresh.index()
    for name in ("nodes", "edges", "parsed", "postings", "stats"):
        a, b = (sorted(map(str, e.tables.table(name).collect())) for e in (engine, fresh))
        assert a == b and a, name
    assert engine.build_context("account").to_dict() == fresh.build_context("account").to_dict()
    found = engine.drill_down("pkg")
    assert [n["id"] for n in found.nodes] == ["pkg/__init__.py", "pkg/user.go"] and not found.truncated
    small = Engine(spark, str(tmp_path / "index"), str(tree), context.Config(budget=9)).drill_down("pkg")
    assert small.truncated and small.token_estimate <= 9 and small.branches[0]["path"] == "pkg" and small.suggested_next == ["pkg"]


def test_engine_plug_ins(spark, tree, tmp_path):
    made = []

    def embed(texts):
        made.append(len(texts))
        return [[float("gadget" in t), float("RunA" in t), 1.0] for t in texts]

    def parse(path, source):
        return [code.Symbol("only", "function", 1, "only", [])] if path == "a.go" else [], []

    engine = Engine(spark, str(tmp_path / "index"), str(tree), embed=embed, parse=parse, vocabulary=T.token_set)
    engine.index()
    assert engine.status()["vectors"] == 4
    assert {r["id"] for r in engine.nodes().filter("type = 'function'").collect()} == {"a.go:only"}
    assert {n["source"] for n in engine.build_context("gadgets").nodes} >= {"fts"}
    assert made == [1]  # the query; files are embedded where the tasks run


def test_engine_expands_queries(spark, tree, tmp_path):
    """Neighbours are searched, but coverage stays that of the query's own terms."""
    engine = Engine(spark, str(tmp_path / "index"), str(tree), expansion=2)
    engine.index()
    engine.tables.commit(neighbours=spark.createDataFrame([("zeppelin", "gadgets", 2.0)], snapshot.SCHEMAS["neighbours"]))
    row = engine._query("zeppelin").first()
    assert (row["query"], row["expanded"]) == ("zeppelin", "zeppelin gadgets")
    assert [n["id"] for n in engine.build_context("zeppelin").nodes] == ["README.md"]


def test_requests(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), str(tree))
    assert json.loads(engine.handle('{"tool": "index"}')) == 4
    assert json.loads(engine.handle(b'{"tool": "search", "arguments": {"query": "widgets"}}'))
    assert json.loads(engine.handle('{"tool": "build_context", "arguments": {"query": "widgets"}}'))["nodes"][0]["id"] == "README.md"
    for bad in ("{", '{"tool": "nodes"}', '{"tool": "search"}', '{"tool": "search", "arguments": {"query": ""}}', '{"tool": "reset"}', " " * (1 << 20) + "{}"):
        assert "error" in json.loads(engine.handle(bad))


def test_command_line(spark, tree, tmp_path, capsys):
    import io

    from quarry import __main__ as cli

    (tmp_path / "conf.json").write_text(json.dumps({"spark.quarry.budget": "50"}))
    out = io.StringIO()
    requests = ['{"tool": "status"}\n', "\n", '{"tool": "build_context", "arguments": {"query": "widgets"}}\n', "no json\n"]
    assert cli.main([str(tmp_path / "index"), str(tree), "--config", str(tmp_path / "conf.json")], requests, out) == 0
    spark.conf.unset("spark.quarry.budget")
    text = out.getvalue()
    decoder, found = json.JSONDecoder(), []
    while text.strip():
        answer, end = decoder.raw_decode(text.lstrip())
        found.append(answer)
        text = text.lstrip()[end:]
    assert found[0]["nodes"] > 4 and found[1]["token_estimate"] <= 50 and "error" in found[2]
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert capsys.readouterr().out.strip()


def test_engine_follows_the_head(spark, tree, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-q", "-m", "x")
    engine = Engine(spark, str(tmp_path / "index"), str(tree), follow_head=True)
    engine.index()
    (tree / "new.md").write_text("zeppelins")
    assert not engine.search("zeppelins")
    git("add", "-A")
    git("commit", "-q", "-m", "y")
    assert engine.search("zeppelins") and not engine.head_changed()


def test_tracked_files(spark, tree, tmp_path):
    assert files.git_tracked(spark, str(tree)).count() == 0
    for args in (["init", "-q"], ["add", "a.go", "pkg"]):
        subprocess.run(["git", "-C", str(tree), *args], check=True)
    assert {r["id"] for r in files.git_tracked(spark, str(tree)).collect()} == {"a.go", "pkg/__init__.py", "pkg/b.go"}
    engine = Engine(spark, str(tmp_path / "index"), str(tree), tracked_only=True)
    assert engine.index() == 3


def test_readers_outlive_a_commit(spark, tmp_path):
    tables = snapshot.Snapshots(spark, str(tmp_path / "t"))
    rows = lambda n: spark.range(n).selectExpr("string(id) AS from_id", "'x' AS to_id", "'calls' AS relation_type")
    tables.commit(edges=rows(3))
    old = tables.table("edges")
    tables.commit(edges=rows(5))
    assert old.count() == 3 and tables.table("edges").count() == 5
    tables.commit(edges=rows(6))
    kept = [p for p in (tmp_path / "t").iterdir() if p.is_dir() and any(p.iterdir())]
    assert len([p for p in kept if (p / "edges").exists()]) == 2


def test_snapshots(spark, tmp_path):
    tables = snapshot.Snapshots(spark, str(tmp_path))
    df = spark.createDataFrame([("a", "b", "calls")], snapshot.SCHEMAS["edges"])
    tables.commit(edges=df)
    tables.commit(edges=df.union(df))
    tables.put("k", "v")
    assert tables.table("edges").count() == 2 and tables.get("k") == "v" and tables.get("none") == ""
    tables.optimise()
    tables.reset()
    assert tables.table("edges").count() == 0 and tables.get("k") == "v"
    (tmp_path / "current.json").write_text(json.dumps({"version": 99, "tables": {}, "meta": {}}))
    with pytest.raises(ValueError):
        tables.table("edges")


def test_head(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], capture_output=True, text=True, check=True).stdout.strip()
    assert files.git_head(str(tmp_path)) == ""
    git("init", "-q")
    git("commit", "-q", "--allow-empty", "-m", "x")
    assert files.git_head(str(tmp_path)) == git("rev-parse", "HEAD")
    git("pack-refs", "--all")
    assert files.git_head(str(tmp_path)) == git("rev-parse", "HEAD")


def test_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "query": "q", "ground_truth_files": ["a"], "notes": ""}]))
    assert files.cases(spark, str(tmp_path)).first()["ground_truth_files"] == ["a"]


def test_streams(spark, tmp_path):
    tables = snapshot.Snapshots(spark, str(tmp_path / "t"))
    schema = snapshot.SCHEMAS["nodes"]
    for content in ("one", "two"):
        spark.createDataFrame([("a", "text_file", content, content), ("b", "text_file", "same", "h")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.upsert_stream(spark, str(tmp_path / "in"), schema, tables, str(tmp_path / "cp")).awaitTermination(60)
    assert {r["id"]: r["content"] for r in tables.table("nodes").collect()} == {"a": "two", "b": "same"}


def test_streams_take_the_latest_row(spark, tmp_path):
    """Several rows of an id in one batch: that of the latest file, whatever the order of reading."""
    import os

    tables, schema = snapshot.Snapshots(spark, str(tmp_path / "t")), snapshot.SCHEMAS["nodes"]
    for k in range(6):
        spark.createDataFrame([("a", "text_file", f"text {k}", f"h{k}")], schema).coalesce(1).write.parquet(str(tmp_path / "made" / str(k)))
        part = next((tmp_path / "made" / str(k)).glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        at = tmp_path / "in" / f"{(k * 5) % 6}.parquet"
        part.rename(at)
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
    incremental.upsert_stream(spark, str(tmp_path / "in"), schema, tables, str(tmp_path / "cp")).awaitTermination(60)
    assert [r["content"] for r in tables.table("nodes").collect()] == ["text 5"]
