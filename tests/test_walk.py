"""Trees listed by tasks, held against a walk of the operating system."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from pyarrow import fs as pafs

from quarry.functions import text as T
from quarry.sources import files


def plain(root, below=""):
    """Ids by os.walk and whole paths alone."""
    start = os.path.join(root, below) if below else root
    patterns, out = files.read_ignores(start), set()
    for folder, _, names in os.walk(start):
        for name in names:
            path = os.path.join(folder, name)
            parts = os.path.relpath(path, start).split(os.sep)
            ways = ["/".join(parts[: n + 1]) for n in range(len(parts))]
            if any(files.ignored(w, patterns) for w in ways) or files.SKIPPED_DIRS & set(parts[:-1]):
                continue
            real = os.path.realpath(path)
            if os.path.splitext(name)[1].lower() in T.EXTENSION_TYPES and os.path.isfile(real) and real.startswith(os.path.realpath(root) + os.sep) and os.path.getsize(real) <= files.MAX_BYTES:
                out.add(os.path.relpath(path, root))
    return out


@pytest.fixture(scope="module")
def forest(tmp_path_factory):
    """Hidden, skipped, ignored, wide, deep and empty folders, odd names."""
    rng, root = random.Random(3), tmp_path_factory.mktemp("forest") / "tree"
    folders = [root]
    root.mkdir()
    for n in range(120):
        parent = rng.choice(folders[-6:] + folders[:3])
        name = rng.choice(["node_modules", "gen"]) if n % 12 == 11 else rng.choice([f"d{n}", f"_d{n}", f".d{n}", f"a b{n}", f"é{n}"])
        made = parent / name
        made.mkdir(exist_ok=True)
        folders.append(made)
    for n in range(600):
        name = rng.choice([f"f{n}.py", f"_f{n}.go", f".f{n}.md", f"f{n}.bin", f"F{n}.MD", "__init__.py", f"x{n}.skip.md", f"f {n}.rs", f"é{n}.ts", f"f{n}"])
        (rng.choice(folders) / name).write_bytes(b"\xffbytes %d" % n)
    (root / ".quarryignore").write_text("gen/\n*.skip.md\n# no\n")
    (root / "below" / "in").mkdir(parents=True)
    (root / "below" / "in" / "_a.py").write_text("a = 1")
    (root / "below" / ".quarryignore").write_text("b.py")
    (root / "below" / "b.py").write_text("b = 1")
    (root / "big.md").write_text("x" * (files.MAX_BYTES + 1))
    return root


def test_rounds_find_what_a_walk_finds(spark, forest):
    expected = plain(str(forest))
    assert len(expected) > 150 and any("/." in i or i.startswith(".") for i in expected) and any("/_" in i for i in expected)
    assert {i for i, _ in files.list_files(str(forest))} == expected
    tree = files.Tree.at(str(forest), None)
    for most in (1, 40, files.LISTED):
        got = [r["id"] for r in files.walk(spark, tree, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == expected, most


def test_other_stores(spark, forest):
    """A store that is not the local one: paths within it mean nothing to open()."""
    store = pafs.SubTreeFileSystem(str(forest.parent), pafs.LocalFileSystem())
    rows = files.scan(spark, "tree", filesystem=store).collect()
    assert {r["id"] for r in rows} == plain(str(forest))
    for r in rows[:50]:
        data = (forest / r["id"]).read_bytes()
        assert r["hash"] == hashlib.sha256(data).hexdigest() and r["content"] == data.decode("utf-8", "replace")
    with pytest.raises(ValueError):
        files.scan(spark, "other", "tree", filesystem=store)


def test_links_and_parts(spark, forest, tmp_path):
    assert {i for i, _ in files.list_files(str(forest / "below"), str(forest))} == plain(str(forest), "below") == {"below/in/_a.py"}
    root = tmp_path / "links"
    (root / "in").mkdir(parents=True)
    (root / "in" / "a.py").write_text("a = 1")
    (tmp_path / "out.py").write_text("b = 1")
    (root / "to_out.py").symlink_to(tmp_path / "out.py")
    (root / "to_in.py").symlink_to(root / "in" / "a.py")
    (root / "broken.py").symlink_to(root / "nothing.py")
    (root / "loop").symlink_to(root)
    assert sorted(r["id"] for r in files.scan(spark, f"file://{root}").collect()) == ["in/a.py", "to_in.py"]


def test_empty_and_missing(spark, tmp_path):
    assert files.scan(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        files.scan(spark, str(tmp_path / "nowhere")).count()
