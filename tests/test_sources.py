"""Files and the change feed as data sources: executors list and read, folders are pruned, streams go on from their checkpoint."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.errors import CodedError
from graphloom.functions import text
from graphloom.sources import changes, files, tree
from graphloom.streaming import changes as stream

NAMES = ["a.py", ".hidden/x.py", "src/a.py", "src/deep/er/b.py", "src/_priv/c.py", "src2/a.py", "src/deep2/d e%20#.py", "src/deep/é.md", "lib/x.py", "lib/skip/y.py"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i, name in enumerate(NAMES):
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"x = {i}\n")
    (root / "bad.py").write_bytes(b"\xff\xfe")
    (root / "nul").write_bytes(b"")
    (root / "none").mkdir()
    os.symlink(root, root / "src" / "loop")  # a link to a directory, which isn't followed
    os.symlink(root / "a.py", root / "src" / "link.py")
    return root


def expected(root, scope, exclude=()):
    every = {os.path.relpath(os.path.join(at, n), root) for at, _, names in os.walk(root) for n in names}
    inside = lambda p, given: any(x.strip("/") in (".", "") or p == x.strip("/") or p.startswith(x.strip("/") + "/") for x in given)
    return {p for p in every if inside(p, scope) and not inside(p, exclude) and not (root / p).is_dir()}


@pytest.mark.parametrize(("scope", "exclude"), [(["."], []), (["src"], []), (["src/deep", "lib/"], ["lib/skip"]), (["src"], ["src"]), ([], []), (["a.py"], []), (["nothing"], []), (["."], ["src", ".hidden"])])
@pytest.mark.parametrize("units", [1, 3, 256])
def test_names(spark, root, monkeypatch, scope, exclude, units):
    reader = tree.TreeReader(str(root), scope, exclude)
    monkeypatch.setattr(tree, "UNITS", units)
    parts = reader.partitions()
    found = [p for unit in parts for batch in reader.read(unit) for p in batch.column("path").to_pylist()]
    assert len(found) == len(set(found)) and set(found) == expected(root, scope, exclude)
    if units == 256:
        df = files.names(spark, str(root), scope, exclude)
        assert {r.path for r in df.collect()} == set(found)
        rule = spark.createDataFrame([(p,) for p in expected(root, ["."])], "path string").where(text.under(F.col("path"), scope) & ~text.under(F.col("path"), exclude))
        assert {r.path for r in rule.collect()} == set(found)


def test_wide_folders_are_shared(tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "UNITS", 8)
    for i in range(40):
        (tmp_path / f"d{i}" / "in").mkdir(parents=True)
        (tmp_path / f"d{i}" / "in" / "f.py").write_text("")
        (tmp_path / f"g{i}.py").write_text("")
    reader = tree.TreeReader(f"file:{tmp_path}", ["."], [])
    parts = reader.partitions()
    found = [[p for batch in reader.read(unit) for p in batch.column("path").to_pylist()] for unit in parts]
    assert len(parts) == tree.SHARES and sum(map(bool, found)) > tree.SHARES // 2
    assert sorted(sum(found, [])) == sorted(expected(tmp_path, ["."]))


def test_folders_are_chosen_and_filters_filter(spark, root):
    assert sorted(u.folder for u in tree.TreeReader(str(root), ["src"], ["src/deep"]).partitions()) == ["", "src", "src/_priv", "src/deep2"]
    df = files.names(spark, str(root), ["src"], ["src/deep"])
    assert df.rdd.getNumPartitions() == 4
    # filters of one query leave the next alone
    assert [r.path for r in df.where("path = 'src/a.py'").collect()] == ["src/a.py"]
    assert {r.path for r in df.where(~F.col("path").startswith("src/d")).collect()} == {"src/a.py", "src/_priv/c.py", "src/link.py"}
    assert {r.path for r in df.collect()} == expected(root, ["src"], ["src/deep"])


def test_scan(spark, root, tmp_path):
    rows = {r.path: (r.source, r.valid) for r in files.scan(spark, str(root), ["."]).collect()}
    assert set(rows) == expected(root, ["."])
    assert rows["bad.py"] == (None, False) and rows["nul"] == ("", True) and rows["src/link.py"] == ("x = 0\n", True)
    assert all(rows[n] == (f"x = {i}\n", True) for i, n in enumerate(NAMES))
    assert {r.path for r in files.scan(spark, f"file://{root}", ["lib"]).collect()} == {"lib/x.py", "lib/skip/y.py"}
    for none in (tmp_path / "missing", root / "a.py", root / "none"):
        assert files.scan(spark, str(none), ["."]).isEmpty()


def test_large_files_are_read_in_batches(spark, tmp_path, monkeypatch):
    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text(f"{i}" * 3_000_000)
    monkeypatch.setattr(files, "PART_BYTES", 1 << 20)
    df = files.scan(spark, str(tmp_path), ["."])
    assert df.rdd.getNumPartitions() == 18
    assert sorted((r.path, r.n, r.c) for r in df.select("path", F.length("source").alias("n"), F.substring("source", -1, 1).alias("c")).collect()) == [(f"f{i}.txt", 3_000_000, f"{i}") for i in range(6)]


@pytest.fixture
def work(tmp_path):
    root = tmp_path / "work"
    root.mkdir()

    def run(*command):
        settings = ["-c", "user.name=t", "-c", "user.email=t@t", "-c", "commit.gpgsign=false"]
        return subprocess.run(["git", *settings, "-C", str(root), *command], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q")

    def commit(written, removed=(), moved=()):
        for name, content in written.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(content)
        for name in removed:
            (root / name).unlink()
        for a, b in moved:
            (root / a).rename(root / b)
        run("add", "-A")
        run("commit", "-q", "--allow-empty", "-m", "x")
        return run("rev-parse", "HEAD")

    return str(root), commit


LONG = "".join(f"line {i}\n" for i in range(50))


def test_feed(spark, work):
    root, commit = work
    first = commit({"a.py": "1", "b/c.py": "2", "b/d.py": LONG})
    second = commit({"a.py": "2", "n.py": "3"}, removed=["b/c.py"], moved=[("b/d.py", "b/e.py")])
    rows = lambda *a: {tuple(r) for r in changes.git_changes(spark, root, *a).collect()}
    assert rows(first, second, ["."]) == {("M", "a.py", None), ("A", "n.py", None), ("D", "b/c.py", None), ("R", "b/e.py", "b/d.py")}
    assert rows(first, second, ["b"]) == {("D", "b/c.py", None), ("R", "b/e.py", "b/d.py")}
    assert rows(second, second, ["."]) == set()
    with pytest.raises(CodedError) as failed:
        changes.git_changes(spark, root, "nothing", second, ["."])
    assert failed.value.code == "GIT_DIFF_FAILED" and "nothing" in failed.value.detail["message"]


def test_feed_as_a_stream(spark, work, tmp_path):
    root, commit = work
    first = commit({"a.py": "1", "b/c.py": "2"})
    second = commit({"a.py": "2"})
    nodes = spark.createDataFrame([(1, "a.py"), (2, "b/c.py"), (3, "other.py"), (4, "b\\e.py")], "node_id long, file_path string")
    out = str(tmp_path / "out")

    def until_now():
        feed = stream.affected(stream.commits(spark, root, first), nodes)
        query = feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
            return sorted((r.node_id, r.status) for r in spark.read.schema("node_id long, path string, status string").parquet(out).collect())
        finally:
            query.stop()

    assert second != first and until_now() == [(1, "M")]
    assert until_now() == [(1, "M")]  # nothing came since
    commit({"b/e.py": "5"}, removed=["b/c.py"])
    assert until_now() == [(1, "M"), (2, "D"), (4, "A")]  # a stream started again goes on
