import subprocess

from graphloom.operators import metrics
from graphloom.sources import scan, store
from graphloom.streaming import watch
from pyspark.sql import functions as F


def make(root):
    (root / "src").mkdir()
    (root / "src/a.ts").write_text("export const a = 1;")
    (root / "src/b.py").write_text("x = 1")
    (root / "node_modules/x").mkdir(parents=True)
    (root / "node_modules/x/i.js").write_text("1")
    (root / "logo.png").write_bytes(b"123")
    (root / "empty.ts").write_text("")
    (root / "skip.log").write_text("log")
    (root / "package.json").write_text('{"dependencies": {"react": "1"}, "devDependencies": {"vue": "2"}}')
    (root / "yarn.lock").write_text("x")


def test_scan_and_index(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    make(root)
    files = scan.scan(spark, str(root), ["*.log"])
    assert {r.path for r in files.collect()} == {"src/a.ts", "src/b.py", "package.json"}
    p = scan.project(files).first()
    assert p.frameworks == ["react", "vue"] and not p.is_monorepo
    table = store.Table(spark, str(tmp_path / "files"), ["path"])
    small = lambda: scan.scan(spark, str(root), ["*.log"]).select("path", "hash", "content")
    assert store.index(small(), table).count() == 3
    assert {r.change for r in store.index(small(), table).collect()} == {"same"}
    (root / "src/a.ts").write_text("export const a = 2;")
    (root / "src/b.py").unlink()
    got = {r.path: r.change for r in store.index(small(), table).collect()}
    assert got == {"src/a.ts": "changed", "src/b.py": "deleted", "package.json": "same"}
    assert {r.path for r in table.read().collect()} == {"src/a.ts", "package.json"}
    table.vacuum(1)
    assert len(table.versions()) == 1


def test_upsert(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ["k"])
    t.upsert(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "n", 1)], "k int, v string, o int"), "o")
    t.upsert(spark.createDataFrame([(2, "c", 1), (None, "m", 1)], "k int, v string, o int"))
    assert {(r.k, r.v) for r in t.read().collect()} == {(1, "b"), (2, "c"), (None, "m")}
    t.delete(spark.createDataFrame([(1,)], "k int"))
    assert t.read().count() == 2


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x.y", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(2):
        (tmp_path / "f.txt").write_text(str(i))
        run("add", "-A")
        run("commit", "-qm", f"c{i}")
    log = scan.git_log(spark, str(tmp_path))
    g = metrics.git_metrics(log.withColumn("author", F.length("author"))).first()
    assert (g.file, g.churn, g.owner) == ("f.txt", 2, 1)
    assert scan.changed_files(spark, str(tmp_path), "HEAD~1").first().path == "f.txt"


def test_rules_and_config(spark, tmp_path):
    r = spark.createDataFrame([("a", "Use tabs", 3), ("b", "use 2 spaces, single quotes", 9), ("c", "Use tabs ", 9), ("d", " ", 1), ("e", "double quotes", 1)], "rule_id string, content string, priority int")
    got = {(x.rule_id, x.other, x.issue, x.prefer) for x in scan.rule_issues(r).collect()}
    assert got == {
        ("d", None, "empty", None), ("c", "a", "duplicate", None), ("a", "b", "conflict: indentation", "b"), ("b", "c", "conflict: indentation", "b"),
        ("b", "e", "conflict: quote style", "b"),
    }
    f = spark.createDataFrame([("AGENTS.md", "x"), (".cursor/rules/a.md", "y"), ("src/AGENTS.md", "z")], "path string, content string")
    assert {(x.path, x.source, x.scope, x.priority) for x in scan.rule_files(f).collect()} == {("AGENTS.md", "agents.md", "global", 10), (".cursor/rules/a.md", "cursor", "path", 8)}
    (tmp_path / "c.toml").write_text("[ranking]\nlexical = 1\n")
    assert scan.read_config(str(tmp_path / "c.toml"), {"ranking": {"path": 2}, "limit": 3}) == {"ranking": {"lexical": 1}, "limit": 3}
    assert scan.workspaces("packages:\n  - 'a/*'\n  - b\nother: 1") == ["a/*", "b"]
    both = scan.federate({"a b": r, "c": r})
    assert {x.repo for x in both.collect()} == {"repo_a_b", "repo_c"}


def test_watch(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    make(root)
    stream = watch.coalesce_changes(watch.watch(spark, str(root)))
    seen = []
    watch.on_batch(stream, lambda df, i: seen.extend(r.path.rsplit("/", 1)[-1] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert "a.ts" in seen and "i.js" not in seen
