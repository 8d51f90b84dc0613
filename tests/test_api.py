from graphloom.api import Project
from graphloom.operators import reports, services
from pyspark.sql import functions as F


def project(spark):
    files = [("src/app.ts", "typescript", "import { s } from './service';\nexport const app = 1;"), ("src/service.ts", "typescript", "import { u } from './util';\nexport function login(a) {\n  return a;\n}"), ("src/util.ts", "typescript", "export const u = 1;"), ("src/unused-legacy.ts", "typescript", "const old = 1;"), ("AGENTS.md", "markdown", "Use tabs")]
    edges = [("src/app.ts", "src/service.ts", "import", "s", 1.0, 0.9), ("src/service.ts", "src/util.ts", "import", "u", 1.0, 0.9)]
    symbols = [(1, "src/service.ts", "login", "function", 4, True), (2, "src/util.ts", "u", "constant", 1, True)]
    return Project(
        spark,
        spark.createDataFrame(files, "path string, language string, content string"),
        spark.createDataFrame(edges, "src string, dst string, kind string, symbol string, weight double, confidence double"),
        spark.createDataFrame(symbols, "symbol_id long, path string, name string, kind string, complexity long, exported boolean"),
    )


def test_tools(spark):
    p = project(spark)
    assert [r.path for r in p.detect_dead_code().collect()] == ["src/unused-legacy.ts"]
    assert p.search("login function").first().path == "src/service.ts"
    assert p.get_context("fix login service", 500).where("path = 'src/service.ts'").count() == 1
    assert {(r.path, r.score) for r in p.pr_diff(["src/util.ts"]).collect()} == {("src/util.ts", 1.0), ("src/service.ts", 0.7)}
    assert p.graph_query("MATCH (a:File)-[:IMPORT]->(b:File) WHERE b.name CONTAINS 'util' RETURN a.id").first()[0] == "src/service.ts"
    assert p.sql_query("SELECT count(*) AS n FROM files").first().n == 5 and p.get_rules().first().source == "agents.md"
    assert [r.dst for r in p.trace_execution_path("src/app.ts", "src/util.ts").orderBy("step").collect()] == ["src/service.ts", "src/util.ts"]
    assert p.find_entry_points("src/util.ts").where("node = 'src/app.ts'").first().is_root
    assert p.calculate_change_surface(["src/util.ts"]).first().direct == 1 and p.complexity_report(1).first().name == "login"
    assert {r.what: r.n for r in p.doctor().collect()} == {"dead files": 1, "dead symbols": 1, "cycles": 0}
    assert p.plan_feature("login service", 2).where("role = 'core'").count() == 1
    assert p.compress("src/service.ts", 5).first().mode == "digest" and p.security_audit().count() == 0


def test_reports(spark):
    ev = spark.createDataFrame([("typescript",), ("vitest",), ("jest",)], "name string")
    assert {r.rule_id for r in reports.propose_rules(ev).collect()} == {"ts_strict_types", "vitest_tests"}
    once = reports.sync_block(F.lit("# Title\n"), F.lit("one"))
    first, second = spark.range(1).select(once, reports.sync_block(once, F.lit("two"))).first()
    assert first == f"# Title\n\n{reports.START}\none\n{reports.END}\n" and second == first.replace("one", "two")
    tree = reports.file_tree(spark.createDataFrame([("a/c",), ("d",), ("a/b",)], "path string")).orderBy("position").collect()
    assert [r.line for r in tree] == ["a/", "  b", "  c", "d"]
    cyc = spark.createDataFrame([(["x.ts", "y.ts", "x.ts"],)], "cycle array<string>")
    vio = spark.createDataFrame([("x.ts", "z.ts", "HIGH")], "src string, dst string, severity string")
    lines = spark.createDataFrame([("x.ts", 1, "a"), ("x.ts", 2, "import y from './y'")], "path string, line_no long, line string")
    assert {(r.path, r.target, r.severity, r.line_no) for r in reports.diagnostics(cyc, vio, lines).collect()} == {("x.ts", "y.ts", "warning", 2), ("y.ts", "x.ts", "warning", 0), ("x.ts", "z.ts", "error", 0)}
    assert reports.cycle_fixes(cyc).count() == 3
    f = spark.createDataFrame([("a", "go", "func a() { // (\n}"), ("b", "go", "func b( {"), ("c", "text", "(")], "path string, language string, content string")
    assert {r.path: r.valid for r in reports.valid_syntax(f).collect()} == {"a": True, "b": False, "c": True}


def test_services(spark):
    rows = [("a", "getUser", "route_handler", "router.get('/api/users/:id')", "f1"), ("b", "userClient", "function", "fetch('http://h/api/users/7')", "f2"), ("a", "OrdersController", "class", None, "f3")]
    s = spark.createDataFrame(rows, "service string, name string, kind string, signature string, file string")
    exported = services.exported_apis(s)
    assert {(r.path, r.method) for r in exported.collect()} == {("/api/users/:id", "GET"), ("/orders", "GET")}
    svc = spark.createDataFrame([("a", "@acme/core"), ("b", "web"), ("c", "other")], "id string, name string")
    deps = spark.createDataFrame([("b", "@acme/core"), ("c", "WEB")], "id string, dep string")
    name = lambda df: df.withColumnRenamed("service", "service_id")
    got = {(r.src, r.dst, r.type) for r in services.all_edges(svc, name(exported), name(services.consumed_apis(s)), deps).collect()}
    assert got == {("b", "a", "api"), ("b", "a", "package_dep"), ("c", "b", "package_dep")}
    assert '"links"' in services.graph_json(svc, deps).first().document


def test_benchmark(spark):
    p = project(spark)
    rows = {r.task: r for r in p.benchmark([("t1", "fix login service", ["service.ts", "nowhere.ts"]), ("t2", "zzz qqq", ["app.ts"])], budget=500).collect()}
    packed = p.get_context("fix login service", 500, 15).collect()
    whole = sum((len(r.content) + 3) // 4 for r in p.files.collect())
    assert rows["t1"].recall == 0.5 and rows["t1"].precision == int(1 / len(packed) * 100 + 0.5) / 100 and rows["t2"].recall == rows["t2"].precision == 0.0
    assert 0 < rows["t1"].tokens <= 500 and rows["t1"].savings == max(0, int((whole - rows["t1"].tokens) / whole * 100 + 0.5)) and rows["t2"].savings == 100.0
    assert "| t1 |" in reports.leaderboard(p.benchmark([("t1", "fix login service", ["service.ts"])])).first()[-1]


def test_signatures_and_semantic_edges(spark):
    p = project(spark)
    assert {(r.name, r.signature) for r in p.signatures().where("kind = 'function'").collect()} == {("login", "function login(a)")}
    # Without a configuration the root is the base; one file imports the other by its path.
    assert {(r.src, r.dst, r.kind, tuple(r.symbols)) for r in p.semantic_edges().collect()} == {("src/app.ts", "src/service.ts", "import", ("s",)), ("src/service.ts", "src/util.ts", "import", ("u",))}
