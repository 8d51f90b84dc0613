import random

from graphloom.operators import graph, metrics
from graphloom.plans import pattern
from pyspark.sql import functions as F


def edges(spark, rows):
    full = [(a, b, "import", None, 1.0, c) for a, b, *rest in rows for c in [rest[0] if rest else 1.0]]
    return spark.createDataFrame(full, "src string, dst string, kind string, symbol string, weight double, confidence double")


def test_hops_and_path(spark):
    e = edges(spark, [("ctl", "auth"), ("auth", "user"), ("user", "db")])
    hop = lambda k: {r.node for r in graph.reach(graph.seeds_of(spark, ["ctl"], "string"), e, k).collect()}
    assert hop(1) == {"auth"} and hop(2) == {"auth", "user"}
    back = graph.reach(graph.seeds_of(spark, ["db"], "string"), graph.reverse(e), 2)
    assert {r.node for r in back.collect()} == {"user", "auth"}
    assert graph.shortest_path(e, "ctl", "db").first()[0] == ["ctl", "auth", "user", "db"]
    assert graph.shortest_path(e, "db", "ctl").isEmpty()
    assert graph.shortest_path(e, "db", "db").first()[0] == ["db"]


def test_breadth_first_misses_nothing(spark):
    e = edges(spark, [("s", "a"), ("s", "b"), ("a", "b"), ("b", "c")])
    assert {r.node: r.depth for r in graph.reach(graph.seeds_of(spark, ["s"], "string"), e, 2).collect()} == {"a": 1, "b": 1, "c": 2}


def test_execution_path_and_entries(spark):
    e = edges(spark, [("src/cli.ts", "src/user.controller.ts"), ("src/user.controller.ts", "svc", 0.95), ("svc", "repo"), ("svc.spec", "svc")])
    steps = graph.execution_path(e, "src/cli.ts", "repo").orderBy("step").collect()
    assert [s.dst for s in steps] == ["src/user.controller.ts", "svc", "repo"] and steps[0].path_confidence == 0.95
    found = {r.node: (r.distance, r.is_root) for r in graph.entry_points(e, "svc").collect()}
    assert found["src/cli.ts"] == (2, True) and found["svc.spec"] == (1, True)
    blast = {r.node: r.depth for r in graph.blast_radius(graph.seeds_of(spark, ["svc"], "string"), e).collect()}
    assert blast == {"src/user.controller.ts": 1, "svc.spec": 1, "src/cli.ts": 2}
    assert graph.change_surface(graph.seeds_of(spark, ["svc"], "string"), e).first().tests == 1


def test_pagerank_and_communities(spark):
    e = edges(spark, [("A", "C"), ("B", "C"), ("D", "C"), ("C", "E")])
    r = {x.node: x.rank for x in graph.pagerank(e).collect()}
    assert r["C"] > r["A"] and abs(sum(r.values()) - 1) < 1e-9
    two = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")])
    c = {x.node: x.community for x in graph.communities(two, 5).collect()}
    assert c["a"] == c["b"] == c["c"] != c["x"] == c["y"] == c["z"] and set(c.values()) == {0, 1}


def test_cycles(spark):
    assert graph.back_edge_cycles([("a", "b"), ("b", "c")]) == []
    assert graph.back_edge_cycles([("a", "b"), ("b", "c"), ("c", "a")]) == [["a", "b", "c", "a"]]
    assert graph.back_edge_cycles([("a", "a")]) == [["a", "a"]]
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])
    assert {tuple(r.cycle) for r in graph.simple_cycles(e, 3).collect()} == {("a", "b", "c", "a"), ("d", "d")}
    assert {r.node: r.component for r in graph.strong_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_metrics(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "c")])
    m = {r.node: (r.in_degree, r.out_degree, r.is_leaf, r.is_root) for r in metrics.node_metrics(e).collect()}
    assert m == {"a": (0, 2, False, True), "b": (1, 1, False, False), "c": (2, 0, True, False)}
    s = metrics.graph_summary(e).first()
    assert (s.nodes, s.edges, s.average_degree) == (3, 3, 2.0)
    hot = spark.createDataFrame([(12, 0.85, True, 25), (1, 0.1, False, 1)], "i int, inst double, god boolean, churn int")
    score = metrics.hotspot_score(F.col("churn"), F.col("inst"), F.col("i"))
    risk = metrics.hotspot_risk(score, F.col("god"), F.col("churn"), F.col("inst"), F.col("i"))
    assert [r[0] for r in hot.select(risk).collect()] == ["critical", "low"]


def test_layers(spark):
    e = edges(spark, [("src/controllers/a.ts", "src/infra/db.ts"), ("src/domain/m.ts", "src/infra/db.ts"), ("src/services/s.ts", "src/domain/m.ts")])
    v = {(r.source_layer, r.target_layer): r.severity for r in metrics.layer_violations(e).collect()}
    assert v == {("presentation", "infrastructure"): "HIGH", ("domain", "infrastructure"): "CRITICAL"}
    banned = metrics.layer_violations(e, disallow=["application -> domain"]).where("type = 'CUSTOM_RULE_VIOLATION'")
    assert banned.count() == 1
    assert metrics.layer_violations(e, allow=["application -> *"]).where("severity = 'MEDIUM'").count() == 2
    assert metrics.clean_score(metrics.layer_violations(e).limit(0), 3).first().score == 100.0


def test_pattern_language(spark):
    nodes = spark.createDataFrame(
        [("1", "Symbol", {"name": "login", "lines": "50"}), ("2", "Symbol", {"name": "queryUser", "lines": "150"}), ("3", "File", {"name": "packages/graph/index.ts", "lines": "500"})],
        "id string, label string, properties map<string,string>",
    )
    e = spark.createDataFrame([("1", "2", "CALLS"), ("2", "1", "CALLS")], "source string, target string, type string")
    run = lambda q: [tuple(r) for r in pattern.run(q, e, nodes).collect()]
    assert run("MATCH (a:symbol {name: 'login'})-[:CALLS]->(b:Symbol) WHERE b.name = 'QUERYUSER' RETURN a.name, b.name") == [("login", "queryUser")]
    assert run("MATCH (f:File) WHERE f.name CONTAINS 'GRAPH' AND f.lines > 400 RETURN f.id") == [("3",)]
    assert run("MATCH (f) WHERE f.missing != 'x' RETURN f.id") == []
    assert run("MATCH (a)<-[:CALLS]-(b) WHERE a.id = 1 RETURN b.name") == [("queryUser",)]
    assert len(run("MATCH (a)--(b) RETURN a.id, b.id")) == 4
    assert run("MATCH (f:File) RETURN g.name")[0][0] is None
    for bad in ("MATCH (a WHERE", "MATCH (a) WHERE a.x = 1 OR a.y = 2 RETURN a", "SELECT 1"):
        try:
            pattern.parse(bad)
        except pattern.PatternError:
            continue
        raise AssertionError(bad)


def test_translation():
    assert pattern.translate("who calls login") == "MATCH (caller:Symbol)-[:CALLS]->(target:Symbol) WHERE target.name = 'login' RETURN caller"
    assert pattern.translate("show python files") == "MATCH (f:File) WHERE f.language = 'python' RETURN f"
    assert pattern.translate("cari fungsi bayar") == "MATCH (s:Symbol) WHERE s.name CONTAINS 'bayar' RETURN s"
    assert pattern.translate("") is None and "CONTAINS 'hello'" in pattern.to_query("well hello")


def brute_components(pairs):
    after = {x: {x} for p in pairs for x in p}
    while True:
        more = {x: after[x] | {b for a, b in pairs if a in after[x]} for x in after}
        if more == after:
            return {x: min(y for y in after[x] if x in after[y]) for x in after}
        after = more


def test_strong_components_of_any_length(spark):
    ring = [(f"n{i:03}", f"n{(i + 1) % 53:03}") for i in range(53)]  # the colour walks 52 hops
    chain = [("n007", "p00"), *[(f"p{i:02}", f"p{i + 1:02}") for i in range(9)]]
    got = {r.node: r.component for r in graph.strong_components(edges(spark, ring + chain)).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(53)} | {f"p{i:02}": f"p{i:02}" for i in range(10)}


def test_strong_components_brute_force(spark):
    r = random.Random(5)
    pairs = [(f"{r.randrange(40):02}", f"{r.randrange(40):02}") for _ in range(55)]
    want = brute_components(pairs)
    rows = [(x.node, x.component) for x in graph.strong_components(edges(spark, pairs)).collect()]
    assert len(rows) == len(want) and dict(rows) == want and 1 < len(set(want.values())) < len(want)
    assert graph.strong_components(edges(spark, pairs).limit(0)).isEmpty()
