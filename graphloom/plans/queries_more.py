"""Registered queries: services, rules, plans, diagnostics, logs, guarded SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import files as ff
from graphloom.functions import scalars as sc
from graphloom.operators import extract, graph, metrics, packing, reports, services
from graphloom.plans import sqlguard
from graphloom.plans.base import query
from graphloom.plans.views import TABLES, table, use, view
from graphloom.sources import scan, store


def _new_table(spark, keys):
    return store.Table(spark, f"{store.shared_home(spark)}/table-{uuid.uuid4().hex}", keys)


@query("SELECT DISTINCT a.s_nationkey AS src, b.n_nationkey AS dst FROM supplier AS a JOIN nation AS b ON lower(b.n_name) = concat('', (SELECT lower(n_name) FROM nation AS c WHERE c.n_nationkey = (a.s_nationkey + a.s_suppkey) % 25)) WHERE a.s_nationkey <> b.n_nationkey")
def j11_package_edges(spark, sf_dir):
    """Dependencies that name another service, in any case."""
    n = table(spark, sf_dir, "nation")
    svc = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    wants = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), ((F.col("s_nationkey") + F.col("s_suppkey")) % 25).alias("t"))
    deps = wants.join(n.select(F.col("n_nationkey").alias("t"), F.lower("n_name").alias("dep")), "t").select(F.col("id").cast("string").alias("id"), "dep")
    return services.package_edges(svc, deps).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@query("SELECT p_partkey % 5 AS service, concat('/', regexp_replace(lower(concat('P', p_partkey, 'Controller')), 'controller|handler', '', 'g')) AS path, 'GET' AS method FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey % 5, concat('/api/', p_partkey), 'POST' FROM part WHERE p_partkey % 3 = 1")
def n11_exported_apis(spark, sf_dir):
    """Routes by name or by signature, with path and method."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("P"), k.cast("string"), F.lit("Controller"))).when(k % 3 == 1, F.concat(F.lit("add"), k.cast("string"))).otherwise("plain")
    sig = F.when(k % 3 == 1, F.concat(F.lit("router.post('/api/"), k.cast("string"), F.lit("', x)")))
    made = p.select((k % 5).alias("service"), name.alias("name"), F.lit("function").alias("kind"), sig.alias("signature"), F.lit("f").alias("file"))
    return services.exported_apis(made).select("service", "path", "method")


@query(
    """WITH n AS (SELECT string_agg(concat('{"id":', n_nationkey, ',"name":"', n_name, '"}'), ',' ORDER BY n_nationkey) AS t FROM nation),
    e AS (SELECT string_agg(concat('{"source":', s, ',"target":1}'), ',' ORDER BY s) AS t FROM (SELECT DISTINCT s_nationkey AS s FROM supplier))
    SELECT concat('{"nodes":[', n.t, '],"links":[', e.t, ']}') AS document FROM n, e"""
)
def sk6_graph_json(spark, sf_dir):
    """SK6: nodes and links as one JSON document."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    links = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.lit(1).alias("target")).distinct()
    return services.graph_json(n, links)


@query("SELECT rule_id, category FROM (VALUES ('ts_strict_types', 'typescript'), ('express_layers', 'express'), ('vitest_tests', 'testing'), ('layer_rules', 'architecture')) AS t(rule_id, category)")
def n17_rule_proposals(spark, sf_dir):
    evidence = spark.createDataFrame([("typescript",), ("express",), ("jest",), ("vitest",), ("layers",), ("other",)], "name string")
    return reports.propose_rules(evidence).select("rule_id", "category")


@query("SELECT n_nationkey AS rule_id, CAST(row_number() OVER (ORDER BY contains(lower(n_name), 'an') DESC, n_regionkey DESC, n_nationkey) AS INTEGER) AS rank FROM nation")
def o6_rule_order(spark, sf_dir):
    rules = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("content"), F.col("n_regionkey").alias("priority"))
    return packing.order_rules(rules.withColumn("content", F.regexp_replace(F.lower("content"), "an", "anx")), "fix anx").select("rule_id", "rank")


@query(
    """WITH c AS (SELECT relative_path AS path FROM v_files ORDER BY size DESC, relative_path LIMIT 10), k AS (SELECT path FROM (SELECT path, row_number() OVER () AS i FROM c) WHERE i <= 5),
    t AS (SELECT dst AS path FROM v_edges_doc WHERE src IN (SELECT path FROM k) UNION SELECT src FROM v_edges_doc WHERE dst IN (SELECT path FROM k) UNION SELECT path FROM c)
    SELECT path, 'core' AS role FROM k UNION ALL SELECT path, 'support' FROM t WHERE path NOT IN (SELECT path FROM k)""",
    "v_files", "v_edges_doc",
)
def n20_feature_plan(spark, sf_dir):
    """The first half is the core, what touches it supports it."""
    files, edges = use(spark, sf_dir, "v_files", "v_edges_doc")
    return reports.plan_feature(files.select(F.col("relative_path").alias("path"), F.col("size").alias("relevance")), edges, 10)


@query(
    """WITH h AS (SELECT DISTINCT src, dst FROM v_edges)
    SELECT 'dead files' AS what, (SELECT count(*) FROM v_files WHERE extension = '.py' AND relative_path NOT IN (SELECT dst FROM v_edges_doc)) AS n
    UNION ALL SELECT 'dead symbols', (SELECT count(*) FROM v_symbols WHERE exported AND name NOT IN (SELECT symbol FROM v_edges))
    UNION ALL SELECT 'cycles', (SELECT count(*) FROM h WHERE src = dst) + (SELECT count(*) FROM h AS a JOIN h AS b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst)""",
    "v_files", "v_edges_doc", "v_symbols", "v_edges",
)
def a16_insights(spark, sf_dir):
    files, doc, symbols, edges = use(spark, sf_dir, "v_files", "v_edges_doc", "v_symbols", "v_edges")
    dead = files.where("extension = '.py'").join(doc.select(F.col("dst").alias("relative_path")).distinct(), "relative_path", "left_anti")
    return reports.insights(dead, metrics.dead_symbols(symbols, edges.select(F.col("symbol").alias("name"))), graph.simple_cycles(edges, 2))


@query("SELECT n_nationkey AS id, array_to_string(CASE n_nationkey % 3 WHEN 0 THEN ['auth', 'login', 'token', 'jwt', 'session', 'security'] WHEN 1 THEN ['db', 'database', 'sqlite', 'sql', 'query', 'storage', 'failure'] ELSE ['plain', 'words'] END, ' ') AS terms FROM nation")
def x6_search_terms(spark, sf_dir):
    """Stop words out, synonyms in, each term once."""
    k = F.col("n_nationkey") % 3
    text = F.when(k == 0, "Where is the auth token?").when(k == 1, "find DB failure").otherwise("plain words, a plain")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(sc.search_terms(text), " ").alias("terms"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def f15_guarded_sql(spark, sf_dir):
    """the guard passes a reading statement and adds the limit."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return sqlguard.run(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey")


@query("SELECT c_custkey AS id, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def f16_partial_update(spark, sf_dir):
    """F16, SK1: fields that an update carries replace the stored ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", "s_acctbal")
    return store.patch(c.toDF("id", "name", "balance"), s.toDF("id", "name", "balance"), "id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS commit, CAST(o_custkey AS VARCHAR) AS author, concat('f', o_orderkey % 7) AS file FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), concat('g', o_orderkey % 5) FROM orders")
def sc14_parse_git_log(spark, sf_dir):
    """SC14: log text into commits and files."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    entry = F.concat(F.lit("\x01"), k.cast("string"), F.lit("\x02"), F.col("o_custkey").cast("string"), F.lit("\x022024-01-01T00:00:00+00:00\n\nf"), (k % 7).cast("string"), F.lit("\ng"), (k % 5).cast("string"), F.lit("\n"))
    return scan.parse_log(o.select(entry.alias("log"))).select("commit", "author", "file")


@query("SELECT concat('repo_', CASE WHEN n_regionkey < 2 THEN 'one' ELSE 'two_x' END) AS repo, n_name AS name FROM nation")
def sc17_federate(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    return scan.federate({"one": n.where("n_regionkey < 2").select("name"), "two x": n.where("n_regionkey >= 2").select("name")}).select("repo", "name")


@query("SELECT relative_path AS path, regexp_matches(relative_path, '(^|/)dist(/|$)') OR regexp_matches(relative_path, '\\.test\\.') AS ignored FROM v_files", "v_files")
def sc3_ignore_rules(spark, sf_dir):
    """SC1, SC3: default ignore list and an ignore file's pattern."""
    f = view(spark, sf_dir, "v_files")
    return f.select(F.col("relative_path").alias("path"), scan.ignored(F.col("relative_path"), ["*.test.*"]).alias("ignored"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS name FROM nation WHERE n_nationkey <> 7")
def sk1_upsert(spark, sf_dir):
    """SK1-SK3: upsert, append and delete on a versioned table; the rows that stay."""
    t = _new_table(spark, ["id"])
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    t.upsert(n)
    t.upsert(n.where("id < 5").withColumn("name", F.lower("name")))
    t.delete(n.where("id = 7").select("id"))
    return t.read()


@query("SELECT * FROM (VALUES ('a.ts', 'b.ts', 'warning', CAST(1 AS BIGINT)), ('b.ts', 'a.ts', 'warning', 0), ('a.ts', 'c.ts', 'error', 0)) AS t(path, target, severity, line_no)")
def n24_diagnostics(spark, sf_dir):
    """Cycle edges and violations of a small project at their import lines."""
    cycles = spark.createDataFrame([(["a.ts", "b.ts", "a.ts"],)], "cycle array<string>")
    violations = spark.createDataFrame([("a.ts", "c.ts", "CRITICAL")], "src string, dst string, severity string")
    lines = spark.createDataFrame([("a.ts", 0, "x"), ("a.ts", 1, "import b from './b'")], "path string, line_no long, line string")
    return reports.diagnostics(cycles, violations, lines)


@query(
    """WITH c AS (SELECT regexp_extract(relative_path, 'packages/([^/]+)', 1) AS context, list(relative_path ORDER BY relative_path) AS f FROM v_files WHERE relative_path LIKE 'packages/%' GROUP BY 1),
    l AS (SELECT string_agg(concat('- **', context, '**: ', array_to_string(f[1:5], ', '), CASE WHEN len(f) > 5 THEN concat(' (+', len(f) - 5, ' more)') ELSE '' END), chr(10) ORDER BY context) AS t FROM c)
    SELECT concat('- Indexed: ', (SELECT count(*) FROM v_files), ' files | 10 symbols | 20 dependencies', chr(10), '- Clean graph (0 cycles)', chr(10), t) AS block FROM l""",
    "v_files",
)
def n26_architecture_block(spark, sf_dir):
    return reports.architecture_block(view(spark, sf_dir, "v_files"), 10, 20, 0)


@query("SELECT file_id FROM v_files WHERE relative_path = 'src/services/f10.ts' OR ends_with(relative_path, '3.py') OR ends_with(relative_path, 'lib/f5.ts')", "v_files")
def f8_suffix_filter(spark, sf_dir):
    """F8: a whole path, or its end."""
    p = F.col("relative_path")
    return view(spark, sf_dir, "v_files").where((p == "src/services/f10.ts") | p.endswith("3.py") | p.endswith("lib/f5.ts")).select("file_id")


@query("""SELECT n_nationkey AS id, concat('x // ', n_name, ' /* y */ "') AS a, CAST(n_nationkey + 2 AS BIGINT) AS b FROM nation""")
def x28_json_comments(spark, sf_dir):
    """JSON with comments and trailing commas, parsed."""
    n = table(spark, sf_dir, "nation")
    name, key = F.col("n_name"), F.col("n_nationkey")
    text = F.concat(F.lit('{ // first\n "a": "x // '), name, F.lit(' /* y */ \\"", /* c " \n d */ "b": [1, '), (key + 2).cast("string"), F.lit(", ],\n // end\n}"))
    parsed = F.from_json(sc.strip_json_comments(text), "a string, b array<long>")
    return n.select(key.alias("id"), parsed["a"].alias("a"), F.get(parsed["b"], F.lit(1)).alias("b"))


CYCLES = """h AS (SELECT DISTINCT src, dst FROM v_edges), c AS (SELECT [src, src] AS cycle FROM h WHERE src = dst
    UNION ALL SELECT [a.src, a.dst, a.src] FROM h AS a JOIN h AS b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst)"""


def _cycles(spark, sf_dir):
    return graph.simple_cycles(view(spark, sf_dir, "v_edges"), 2).select(F.transform("cycle", lambda x: x.cast("string")).alias("cycle"))


@query(
    f"""WITH {CYCLES}, l AS (SELECT CASE split_part(relative_path, '/', 2) WHEN 'controllers' THEN 'presentation' WHEN 'services' THEN 'application' WHEN 'domain' THEN 'domain' WHEN 'infra' THEN 'infrastructure'
      WHEN 'shared' THEN 'shared' END AS layer, count(*) AS n FROM v_files WHERE relative_path LIKE 'src/%' GROUP BY 1),
    t AS (SELECT array_to_string(cycle, '>') AS cycle FROM c), d AS (SELECT relative_path AS path FROM v_files WHERE extension = '.py' AND relative_path NOT IN (SELECT dst FROM v_edges_doc))
    SELECT 'layers' AS section, row_number() OVER (ORDER BY layer) AS position, layer AS label, n FROM l WHERE layer IS NOT NULL
    UNION ALL SELECT 'cycles', k, cycle, NULL FROM (SELECT cycle, row_number() OVER (ORDER BY cycle) AS k FROM t) WHERE k <= 20
    UNION ALL SELECT 'dead files', k, path, NULL FROM (SELECT path, row_number() OVER (ORDER BY path) AS k FROM d) WHERE k <= 30""",
    "v_files", "v_edges", "v_edges_doc",
)
def n25_health_tree(spark, sf_dir):
    """Layer sizes, the first cycles, the first dead files."""
    files, _, doc = use(spark, sf_dir, "v_files", "v_edges", "v_edges_doc")
    layers = files.groupBy(ff.layer(F.col("relative_path")).alias("layer")).agg(F.count(F.lit(1)).alias("files"))
    dead = files.where("extension = '.py'").join(doc.select(F.col("dst").alias("relative_path")).distinct(), "relative_path", "left_anti")
    return reports.health_tree(layers, _cycles(spark, sf_dir).select(F.array_join("cycle", ">").alias("cycle")), dead.select(F.col("relative_path").alias("path")))


@query(
    f"""WITH {CYCLES}, t AS (SELECT list_transform(cycle, lambda x: CAST(x AS VARCHAR)) AS cycle FROM c)
    SELECT concat('graph TD', chr(10), array_to_string(list_transform(range(1, len(cycle) + 1), lambda i: concat('  ', cycle[i], ' --> ', cycle[i % len(cycle) + 1])), chr(10))) AS chart FROM t""",
    "v_edges",
)
def sk7_mermaid(spark, sf_dir):
    """SK7: every short cycle as a chart; a cycle names its first node at its end too."""
    return _cycles(spark, sf_dir).select(packing.mermaid(F.col("cycle")).alias("chart"))


@query(f"WITH {CYCLES} SELECT array_to_string(cycle, '>') AS cycle, count(*) AS fixes FROM c, range(3) GROUP BY 1", "v_edges")
def n19_cycle_fixes(spark, sf_dir):
    """Every cycle with the ways to break it."""
    fixes = reports.cycle_fixes(_cycles(spark, sf_dir).select(F.array_join("cycle", ">").alias("cycle")))
    return fixes.groupBy("cycle").agg(F.countDistinct("fix").alias("fixes"))


@query(
    """WITH b AS (SELECT concat('set ', item_id % 2) AS dataset, concat('t', lpad(CAST(item_id AS VARCHAR), 6, '0')) AS task, (item_id % 5) / 4.0 AS recall, (item_id % 4) / 4.0 AS precision, item_id % 7000 + 1000 AS tokens, (item_id % 9) * 10.0 AS savings, item_id % 90 AS ms FROM benchmark),
    r AS (SELECT dataset, concat('| ', string_agg(concat(task, ' | ', CAST(floor(recall * 100 + 0.5) AS BIGINT), '% | ', CAST(floor(precision * 100 + 0.5) AS BIGINT), '% | ', format('{:,}', tokens), ' | ', CAST(savings AS BIGINT), '% | ', ms, ' ms |'), concat(chr(10), '| ') ORDER BY task),
      chr(10), '| all tasks | ', CAST(floor(avg(recall) * 100 + 0.5) AS BIGINT), '% | ', CAST(floor(avg(precision) * 100 + 0.5) AS BIGINT), '% | - | ', CAST(floor(avg(savings) + 0.5) AS BIGINT), '% | ', CAST(floor(avg(ms) + 0.5) AS BIGINT), ' ms |', chr(10)) AS t FROM b GROUP BY dataset)
    SELECT string_agg(concat('## ', dataset, chr(10), chr(10), '| Task | Recall | Precision | Tokens | Savings | Latency |', chr(10), '| - | - | - | - | - | - |', chr(10), t), chr(10) ORDER BY dataset) AS document FROM r"""
)
def sk8_leaderboard(spark, sf_dir):
    """SK8, A15: results of a benchmark as a table with averages, savings among them."""
    k = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("set "), (k % 2).cast("string")).alias("dataset"), F.concat(F.lit("t"), F.lpad(k.cast("string"), 6, "0")).alias("task"), ((k % 5) / 4.0).alias("recall"),
        ((k % 4) / 4.0).alias("precision"), (k % 7000 + 1000).alias("tokens"), ((k % 9) * 10.0).alias("savings"), (k % 90).cast("double").alias("ms"),
    )
    return reports.leaderboard(rows)


@query(
    """WITH s AS (SELECT string_split(relative_path, '/') AS p FROM v_files), u AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM s),
    a AS (SELECT p[:k] AS pre, bool_or(k < len(p)) AS folder FROM u GROUP BY 1)
    SELECT row_number() OVER (ORDER BY pre) AS position, concat(repeat('  ', len(pre) - 1), pre[-1], CASE WHEN folder THEN '/' ELSE '' END) AS line FROM a""",
    "v_files",
)
def n27_file_tree(spark, sf_dir):
    return reports.file_tree(view(spark, sf_dir, "v_files").select(F.col("relative_path").alias("path")))


CODE = ["f(a[1], {b: 2})", ")(", "([)]", "x = '(' + \"[\" // (", "{ /* } */ }", "((", "a]"]


@query("SELECT n_nationkey AS path, n_nationkey % 7 IN (0, 3, 4) OR n_nationkey % 2 = 1 AS valid FROM nation")
def p9_syntax(spark, sf_dir):
    """Brackets that close in order; markdown has no rule."""
    k = F.col("n_nationkey")
    code = F.element_at(F.array(*[F.lit(x) for x in CODE]), (k % 7 + 1).cast("int"))
    made = table(spark, sf_dir, "nation").select(k.alias("path"), code.alias("content"), F.when(k % 2 == 1, "markdown").otherwise("typescript").alias("language"))
    return reports.valid_syntax(made)


@query("""SELECT n_nationkey AS id, concat(CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('old ', n_name, chr(10), chr(10)) ELSE concat('head', chr(10), chr(10)) END,
    '<!-- START_ARCHITECTURE_MAP -->', chr(10), 'new', chr(10), '<!-- END_ARCHITECTURE_MAP -->', CASE n_nationkey % 3 WHEN 2 THEN concat(chr(10), chr(10), 'tail') ELSE '' END, chr(10)) AS text FROM nation""")
def n18_marker_block(spark, sf_dir):
    """A block put between its markers, or added."""
    k, markers = F.col("n_nationkey"), f"head\n{reports.START}\nwas\n{reports.END}\n\n\ntail\n"
    old = F.when(k % 3 == 0, " \n").when(k % 3 == 1, F.concat(F.lit("old "), "n_name", F.lit("\n"))).otherwise(markers)
    return table(spark, sf_dir, "nation").select(k.alias("id"), reports.sync_block(old, F.lit("\nnew \n")).alias("text"))


@query("SELECT 'pnpm' AS package_manager, 'express,next,react' AS frameworks, true AS is_monorepo")
def sc10_project(spark, sf_dir):
    """SC10-SC12: package manager, frameworks, workspaces from root files."""
    package = '{"dependencies": {"react": "1", "next": "2", "left-pad": "3"}, "devDependencies": {"express": "4"}}'
    rows = [("package.json", package), ("pnpm-workspace.yaml", "packages:\n  - 'a/*'"), ("a/package.json", '{"dependencies": {"vue": "1"}}')]
    p = scan.project(spark.createDataFrame(rows, "path string, content string"))
    return p.withColumn("frameworks", F.array_join("frameworks", ","))


@query("SELECT * FROM (VALUES ('AGENTS.md', 'agents.md', 'global', CAST(10 AS BIGINT)), ('.cursor/rules/x/a.mdc', 'cursor', 'path', 8), ('.clinerules', 'custom', 'global', 5)) AS t(path, source, scope, priority)")
def sc16_rule_files(spark, sf_dir):
    rows = [(p, "use tabs") for p in ("AGENTS.md", ".cursor/rules/x/a.mdc", ".clinerules", "src/AGENTS.md", "README.md")]
    return scan.rule_files(spark.createDataFrame(rows, "path string, content string")).select("path", "source", "scope", "priority")


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'A' WHEN 2 THEN 'R' ELSE 'D' END AS status, concat('f', c_custkey, '.ts') AS path, c_custkey % 9 + 1 AS first,
      CASE c_custkey % 3 WHEN 0 THEN 1 ELSE c_custkey % 3 END AS added, c_custkey % 5 AS removed FROM customer"""
)
def sc15_diffs(spark, sf_dir):
    """SC15: name-status lines and hunks of unified diffs."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    t = lambda x: x.cast("string")
    name = F.concat(F.lit("f"), t(k), F.lit(".ts"))
    letter = F.element_at(F.array(*[F.lit(x) for x in ("M", "A", "R100\told.ts", "D")]), (k % 4 + 1).cast("int"))
    status = scan.parse_name_status(c.select(F.concat(letter, F.lit("\t"), name, F.lit("\n")).alias("text")))
    new = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(","), t(k % 3)))
    hunk = F.concat(F.lit("@@ -1,"), t(k % 5), F.lit(" +"), t(k % 9 + 1), new, F.lit(" @@ fn\n+x\n"))
    hunks = scan.parse_diff(c.select(F.concat(F.lit("diff --git a/old b/x\n--- a/old\n+++ b/"), name, F.lit("\n"), hunk).alias("text")))
    return status.join(hunks, "path").select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("id"), "status", "path", "first", "added", "removed")


@query("SELECT 'nations' AS what, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customers', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def sk3_cascade(spark, sf_dir):
    """SK2, SK3, SK4: appended in parts, deleted with what names it; a savepoint undoes a block that fails, and one within it."""
    nations, customers = _new_table(spark, ["n_nationkey"]), _new_table(spark, ["c_custkey"])
    nations.append(table(spark, sf_dir, "nation"))
    c = table(spark, sf_dir, "customer")
    customers.append(c.where("c_custkey % 2 = 0"))
    customers.append(c.where("c_custkey % 2 = 1"))
    try:
        with store.Savepoint(nations, customers):
            with store.Savepoint(customers):
                store.delete_cascade(nations, nations.read(), [(customers, "c_nationkey")])
            raise LookupError("undone")
    except LookupError:
        pass
    store.delete_cascade(nations, nations.read().where("n_regionkey = 1"), [(customers, "c_nationkey")])
    parts = [t.read().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, t in (("nations", nations), ("customers", customers))]
    return parts[0].unionByName(parts[1])


@query(
    """SELECT 'full' AS run, 'added' AS change, count(*) AS n FROM v_files WHERE file_id % 4 <> 3 UNION ALL SELECT 'targeted', CASE WHEN file_id % 4 = 3 THEN 'added' WHEN file_id % 2 = 0 THEN 'changed' ELSE 'same' END, count(*) FROM v_files WHERE file_id < 40 GROUP BY 2
    UNION ALL SELECT 'symbols', 'kept', (SELECT count(*) FROM v_files WHERE file_id % 4 <> 3 OR file_id < 40)""",
    "v_files",
)
def p2_targeted_index(spark, sf_dir):
    """A full index, then one of named files alone; the other files are not taken for deleted."""
    f = view(spark, sf_dir, "v_files").select("file_id", F.col("relative_path").alias("path"), F.sha2("content", 256).alias("hash"))
    files, symbols = _new_table(spark, ["path"]), _new_table(spark, ["path"])
    derive = lambda todo: [todo.select("path", F.lit("s").alias("name"))]
    full = store.index(f.where("file_id % 4 <> 3"), files, [symbols], derive)
    full = full.groupBy("change").agg(F.count(F.lit(1)).alias("n")).select(F.lit("full").alias("run"), "change", "n").collect()
    now = f.withColumn("hash", F.when((F.col("file_id") < 40) & (F.col("file_id") % 2 == 0), "new").otherwise(F.col("hash")))
    paths = [r.path for r in f.where("file_id < 40").collect()]
    named = store.index_files(now, paths, files, [symbols], derive)
    named = named.groupBy("change").agg(F.count(F.lit(1)).alias("n")).select(F.lit("targeted").alias("run"), "change", "n")
    kept = symbols.read().agg(F.count(F.lit(1)).alias("n")).select(F.lit("symbols").alias("run"), F.lit("kept").alias("change"), "n")
    return spark.createDataFrame(full, "run string, change string, n long").unionByName(named).unionByName(kept)


@query("SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'hook' WHEN 1 THEN 'page' WHEN 2 THEN 'controller' WHEN 3 THEN 'route_handler' END AS kind FROM v_files", "v_files")
def p7_framework_kinds(spark, sf_dir):
    """Hooks, pages, routes, controllers."""
    k = F.col("file_id") % 5
    path = F.when(k == 1, "src/app/a/page.tsx").when(k == 3, "app/api/route.ts").otherwise("src/x.ts")
    name, line = F.when(k == 0, "useThing").otherwise("used"), F.when(k == 2, "@Controller()").otherwise("class X")
    return view(spark, sf_dir, "v_files").select("file_id", extract.framework_kind(path, name, line).alias("kind"))
