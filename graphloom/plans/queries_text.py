"""Registered queries: search, retrieval, ranking, packing, secrets, taint, code, patterns, events."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as sc
from graphloom.operators import extract, graph, metrics, packing, reports, search, security, services
from graphloom.plans import pattern
from graphloom.plans.base import query
from graphloom.plans.views import table, use, view
from graphloom.sources import scan, store
from graphloom.streaming import watch

TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _bm25(terms: list[str], prefix: bool, limit: int) -> str:
    test = (lambda t: f"starts_with(p, '{t}')") if prefix else (lambda t: f"p = '{t}'")
    rows = " UNION ALL ".join(f"SELECT doc_id, len, '{t}' AS term, len(list_filter(parts, lambda p: {test(t)})) AS tf FROM b" for t in terms)
    return f"""WITH b AS (SELECT doc_id, len({TOKENS}) AS len, {TOKENS} AS parts FROM documents), g AS (SELECT count(*) AS n, avg(len) AS avg_len FROM b),
      h AS (SELECT * FROM ({rows}) WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
      SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
      FROM h JOIN d USING (term) CROSS JOIN g GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {limit}"""


@query(_bm25(["license", "hand", "the"], True, 25))
def r2_bm25_files(spark, sf_dir):
    """Each term a prefix phrase."""
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["license", "hand", "the"], 25)


@query(_bm25(["a", "part"], True, 15).replace("FROM documents", "FROM (SELECT p_partkey AS doc_id, p_name AS text FROM part)").replace("SELECT doc_id, round", "SELECT doc_id AS symbol_id, round"))
def r3_bm25_symbols(spark, sf_dir):
    """The same search over symbol names."""
    symbols = view(spark, sf_dir, "v_symbols")
    return search.bm25(symbols, "symbol_id", "name", ["a", "part"], 15)


@query("""SELECT p_partkey AS symbol_id, t.term, CAST(len(list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x = t.term)) AS BIGINT) AS tf
    FROM part, (SELECT DISTINCT unnest(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+')) AS term FROM part) AS t
    WHERE t.term <> '' AND list_contains(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), t.term)""")
def r4_postings(spark, sf_dir):
    """The inverted index, rebuilt."""
    return search.postings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), "p_name"), "symbol_id", "p_name")


@query(_bm25(["license", "hand", "the", "q"], True, 25))
def r4_stored_search(spark, sf_dir):
    """The index written once, then read by the terms of a search."""
    path = f"{store.shared_home(spark)}/index-{uuid.uuid4().hex}"
    search.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return search.bm25_of_index(spark, path, "doc_id", ["license", "hand", "the", "q"], 25)


@query()
def r1_retrieve(spark, sf_dir):
    """Sources of candidates for a task with the intent to fix a bug."""
    files, edges, symbols = use(spark, sf_dir, "v_files", "v_edges_doc", "v_symbols")
    terms = ["services", "main", "blue"]
    hits = search.bm25(files.select(F.col("relative_path").alias("path"), "content"), "path", "content", ["the", "of"], 30)
    named = symbols.join(files, "file_id").select(F.col("relative_path").alias("path"), "name")
    return search.retrieve(files.select(F.col("relative_path").alias("path")), named, edges, hits, terms, "bug", 50).groupBy("path", "type").agg(F.round(F.sum("score"), 6).alias("score"))


@query()
def r7_rank(spark, sf_dir):
    """R7 and A11 over the candidates of R1."""
    return search.rank(r1_retrieve(spark, sf_dir), ["services", "main", "blue"])


@query(
    """WITH e AS (SELECT item_id AS task, concat('f', item_id, '.ts') AS expected FROM benchmark), f AS (SELECT item_id AS task, concat('src/', CASE WHEN k = 3 THEN 'y' ELSE 'x' END, '/f', item_id + k % 3, '.ts') AS path FROM benchmark, (VALUES (0), (1), (2), (3)) AS v(k) WHERE (item_id + k % 3) % 3 <> 0),
    h AS (SELECT e.task, count(DISTINCT expected) AS e FROM e JOIN f ON e.task = f.task AND ends_with(path, expected) GROUP BY 1),
    a AS (SELECT task, count(DISTINCT expected) AS want FROM e GROUP BY 1), b AS (SELECT task, count(DISTINCT path) AS got FROM f GROUP BY 1)
    SELECT a.task, floor(coalesce(CAST(e AS DOUBLE) / want, 0) * 100 + 0.5) / 100 AS recall, floor(coalesce(CAST(e AS DOUBLE) / got, 0) * 100 + 0.5) / 100 AS precision
    FROM a LEFT JOIN b ON a.task = b.task LEFT JOIN h ON a.task = h.task"""
)
def b1_retrieval_benchmark(spark, sf_dir):
    """A15 and B1."""
    items = table(spark, sf_dir, "benchmark")
    expected = items.select(F.col("item_id").alias("task"), F.concat(F.lit("f"), F.col("item_id").cast("string"), F.lit(".ts")).alias("expected"))
    found = items.select(F.col("item_id").alias("task"), F.posexplode(F.array(*[F.col("item_id") + k % 3 for k in range(4)])).alias("k", "n")).where("n % 3 <> 0")
    folder = F.when(F.col("k") == 3, "src/y/f").otherwise("src/x/f")
    found = found.select("task", F.concat(folder, F.col("n").cast("string"), F.lit(".ts")).alias("path"))
    return search.recall(found, expected)


@query("""SELECT file_id, regexp_replace(regexp_replace(content, '(^|[^A-Za-z0-9_])AKIA[0-9A-Z]{16}', '\\1[REDACTED_AWS_KEY]', 'g'), '(password\\s*[:=]\\s*"?)([^"''\\r\\n\\s]{8,})("?)', '\\1[REDACTED_SECRET]\\3', 'gi') AS clean FROM v_code""", "v_code")
def x10_redact(spark, sf_dir):
    return view(spark, sf_dir, "v_code").select("file_id", security.redact(F.col("content")).alias("clean"))


@query("""WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM v_code)
    SELECT file_id, 'AWS Access Key' AS secret, line_no AS line, CAST(strpos(line, 'AKIA') AS BIGINT) AS "column" FROM l WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])AKIA[0-9A-Z]{16}([^A-Za-z0-9_]|$)')
    UNION ALL SELECT file_id, 'Config Secret Assignment', line_no, CAST(strpos(line, 'password') AS BIGINT) FROM l WHERE regexp_matches(line, 'password\\s*[:=]\\s*"?[^"''\\s]{8,}')""", "v_code")
def x11_scan_secrets(spark, sf_dir):
    return security.scan_secrets(view(spark, sf_dir, "v_code"), "file_id", "content").drop("value")


TAINT = """l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM v_code),
  s AS (SELECT DISTINCT file_id, regexp_extract(line, 'const ([A-Za-z0-9_$]+) = req\\.query', 1) AS variable FROM l WHERE line LIKE 'const % = req.query%'),
  f AS (SELECT l.file_id, line_no, 'SQL_INJECTION' AS type, 'CRITICAL' AS severity, regexp_extract(line, '\\$\\{([^}]+)\\}', 1) AS variable FROM l JOIN s ON s.file_id = l.file_id AND line LIKE '%db.run(`%' AND regexp_extract(line, '\\$\\{([^}]+)\\}', 1) = s.variable
    UNION ALL SELECT file_id, line_no, 'CODE_INJECTION', 'HIGH', regexp_extract(line, 'eval\\((\\w+)', 1) FROM l WHERE line LIKE 'eval(%'
    UNION ALL SELECT file_id, line_no, 'XSS', 'MEDIUM', regexp_extract(line, 'innerHTML = (\\w+)', 1) FROM l WHERE line LIKE '%innerHTML = %')"""


@query(f"WITH {TAINT} SELECT * FROM f", "v_code")
def n9_taint(spark, sf_dir):
    """N8 and N9."""
    return security.taint_scan(security.lines_of(view(spark, sf_dir, "v_code"), "file_id", "content"), "file_id")


@query(f"WITH {TAINT} SELECT count(*) AS findings, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, CAST(0 AS BIGINT) AS low, count(DISTINCT file_id) AS files FROM f", "v_code")
def n10_audit(spark, sf_dir):
    return security.audit(n9_taint(spark, sf_dir), "file_id")


@query("""SELECT path, line_no, name, kind, parent FROM (
    SELECT path, 3 AS line_no, concat('Box', file_id % 11) AS name, 'class' AS kind, NULL AS parent FROM v_code
    UNION ALL SELECT path, 4, 'load', 'method', concat('Box', file_id % 11) FROM v_code
    UNION ALL SELECT path, 2, CASE WHEN file_id % 3 = 0 THEN concat('id', file_id % 5) ELSE 'local' END, 'constant', NULL FROM v_code
    UNION ALL SELECT path, 8 + CASE WHEN file_id % 5 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN file_id % 7 IN (0, 1) THEN 1 ELSE 0 END, concat('run', file_id % 13), 'method', concat('Box', file_id % 11) FROM v_code)""", "v_code")
def p6_symbols(spark, sf_dir):
    """Line-rule extraction; functions after a class are its methods."""
    return extract.symbols(view(spark, sf_dir, "v_code")).select("path", F.col("line_no").cast("int").alias("line_no"), "name", "kind", "parent")


@query("SELECT path, concat('./db', file_id % 9) AS import_path FROM v_code", "v_code")
def p6_imports(spark, sf_dir):
    return extract.imports(view(spark, sf_dir, "v_code")).select("path", "import_path")


@query()
def c1_compress(spark, sf_dir):
    """The ladder within 60 tokens a file, secrets redacted first."""
    code = view(spark, sf_dir, "v_code").withColumn("content", security.redact(F.col("content")))
    return packing.compress(code, 60).select("path", "mode", "tokens", "reduction", "compressed")


def _candidates(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    return c.select(
        F.col("conv_id").alias("task"),
        F.format_string("t%03d", F.col("turn").cast("long")).alias("path"),
        F.round(1.0 / (F.col("turn") + 1), 6).alias("relevance"),
        sc.tokens(text).alias("full"),
        F.ceil(F.length(text) / 16).cast("long").alias("signature"),
        F.lit(5).cast("long").alias("digest"),
    )


@query()
def c2_context_pack(spark, sf_dir):
    """Greedy packing of each conversation's turns."""
    return packing.pack(_candidates(spark, sf_dir), 300, rule_tokens=30, map_tokens=80)


@query()
def sk5_export(spark, sf_dir):
    """SK5: each conversation's pack as one document."""
    c = packing.pack(_candidates(spark, sf_dir), 300).withColumns({"language": F.lit("text"), "content": F.col("path")})
    return packing.export(c, ["Keep it short."], "demo", "rich", ["task"])


@query("SELECT relative_path, sha256(content) AS hash, file_id % 10 = 0 AS moved FROM v_files WHERE file_id % 10 <> 1", "v_files")
def p3_hash_state(spark, sf_dir):
    """The state that incremental indexing compares."""
    f = view(spark, sf_dir, "v_files")
    return f.where("file_id % 10 <> 1").select("relative_path", F.sha2("content", 256).alias("hash"), (F.col("file_id") % 10 == 0).alias("moved"))


@query("""SELECT file_id AS path, CASE WHEN file_id % 10 = 1 THEN 'deleted' WHEN file_id % 10 = 2 THEN 'added' WHEN file_id % 10 = 3 THEN 'changed' ELSE 'same' END AS change FROM v_files""", "v_files")
def p3_changes(spark, sf_dir):
    f = view(spark, sf_dir, "v_files").select(F.col("file_id").alias("path"), F.sha2("content", 256).alias("hash"))
    old = f.where("path % 10 <> 2")
    new = f.where("path % 10 <> 1").withColumn("hash", F.when(F.col("path") % 10 == 3, "other").otherwise(F.col("hash")))
    return store.changes(old, new)


@query("SELECT s.n_nationkey AS id, s.n_name AS name FROM nation AS s WHERE lower(s.n_name) LIKE '%an%' AND s.n_nationkey > 5")
def q2_pattern_nodes(spark, sf_dir):
    """Q1, Q2, Q4, Q5, Q6: a node query with two conditions."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("string").alias("id"), F.lit("Nation").alias("label"), F.create_map(F.lit("name"), "n_name", F.lit("key"), F.col("n_nationkey").cast("string")).alias("properties"))
    edges = n.select(F.col("n_nationkey").cast("string").alias("source"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target"), F.lit("IN").alias("type"))
    out = pattern.run("MATCH (s:nation) WHERE s.name CONTAINS 'an' AND s.key > 5 RETURN s.id, s.name", edges, nodes)
    return out.select(F.col("s_id").cast("int").alias("id"), F.col("s_name").alias("name"))


@query(
    """SELECT CAST(src AS VARCHAR) AS a_id, CAST(dst AS VARCHAR) AS b_id FROM v_edges WHERE kind = 'import' AND src < 50 AND dst >= 100""",
    "v_edges",
)
def q3_pattern_edges(spark, sf_dir):
    """Typed edge with numeric conditions on both ends; parallel edges give rows of their own."""
    e = view(spark, sf_dir, "v_edges")
    edges = e.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.upper("kind").alias("type"))
    return pattern.run("MATCH (a:File)-[e:IMPORT]->(b:File) WHERE a.id < 50 AND b.id >= 100 RETURN a.id, b.id", edges)


@query(
    """SELECT CAST(src AS VARCHAR) AS a_id, CAST(dst AS VARCHAR) AS b_id FROM v_edges WHERE src = 7 UNION ALL SELECT CAST(dst AS VARCHAR), CAST(src AS VARCHAR) FROM v_edges WHERE dst = 7""",
    "v_edges",
)
def q5_pattern_undirected(spark, sf_dir):
    e = view(spark, sf_dir, "v_edges")
    edges = e.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.upper("kind").alias("type"))
    return pattern.run("MATCH (a {name: '7'})--(b) RETURN a.id, b.id", edges)


@query("""SELECT 'MATCH (s:Symbol) WHERE s.name CONTAINS ''login'' RETURN s' AS query""")
def q8_translate(spark, sf_dir):
    """Q8 and Q9."""
    return spark.createDataFrame([(pattern.to_query("find function login"),)], "query string")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def t5_tumbling(spark, sf_dir):
    out = watch.tumbling(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start FROM events) GROUP BY 1""")
def t5_sliding(spark, sf_dir):
    return watch.sliding(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def t5_sessions(spark, sf_dir):
    return watch.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def t5_stream_sessions(spark, sf_dir):
    """The same sessions from a stream over the event files, append mode: those that the watermark has closed.

    Watermarks begin in 1970 and have whole milliseconds.  So the stream runs on
    later dates and closes a millisecond more, which the last filter takes back.
    """
    events, later = table(spark, sf_dir, "events"), F.expr("interval '719162' day")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern, a file or a folder of parts
    name = "sessions_" + uuid.uuid4().hex[:8]
    moved = watch.sessions(stream.withColumn("ts", F.col("ts") + later), late="10 minutes -1 milliseconds")
    out = watch.drain(moved, name, f"{store.shared_home(spark)}/{name}")
    start, end = (F.col(c).cast("timestamp_ntz") - later for c in ("start", "end"))
    last = events.agg(F.max("ts").alias("last"))
    return out.crossJoin(F.broadcast(last)).where(end <= F.col("last") - F.expr("interval 10 minutes")).select("user_id", start.alias("start"), "n")


@query("""WITH c AS (SELECT s_nationkey AS id, count(*) AS apis FROM supplier GROUP BY 1) SELECT n_nationkey AS id, lower(n_name) AS name, coalesce(apis, 0) AS apis, least(30.0, 8 + 2 * coalesce(apis, 0))::DOUBLE AS size FROM nation LEFT JOIN c ON c.id = n_nationkey""")
def n13_service_graph(spark, sf_dir):
    """Services as sized nodes."""
    apis = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("apis"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    out = n.join(apis, "id", "left").withColumn("apis", F.coalesce("apis", F.lit(0)))
    return out.withColumn("size", services.node_size(F.col("apis")))


@query(
    """SELECT * FROM (VALUES ('d', NULL, 'empty', NULL), ('c', 'a', 'duplicate', NULL), ('a', 'b', 'conflict: indentation', 'a'), ('b', 'c', 'conflict: indentation', 'b'),
    ('b', 'e', 'conflict: quote style', 'b')) AS t(rule_id, other, issue, prefer)"""
)
def n16_rule_issues(spark, sf_dir):
    """J17, J18, N16 over a few made rules."""
    rows = [("a", "Use tabs"), ("b", "Use spaces and single quotes"), ("c", " Use tabs "), ("d", ""), ("e", "double quotes")]
    return scan.rule_issues(spark.createDataFrame(rows, "rule_id string, content string"))


@query(
    """WITH RECURSIVE h AS (SELECT DISTINCT src, dst FROM v_edges), w AS (SELECT CAST(7 AS BIGINT) AS node, 0 AS d UNION SELECT h.src, w.d + 1 FROM w JOIN h ON h.dst = w.node WHERE w.d < 2)
    SELECT node, CASE min(d) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS score FROM w GROUP BY node""",
    "v_edges",
)
def n22_diff_impact(spark, sf_dir):
    """Changed files 1.0, direct dependents 0.8, transitive ones 0.5."""
    seeds = graph.seeds_of(spark, [7])
    hit = graph.blast_radius(seeds, view(spark, sf_dir, "v_edges"), 2)
    near = hit.select("node", F.when(F.col("depth") == 1, 0.8).otherwise(0.5).alias("score"))
    return seeds.select(F.col("seed").alias("node"), F.lit(1.0).alias("score")).unionByName(near)


@query(
    """WITH f AS (SELECT count(*) AS files, count(*) FILTER (extension IN ('.ts', '.js')) AS code, count(*) FILTER (extension IN ('.ts', '.js') AND file_id IN (SELECT file_id FROM v_symbols)) AS covered FROM v_files),
    c AS (SELECT floor(covered * 100.0 / code + 0.5) AS coverage FROM f)
    SELECT * FROM (SELECT 'Index' AS "check", 'pass' AS status, 95.0::DOUBLE AS score UNION ALL SELECT 'Files', 'pass', 100 UNION ALL SELECT 'Dependencies', 'pass', 90 UNION ALL SELECT 'Rules', 'warn', 70
      UNION ALL SELECT 'Integrity', 'pass', 100 UNION ALL SELECT 'Coverage', CASE WHEN coverage > 80 THEN 'pass' ELSE 'warn' END, coverage FROM c)
    UNION ALL SELECT 'Overall', '', floor((455 + coverage) / 6 + 0.5) FROM c""",
    "v_files", "v_symbols",
)
def n15_health(spark, sf_dir):
    """The six checks and their rounded mean."""
    from graphloom.functions import files as ff

    files, symbols, edges = use(spark, sf_dir, "v_files", "v_symbols", "v_edges_doc")
    named = files.select("file_id", F.col("relative_path").alias("path"), ff.language(F.col("relative_path")).alias("language"))
    rules = spark.createDataFrame([("a", "Use tabs"), ("b", "Use spaces")], "rule_id string, content string")
    conflicts = scan.rule_issues(rules).where("issue like 'conflict%'")
    state = files.groupBy().agg(F.count(F.lit(1)).alias("file_count"))
    checks = metrics.health_checks(state, named, edges, rules, conflicts, symbols.join(named, "file_id").select("path"))
    return checks.unionByName(metrics.health(checks).select(F.lit("Overall").alias("check"), F.lit("").alias("status"), F.col("score").cast("double").alias("score")))


@query(
    """WITH w AS (SELECT file_id, string_split_regex(content, '[ \\t\\n\\x0B\\f\\r]+') AS w FROM v_files),
    h AS (SELECT file_id, w, greatest(coalesce(list_position(list_transform(w, lambda x: contains(lower(x), 'the')), true), 1) - 17, 0) AS a FROM w)
    SELECT file_id, regexp_replace(array_to_string(w[a + 1:a + 32], ' '), '(the)', '[\\1]', 'gi') AS snippet FROM h""",
    "v_files",
)
def x26_snippet(spark, sf_dir):
    """The snippet of every file."""
    return view(spark, sf_dir, "v_files").select("file_id", search.snippet(F.col("content"), "the").alias("snippet"))


@query()
def x17_hash_embedding(spark, sf_dir):
    """Items as hashed vectors, their similarity to the first one."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sc.hash_embedding(t or ""))

    items = table(spark, sf_dir, "benchmark").select("item_id", embed("text").alias("v"))
    first = sc.hash_embedding(table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"])
    return search.semantic(items, first, 10, "item_id", "v").withColumn("score", F.round("score", 9))


@query(
    """SELECT 'summary' AS report, 'nodes' AS metric, (SELECT count(*) FROM (SELECT src FROM v_edges UNION SELECT dst FROM v_edges))::DOUBLE AS value UNION ALL SELECT 'summary', 'edges', (SELECT count(*) FROM v_edges)
    UNION ALL SELECT 'contexts', 'violations', (SELECT count(*) FROM v_edges_doc WHERE regexp_extract(src, 'packages/([^/]+)', 1) <> '' AND regexp_extract(dst, 'packages/([^/]+)', 1) <> ''
      AND regexp_extract(src, 'packages/([^/]+)', 1) <> regexp_extract(dst, 'packages/([^/]+)', 1))
    UNION ALL SELECT 'cycles', 'short', (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM v_edges) AS a WHERE src = dst)
      + (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM v_edges) AS a JOIN (SELECT DISTINCT src, dst FROM v_edges) AS b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst)""",
    "v_files", "v_edges", "v_edges_doc",
)
def n14_report(spark, sf_dir):
    """The sub-reports as rows; one that fails breaks the report."""
    _, edges, doc = use(spark, sf_dir, "v_files", "v_edges", "v_edges_doc")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return reports.report({
        "summary": metrics.graph_summary(edges).select("nodes", "edges"),
        "contexts": count(metrics.context_violations(doc), "violations"),
        "cycles": count(graph.simple_cycles(edges, 2), "short"),
    })
