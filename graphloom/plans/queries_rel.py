"""Registered queries: lookups, filters, joins, aggregates, windows, sets, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import files as ff
from graphloom.functions import scalars as sc
from graphloom.operators import metrics
from graphloom.plans.base import query
from graphloom.plans.views import table, use, view

LANG_SQL = """CASE extension WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.md' THEN 'markdown' ELSE 'javascript' END"""
P = "relative_path"
TEST_SQL = f"({P} LIKE 'tests/%' OR {P} LIKE '%.test.%')"
GEN_SQL = f"({P} LIKE 'dist/%')"


@query(f"SELECT file_id, {LANG_SQL} AS language, {LANG_SQL} <> 'markdown' AS parseable FROM v_files", "v_files")
def sc5_language(spark, sf_dir):
    """SC5 and SC8: language by path, and whether an extractor exists."""
    lang = ff.language(F.col(P))
    return view(spark, sf_dir, "v_files").select("file_id", lang.alias("language"), ff.is_parseable(lang).alias("parseable"))


@query(f"SELECT file_id, {TEST_SQL} AS is_test, {GEN_SQL} AS is_generated, module FROM v_files", "v_files")
def sc6_file_predicates(spark, sf_dir):
    """SC6, SC7 and SC9: test, generated, module."""
    p = F.col(P)
    return view(spark, sf_dir, "v_files").select("file_id", ff.is_test(p).alias("is_test"), ff.is_generated(p).alias("is_generated"), ff.dirname(p).alias("module"))


@query(f"SELECT {LANG_SQL} AS language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM v_files GROUP BY 1", "v_files")
def sc13_language_histogram(spark, sf_dir):
    return view(spark, sf_dir, "v_files").groupBy(ff.language(F.col(P)).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("SELECT file_id, relative_path, CAST(size AS INTEGER) AS size FROM v_files WHERE relative_path = 'src/services/f10.ts' OR file_id = 3", "v_files")
def f1_point_lookup(spark, sf_dir):
    return view(spark, sf_dir, "v_files").where((F.col(P) == "src/services/f10.ts") | (F.col("file_id") == 3)).select("file_id", P, "size")


@query("SELECT file_id FROM v_files WHERE extension = '.py' AND relative_path LIKE '%/lib/%'", "v_files")
def f2_equality_filter(spark, sf_dir):
    """F2 and F8: equality by language and a path test."""
    return view(spark, sf_dir, "v_files").where((ff.language(F.col(P)) == "python") & F.col(P).contains("/lib/")).select("file_id")


@query("SELECT symbol_id, name FROM v_symbols WHERE name ILIKE '%AL%'", "v_symbols")
def f3_symbol_substring(spark, sf_dir):
    return view(spark, sf_dir, "v_symbols").where(F.col("name").ilike("%AL%")).select("symbol_id", "name")


@query("SELECT count(*) AS n FROM v_symbols WHERE file_id IN (SELECT file_id FROM v_files WHERE extension = '.ts')", "v_files", "v_symbols")
def f4_in_subquery_count(spark, sf_dir):
    files, symbols = use(spark, sf_dir, "v_files", "v_symbols")
    return symbols.join(files.where("extension = '.ts'"), "file_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT symbol_id, complexity FROM (SELECT symbol_id, nullif(complexity, 1) AS complexity FROM v_symbols) WHERE complexity IS NOT NULL", "v_symbols")
def f5_not_null(spark, sf_dir):
    s = view(spark, sf_dir, "v_symbols")
    return s.select("symbol_id", F.nullif("complexity", F.lit(1)).alias("complexity")).where("complexity is not null")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'click' AS is_click, 1.0::DOUBLE AS weight FROM events""")
def f6_row_mapping(spark, sf_dir):
    """JSON parsed, flags as booleans, defaults filled in."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long, weight double"))
    return e.select("event_id", F.col("p.k").alias("k"), (F.col("event_type") == "click").alias("is_click"), F.coalesce("p.weight", F.lit(1.0)).alias("weight"))


@query("SELECT file_id FROM v_files WHERE len(string_split(relative_path, '/')) <= 3 AND module LIKE 'src%'", "v_files")
def f7_depth_filter(spark, sf_dir):
    return view(spark, sf_dir, "v_files").where(ff.depth_at_most(F.col(P), 2) & F.col("module").startswith("src")).select("file_id")


@query(
    """WITH c AS (SELECT relative_path FROM v_files WHERE extension IN ('.ts', '.js')) SELECT src, dst FROM v_edges_doc
    WHERE src IN (SELECT relative_path FROM c) AND dst IN (SELECT relative_path FROM c)""",
    "v_files", "v_edges_doc",
)
def f9_induced_subgraph(spark, sf_dir):
    files, edges = use(spark, sf_dir, "v_files", "v_edges_doc")
    keep = files.where(F.col("extension").isin(".ts", ".js"))
    for end in ("src", "dst"):
        edges = edges.join(keep.select(F.col(P).alias(end)), end, "left_semi")
    return edges.select("src", "dst")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY relative_path) AS k FROM v_files)
    SELECT a.relative_path AS src, b.relative_path AS dst FROM r AS a JOIN r AS b ON a.module = b.module AND a.k = 1 AND b.k > 1""",
    "v_files",
)
def f10_sibling_links(spark, sf_dir):
    """The first file of a directory linked to each other one: a star, not a clique."""
    f = view(spark, sf_dir, "v_files")
    first = f.groupBy("module").agg(F.min(P).alias("src"))
    return f.join(first, "module").where(F.col(P) != F.col("src")).select("src", F.col(P).alias("dst"))


@query("SELECT DISTINCT CASE WHEN src = 10 THEN dst ELSE src END AS node FROM v_edges WHERE src = 10 OR dst = 10 UNION SELECT CAST(10 AS BIGINT)", "v_edges")
def f11_highlight(spark, sf_dir):
    e = view(spark, sf_dir, "v_edges").where("src = 10 or dst = 10")
    return e.select(F.explode(F.array("src", "dst", F.lit(10).cast("long"))).alias("node")).distinct()


@query("SELECT file_id FROM v_files WHERE contains(lower(relative_path), 'main')", "v_files")
def f12_client_search(spark, sf_dir):
    return view(spark, sf_dir, "v_files").where(F.lower(P).contains("main")).select("file_id")


@query(
    """WITH r(id, scope, prefix, priority) AS (VALUES (1, 'global', NULL, 5), (2, 'path', 'src/', 7), (3, 'path', 'packages/auth', 9), (4, 'path', NULL, 8))
    SELECT file_id, CAST(id AS BIGINT) AS rule_id, CAST(priority + CASE scope WHEN 'path' THEN 2 ELSE 0 END AS BIGINT) AS priority FROM v_files
    JOIN r ON scope = 'global' OR (prefix IS NOT NULL AND starts_with(relative_path, prefix))""",
    "v_files",
)
def f14_applicable_rules(spark, sf_dir):
    """Rules by path prefix; a path rule without a prefix applies nowhere, and path rules rank two higher."""
    rules = spark.createDataFrame([(1, "global", None, 5), (2, "path", "src/", 7), (3, "path", "packages/auth", 9), (4, "path", None, 8)], "rule_id long, scope string, prefix string, priority long")
    files = view(spark, sf_dir, "v_files")
    fits = (F.col("scope") == "global") | F.coalesce(F.col(P).startswith(F.col("prefix")), F.lit(False))
    hit = files.join(F.broadcast(rules), fits)  # a handful of rules
    return hit.select("file_id", "rule_id", (F.col("priority") + F.when(F.col("scope") == "path", 2).otherwise(0)).alias("priority"))


@query("SELECT relative_path, sha256(content) AS hash FROM v_files", "v_files")
def f17_hashes(spark, sf_dir):
    """F17 and X1."""
    return view(spark, sf_dir, "v_files").select(P, sc.sha256_hex(F.col("content")).alias("hash"))


@query("""WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS k FROM v_files)
    SELECT f.file_id, CAST(coalesce(min(k), 0) AS BIGINT) AS line_no FROM v_files AS f LEFT JOIN l ON l.file_id = f.file_id AND contains(line, 'the') AND contains(line, 'of') GROUP BY 1""", "v_files")
def f18_line_locator(spark, sf_dir):
    """First line that holds two words, line 0 where there is none."""
    f = view(spark, sf_dir, "v_files").select("file_id", F.split("content", "\n").alias("lines"))
    hits = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.contains(F.get("lines", i), F.lit("the")) & F.contains(F.get("lines", i), F.lit("of")))
    return f.select("file_id", F.coalesce(F.get(hits, F.lit(0)), F.lit(0)).cast("long").alias("line_no"))


@query("SELECT s.symbol_id, f.relative_path, s.name FROM v_symbols AS s JOIN v_files AS f USING (file_id)", "v_files", "v_symbols")
def j1_symbols_files(spark, sf_dir):
    files, symbols = use(spark, sf_dir, "v_files", "v_symbols")
    return symbols.join(files, "file_id").select("symbol_id", P, "name")


@query("SELECT e.src, f.file_id, e.kind FROM v_edges_doc AS e JOIN v_files AS f ON e.src = f.relative_path", "v_files", "v_edges_doc")
def j2_imports_files(spark, sf_dir):
    files, edges = use(spark, sf_dir, "v_files", "v_edges_doc")
    return edges.join(files, edges.src == files[P]).select("src", "file_id", "kind")


@query("SELECT symbol_id, (SELECT relative_path FROM v_files AS f WHERE f.file_id = s.file_id) AS path FROM v_symbols AS s", "v_files", "v_symbols")
def j4_scalar_lookup(spark, sf_dir):
    files, symbols = use(spark, sf_dir, "v_files", "v_symbols")
    return symbols.join(files.select("file_id", F.col(P).alias("path")), "file_id", "left").select("symbol_id", "path")


@query(
    """WITH c AS (SELECT file_id, module, unnest(['.ts', '.py', '.js']) AS ext, unnest([0, 1, 2]) AS ord FROM v_files),
    p AS (SELECT file_id, concat(module, '/f', file_id + 1, ext) AS candidate, ord FROM c UNION ALL SELECT file_id, concat('src/services/f', file_id + 1, '.py'), 3 FROM v_files)
    SELECT p.file_id, min_by(candidate, ord) AS resolved FROM p JOIN v_files AS f ON f.relative_path = candidate GROUP BY p.file_id""",
    "v_files",
)
def j6_import_resolution(spark, sf_dir):
    """Candidate paths in order of preference; the first that exists wins."""
    f = view(spark, sf_dir, "v_files")
    name = F.concat(F.lit("/f"), (F.col("file_id") + 1).cast("string"))
    made = F.array(*[F.concat("module", name, F.lit(x)) for x in (".ts", ".py", ".js")], F.concat(F.lit("src/services"), name, F.lit(".py")))
    probes = f.select("file_id", F.posexplode(made).alias("ord", "candidate"))
    return probes.join(f.select(F.col(P).alias("candidate")), "candidate", "left_semi").groupBy("file_id").agg(F.min_by("candidate", "ord").alias("resolved"))


@query(
    """WITH a AS (SELECT src, dst, kind, max(weight) AS weight FROM v_edges GROUP BY ALL), b AS (SELECT src, dst, kind, 1.0::DOUBLE AS confidence FROM v_edges WHERE kind = 'implements' AND src % 3 = 0 GROUP BY ALL)
    SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.kind, b.kind) AS kind, coalesce(weight, 1.5) AS weight, coalesce(confidence, 0.9) AS confidence
    FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst AND a.kind = b.kind""",
    "v_edges",
)
def j7_merge_edges(spark, sf_dir):
    """Resolved edges laid over syntactic ones by source, target and kind."""
    e, key = view(spark, sf_dir, "v_edges"), ["src", "dst", "kind"]
    plain = e.groupBy(*key).agg(F.max("weight").alias("weight"))
    resolved = e.where("kind = 'implements' and src % 3 = 0").select(*key, F.lit(1.0).alias("confidence")).distinct()
    return plain.join(resolved, key, "full_outer").select(*key, F.coalesce("weight", F.lit(1.5)).alias("weight"), F.coalesce("confidence", F.lit(0.9)).alias("confidence"))


@query("SELECT src, dst, kind, array_to_string(list_sort(list_distinct(list(symbol))), ',') AS symbols, max(weight) AS weight FROM v_edges GROUP BY src, dst, kind", "v_edges")
def j8_dedupe_edges(spark, sf_dir):
    e = view(spark, sf_dir, "v_edges")
    return e.groupBy("src", "dst", "kind").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"), F.max("weight").alias("weight"))


LAYER_CASE = """CASE WHEN {0} LIKE 'src/controllers/%' THEN 'presentation' WHEN {0} LIKE 'src/services/%' THEN 'application' WHEN {0} LIKE 'src/domain/%' THEN 'domain'
  WHEN {0} LIKE 'src/infra/%' THEN 'infrastructure' WHEN {0} LIKE 'src/shared/%' THEN 'shared' END"""
VIOLATIONS = f"""e AS (SELECT src, dst, {LAYER_CASE.format('src')} AS source_layer, {LAYER_CASE.format('dst')} AS target_layer FROM v_edges_doc),
  v AS (SELECT *, CASE WHEN source_layer = 'presentation' AND target_layer = 'infrastructure' THEN 'HIGH' WHEN source_layer = 'domain' AND target_layer IN ('infrastructure', 'application', 'presentation') THEN 'CRITICAL'
    WHEN source_layer = 'application' AND target_layer = 'presentation' THEN 'HIGH' END AS severity FROM e)"""


@query(f"WITH {VIOLATIONS} SELECT src, dst, source_layer, target_layer, severity FROM v WHERE severity IS NOT NULL", "v_files", "v_edges_doc")
def n5_layer_violations(spark, sf_dir):
    """Both ends looked up, the first fitting layer wins, built-in rules."""
    return metrics.layer_violations(view(spark, sf_dir, "v_edges_doc")).select("src", "dst", "source_layer", "target_layer", "severity")


@query(
    f"""WITH {VIOLATIONS}, h AS (SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
      count(*) FILTER (severity = 'LOW') AS low FROM v), p AS (SELECT *, least(100.0, floor((20 * critical + 10 * high + 5 * medium + 2 * low) / CAST((SELECT count(*) FROM v_files) AS DOUBLE) * 50 + 0.5)) AS penalty FROM h)
    SELECT critical, high, medium, low, CAST(CASE WHEN critical + high + medium + low = 0 THEN 100 ELSE greatest(0, 100 - greatest(10, penalty)) END AS DOUBLE) AS score FROM p""",
    "v_files", "v_edges_doc",
)
def n7_architecture_report(spark, sf_dir):
    """Severity histogram and clean score."""
    files, edges = use(spark, sf_dir, "v_files", "v_edges_doc")
    return metrics.clean_score(metrics.layer_violations(edges), files.count())


@query(
    """WITH e AS (SELECT src, dst, regexp_extract(src, 'packages/([^/]+)', 1) AS a, regexp_extract(dst, 'packages/([^/]+)', 1) AS b FROM v_edges_doc)
    SELECT src, dst, a AS source_context, b AS target_context FROM e WHERE a <> '' AND b <> '' AND a <> b""",
    "v_files", "v_edges_doc",
)
def n6_context_violations(spark, sf_dir):
    """N4, N6, X14, X15."""
    return metrics.context_violations(view(spark, sf_dir, "v_edges_doc")).drop("severity")


@query(f"SELECT {LAYER_CASE.format(P)} AS layer, count(*) AS files, min({P}) AS first FROM v_files GROUP BY 1", "v_files")
def n3_layer_sizes(spark, sf_dir):
    """Files a layer."""
    return view(spark, sf_dir, "v_files").groupBy(ff.layer(F.col(P)).alias("layer")).agg(F.count(F.lit(1)).alias("files"), F.min(P).alias("first"))


ENTRY_SQL = f"regexp_matches({P}, '((index|main|app|server|cli|bin|extension|rc)\\.[a-z0-9]+|\\.config\\.[a-z0-9]+|\\.d\\.ts|/commands/[a-z0-9_-]+\\.[a-z0-9]+)$', 'i')"


@query(f"SELECT {P} FROM v_files WHERE NOT {TEST_SQL} AND NOT {GEN_SQL} AND NOT {ENTRY_SQL} AND extension <> '.md' AND {P} NOT IN (SELECT dst FROM v_edges_doc)", "v_files", "v_edges_doc")
def n1_dead_files(spark, sf_dir):
    """J13 and N1."""
    files, edges = use(spark, sf_dir, "v_files", "v_edges_doc")
    return metrics.dead_files(files, edges).select(P)


@query("SELECT symbol_id FROM v_symbols WHERE exported AND concat('sym', symbol_id % 60) NOT IN (SELECT symbol FROM v_edges_doc)", "v_files", "v_edges_doc", "v_symbols")
def n2_dead_symbols(spark, sf_dir):
    """By name alone."""
    _, edges, symbols = use(spark, sf_dir, "v_files", "v_edges_doc", "v_symbols")
    named = symbols.withColumn("name", F.concat(F.lit("sym"), (F.col("symbol_id") % 60).cast("string")))
    return metrics.dead_symbols(named, edges.select(F.col("symbol").alias("name"))).select("symbol_id")


@query("SELECT relative_path FROM v_files WHERE file_id % 3 = 0 AND relative_path NOT IN (SELECT relative_path FROM v_files WHERE file_id % 2 = 0)", "v_files")
def j15_deleted_files(spark, sf_dir):
    f = view(spark, sf_dir, "v_files")
    return f.where("file_id % 3 = 0").select(P).join(f.where("file_id % 2 = 0").select(P), P, "left_anti")


@query("SELECT dst, symbol, count(*) AS refs FROM v_edges_doc GROUP BY dst, symbol", "v_files", "v_edges_doc")
def j16_reference_counts(spark, sf_dir):
    return view(spark, sf_dir, "v_edges_doc").groupBy("dst", "symbol").agg(F.count(F.lit(1)).alias("refs"))


NORM = "lower(regexp_replace(regexp_replace(split_part(regexp_replace(path, '^https?://[^/]+', ''), '?', 1), '/+', '/', 'g'), '/$', ''))"


@query(
    f"""WITH o AS (SELECT DISTINCT service_id AS dst, {NORM} AS offer, string_split({NORM}, '/') AS a FROM v_exports), w AS (SELECT DISTINCT service_id AS src, {NORM} AS endpoint, string_split({NORM}, '/') AS b FROM v_consumes)
    SELECT DISTINCT src, dst, endpoint FROM w JOIN o ON src <> dst AND offer <> '' AND endpoint <> '' AND len(a) = len(b)
      AND len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i] AND NOT starts_with(a[i], ':') AND NOT starts_with(a[i], '{{') AND NOT starts_with(b[i], ':') AND NOT starts_with(b[i], '{{'))) = 0""",
    "v_exports", "v_consumes",
)
def n12_service_edges(spark, sf_dir):
    """Endpoint template match."""
    exports, consumes = use(spark, sf_dir, "v_exports", "v_consumes")
    return metrics.service_edges(None, exports, consumes)


@query("SELECT text, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def j18_duplicate_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("SELECT 'files' AS what, count(*) AS n FROM v_files UNION ALL SELECT 'symbols', count(*) FROM v_symbols UNION ALL SELECT 'edges', count(*) FROM v_edges", "v_files", "v_symbols", "v_edges")
def a1_counts(spark, sf_dir):
    named = zip(("files", "symbols", "edges"), use(spark, sf_dir, "v_files", "v_symbols", "v_edges"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT file, count(*) AS churn FROM v_commits GROUP BY file", "v_commits")
def a4_churn(spark, sf_dir):
    return view(spark, sf_dir, "v_commits").groupBy("file").agg(F.count(F.lit(1)).alias("churn"))


@query(
    """WITH a AS (SELECT file, author, count(*) AS commits, max(committed) AS newest FROM v_commits GROUP BY file, author),
    r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY commits DESC, newest DESC, author) AS k FROM a)
    SELECT file, CAST(sum(commits) AS BIGINT) AS churn, max(author) FILTER (k = 1) AS owner, count(*) AS authors FROM r GROUP BY file""",
    "v_commits",
)
def a5_git_metrics(spark, sf_dir):
    g = metrics.git_metrics(view(spark, sf_dir, "v_commits"))
    return g.select("file", "churn", "owner", F.size("authors").cast("long").alias("authors"))


@query("SELECT round(avg(complexity), 1) AS average FROM (SELECT complexity FROM v_symbols ORDER BY complexity DESC, symbol_id LIMIT 25)", "v_symbols")
def a8_top_complexity_average(spark, sf_dir):
    """The average of the top alone."""
    return metrics.top_complexity(view(spark, sf_dir, "v_symbols"), 25).agg(F.round(F.avg("complexity"), 1).alias("average"))


@query("SELECT symbol_id, complexity, CASE WHEN complexity > 15 THEN 'HIGH' WHEN complexity > 8 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM v_symbols ORDER BY complexity DESC, symbol_id LIMIT 20", "v_symbols")
def x23_complexity_report(spark, sf_dir):
    return metrics.top_complexity(view(spark, sf_dir, "v_symbols"), 20).select("symbol_id", "complexity", sc.complexity_risk(F.col("complexity")).alias("risk"))


@query("SELECT module, count(*) AS files, array_to_string(list_slice(list(file_id ORDER BY file_id), 1, 8), ',') AS first_files FROM v_files GROUP BY module", "v_files")
def n23_repository_map(spark, sf_dir):
    """Files a module with the first eight."""
    g = view(spark, sf_dir, "v_files").groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list("file_id")).alias("ids"))
    return g.select("module", "files", F.array_join(F.transform(F.slice("ids", 1, 8), lambda x: x.cast("string")), ",").alias("first_files"))


@query(
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents ORDER BY r LIMIT 60),
    b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents ORDER BY r LIMIT 60)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(1.0::DOUBLE / (60 + coalesce(a.r, 90)) + 1.0::DOUBLE / (60 + coalesce(b.r, 90)), 9) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
)
def w2_reciprocal_rank_fusion(spark, sf_dir):
    """W1, W2, R5, U1 over two rankings, limit 30, fetched at twice the limit."""
    from graphloom.operators import search

    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a = search.ranked(d, 60, F.desc("n_chars"), "doc_id").select("doc_id", "rank")
    b = search.ranked(d, 60, F.desc("doc_id")).select("doc_id", "rank")
    return search.fuse(a, b, "doc_id", 30)


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 45")
def u2_union_affected(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return a.union(table(spark, sf_dir, "part").where("p_size > 45").select("p_partkey")).distinct()


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def u3_difference(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return a.join(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k")), "k", "left_anti").distinct()


@query(
    """SELECT * FROM (SELECT 'repo_a' AS repo, symbol_id FROM v_symbols WHERE symbol_id % 2 = 0 ORDER BY symbol_id LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'repo_b', symbol_id FROM v_symbols WHERE symbol_id % 2 = 1 ORDER BY symbol_id LIMIT 30) ORDER BY repo, symbol_id LIMIT 50""",
    "v_symbols",
)
def u5_federated_search(spark, sf_dir):
    """SC17 and U5: a limit a repository, then one over all."""
    s = view(spark, sf_dir, "v_symbols")
    part = lambda alias, k: s.where(f"symbol_id % 2 = {k}").orderBy("symbol_id").limit(30).select(F.lit(alias).alias("repo"), "symbol_id")
    return part("repo_a", 0).unionByName(part("repo_b", 1)).orderBy("repo", "symbol_id").limit(50)


@query("""SELECT doc_id, CASE WHEN length(text) > 60 THEN concat(substr(text, 1, 57), '...') ELSE text END AS short, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
    CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, substr(text, 1, 40) AS fit FROM documents""")
def x2_text_functions(spark, sf_dir):
    """X2, X8, X9."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", sc.truncate(t, 60).alias("short"), sc.tokens(t).alias("tokens"), sc.count_lines(t).alias("n_lines"), sc.fit_budget(t, 10).alias("fit"))


@query("""SELECT p_partkey, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(n / 1073741824.0 * 10 + 0.5) / 10) END AS bytes,
    CASE WHEN p_size = 1 THEN 'file' ELSE 'files' END AS word FROM (SELECT *, p_partkey * p_partkey * p_partkey AS n FROM part)""")
def x3_formats(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", sc.format_bytes(F.col("p_partkey") * F.col("p_partkey") * F.col("p_partkey")).alias("bytes"), sc.pluralize(F.col("p_size"), "file").alias("word"))


@query(f"""SELECT file_id, extension, split_part({P}, '/', -1) AS base, module AS dir, starts_with(split_part({P}, '/', -1), '.') AS hidden FROM v_files""", "v_files")
def x4_path_helpers(spark, sf_dir):
    p = F.col(P)
    return view(spark, sf_dir, "v_files").select("file_id", ff.extension(p).alias("extension"), ff.basename(p).alias("base"), ff.dirname(p).alias("dir"), ff.is_hidden(p).alias("hidden"))


@query(f"""WITH t AS (SELECT ['main', 'services', 'f1'] AS terms) SELECT file_id, list_sum(list_transform(terms, lambda x: CASE WHEN contains(lower(split_part({P}, '/', -1)), x) THEN 1.5
    WHEN contains(lower({P}), x) THEN 1.0 ELSE 0.0 END))::DOUBLE / 3 AS score FROM v_files, t""", "v_files")
def x7_path_scores(spark, sf_dir):
    """Terms of a query, then its score on every path."""
    f = view(spark, sf_dir, "v_files").withColumn("terms", sc.retrieval_terms(F.lit("find the main services, F1")))
    return f.select("file_id", sc.path_score(F.col(P), F.col("terms")).alias("score"))


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS score FROM embeddings, q
    WHERE list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) > 0.1 ORDER BY score DESC, vec_id LIMIT 20""")
def r6_semantic_search(spark, sf_dir):
    """R6 and X16."""
    from graphloom.operators import search

    e = table(spark, sf_dir, "embeddings")
    query_vector = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    return search.semantic(e, query_vector, 20, "vec_id", "embedding").select("vec_id", F.round("score", 9).alias("score"))


@query("""SELECT doc_id, CAST(1 + len(regexp_extract_all(code, '\\b(if|for|while|catch|case|elif)\\b|&&|\\|\\||\\?\\?|\\?')) - len(regexp_extract_all(replace(code, '??', ''), '\\?\\.')) AS BIGINT) AS complexity
    FROM (SELECT doc_id, concat(coalesce(text, ''), chr(10), 'if (a && b) for case ', repeat('while ', CAST(doc_id % 9 AS INTEGER))) AS code FROM documents)""")
def x18_text_complexity(spark, sf_dir):
    """A ``?`` counts unless a point follows, ``??`` once."""
    code = F.concat(F.coalesce("text", F.lit("")), F.lit("\nif (a && b) for case "), F.repeat(F.lit("while "), (F.col("doc_id") % 9).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", sc.complexity(code).alias("complexity"))


@query("SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS slug, floor(n_nationkey * 1.005::DOUBLE * 100 + 0.5)::DOUBLE / 100 AS rounded FROM nation")
def x21_slug(spark, sf_dir):
    """X21 and X29."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", sc.slug(F.col("n_name")).alias("slug"), sc.half_up(F.col("n_nationkey") * F.lit(1.005), 2).alias("rounded"))


def _top(w: str, *order):
    return F.row_number().over(Window.partitionBy(w).orderBy(*order))


@query("SELECT src, dst, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, kind, symbol, weight) AS k FROM v_edges) WHERE k <= 3", "v_edges")
def o5_top_per_group(spark, sf_dir):
    e = view(spark, sf_dir, "v_edges")
    return e.withColumn("k", _top("src", F.desc("confidence"), "dst", "kind", "symbol", "weight")).where("k <= 3").select("src", "dst", "confidence")
