"""Registered queries over the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph, metrics
from graphloom.plans.base import query
from graphloom.plans.views import use, view

DEGREES = """
  m AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
        FROM (SELECT src AS node, 0 AS i, 1 AS o FROM v_edges UNION ALL SELECT dst, 1, 0 FROM v_edges) GROUP BY node),
  mm AS (SELECT node, in_degree, out_degree, in_degree + out_degree AS total_degree,
         floor(CAST(out_degree AS DOUBLE) / (in_degree + out_degree) * 1000 + 0.5) / 1000 AS instability,
         in_degree + out_degree >= 10 AS is_god, out_degree = 0 AND in_degree > 0 AS is_leaf, in_degree = 0 AND out_degree > 0 AS is_root FROM m)"""


def back(seed: str, depth: int, a: str = "dst", b: str = "src") -> str:
    """Recursive walk from seeds: against the edges, or along them with a and b swapped."""
    return f"""WITH RECURSIVE h AS (SELECT DISTINCT src, dst FROM v_edges),
      w AS (SELECT node, 0 AS depth FROM ({seed}) UNION SELECT h.{b}, w.depth + 1 FROM w JOIN h ON h.{a} = w.node WHERE w.depth < {depth}),
      r AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)"""


@query(f"WITH {DEGREES} SELECT * FROM mm", "v_edges")
def a2_node_metrics(spark, sf_dir):
    return metrics.node_metrics(view(spark, sf_dir, "v_edges"))


@query(
    """WITH n AS (SELECT src AS x FROM v_edges UNION SELECT dst FROM v_edges), c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM v_edges) AS edges)
    SELECT nodes, edges, floor(CAST(edges AS DOUBLE) / (nodes * (nodes - 1)) * 10000 + 0.5) / 10000 AS density,
           floor(2.0 * edges / nodes * 100 + 0.5) / 100 AS average_degree FROM c""",
    "v_edges",
)
def a3_graph_summary(spark, sf_dir):
    return metrics.graph_summary(view(spark, sf_dir, "v_edges"))


@query(f"WITH {DEGREES} SELECT node, total_degree FROM mm ORDER BY total_degree DESC, node LIMIT 10", "v_edges")
def o2_top_by_degree(spark, sf_dir):
    return metrics.top_by_degree(metrics.node_metrics(view(spark, sf_dir, "v_edges")), 10).select("node", "total_degree")


@query(f"WITH {DEGREES} SELECT node, out_degree, instability FROM mm WHERE out_degree > 2 AND instability >= 0.8 ORDER BY instability DESC, node LIMIT 10", "v_edges")
def o3_unstable_nodes(spark, sf_dir):
    return metrics.unstable(metrics.node_metrics(view(spark, sf_dir, "v_edges")), 10).select("node", "out_degree", "instability")


@query(
    f"""WITH {DEGREES}, c AS (SELECT file AS node, count(*) AS churn FROM v_commits GROUP BY file),
    t AS (SELECT mm.*, coalesce(churn, 0) AS churn FROM (SELECT * FROM mm ORDER BY total_degree DESC, node LIMIT 10) AS mm LEFT JOIN c USING (node)),
    s AS (SELECT *, floor((churn * (1 + 2 * instability) * (1 + ln(1 + in_degree)) + 0.5 * in_degree) * 100 + 0.5) / 100 AS score FROM t)
    SELECT node, churn, score, CASE WHEN score >= 15 OR (is_god AND churn > 3) THEN 'critical' WHEN score >= 8 OR instability > 0.8 THEN 'high'
      WHEN score >= 3 OR in_degree > 5 THEN 'medium' ELSE 'low' END AS risk FROM s""",
    "v_edges", "v_commits",
)
def x22_hotspots(spark, sf_dir):
    edges, commits = use(spark, sf_dir, "v_edges", "v_commits")
    churn = commits.groupBy(F.col("file").alias("node")).agg(F.count(F.lit(1)).alias("churn"))
    return metrics.hotspots(metrics.node_metrics(edges), churn)


@query(
    """SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT src FROM v_edges UNION SELECT dst FROM v_edges)) AS nodes,
    CAST(count(*) FILTER (src = 7 OR dst = 7) > 0 AS BOOLEAN) AS has_seven FROM v_edges""",
    "v_edges",
)
def g1_graph_counts(spark, sf_dir):
    e = view(spark, sf_dir, "v_edges")
    n = graph.nodes(e).agg(F.count(F.lit(1)).alias("nodes"))
    return e.agg(F.count(F.lit(1)).alias("edges"), (F.count_if((F.col("src") == 7) | (F.col("dst") == 7)) > 0).alias("has_seven")).join(F.broadcast(n))


@query(back("SELECT CAST(7 AS BIGINT) AS node", 2, "src", "dst") + " SELECT node, depth FROM r WHERE depth > 0", "v_edges")
def g2_dependencies(spark, sf_dir):
    return graph.reach(graph.seeds_of(spark, [7]), view(spark, sf_dir, "v_edges"), 2).select("node", "depth")


@query(back("SELECT CAST(7 AS BIGINT) AS node", 2) + " SELECT node, depth FROM r WHERE depth > 0", "v_edges")
def g3_dependents(spark, sf_dir):
    return graph.reach(graph.seeds_of(spark, [7]), graph.reverse(view(spark, sf_dir, "v_edges")), 2).select("node", "depth")


@query("SELECT 'out' AS side, dst AS node, kind, confidence FROM v_edges WHERE src = 10 UNION ALL SELECT 'in', src, kind, confidence FROM v_edges WHERE dst = 10", "v_edges")
def g4_direct_edges(spark, sf_dir):
    e = view(spark, sf_dir, "v_edges")
    out = e.where("src = 10").select(F.lit("out").alias("side"), F.col("dst").alias("node"), "kind", "confidence")
    return out.unionByName(e.where("dst = 10").select(F.lit("in").alias("side"), F.col("src").alias("node"), "kind", "confidence"))


@query(
    back("SELECT CAST(7 AS BIGINT) AS node UNION ALL SELECT 20", 1) + """, f AS (SELECT dst AS node FROM h WHERE src IN (7, 20)), s AS (SELECT node FROM r UNION SELECT node FROM f)
    SELECT src, dst, count(*) AS parallel FROM v_edges WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s) GROUP BY src, dst""",
    "v_edges",
)
def g5_connected_subgraph(spark, sf_dir):
    e, seeds = view(spark, sf_dir, "v_edges"), graph.seeds_of(spark, [7, 20])
    near = graph.reach(seeds, e, 1).select("node").union(graph.reach(seeds, graph.reverse(e), 1).select("node")).union(seeds).distinct()
    inside = e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("parallel"))


@query(back("SELECT CAST(7 AS BIGINT) AS node UNION ALL SELECT 13", 3) + " SELECT node, depth FROM r WHERE depth > 0 AND node NOT IN (7, 13)", "v_edges")
def g6_blast_radius(spark, sf_dir):
    return graph.blast_radius(graph.seeds_of(spark, [7, 13]), view(spark, sf_dir, "v_edges"), 3)


BLAST = back("SELECT CAST(7 AS BIGINT) AS node UNION ALL SELECT 13", 3) + """, b AS (SELECT * FROM r WHERE depth > 0 AND node NOT IN (7, 13)),
  c AS (SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive FROM b),
  m AS (SELECT coalesce(max(k), 0) AS max_in_degree FROM (SELECT count(*) AS k FROM v_edges WHERE dst IN (7, 13) GROUP BY dst))"""


@query(
    BLAST + """ SELECT direct, transitive, max_in_degree, CASE WHEN max_in_degree >= 10 OR direct >= 10 THEN 'CRITICAL' WHEN max_in_degree >= 5 OR direct >= 5 THEN 'HIGH'
    WHEN direct + transitive > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c, m""",
    "v_edges",
)
def g6_blast_summary(spark, sf_dir):
    return graph.blast_summary(graph.seeds_of(spark, [7, 13]), view(spark, sf_dir, "v_edges"), 3)


@query(
    BLAST + """, n AS (SELECT count(*) AS total FROM (SELECT src FROM v_edges UNION SELECT dst FROM v_edges)),
    s AS (SELECT direct, transitive, CAST(0 AS BIGINT) AS tests, least(100.0, floor((2 * direct + transitive) / CAST(total AS DOUBLE) * 100 * 10 + 0.5) / 10) AS risk_score FROM c, n)
    SELECT *, CASE WHEN risk_score > 50 OR direct > 20 THEN 'CRITICAL' WHEN risk_score > 25 OR direct > 10 THEN 'HIGH' WHEN risk_score > 10 OR direct > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s""",
    "v_edges",
)
def g10_change_surface(spark, sf_dir):
    return graph.change_surface(graph.seeds_of(spark, [7, 13]), view(spark, sf_dir, "v_edges"), 3)


def _paths(levels: int = 6) -> str:
    """The smallest path to each node by its number of steps, a table a level; the first that ends in 30."""
    out = "WITH h AS (SELECT DISTINCT src, dst FROM v_edges), p0 AS (SELECT CAST(11 AS BIGINT) AS node, [CAST(11 AS BIGINT)] AS path)"
    for i in range(levels):
        seen = " UNION ALL ".join(f"SELECT node FROM p{k}" for k in range(i + 1))
        out += f""", p{i + 1} AS MATERIALIZED (SELECT h.dst AS node, min(list_append(path, h.dst)) AS path FROM p{i} JOIN h ON h.src = p{i}.node
          WHERE h.dst NOT IN ({seen}) GROUP BY 1)"""
    every = " UNION ALL ".join(f"SELECT path FROM p{k} WHERE node = 30" for k in range(levels + 1))
    return out + f", s AS (SELECT path FROM ({every}) ORDER BY len(path) LIMIT 1)"


PATHS = _paths()


@query(PATHS + " SELECT array_to_string(path, '>') AS path, len(path) - 1 AS distance FROM s", "v_edges")
def g7_shortest_path(spark, sf_dir):
    path = graph.shortest_path(view(spark, sf_dir, "v_edges"), 11, 30)
    return path.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).cast("long").alias("distance"))


@query(
    PATHS + """, u AS (SELECT unnest(range(1, len(path))) AS step, path FROM s), e AS (SELECT step, path[step] AS src, path[step + 1] AS dst FROM u),
    k AS (SELECT e.step, e.src, e.dst, min({'kind': v.kind, 'confidence': v.confidence}) AS f FROM e JOIN v_edges AS v ON v.src = e.src AND v.dst = e.dst GROUP BY ALL)
    SELECT step, src, dst, f.kind AS kind, f.confidence AS confidence, (SELECT floor(product(f.confidence) * 100 + 0.5) / 100 FROM k) AS path_confidence FROM k""",
    "v_edges",
)
def g8_execution_path(spark, sf_dir):
    return graph.execution_path(view(spark, sf_dir, "v_edges"), 11, 30).withColumn("step", F.col("step").cast("long"))


@query(
    """WITH RECURSIVE h AS (SELECT DISTINCT src, dst FROM v_edges_doc), t AS (SELECT relative_path AS node FROM v_files WHERE file_id = 24),
      w AS (SELECT node, 0 AS d FROM t UNION SELECT h.src, w.d + 1 FROM w JOIN h ON h.dst = w.node WHERE w.d < 7),
      r AS (SELECT node, min(d) AS distance FROM w GROUP BY node)
    SELECT node, distance, node NOT IN (SELECT dst FROM h) AS is_root FROM r WHERE distance > 0 AND (node NOT IN (SELECT dst FROM h)
      OR regexp_matches(node, '(index|main|app|server|cli|command|route|controller)\\.(ts|js|py|go|rs)$', 'i'))""",
    "v_files", "v_edges_doc",
)
def g9_entry_points(spark, sf_dir):
    files, edges = use(spark, sf_dir, "v_files", "v_edges_doc")
    target = files.where("file_id = 24").select("relative_path").first()[0]
    return graph.entry_points(edges, target, 8).select("node", "distance", "is_root")


def _pagerank_sql(k: int) -> str:
    steps = "".join(
        f""", r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + l.lost / c.n) AS rank FROM n CROSS JOIN c
        CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM o)) AS l
        LEFT JOIN (SELECT v.dst, sum(r.rank / o.k) AS got FROM v_edges AS v JOIN r{i} AS r ON r.node = v.src JOIN o ON o.src = v.src GROUP BY v.dst) AS g ON g.dst = n.node)"""
        for i in range(k)
    )
    return f"""WITH n AS (SELECT src AS node FROM v_edges UNION SELECT dst FROM v_edges), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM n),
      o AS (SELECT src, CAST(count(*) AS DOUBLE) AS k FROM v_edges GROUP BY src), r0 AS (SELECT node, 1 / c.n AS rank FROM n CROSS JOIN c){steps}
      SELECT node, round(rank, 9) AS rank FROM r{k}"""


@query(_pagerank_sql(20), "v_edges")
def g11_pagerank(spark, sf_dir):
    return graph.pagerank(view(spark, sf_dir, "v_edges")).select("node", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(20) + " WHERE node = 7", "v_edges")
def g12_node_pagerank(spark, sf_dir):
    return graph.pagerank(view(spark, sf_dir, "v_edges")).where("node = 7").select("node", F.round("rank", 9).alias("rank"))


def _communities_sql(k: int) -> str:
    steps = "".join(
        f""", v{i} AS MATERIALIZED (SELECT b.src AS node, l.label AS vote, sum(b.w) AS w FROM b JOIN l{i} AS l ON l.node = b.dst GROUP BY ALL),
        t{i} AS (SELECT v.node, v.vote FROM v{i} AS v JOIN (SELECT node, max(w) AS top FROM v{i} GROUP BY node) AS m ON m.node = v.node AND v.w = m.top),
        l{i + 1} AS MATERIALIZED (SELECT l.node, CASE WHEN bool_or(t.vote = l.label) THEN l.label ELSE coalesce(min(t.vote), l.label) END AS label
          FROM l{i} AS l LEFT JOIN t{i} AS t ON t.node = l.node GROUP BY l.node, l.label)"""
        for i in range(k)
    )
    return f"""WITH b AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, weight AS w FROM v_edges UNION ALL SELECT dst, src, weight FROM v_edges) GROUP BY ALL),
      l0 AS (SELECT DISTINCT src AS node, src AS label FROM b){steps}, h AS (SELECT label, row_number() OVER (ORDER BY min(node)) - 1 AS community FROM l{k} GROUP BY label)
      SELECT node, community FROM l{k} JOIN h USING (label)"""


@query(_communities_sql(10), "v_edges")
def g13_communities(spark, sf_dir):
    return graph.communities(view(spark, sf_dir, "v_edges"))


@query(
    """WITH RECURSIVE h AS (SELECT DISTINCT src, dst FROM v_edges), n AS (SELECT src AS node FROM h UNION SELECT dst FROM h),
      w AS (SELECT node AS a, node AS b FROM n UNION SELECT w.a, h.dst FROM w JOIN h ON h.src = w.b)
    SELECT x.a AS node, min(x.b) AS component FROM w AS x JOIN w AS y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
    "v_edges",
)
def g14_strong_components(spark, sf_dir):
    return graph.strong_components(view(spark, sf_dir, "v_edges"))


@query(
    """WITH h AS (SELECT DISTINCT src, dst FROM v_edges)
    SELECT concat_ws('>', src, dst) AS cycle FROM h WHERE src = dst
    UNION ALL SELECT concat_ws('>', a.src, a.dst, a.src) FROM h AS a JOIN h AS b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
    UNION ALL SELECT concat_ws('>', a.src, a.dst, b.dst, a.src) FROM h AS a JOIN h AS b ON a.dst = b.src JOIN h AS c ON c.src = b.dst AND c.dst = a.src
      WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""",
    "v_edges",
)
def g14_short_cycles(spark, sf_dir):
    c = graph.simple_cycles(view(spark, sf_dir, "v_edges"), 3)
    return c.select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


@query(
    """WITH s AS (SELECT relative_path, string_split(relative_path, '/') AS p FROM v_files), u AS (SELECT p, unnest(range(2, len(p) + 1)) AS k FROM s WHERE len(p) > 1)
    SELECT DISTINCT array_to_string(p[:k - 1], '/') AS parent, array_to_string(p[:k], '/') AS child FROM u""",
    "v_files",
)
def g15_containment(spark, sf_dir):
    return graph.containment(view(spark, sf_dir, "v_files"))


@query(
    """WITH d AS (SELECT dst AS node, count(*) AS dependents FROM v_edges GROUP BY dst)
    SELECT node, dependents, CASE WHEN dependents >= 10 THEN 'critical' WHEN dependents >= 5 THEN 'high' WHEN dependents >= 2 THEN 'medium' ELSE 'low' END AS risk FROM d""",
    "v_edges",
)
def x24_editor_risk(spark, sf_dir):
    d = view(spark, sf_dir, "v_edges").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    return d.withColumn("risk", graph.risk_bucket(F.col("dependents")))


@query(
    f"""WITH {DEGREES}, c AS (SELECT file AS node, count(*) AS churn FROM v_commits GROUP BY file)
    SELECT mm.node, in_degree, out_degree, instability, coalesce(churn, 0) AS churn, CASE WHEN in_degree > 5 THEN 'hub' WHEN in_degree > 2 THEN 'mid' WHEN in_degree > 0 THEN 'low' ELSE 'none' END AS degree_bin,
      CASE WHEN is_god THEN 'god' WHEN instability <= 0.25 THEN 'stable' WHEN instability <= 0.5 THEN 'balanced' WHEN instability <= 0.75 THEN 'leaning' ELSE 'unstable' END AS instability_bin,
      CASE WHEN coalesce(churn, 0) <= 0 THEN 0 WHEN churn <= 3 THEN 1 WHEN churn <= 8 THEN 2 WHEN churn <= 15 THEN 3 ELSE 4 END AS churn_bin
    FROM mm LEFT JOIN c ON c.node = mm.node""",
    "v_edges", "v_commits",
)
def g16_decorated_nodes(spark, sf_dir):
    """Left lookups of metrics with colour bins."""
    edges, commits = use(spark, sf_dir, "v_edges", "v_commits")
    churn = commits.groupBy(F.col("file").alias("node")).agg(F.count(F.lit(1)).alias("churn"))
    m = metrics.node_metrics(edges).join(churn, "node", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    i, n, c = F.col("instability"), F.col("in_degree"), F.col("churn")
    return m.select(
        "node", "in_degree", "out_degree", "instability", "churn",
        F.when(n > 5, "hub").when(n > 2, "mid").when(n > 0, "low").otherwise("none").alias("degree_bin"),
        F.when(F.col("is_god"), "god").when(i <= 0.25, "stable").when(i <= 0.5, "balanced").when(i <= 0.75, "leaning").otherwise("unstable").alias("instability_bin"),
        F.when(c <= 0, 0).when(c <= 3, 1).when(c <= 8, 2).when(c <= 15, 3).otherwise(4).alias("churn_bin"),
    )
