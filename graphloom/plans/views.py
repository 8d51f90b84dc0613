"""Canonical views: the engine's tables, derived from the star-schema inputs.

The text of each view is SQL that Spark and the oracle engine both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # Files: a document each, with a path made from its id.
    "v_files": """
        SELECT doc_id AS file_id, relative_path, extension, lang AS natural_language, size, is_doc, content,
               substr(relative_path, 1, length(relative_path) - length(file_name) - 1) AS module
        FROM (
          SELECT *, concat(dir, '/', file_name) AS relative_path FROM (
            SELECT doc_id, lang, text AS content, length(text) AS size, doc_id % 5 = 3 AS is_doc,
                   CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.md' ELSE '.js' END AS extension,
                   concat(CASE WHEN doc_id % 29 = 0 THEN concat('x', doc_id, '_main') WHEN doc_id % 31 = 0 THEN concat('f', doc_id, '.test') ELSE concat('f', doc_id) END,
                          CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.md' ELSE '.js' END) AS file_name,
                   CASE doc_id % 9 WHEN 0 THEN 'src/controllers' WHEN 1 THEN 'src/services' WHEN 2 THEN 'src/domain' WHEN 3 THEN 'src/infra'
                     WHEN 4 THEN 'src/shared' WHEN 5 THEN 'packages/auth/lib' WHEN 6 THEN 'tests/unit' WHEN 7 THEN 'packages/billing/lib' ELSE 'dist/bundle' END AS dir
            FROM documents) AS a) AS b""",
    # Dependencies between parts that follow each other in an order.
    "v_edges": """
        SELECT src, dst, kind, symbol, weight, confidence FROM (
          SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst,
                 CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'implements' ELSE 'export' END AS kind,
                 l_linestatus AS symbol, l_quantity AS weight, 1 - l_discount AS confidence
          FROM lineitem) AS s WHERE dst IS NOT NULL""",
    # Dependencies between files: a tree by halving, and some links back.
    "v_edges_doc": """
        SELECT a.relative_path AS src, b.relative_path AS dst, l.kind, l.symbol, l.confidence
        FROM (SELECT doc_id AS s, CAST(floor(doc_id / 2) AS BIGINT) AS t, CASE WHEN doc_id % 4 = 1 THEN 'implements' ELSE 'import' END AS kind,
                     concat('sym', doc_id % 50) AS symbol, CAST(0.9 AS DOUBLE) AS confidence FROM documents WHERE doc_id > 0 AND doc_id % 6 <> 5
              UNION ALL SELECT doc_id, doc_id + 3, 'export', concat('sym', doc_id % 7), CAST(0.5 AS DOUBLE) FROM documents WHERE doc_id % 8 = 1) AS l
        JOIN v_files AS a ON a.file_id = l.s JOIN v_files AS b ON b.file_id = l.t""",
    "v_symbols": """
        SELECT p_partkey AS symbol_id, p_partkey % (SELECT count(*) FROM documents) AS file_id, p_name AS name, p_type AS kind,
               p_partkey % 400 + 1 AS line, CAST(p_size AS BIGINT) AS complexity, p_partkey % 3 <> 0 AS exported FROM part""",
    "v_commits": """
        SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS committed, l_partkey AS file
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    # Code: a few lines a document, with secrets, sources and sinks placed by its id.
    "v_code": """
        SELECT doc_id AS file_id, concat('src/code/f', doc_id, '.ts') AS path, 'typescript' AS language, concat_ws(chr(10),
            concat('import { db } from ', chr(39), './db', doc_id % 9, chr(39), ';'),
            CASE WHEN doc_id % 3 = 0 THEN concat('const id', doc_id % 5, ' = req.query.id;') ELSE 'const local = 1;' END,
            concat('export class Box', doc_id % 11, ' {'),
            '  load(x: string) {',
            CASE WHEN doc_id % 4 = 0 THEN concat('    db.run(`SELECT * FROM t WHERE id = $', '{id', doc_id % 5, '}`);') ELSE '    return x;' END,
            '  }',
            '}',
            CASE WHEN doc_id % 5 = 1 THEN 'eval(payload);' WHEN doc_id % 5 = 2 THEN 'node.innerHTML = body;' END,
            CASE WHEN doc_id % 7 = 0 THEN concat('password = "', md5(CAST(doc_id AS STRING)), '"') END,
            CASE WHEN doc_id % 7 = 1 THEN concat('key = AKIA', upper(substr(md5(CAST(doc_id AS STRING)), 1, 16)), ' end') END,
            concat('export function run', doc_id % 13, '(a) {'),
            concat('  return a && ', doc_id, ';'),
            '}') AS content
        FROM documents""",
    # Services: a nation each; what it exports and consumes follows from keys.
    "v_services": "SELECT n_nationkey AS service_id, lower(n_name) AS name, n_regionkey AS region FROM nation",
    "v_exports": """
        SELECT s_nationkey AS service_id, concat('/api/', lower(n_name), '/', CASE s_suppkey % 3 WHEN 0 THEN ':id' WHEN 1 THEN 'list' ELSE concat('item', s_suppkey % 5) END) AS path
        FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN '/users/:id' WHEN 1 THEN '/{tenant}/orders/open' WHEN 2 THEN '/' ELSE concat('/users/', s_suppkey) END FROM supplier""",
    "v_consumes": """
        SELECT c_nationkey AS service_id, concat('https://Gateway.example.com/api/', n_name, '/', CASE c_custkey % 4 WHEN 0 THEN 'LIST' WHEN 1 THEN concat('item', c_custkey % 5) ELSE concat('', c_custkey) END, '/?v=1') AS path
        FROM customer JOIN nation ON n_nationkey = (c_nationkey + c_custkey) % 25
        UNION ALL SELECT c_nationkey, CASE c_custkey % 5 WHEN 0 THEN concat('/users/', c_custkey % 40) WHEN 1 THEN '/users/{name}' WHEN 2 THEN concat('/t', c_custkey % 3, '/orders/:state') WHEN 3 THEN '/api/{x}/list' ELSE 'http://h/' END FROM customer""",
}
#: Views that a view reads.
NEEDS = {"v_edges_doc": ["v_files"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order(names) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in [*NEEDS.get(name, []), name]:
            if x not in out:
                out.append(x)
    return out


def use(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views as DataFrames; the inputs become temporary views."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    out = {}
    for name in _order(names):
        out[name] = spark.sql(VIEWS[name])
        out[name].createOrReplaceTempView(name)
    return [out[n] for n in names]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use(spark, sf_dir, name)[0]


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL: the query with the views it needs in front."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in _order(names))
    sql = sql.strip()
    if not head:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql[14:]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {head}, {sql[4:]}"
    return f"WITH {head} {sql}"
