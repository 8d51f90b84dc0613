"""Registered queries: declarations of all languages, signatures, semantic edges, colour bins, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import describe, extract, metrics, semantic
from graphloom.plans.base import query
from graphloom.plans.views import table, use, view

#: language -> code with an import, a type and functions where the language has them.
SNIPPETS = {
    "python": "import os.path\nfrom a.b import c\nclass P:\n    def m(self):\n        pass\ndef _f():\n    pass",
    "go": 'package x\nimport "fmt"\ntype S struct {\nfunc (s S) Do(a int) {\nfunc run() {',
    "rust": "use std::io;\npub struct S;\nenum E {}\npub fn go() {}",
    "java": "import java.util.List;\npublic class J {\n  public int size(int a) {",
    "csharp": "using System.Text;\npublic interface IThing {\n  public void Go(int a) {",
    "cpp": "#include <vector>\nclass V {\nint at(int i) {",
    "ruby": "require 'set'\nmodule M\n  def empty?\n  end",
    "kotlin": "import a.b.C\ndata class K(val x: Int)\nprivate fun f() {}",
    "swift": "import Foundation\npublic protocol P {\n  func f()",
    "php": "use App\\Models\\User;\nfinal class U {\n  private function g() {",
    "prisma": "model User {\n  id Int\n}\nenum Role {",
    "dart": "import 'a.dart';\nabstract class D {\nvoid _main() {",
    "scala": "import a.b._\ntrait T\nobject O {\n  def f(x: Int) = x",
    "lua": "local m = require('x')\nlocal function f()\nfunction m.g()",
    "elixir": "defmodule A.B do\n  use GenServer\n  defp f(x)\n  def ok?(x)",
    "erlang": '-module(m).\n-include("h.hrl").\ngo(X) -> X.',
    "zig": 'const std = @import("std");\npub const S = struct {\nfn f() void {',
    "graphql": "interface Node {\ntype User {\nquery Me {",
    "sql": "CREATE TABLE IF NOT EXISTS t (a int);\ncreate or replace function f()",
    "shell": "function f() {\nsource x.sh",
}
FOUND = """VALUES ('python', 1, 'import', 'os.path', NULL), ('python', 2, 'import', 'a.b', NULL), ('python', 3, 'class', 'P', NULL), ('python', 4, 'method', 'm', 'P'), ('python', 6, 'function', '_f', NULL),
    ('go', 2, 'import', 'fmt', NULL), ('go', 3, 'struct', 'S', NULL), ('go', 4, 'method', 'Do', NULL), ('go', 5, 'function', 'run', NULL),
    ('rust', 1, 'import', 'std::io', NULL), ('rust', 2, 'struct', 'S', NULL), ('rust', 3, 'enum', 'E', NULL), ('rust', 4, 'function', 'go', NULL),
    ('java', 1, 'import', 'java.util.List', NULL), ('java', 2, 'class', 'J', NULL), ('java', 3, 'method', 'size', 'J'),
    ('csharp', 1, 'import', 'System.Text', NULL), ('csharp', 2, 'interface', 'IThing', NULL), ('csharp', 3, 'method', 'Go', 'IThing'),
    ('cpp', 1, 'import', 'vector', NULL), ('cpp', 2, 'class', 'V', NULL), ('cpp', 3, 'method', 'at', 'V'),
    ('ruby', 1, 'import', 'set', NULL), ('ruby', 2, 'class', 'M', NULL), ('ruby', 3, 'method', 'empty?', 'M'),
    ('kotlin', 1, 'import', 'a.b.C', NULL), ('kotlin', 2, 'class', 'K', NULL), ('kotlin', 3, 'method', 'f', 'K'),
    ('swift', 1, 'import', 'Foundation', NULL), ('swift', 2, 'trait', 'P', NULL), ('swift', 3, 'method', 'f', 'P'),
    ('php', 1, 'import', 'App\\Models\\User', NULL), ('php', 2, 'class', 'U', NULL), ('php', 3, 'method', 'g', 'U'),
    ('prisma', 1, 'model', 'User', NULL), ('prisma', 4, 'enum', 'Role', NULL),
    ('dart', 1, 'import', 'a.dart', NULL), ('dart', 2, 'class', 'D', NULL), ('dart', 3, 'function', '_main', NULL),
    ('scala', 1, 'import', 'a.b._', NULL), ('scala', 2, 'interface', 'T', NULL), ('scala', 3, 'class', 'O', NULL), ('scala', 4, 'function', 'f', NULL),
    ('lua', 1, 'import', 'x', NULL), ('lua', 2, 'function', 'f', NULL), ('lua', 3, 'function', 'm.g', NULL),
    ('elixir', 1, 'class', 'A.B', NULL), ('elixir', 2, 'import', 'GenServer', NULL), ('elixir', 3, 'function', 'f', NULL), ('elixir', 4, 'function', 'ok?', NULL),
    ('erlang', 1, 'class', 'm', NULL), ('erlang', 2, 'import', 'h.hrl', NULL), ('erlang', 3, 'function', 'go', NULL),
    ('zig', 1, 'import', 'std', NULL), ('zig', 2, 'struct', 'S', NULL), ('zig', 3, 'function', 'f', NULL),
    ('graphql', 1, 'interface', 'Node', NULL), ('graphql', 2, 'type', 'User', NULL), ('graphql', 3, 'function', 'Me', NULL),
    ('sql', 1, 'model', 't', NULL), ('sql', 2, 'function', 'f', NULL)"""
#: Declarations that are not public.
HIDDEN = ["python/_f", "go/run", "rust/E", "kotlin/f", "swift/f", "php/g", "dart/_main", "lua/f", "elixir/f", "zig/f"]


@query(
    f"""SELECT n_nationkey AS nation, language, CAST(line_no AS BIGINT) AS line_no, kind, name, parent, concat(language, '/', name) NOT IN ({', '.join(repr(x) for x in HIDDEN)}) AS exported
    FROM ({FOUND}) AS t(language, line_no, kind, name, parent), nation WHERE kind <> 'import'"""
)
def p6_languages(spark, sf_dir):
    """The line rules of every language; shell has none."""
    return _snippets(spark, sf_dir, extract.symbols)


@query(f"SELECT n_nationkey AS nation, language, CAST(line_no AS BIGINT) AS line_no, name AS import_path FROM ({FOUND}) AS t(language, line_no, kind, name, parent), nation WHERE kind = 'import'")
def p6_language_imports(spark, sf_dir):
    return _snippets(spark, sf_dir, extract.imports)


def _snippets(spark, sf_dir, operator):
    code = F.explode(F.create_map(*[F.lit(x) for pair in SNIPPETS.items() for x in pair])).alias("language", "content")
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), code)
    files = files.withColumn("path", F.concat(F.col("nation").cast("string"), F.lit("/"), "language"))
    out = operator(files)
    return out.select(F.substring_index("path", "/", 1).cast("int").alias("nation"), F.substring_index("path", "/", -1).alias("language"), *[c for c in out.columns if c != "path"])


def _lines(*lines: str):
    """A text over lines with ``#`` for the customer's number."""
    return F.replace(F.lit("\n".join(lines)), F.lit("#"), F.col("c_custkey").cast("string"))


@query("""WITH c AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS k, chr(10) AS n FROM customer)
    SELECT id, CASE id % 5 WHEN 0 THEN 4 WHEN 2 THEN 8 ELSE 1 END AS line_no, CASE id % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'enum' WHEN 3 THEN 'function' ELSE 'class' END AS kind,
      CASE id % 5 WHEN 0 THEN concat('async function f', k, '<T>(', n, '  a: T,', n, '  b = (1 > 0)', n, '): Promise<{ x: T }>') WHEN 1 THEN concat('class C', k, '<T> extends Base<T[]> implements A, B')
        WHEN 2 THEN concat('enum E', k, ' { A, B, C, D, E, F, G, H, ... }') WHEN 3 THEN concat('async function g', k, '(a: int): dict[str, int]') ELSE concat('public class J', k, ' {') END AS signature,
      CASE id % 5 WHEN 0 THEN concat('/**', n, ' * Number ', k, '.', n, ' */') WHEN 2 THEN concat('/** a', n, ' * b', n, ' * c', n, ' * ', k, n, ' */') ELSE '' END AS doc FROM c""")
def p8_signatures(spark, sf_dir):
    """Heads over several lines, doc comments, members of enums, cut where they are long."""
    k = F.col("c_custkey") % 5
    text = (
        F.when(k == 0, _lines("/**", " * Number #.", " */", "export async function f#<T>(", "  a: T,", "  b = (1 > 0)", "): Promise<{ x: T }> {", "  return b;", "}"))
        .when(k == 1, _lines("export class C#<T> extends Base<T[]> implements A, B {", "}"))
        .when(k == 2, _lines("/** a", " * b", " * c", " * #", " * e", " */", "", "enum E# { A, B = 2, C, D, E, F, G, H, I }"))
        .when(k == 3, _lines("async def g#(a: int) -> dict[str, int]:", "    pass"))
        .otherwise(_lines("public class J# {"))
    )
    language = F.when(k == 3, "python").when(k == 4, "java").otherwise("typescript")
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), language.alias("language"), text.alias("content"))
    return describe.described(files).select(F.col("path").alias("id"), "line_no", "kind", "signature", "doc")


CONFIG = '{ // aliases\n "compilerOptions": { "baseUrl": ".", "paths": { "@lib/*": ["src/none/*", "src/lib/*"], }, }, }'


@query("""WITH c AS (SELECT c_custkey % 7 AS j, concat('src/app/c', c_custkey, '.ts') AS src, concat('src/lib/base', c_custkey % 7, CASE WHEN c_custkey % 7 % 2 = 0 THEN '.ts' ELSE '.tsx' END) AS base FROM customer)
    SELECT src, base AS dst, 'import' AS kind, concat('B', j, ',Extra,Root') AS symbols, 1.0::DOUBLE AS weight FROM c UNION ALL SELECT src, 'src/lib/ns/index.ts', 'import', '', 1.0::DOUBLE FROM c
    UNION ALL SELECT src, base, 'extends', concat('B', j), 1.5::DOUBLE FROM c UNION ALL SELECT src, base, 'implements', 'Extra', 1.2::DOUBLE FROM c UNION ALL SELECT src, 'src/lib/ns/index.ts', 'implements', 'ns.Shape', 1.2::DOUBLE FROM c""")
def p10_semantic_edges(spark, sf_dir):
    """P10: imports by alias, by relative path and of an index file; classes that extend and implement what they import."""
    c, j = table(spark, sf_dir, "customer"), (F.col("c_custkey") % 7).cast("string")
    spec = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("../lib/base"), j, F.lit(".js"))).otherwise(F.concat(F.lit("@lib/base"), j))
    text = F.concat(
        F.lit("import Root, { Base as B"), j, F.lit(", type Extra } from '"), spec,
        F.lit("';\nimport * as ns from '../lib/ns';\nimport './none';\nimport { readFile } from 'fs';\nexport class C"), j, F.lit("<T extends Root<T>> extends B"), j,
        F.lit("<T[], Map<string, T>> implements Extra, ns.Shape {\n}\ninterface Own extends Local {}\n"),
    )
    row = lambda path, content: (path.alias("path"), F.lit("typescript").alias("language"), content.alias("content"))
    app = c.select(*row(F.concat(F.lit("src/app/c"), F.col("c_custkey").cast("string"), F.lit(".ts")), text))
    base = c.where("c_custkey <= 7").select(*row(F.concat(F.lit("src/lib/base"), j, F.when(F.col("c_custkey") % 7 % 2 == 0, ".ts").otherwise(".tsx")), F.lit("export {}")))
    rest = spark.createDataFrame([("src/lib/ns/index.ts", "typescript", ""), ("tsconfig.json", "json", CONFIG)], "path string, language string, content string")
    files = app.unionByName(base).unionByName(rest)
    edges = semantic.semantic_edges(files, semantic.path_map(files))
    return edges.select("src", "dst", "kind", F.array_join("symbols", ",").alias("symbols"), "weight")


@query(
    """WITH n AS (SELECT file_id AS id, extension, file_id % 20 AS churn, file_id % 11 / 10.0 AS inst, file_id % 13 = 0 AS god, file_id % 14 AS deg, file_id % 4 AS risk, size FROM v_files)
    SELECT id, CASE extension WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'other' END AS language, id % 8 AS cluster,
      CASE WHEN churn = 0 THEN 0 WHEN churn <= 3 THEN 1 WHEN churn <= 8 THEN 2 WHEN churn <= 15 THEN 3 ELSE 4 END AS churn,
      CASE WHEN god THEN -1 WHEN inst <= 0.25 THEN 0 WHEN inst <= 0.5 THEN 1 WHEN inst <= 0.75 THEN 2 ELSE 3 END AS instability,
      CASE WHEN deg = 0 THEN 0 WHEN deg <= 2 THEN 1 WHEN deg <= 5 THEN 2 WHEN deg <= 10 THEN 3 ELSE 4 END AS impact, risk AS hotspot,
      CASE WHEN coalesce(size, 0) < 1000 THEN 0 WHEN size < 4000 THEN 1 WHEN size < 12000 THEN 2 ELSE 3 END AS size FROM n""",
    "v_files",
)
def f13_color_bins(spark, sf_dir):
    """the seven colour modes."""
    k = F.col("file_id")
    risk = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), (k % 4 + 1).cast("int"))
    nodes = view(spark, sf_dir, "v_files").select(
        k.alias("id"), F.col("relative_path").alias("name"), F.lit("").alias("language"), k.alias("community"), (k % 20).alias("churn"), (k % 11 / 10).alias("instability"),
        (k % 13 == 0).alias("is_god"), (k % 14).alias("in_degree"), risk.alias("risk"), "size",
    )
    return metrics.color_bins(nodes).select("id", "bins.*")


@query("""SELECT c_custkey AS id, concat('{"id":', c_custkey, ',"name":"', c_name, ' \\"x\\"","tags":["', c_mktsegment, '",null],"of":{"nation":', c_nationkey, '}}') AS text,
    concat(c_name, ' "x"') AS name, c_mktsegment AS tag, CAST(c_nationkey AS BIGINT) AS nation FROM customer""")
def x27_json(spark, sf_dir):
    """Rows written as JSON and read again, nested values among them."""
    made = F.struct(
        F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(' "x"')).alias("name"),
        F.array("c_mktsegment", F.lit(None)).alias("tags"), F.struct(F.col("c_nationkey").alias("nation")).alias("of"),
    )
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.to_json(made).alias("text"))
    parsed = F.from_json("text", "name string, tags array<string>, of struct<nation: long>")
    return texts.withColumn("p", parsed).select("id", "text", "p.name", F.get("p.tags", F.lit(0)).alias("tag"), "p.of.nation")


@query()
def b1_benchmark_run(spark, sf_dir):
    """Tasks retrieved, ranked and packed; all but the time."""
    from graphloom.api import Project

    files, edges, symbols = use(spark, sf_dir, "v_files", "v_edges_doc", "v_symbols")
    code = files.select(F.col("relative_path").alias("path"), F.lit("typescript").alias("language"), "content")
    named = symbols.join(files.select("file_id", F.col("relative_path").alias("path")), "file_id")
    tasks = [("services", "main services", ["main.py", "f1.py"]), ("billing", "billing blue", ["f7.go"])]
    return Project(spark, code, edges, named).benchmark(tasks).drop("ms")
