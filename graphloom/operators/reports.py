"""Rules made from evidence, live blocks, feature plans, diagnostics, insight rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import files as ff

#: Evidence -> rule (id, category); in order, one of the two test runners.
PROPOSALS = [
    ("typescript", "ts_strict_types", "typescript"),
    ("react", "react_hooks", "react"),
    ("next.js", "next_app_router", "next"),
    ("nestjs", "nest_modules", "nest"),
    ("express", "express_layers", "express"),
    ("vitest", "vitest_tests", "testing"),
    ("jest", "jest_tests", "testing"),
    ("monorepo", "workspace_boundaries", "architecture"),
    ("layers", "layer_rules", "architecture"),
]
START, END = "<!-- START_ARCHITECTURE_MAP -->", "<!-- END_ARCHITECTURE_MAP -->"
#: Ways to break a cycle.
FIXES = ["Extract shared code into a third module", "Invert one dependency with an interface", "Merge the modules if they belong together"]


def propose_rules(evidence: DataFrame) -> DataFrame:
    """``rule_id, category, position``: a rule for each known piece of ``evidence(name)``."""
    spark = evidence.sparkSession
    table = spark.createDataFrame([(i, n, r, c) for i, (n, r, c) in enumerate(PROPOSALS)], "position long, name string, rule_id string, category string")
    hit = table.join(evidence.select("name").distinct(), "name", "left_semi")
    runner = hit.where("name in ('vitest', 'jest')").withColumn("k", F.row_number().over(Window.orderBy("position"))).where("k = 1").drop("k")
    return hit.where("name not in ('vitest', 'jest')").unionByName(runner).select("rule_id", "category", "position")


def sync_block(existing: Column, block: Column) -> Column:
    """A text with the block between the markers replaced, or added at its end."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    end = lambda x: F.regexp_replace(x, r"\s+$", "")
    full = F.concat(F.lit(START + "\n"), bare(block), F.lit("\n" + END))
    a, b = F.instr(existing, START), F.instr(existing, END)
    before, behind = F.substring(existing, F.lit(1), a - 1), F.substring(existing, b + len(END), F.length(existing))
    inside = F.concat(bare(F.concat_ws("\n\n", end(before), full, F.regexp_replace(behind, r"^\s+", ""))), F.lit("\n"))
    added = F.concat(F.when(bare(existing) != "", F.concat(end(existing), F.lit("\n\n"))).otherwise(""), full, F.lit("\n"))
    return F.when((a > 0) & (b >= a), inside).otherwise(added)


def architecture_block(files: DataFrame, symbols: int, edges: int, cycles: int, path: str = "relative_path") -> DataFrame:
    """One row ``block``: counts, health and contexts with their first five files."""
    named = files.withColumn("context", ff.bounded_context(F.col(path)))
    total = files.agg(F.count(F.lit(1)).alias("n"))
    ctx = named.where("context <> ''").groupBy("context").agg(F.sort_array(F.collect_list(path)).alias("f"))
    more = F.when(F.size("f") > 5, F.format_string(" (+%d more)", F.size("f") - 5)).otherwise("")
    lines = ctx.agg(F.sort_array(F.collect_list(F.concat(F.lit("- **"), "context", F.lit("**: "), F.array_join(F.slice("f", 1, 5), ", "), more))).alias("lines"))
    health = f"- Active cycles: {cycles}" if cycles else "- Clean graph (0 cycles)"
    head = F.format_string(f"- Indexed: %d files | {symbols} symbols | {edges} dependencies\n{health}\n", F.col("n"))
    return total.join(F.broadcast(lines)).select(F.concat(head, F.array_join("lines", "\n")).alias("block"))  # one row each


def plan_feature(ranked: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """``path, role``: the first half of the ranked files is the core; what it touches supports it."""
    top = ranked.orderBy(F.desc("relevance"), "path").limit(most)
    half = -(-most // 2)
    core = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("relevance"), "path"))).where(F.col("k") <= half).select("path")
    touched = edges.join(core.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path"))
    touched = touched.union(edges.join(core.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src")).union(top.select("path")).distinct()
    support = touched.join(core, "path", "left_anti")
    return core.withColumn("role", F.lit("core")).unionByName(support.withColumn("role", F.lit("support")))


def diagnostics(cycles: DataFrame, violations: DataFrame, lines: DataFrame) -> DataFrame:
    """``path, target, severity, line_no``: cycle edges and violations at their import lines.

    ``cycles``: cycle (first node repeated at the end); ``lines``: path, line_no, line.
    """
    pairs = cycles.select(F.posexplode("cycle").alias("k", "path"), "cycle").where(F.col("k") < F.size("cycle") - 1)
    pairs = pairs.select("path", F.get("cycle", F.col("k") + 1).alias("target"), F.lit("warning").alias("severity"))
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").otherwise("warning")
    found = pairs.unionByName(violations.select(F.col("src").alias("path"), F.col("dst").alias("target"), level.alias("severity")))
    stem = F.regexp_replace(F.substring_index("target", "/", -1), r"\.[^.]*$", "")
    found = found.distinct().withColumn("stem", stem)
    hits = found.join(lines, "path", "left").withColumn(
        "at", F.when((F.contains("line", F.lit("import ")) | F.contains("line", F.lit("require("))) & F.contains("line", "stem"), F.col("line_no"))
    )
    return hits.groupBy("path", "target", "severity").agg(F.coalesce(F.min("at"), F.lit(0)).cast("long").alias("line_no"))


def file_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """``position, line``: sorted paths as an indented tree, folders with a slash.

    Every beginning of a path is a row; sorting these as arrays of names is the
    order of the tree.
    """
    parts = F.split(F.col(path), "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.slice(parts, F.lit(1), k).alias("at"), (k < F.size(parts)).alias("folder")))
    rows = paths.select(F.explode(heads).alias("h")).select("h.*").groupBy("at").agg(F.max("folder").alias("folder"))
    line = F.concat(F.repeat(F.lit("  "), F.size("at") - 1), F.element_at("at", -1), F.when(F.col("folder"), "/").otherwise(""))
    ordered = rows.withColumn("position", F.row_number().over(Window.orderBy("at")))  # names of a pack, not of a corpus
    return ordered.select(F.col("position").cast("long").alias("position"), line.alias("line"))


def cycle_fixes(cycles: DataFrame) -> DataFrame:
    """``cycle, fix``: the standard ways to break each cycle."""
    return cycles.select("cycle", F.explode(F.array(*[F.lit(x) for x in FIXES])).alias("fix"))


def insights(dead_files: DataFrame, dead_symbols: DataFrame, cycles: DataFrame) -> DataFrame:
    """``what, n``: counts that follow an index run."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("dead files", dead_files), ("dead symbols", dead_symbols), ("cycles", cycles))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def valid_syntax(files: DataFrame) -> DataFrame:
    """``path, valid``: brackets that close in the right order; languages without a rule are valid.

    Comments and strings go first; a fold over the brackets alone keeps the open ones.
    """
    code = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/|//[^\n]*|#[^\n]*", ""), r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", "")
    known = F.col("language").isin("typescript", "javascript", "python", "go", "rust", "java", "csharp", "cpp", "c", "php")
    brackets = F.filter(F.split(F.regexp_replace(code, r"[^()\[\]{}]", ""), ""), lambda c: c != "")

    def step(acc, c):
        opens = F.substring(acc, 1, 1)
        pair = F.concat(opens, c).isin("()", "[]", "{}")
        closes = F.when(pair, F.substring(acc, 2, 2**30)).otherwise(F.concat(F.lit("!"), acc))
        return F.when(acc.startswith("!"), acc).when(c.isin("(", "[", "{"), F.concat(c, acc)).otherwise(closes)

    return files.select("path", F.when(known, F.aggregate(brackets, F.lit(""), step) == "").otherwise(True).alias("valid"))


def health_tree(layers: DataFrame, cycles: DataFrame, dead: DataFrame, most_cycles: int = 20, most_dead: int = 30) -> DataFrame:
    """``section, position, label, n``: layers with their sizes, the first cycles, the first dead files.

    ``layers``: layer, files; ``cycles``: cycle (text); ``dead``: path.
    """

    def first(df: DataFrame, section: str, label, n, most: int | None, *order) -> DataFrame:
        top = df.orderBy(*order).limit(most) if most else df
        rows = top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
        return rows.select(F.lit(section).alias("section"), "position", label.alias("label"), n.cast("long").alias("n"))

    none = F.lit(None)
    return (
        first(layers.where("layer is not null"), "layers", F.col("layer"), F.col("files"), None, "layer")
        .unionByName(first(cycles, "cycles", F.col("cycle"), none, most_cycles, "cycle"))
        .unionByName(first(dead, "dead files", F.col("path"), none, most_dead, "path"))
    )


def leaderboard(results: DataFrame) -> DataFrame:
    """One row ``document``: a table of tasks and their averages in markdown, by data set.

    ``results``: dataset, task, recall, precision (0 to 1), tokens, savings (%), ms.
    """
    cell = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    percent = lambda x: F.concat(cell(x * 100), F.lit("%"))
    row = F.concat_ws(" | ", F.concat(F.lit("| "), "task"), percent(F.col("recall")), percent(F.col("precision")), F.format_number("tokens", 0), F.concat(cell(F.col("savings")), F.lit("%")), F.concat(cell(F.col("ms")), F.lit(" ms |")))
    mean = F.concat_ws(" | ", F.lit("| all tasks"), percent(F.avg("recall")), percent(F.avg("precision")), F.lit("-"), F.concat(cell(F.avg("savings")), F.lit("%")), F.concat(cell(F.avg("ms")), F.lit(" ms |")))
    tables = results.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("task", row.alias("line")))).alias("rows"), mean.alias("mean"))
    head = F.concat(F.lit("## "), "dataset", F.lit("\n\n| Task | Recall | Precision | Tokens | Savings | Latency |\n| - | - | - | - | - | - |\n"))
    text = F.concat(head, F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("\n"), "mean", F.lit("\n"))
    return tables.agg(F.sort_array(F.collect_list(F.struct("dataset", text.alias("t")))).alias("t")).select(F.array_join(F.transform("t", lambda x: x["t"]), "\n").alias("document"))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """``report, metric, value`` from sub-reports of one row each; a broken one breaks the report."""
    out = None
    for name, df in parts.items():
        values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        part = df.select(F.lit(name).alias("report"), F.explode(values).alias("v")).select("report", "v.*")
        out = part if out is None else out.unionByName(part)
    return out
