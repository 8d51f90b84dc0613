"""Node metrics, graph summary, hotspots, dead code, layers, services, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import files
from graphloom.functions.scalars import api_path, half_up


def node_metrics(edges: DataFrame) -> DataFrame:
    """Degrees (parallel edges count), instability, and the god, leaf and root flags.

    One aggregation over both ends of every edge, so the edges shuffle once.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    m = ends.select("e.*").groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    total = F.col("in_degree") + F.col("out_degree")
    return m.select(
        "node",
        "in_degree",
        "out_degree",
        total.alias("total_degree"),
        half_up(F.col("out_degree") / total, 3).alias("instability"),
        (total >= 10).alias("is_god"),
        ((F.col("out_degree") == 0) & (F.col("in_degree") > 0)).alias("is_leaf"),
        ((F.col("in_degree") == 0) & (F.col("out_degree") > 0)).alias("is_root"),
    )


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average degree."""
    m = node_metrics(edges).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"))
    n, e = F.col("nodes"), F.col("edges")
    density = F.when(n > 1, half_up(e / F.greatest(n * (n - 1), F.lit(1)), 4)).otherwise(0.0)
    return m.select("nodes", "edges", density.alias("density"), F.when(n > 0, half_up(2 * e / F.greatest(n, F.lit(1)), 2)).otherwise(0.0).alias("average_degree"))


def top_by_degree(metrics: DataFrame, k: int) -> DataFrame:
    return metrics.orderBy(F.desc("total_degree"), "node").limit(k)


def unstable(metrics: DataFrame, k: int) -> DataFrame:
    return metrics.where("out_degree > 2 and instability >= 0.8").orderBy(F.desc("instability"), "node").limit(k)


def hotspot_score(churn: Column, instability: Column, in_degree: Column) -> Column:
    return half_up(churn * (1 + 2 * instability) * (1 + F.log1p(in_degree.cast("double"))) + 0.5 * in_degree, 2)


def hotspot_risk(score: Column, god: Column, churn: Column, instability: Column, in_degree: Column) -> Column:
    return (
        F.when((score >= 15) | (god & (churn > 3)), "critical")
        .when((score >= 8) | (instability > 0.8), "high")
        .when((score >= 3) | (in_degree > 5), "medium")
        .otherwise("low")
    )


def hotspots(metrics: DataFrame, churn: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of highest degree with churn score and risk; ``churn``: node, churn."""
    top = top_by_degree(metrics, k).join(churn, "node", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    scored = top.withColumn("score", hotspot_score(F.col("churn"), F.col("instability"), F.col("in_degree")))
    risk = hotspot_risk(F.col("score"), F.col("is_god"), F.col("churn"), F.col("instability"), F.col("in_degree"))
    return scored.select("node", "churn", "score", risk.alias("risk"))


def git_metrics(commits: DataFrame) -> DataFrame:
    """``file, churn, last_modified, owner, authors``; the owner has most commits, ties go to the newest."""
    by_author = commits.groupBy("file", "author").agg(F.count(F.lit(1)).alias("commits"), F.max("committed").alias("newest"))
    return by_author.groupBy("file").agg(
        F.sum("commits").alias("churn"),
        F.max("newest").alias("last_modified"),
        F.max_by("author", F.struct("commits", "newest", -F.col("author"))).alias("owner"),
        F.sort_array(F.collect_list(F.struct(F.col("commits"), F.col("author"))), asc=False).alias("authors"),
    )


#: Languages that are not code, for the search for dead files.
NOT_CODE = ["markdown", "json", "yaml", "toml", "html", "css", "scss", "dockerfile", "unknown", "shell"]


def dead_files(table: DataFrame, edges: DataFrame, path: str = "relative_path") -> DataFrame:
    """Code files that nothing depends on and that are no test, entry or generated file."""
    p = F.col(path)
    code = table.where(~files.is_test(p) & ~files.is_generated(p) & ~files.is_entry(p) & ~files.language(p).isin(NOT_CODE))
    return code.join(edges.select(F.col("dst").alias(path)).distinct(), path, "left_anti")


def dead_symbols(symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """Exported symbols whose name nobody imports; ``imported`` has ``name``."""
    return symbols.where("exported").join(imported.select("name").distinct(), "name", "left_anti")


def _rule(name: str):
    return name.lower().strip()


def layer_violations(edges: DataFrame, layers=None, allow=(), disallow=()) -> DataFrame:
    """Edges between layers that a rule forbids: ``src, dst, source_layer, target_layer, type, severity, rule``."""
    ends = F.struct(files.layer(F.col("src"), layers).alias("s"), files.layer(F.col("dst"), layers).alias("t"))
    # One row out of a generator: the filters below do not compute the layers again.
    e = edges.withColumn("ends", F.explode(F.array(ends))).select(*edges.columns, F.col("ends.s").alias("source_layer"), F.col("ends.t").alias("target_layer"))
    e = e.where("source_layer is not null and target_layer is not null and source_layer <> target_layer")
    s, t = F.col("source_layer"), F.col("target_layer")
    key, star, to = F.lower(F.concat_ws(" -> ", s, t)), F.lower(F.concat(s, F.lit(" -> *"))), F.lower(F.concat(F.lit("* -> "), t))
    st, tt = files.layer_type(s), files.layer_type(t)
    found = lambda kind, severity, rule: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))
    banned = [_rule(x) for x in disallow]
    verdict = F.when(key.isin(banned) | star.isin(banned), found("CUSTOM_RULE_VIOLATION", "HIGH", "disallowed")) if banned else F.when(F.lit(False), found("", "", ""))
    if allow:
        ok = [_rule(x) for x in allow]
        verdict = verdict.when(~(key.isin(ok) | star.isin(ok) | to.isin(ok)) & (s != "shared") & (t != "shared"), found("LAYER_REGRESSION", "MEDIUM", "not allowed"))
    else:
        verdict = (
            verdict.when((st == "presentation") & (tt == "infrastructure"), found("LAYER_REGRESSION", "HIGH", "layer bypass"))
            .when((st == "domain") & (tt == "infrastructure"), found("LAYER_REGRESSION", "CRITICAL", "dependency inversion"))
            .when((st == "domain") & tt.isin("application", "presentation"), found("LAYER_REGRESSION", "CRITICAL", "outward dependency"))
            .when((st == "application") & (tt == "presentation"), found("LAYER_REGRESSION", "HIGH", "inverted dependency"))
        )
    return e.withColumn("v", verdict).where("v is not null").select("src", "dst", "source_layer", "target_layer", "v.type", "v.severity", "v.rule")


def context_violations(edges: DataFrame) -> DataFrame:
    """Edges into another bounded context that bypass its public files."""
    e = edges.withColumns({"source_context": files.bounded_context(F.col("src")), "target_context": files.bounded_context(F.col("dst"))})
    e = e.where("source_context <> '' and target_context <> '' and source_context <> target_context")
    return e.where(~files.is_public_api(F.col("dst"))).select("src", "dst", "source_context", "target_context", F.lit("HIGH").alias("severity"))


def clean_score(violations: DataFrame, n_files: int) -> DataFrame:
    """One row: severity histogram and the clean score."""
    hist = violations.agg(*[F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")])
    weighted = 20 * F.col("critical") + 10 * F.col("high") + 5 * F.col("medium") + 2 * F.col("low")
    penalty = F.least(F.lit(100.0), half_up(weighted / F.lit(float(max(n_files, 1))) * 50, 0))
    none = (F.col("critical") + F.col("high") + F.col("medium") + F.col("low")) == 0
    return hist.withColumn("score", F.when(none, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.greatest(F.lit(10.0), penalty))))


def service_edges(services: DataFrame, exports: DataFrame, consumes: DataFrame) -> DataFrame:
    """API edges between services: ``src, dst, endpoint``, where a consumed path fits an exported one.

    A segment ``:x`` or ``{x}`` of either side fits any segment.  Paths have a
    shape: how many segments, and which are wild.  For every pair of shapes that
    occur, the segments that neither has wild must be equal, so that is an equal
    join and no pair of unrelated endpoints is formed.
    """
    offered = exports.select(F.col("service_id").alias("dst"), api_path(F.col("path")).alias("offer")).distinct()
    wanted = consumes.select(F.col("service_id").alias("src"), api_path(F.col("path")).alias("endpoint")).distinct()
    shaped = []
    for df, c in ((offered, "offer"), (wanted, "endpoint")):
        segs = F.split(F.col(c), "/")
        shape = F.array_join(F.transform(segs, lambda x: F.when(x.startswith(":") | x.startswith("{"), "*").otherwise("=")), "")
        shaped.append(df.where(F.col(c) != "").withColumns({f"{c}_shape": shape, "size": F.size(segs)}))
    offered, wanted = shaped
    both = offered.select("size", "offer_shape").distinct().join(wanted.select("size", "endpoint_shape").distinct(), "size")

    def fixed(c: str):
        return F.array_join(
            F.transform(
                F.split(F.col(c), "/"),
                lambda x, i: F.when((F.substring(F.col("offer_shape"), i + 1, F.lit(1)) == "*") | (F.substring(F.col("endpoint_shape"), i + 1, F.lit(1)) == "*"), "*").otherwise(F.concat(F.lit("="), x)),
            ),
            "/",
        )

    a = offered.join(both, ["size", "offer_shape"]).select("dst", "offer_shape", "endpoint_shape", fixed("offer").alias("key"))
    b = wanted.join(both, ["size", "endpoint_shape"]).select("src", "endpoint", "offer_shape", "endpoint_shape", fixed("endpoint").alias("key"))
    return b.join(a, ["offer_shape", "endpoint_shape", "key"]).where("src <> dst").select("src", "dst", "endpoint").distinct()


def health_checks(index_state: DataFrame, files: DataFrame, edges: DataFrame, rules: DataFrame, conflicts: DataFrame, symbols: DataFrame, intact: bool = True) -> DataFrame:
    """``check, status, score``: index, files, dependencies, rules, integrity, coverage of symbols.

    ``files``: path, language; ``symbols``: path; the others are only counted.
    """
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    code = files.where(F.col("language").isin("typescript", "javascript"))
    covered = code.join(symbols.select("path").distinct(), "path", "left_semi")
    one = n(index_state, "index")
    for df, name in ((files, "files"), (edges, "edges"), (rules, "rules"), (conflicts, "conflicts"), (code, "code"), (covered, "covered")):
        one = one.join(F.broadcast(n(df, name)))  # one row each
    share = F.when(F.col("code") == 0, 100.0).otherwise(half_up(F.col("covered") / F.greatest(F.col("code"), F.lit(1)) * 100, 0))
    row = lambda check, status, score: F.struct(F.lit(check).alias("check"), status.alias("status"), score.cast("double").alias("score"))
    verdict = lambda bad, low, high, level: (F.when(bad, level).otherwise("pass"), F.when(bad, low).otherwise(high))
    rule_state = F.when((F.col("rules") == 0) | (F.col("conflicts") > 0), "warn").otherwise("pass")
    checks = [
        row("Index", *verdict(F.col("index") == 0, 0, 95, "fail")),
        row("Files", *verdict(F.col("files") == 0, 0, 100, "fail")),
        row("Dependencies", *verdict((F.col("edges") == 0) & (F.col("files") > 5), 50, 90, "warn")),
        row("Rules", rule_state, F.when(F.col("rules") == 0, 60).when(F.col("conflicts") > 0, 70).otherwise(95)),
        row("Integrity", *verdict(F.lit(not intact), 0, 100, "fail")),
        row("Coverage", F.when(share > 80, "pass").otherwise("warn"), share),
    ]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def health(checks: DataFrame) -> DataFrame:
    """One row: the rounded mean of the checks' scores."""
    return checks.agg(F.floor(F.avg("score") + 0.5).cast("long").alias("score"))


def top_complexity(symbols: DataFrame, k: int) -> DataFrame:
    return symbols.where("complexity is not null").orderBy(F.desc("complexity"), "symbol_id").limit(k)


def with_row_number(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


#: Languages that the language mode tells apart, by name or by extension.
COLORED = {
    "typescript": ("ts", "tsx"), "javascript": ("js", "jsx"), "csharp": ("cs",), "cpp": ("cpp", "c", "h"), "java": ("java",), "ruby": ("rb",), "kotlin": ("kt",),
    "swift": ("swift",), "php": ("php",), "python": ("py",), "css": ("css", "scss", "less"), "html": ("html", "htm"),
}
#: Inclusive upper ends of the bins of a mode.
BIN_ENDS = {"churn": (0, 3, 8, 15), "instability": (0.25, 0.5, 0.75), "impact": (0, 2, 5, 10)}
CLUSTERS = 8


def _bin(value: Column, ends: tuple) -> Column:
    out = F.lit(len(ends))
    for k, end in reversed(list(enumerate(ends))):
        out = F.when(value <= end, k).otherwise(out)
    return out


def color_bins(nodes: DataFrame) -> DataFrame:
    """Adds ``bins``: the bin of each of the seven colour modes of a node.

    ``nodes``: name, language, community, churn, instability, is_god, in_degree,
    risk, size; nulls count as 0.  ``-1`` in instability is a god object.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ending, lang = F.lower(F.substring_index("name", ".", -1)), F.lower("language")
    language = F.lit("other")
    for name, endings in reversed(COLORED.items()):
        language = F.when((lang == name) | ending.isin(*endings) | ((lang == "c") if name == "cpp" else F.lit(False)), name).otherwise(language)
    size = zero("size")
    return nodes.withColumn(
        "bins",
        F.struct(
            language.alias("language"),
            (zero("community") % CLUSTERS).cast("int").alias("cluster"),
            _bin(zero("churn"), BIN_ENDS["churn"]).alias("churn"),
            F.when(F.col("is_god"), -1).otherwise(_bin(zero("instability"), BIN_ENDS["instability"])).alias("instability"),
            _bin(zero("in_degree"), BIN_ENDS["impact"]).alias("impact"),
            F.when(F.col("risk") == "critical", 3).when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0).alias("hotspot"),
            F.when(size < 1000, 0).when(size < 4000, 1).when(size < 12000, 2).otherwise(3).alias("size"),
        ),
    )
