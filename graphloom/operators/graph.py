"""Graph algebra over an edge table: hops, paths, impact, centrality, groups, cycles.

Edges are a DataFrame with ``src`` and ``dst``; parallel edges count.  Walks
are driver loops over frontier joins: each round is one join of the frontier
with the edges and one anti join against what was seen, written to the shared
checkpoint folder so that the lineage stays short and a lost executor costs
one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import half_up
from graphloom.sources.store import shared_home

#: Fixed value: ends of the names of files where requests come in.
INGRESS = r"(?i)(index|main|app|server|cli|command|route|controller)\.(ts|js|py|go|rs)$"
#: Fixed value: names that mark a test.
TESTS = r"(?i)(test|spec|__tests__)"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_home(df.sparkSession))
    return df.checkpoint()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def reach(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``seed, node, depth``: least depth (1 to ``depth``) at which a node is reached.

    ``seeds`` has one column ``seed``; a seed itself is not among its nodes.
    Breadth first, so no node within reach is missed.
    """
    hops = cut(edges.select("src", "dst").distinct())
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(hops, frontier.node == hops.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def seeds_of(spark, values: list, kind: str = "long") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"seed {kind}")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


def blast_radius(seeds: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """``node, depth``: what depends on the seeds, seeds left out, least depth."""
    hit = reach(seeds, reverse(edges), max_depth).groupBy("node").agg(F.min("depth").alias("depth"))
    return hit.join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")


def blast_summary(seeds: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """One row: direct, transitive, highest in-degree of the seeds, severity."""
    hit = blast_radius(seeds, edges, max_depth)
    counts = hit.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    most = in_degree(edges).join(seeds.select(F.col("seed").alias("node")), "node").agg(F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in_degree"))
    severity = (
        F.when((F.col("max_in_degree") >= 10) | (F.col("direct") >= 10), "CRITICAL")
        .when((F.col("max_in_degree") >= 5) | (F.col("direct") >= 5), "HIGH")
        .when((F.col("direct") > 0) | (F.col("transitive") > 0), "MEDIUM")
        .otherwise("LOW")
    )
    return counts.join(F.broadcast(most)).withColumn("severity", severity)  # one row each


def change_surface(seeds: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """One row: direct, transitive, tests, risk score and level of a change."""
    hit = blast_radius(seeds, edges, max_depth)
    total = nodes(edges).agg(F.count(F.lit(1)).alias("total"))
    counts = hit.agg(
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("depth") > 1).alias("transitive"),
        F.count_if(F.col("node").cast("string").rlike(TESTS)).alias("tests"),
    ).join(F.broadcast(total))  # one row each
    score = F.least(F.lit(100.0), half_up((2 * F.col("direct") + F.col("transitive")) / F.greatest(F.col("total"), F.lit(1)) * 100, 1))
    out = counts.withColumn("risk_score", score)
    level = F.lit("LOW")
    for name, least, most in (("MEDIUM", 10, 3), ("HIGH", 25, 10), ("CRITICAL", 50, 20)):
        level = F.when((F.col("risk_score") > least) | (F.col("direct") > most), name).otherwise(level)
    return out.withColumn("risk_level", level).drop("total")


def shortest_path(edges: DataFrame, start, end, max_depth: int = 20) -> DataFrame:
    """One row ``path`` (the smallest of the shortest), or none; ``[start]`` if start is end."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    if start == end:
        return spark.createDataFrame([([start],)], f"path array<{kind}>")
    hops = cut(edges.select("src", "dst").distinct())
    frontier = spark.createDataFrame([(start, [start])], f"node {kind}, path array<{kind}>")
    seen = frontier.select("node")
    for _ in range(max_depth):
        step = frontier.join(hops, frontier.node == hops.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        found = frontier.where(F.col("node") == F.lit(end)).select("path")
        if not found.isEmpty() or frontier.isEmpty():
            return found
        seen = seen.unionByName(frontier.select("node"))
    return frontier.where(F.lit(False)).select("path")


def execution_path(edges: DataFrame, start, end) -> DataFrame:
    """``step, src, dst, kind, confidence, path_confidence`` along the shortest path."""
    path = shortest_path(edges, start, end)
    steps = path.select(F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("src"), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("dst"))).alias("step", "e"))
    steps = steps.select((F.col("step") + 1).alias("step"), "e.src", "e.dst")
    first = edges.groupBy("src", "dst").agg(F.min(F.struct("kind", "confidence")).alias("f"))
    out = steps.join(first, ["src", "dst"], "left").select("step", "src", "dst", "f.kind", F.coalesce("f.confidence", F.lit(0.9)).alias("confidence"))
    total = out.agg(half_up(F.product("confidence"), 2).alias("path_confidence"))
    return out.join(F.broadcast(total))  # one row


def entry_points(edges: DataFrame, target, max_depth: int = 10) -> DataFrame:
    """``node, distance, is_root, chain``: where calls that reach the target come in.

    A node without dependents is a root and ends its branch; a node whose name
    marks an ingress is reported and the walk goes on behind it.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    hops = cut(edges.select("src", "dst").distinct())
    called = in_degree(edges).select("node").distinct()
    frontier = spark.createDataFrame([(target, [target])], f"node {kind}, chain array<{kind}>")
    seen, found = frontier.select("node"), None
    for d in range(1, max_depth):
        step = frontier.join(hops, frontier.node == hops.dst).select(F.col("src").alias("node"), F.concat(F.array("src"), "chain").alias("chain"))
        frontier = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("chain").alias("chain")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node"))
        roots = frontier.join(called, "node", "left_anti").withColumn("is_root", F.lit(True))
        others = frontier.join(called, "node", "left_semi").where(F.col("node").cast("string").rlike(INGRESS)).withColumn("is_root", F.lit(False))
        here = roots.unionByName(others).select("node", F.lit(d).alias("distance"), "is_root", "chain")
        found = here if found is None else found.unionByName(here)
    empty = spark.createDataFrame([], f"node {kind}, distance int, is_root boolean, chain array<{kind}>")
    return empty if found is None else found


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """``node, rank``: fixed iterations, parallel edges share, dangling mass to all nodes."""
    weights = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    out = weights.groupBy("src").agg(F.sum("w").alias("out"))
    links = cut(weights.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    every = cut(nodes(edges).join(out.select(F.col("src").alias("node"), F.lit(True).alias("gives")), "node", "left"))
    n = every.count()
    ranks = every.select("node", F.lit(1.0 / max(n, 1)).alias("rank"), F.col("gives").isNull().alias("dangling"))
    for _ in range(iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = cut(
            ranks.join(got, ranks.node == got.dst, "left")
            .join(F.broadcast(lost))  # one row
            .select("node", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("rank"), "dangling")
        )
    return ranks.select("node", "rank")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 in an order, without gathering them in one task.

    Ranges are sorted on their own; the table of range sizes has a row a
    partition, and that alone is summed in one place.
    """
    parts = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_k", within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_k")).drop("_part", "_k", "_start")


def communities(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """``node, community``: label propagation, both directions, weights summed.

    All nodes move at once and a tie goes to the smaller label; a node keeps its
    label when that ties with the best, which stops two-coloured graphs from
    swapping for ever.  Communities are numbered densely by their smallest node.
    """
    both = edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    )
    both = cut(both.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    labels = cut(nodes(edges).withColumn("label", F.col("node")))
    for _ in range(iterations):
        votes = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node"), F.col("label").alias("vote")).agg(F.sum("w").alias("w"))
        kept = votes.join(labels, "node").withColumn("own", F.col("vote") == F.col("label"))
        best = kept.groupBy("node").agg(F.max("w").alias("top"))
        winner = kept.join(best.select("node", "top"), "node").where("w = top").groupBy("node").agg(F.max("own").alias("stay"), F.min("vote").alias("vote"))
        after = cut(labels.join(winner, "node", "left").select("node", F.when(F.col("stay"), F.col("label")).otherwise(F.coalesce("vote", "label")).alias("label"), (F.coalesce("stay", F.lit(True)) | (F.col("vote") == F.col("label"))).alias("same")))
        labels = after.select("node", "label")
        if after.where(~F.col("same")).isEmpty():
            break
    heads = labels.groupBy("label").agg(F.min("node").alias("head"))
    return labels.join(numbered(heads, "head", "community"), "label").select("node", "community")


def among(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes kept."""
    return cut(edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component``: strongly connected components by their smallest node.

    Nodes without an edge in or out are components of their own and go first.
    Then forward-backward colouring: the smallest node that reaches a node is
    its colour; the nodes of a colour that also reach their colour's node form a
    component; the rest goes another round.  Both walks go on until nothing
    moves, so a component of any length is found whole.
    """
    spark = edges.sparkSession
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    todo = cut(nodes(edges))
    found: list[DataFrame] = []

    def add(part: DataFrame) -> None:
        found.append(part)
        if len(found) == 50:  # keeps the plan small
            found[:] = [cut(reduce(DataFrame.unionByName, found))]

    while not todo.isEmpty():
        core = cut(left.select(F.col("src").alias("node")).intersect(left.select("dst")))
        alone = cut(todo.join(core, "node", "left_anti"))
        if not alone.isEmpty():
            add(alone.withColumn("component", F.col("node")))
            todo, left = core, among(core, left)
            continue
        colour = todo.withColumn("colour", F.col("node"))
        while True:
            low = left.join(colour, left.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            after = cut(colour.join(low, "node", "left").select("node", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
            colour = after.select("node", "colour")
            if after.where("moved").isEmpty():
                break
        back = cut(colour.where("node = colour"))
        frontier = back
        same = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        same = cut(same.select("src", "dst", "cs"))
        while True:
            step = same.join(frontier, same.dst == frontier.node).select(F.col("src").alias("node"), F.col("cs").alias("colour")).distinct()
            frontier = cut(step.join(back, "node", "left_anti"))
            if frontier.isEmpty():
                break
            back = cut(back.unionByName(frontier))
        add(back.select("node", F.col("colour").alias("component")))
        todo = cut(todo.join(back, "node", "left_anti"))
        left = among(todo, left)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"node {dict(edges.dtypes)['src']}, component {dict(edges.dtypes)['src']}")


def simple_cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """``cycle``: simple cycles of at most ``longest`` edges, smallest node first and last."""
    hops = cut(edges.select("src", "dst").distinct())
    paths = hops.select(F.array("src").alias("path"), "dst").where("dst >= src")
    found = None
    for k in range(1, longest + 1):
        closed = paths.where(F.col("dst") == F.element_at("path", 1)).select(F.concat("path", F.array("dst")).alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        if k == longest:
            break
        open_ = paths.where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst")))
        open_ = open_.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
        on = open_["last"] == hops.src
        if k == longest - 1:  # the last edge can only close
            on &= F.element_at("path", 1) == hops.dst
        paths = cut(open_.join(hops, on).where(F.col("dst") >= F.element_at("path", 1)).select("path", "dst"))
    return found.distinct()


def back_edge_cycles(edge_list: list[tuple]) -> list[list]:
    """Sequential parity form: a depth-first walk in edge order, a cycle for each back edge."""
    after: dict = {}
    for a, b in edge_list:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    out, keys, state = [], set(), {}
    for root in after:
        if root in state:
            continue
        stack, path = [(root, iter(after[root]))], [root]
        state[root] = 1
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                stack.pop()
                path.pop()
                state[node] = 2
            elif state.get(nxt) == 1:
                cycle = path[path.index(nxt) :]
                turn = min(range(len(cycle)), key=lambda i: cycle[i:] + cycle[:i])
                cycle = cycle[turn:] + cycle[:turn]
                if tuple(cycle) not in keys:
                    keys.add(tuple(cycle))
                    out.append([*cycle, cycle[0]])
            elif nxt not in state:
                state[nxt] = 1
                path.append(nxt)
                stack.append((nxt, iter(after[nxt])))
    return out


def containment(paths: DataFrame, col: str = "relative_path") -> DataFrame:
    """``parent, child``: directory containment edges; top-level directories have no parent."""
    parts = F.split(col, "/")
    prefix = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    levels = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.struct(prefix(k - 1).alias("parent"), prefix(k).alias("child")))).otherwise(
        F.array().cast("array<struct<parent:string,child:string>>")
    )
    return paths.select(F.explode(levels).alias("e")).select("e.*").distinct()


def risk_bucket(dependents: Column) -> Column:
    """Editor scale of a node's dependents."""
    return F.when(dependents >= 10, "critical").when(dependents >= 5, "high").when(dependents >= 2, "medium").when(dependents >= 1, "low").otherwise("leaf")
