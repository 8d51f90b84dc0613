"""One object over a project's tables: each tool of the engine is a method that returns a DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import describe, graph, metrics, packing, reports, search, security, semantic
from graphloom.plans import pattern, sqlguard
from graphloom.sources import scan, store


@dataclass
class Project:
    """``files``: path, language, content; ``edges``: src, dst, kind, symbol, weight, confidence;
    ``symbols``: symbol_id, path, name, kind, complexity, exported."""

    spark: SparkSession
    files: DataFrame
    edges: DataFrame
    symbols: DataFrame

    def scan(self, root: str, ignore: list[str] = ()) -> DataFrame:
        return scan.scan(self.spark, root, ignore)

    def index(self, root: str, table_path: str) -> DataFrame:
        rows = self.scan(root).select("path", "language", "hash", "content")
        return store.index(rows, store.Table(self.spark, table_path, ["path"]))

    def search(self, text: str, limit: int = 20) -> DataFrame:
        from graphloom.functions import scalars as sc

        terms = self.spark.range(1).select(sc.search_terms(F.lit(text))).first()[0]
        empty = self.spark.createDataFrame([], "path string, score double")
        return search.bm25(self.files, "path", "content", terms, limit) if terms else empty

    def get_context(self, task: str, budget: int = 8000, limit: int = 15, intent: str = "", weights: dict[str, float] | None = None) -> DataFrame:
        from graphloom.functions import scalars as sc

        terms = self.spark.range(1).select(sc.retrieval_terms(F.lit(task))).first()[0]
        sources = search.retrieve(self.files, self.symbols, self.edges, self.search(task, limit), terms, intent, limit)
        ranked = search.rank(sources, terms, weights)
        forms = packing.add_forms(self.files.join(F.broadcast(ranked), "path"))  # at most ``limit`` rows
        count = lambda c: sc.tokens(F.col(c))
        sized = forms.select(F.lit(task).alias("task"), "path", "relevance", count("content").alias("full"), count("signature").alias("signature"), count("digest").alias("digest"))
        return packing.pack(sized, budget)

    def benchmark(self, tasks: list[tuple[str, str, list[str]]], dataset: str = "own", budget: int = 8000, limit: int = 15) -> DataFrame:
        """``dataset, task, recall, precision, tokens, savings, ms`` of each task (name, query, expected files).

        Tasks run one after the other, since each is timed; a task has at most ``limit`` rows.
        Savings are of the tokens of all files, in whole percent.
        """
        from graphloom.functions import scalars as sc

        whole = self.files.agg(F.sum(sc.tokens(F.col("content")))).first()[0] or 0
        found, sums = [], []
        for name, text, _ in tasks:
            start = time.perf_counter()
            rows = self.get_context(text, budget, limit, weights=search.BENCHMARK_WEIGHTS).collect()
            used = sum(r.tokens for r in rows)
            found += [(name, r.path) for r in rows]
            sums.append((name, used, float(max(0, int((whole - used) / whole * 100 + 0.5))) if whole else 0.0, (time.perf_counter() - start) * 1000))
        expected = self.spark.createDataFrame([(name, x) for name, _, files in tasks for x in files], "task string, expected string")
        scores = search.recall(self.spark.createDataFrame(found, "task string, path string"), expected)
        costs = self.spark.createDataFrame(sums, "task string, tokens long, savings double, ms double")
        zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("recall", "precision")]
        return costs.join(F.broadcast(scores), "task", "left").select(F.lit(dataset).alias("dataset"), "task", *zero, "tokens", "savings", "ms")  # one row a task

    def signatures(self) -> DataFrame:
        return describe.described(self.files)

    def semantic_edges(self) -> DataFrame:
        return semantic.semantic_edges(self.files, semantic.path_map(self.files))

    def graph_query(self, text: str, nodes: DataFrame | None = None) -> DataFrame:
        links = self.edges.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.upper("kind").alias("type"))
        return pattern.run(pattern.to_query(text), links, nodes)

    def pr_diff(self, changed: list[str]) -> DataFrame:
        seeds = graph.seeds_of(self.spark, changed, "string")
        near = graph.reach(seeds, graph.reverse(self.edges), 1).select(F.col("node").alias("path")).distinct()
        own = seeds.select(F.col("seed").alias("path"))
        return own.withColumn("score", F.lit(1.0)).unionByName(near.join(own, "path", "left_anti").withColumn("score", F.lit(0.7)))

    def compress(self, path: str, budget: int | None = None) -> DataFrame:
        one = self.files.where(F.col("path") == path).withColumn("content", security.redact(F.col("content")))
        return packing.compress(one, budget)

    def get_map(self, depth: int = 3) -> DataFrame:
        from graphloom.functions import files as ff

        return self.files.where(ff.depth_at_most(F.col("path"), depth)).groupBy(ff.dirname(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("files"))

    def get_rules(self) -> DataFrame:
        return scan.rule_files(self.files)

    def doctor(self) -> DataFrame:
        return reports.insights(self.detect_dead_code(), metrics.dead_symbols(self.symbols, self.edges.select(F.col("symbol").alias("name"))), graph.simple_cycles(self.edges, 3))

    def analyze(self) -> DataFrame:
        return metrics.node_metrics(self.edges)

    def sql_query(self, sql: str, limit: int = 100) -> DataFrame:
        for name, df in (("files", self.files), ("dependencies", self.edges), ("symbols", self.symbols)):
            df.createOrReplaceTempView(name)
        return sqlguard.run(self.spark, sql, limit)

    def fix_circular_dependency(self, longest: int = 3) -> DataFrame:
        return reports.cycle_fixes(graph.simple_cycles(self.edges, longest))

    def security_audit(self) -> DataFrame:
        return security.taint_scan(security.lines_of(self.files, "path", "content"), "path")

    def federate(self, others: dict[str, DataFrame]) -> DataFrame:
        return scan.federate({"own": self.symbols} | others)

    def plan_feature(self, task: str, most: int = 10) -> DataFrame:
        from graphloom.functions import scalars as sc

        terms = self.spark.range(1).select(sc.retrieval_terms(F.lit(task))).first()[0]
        ranked = search.rank(search.retrieve(self.files, self.symbols, self.edges, self.search(task), terms, "feature"), terms)
        return reports.plan_feature(ranked, self.edges, most)

    def detect_dead_code(self) -> DataFrame:
        return metrics.dead_files(self.files, self.edges, "path")

    def complexity_report(self, k: int = 20) -> DataFrame:
        return metrics.top_complexity(self.symbols, k)

    def trace_execution_path(self, start: str, end: str) -> DataFrame:
        return graph.execution_path(self.edges, start, end)

    def find_entry_points(self, target: str, depth: int = 10) -> DataFrame:
        return graph.entry_points(self.edges, target, depth)

    def calculate_change_surface(self, changed: list[str], depth: int = 5) -> DataFrame:
        return graph.change_surface(graph.seeds_of(self.spark, changed, "string"), self.edges, depth)
