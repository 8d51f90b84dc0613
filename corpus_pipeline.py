"""Corpus preparation: quality rules, line dedup, near-duplicate join,
benchmark decontamination, best-fit packing.

Defined results of every stage: a null or empty text is a document without
words, which the quality rules reject; long texts are read whole; rows that
repeat id and text are judged alike, and of such rows the join keeps one; null
ids count as documents of their own; where documents tie, the smallest id (or
the earliest line of the smallest id) stays; other columns stay as they are,
whatever their names, but ``n_chars``, which follows the text; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bestfit, decontam, linededup, ngramjoin, quality
from graphloom.llm.common import materialize, table

CAPACITY = 1024


def _wrapped(docs: DataFrame) -> DataFrame:
    """``all`` (the row but for its text), ``doc_id``, ``text``: names that no other column clashes with."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("all"), "doc_id", "text")


def _unwrapped(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some with other values."""
    changed["text"] = F.col("text")
    return rows.select(*[changed.get(c, F.col("all")[c]).alias(c) for c in docs.columns])


def _key() -> list[Column]:
    """A document as its id and two hashes of its text."""
    return [F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _unwrapped(quality.quality_rules(_wrapped(docs)).where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Duplicate lines go, and with them documents that keep no word."""
    out = linededup.dedup_lines(_wrapped(docs))
    left = F.translate(F.coalesce("text", F.lit("")), quality.SPACES, "") != ""
    out = out.where(F.col("ld_removed").isNull() | left)
    return _unwrapped(out, docs, n_chars=F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = materialize(ngramjoin.join_documents(docs))
    repeated = materialize(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id"))
    out = _wrapped(docs).join(groups.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti")
    if not repeated.isEmpty():
        mine, again = F.col("doc_id").eqNullSafe(F.col("other")), repeated.select(F.col("doc_id").alias("other"))
        out = out.join(again, mine, "left_anti").unionByName(out.join(again, mine, "left_semi").dropDuplicates(["doc_id", "text"]))
    return _unwrapped(out, docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    hits = decontam.find_hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = materialize(hits.where("n_hit > 0").select(*_key()).distinct())
    return _unwrapped(_wrapped(docs).select("*", *_key()).join(found, ["id", "h1", "h2"], "left_anti"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; a row a piece."""
    return bestfit.pack_documents(docs, CAPACITY)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: Packing needs a tokenizer, which SQL has not: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
