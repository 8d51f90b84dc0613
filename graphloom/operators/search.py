"""Full-text search (BM25), vector search, rank fusion, retrieval and ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as sc
from graphloom.operators.graph import cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def ranked(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows in an order, with their 1-based rank."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def fuse(a: DataFrame, b: DataFrame, key: str, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of two rankings; a missing rank counts as 3 * limit."""
    miss = F.lit(3 * limit)
    both = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full_outer")
    score = 1.0 / (60 + F.coalesce("ra", miss)) + 1.0 / (60 + F.coalesce("rb", miss))
    return both.select(key, F.round(score, 9).alias("score"))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``: the inverted index, a row a document and term."""
    terms = docs.select(key, F.explode(tokenize(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(tokenize(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("len"))


def _bm25_score(hits: DataFrame, total: DataFrame, key: str, limit: int) -> DataFrame:
    """``hits``: key, len, term, tf; ``total``: one row n, avg_len."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(total))  # a row a term; one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy(key).agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def write_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """The inverted index as files: postings by the first two letters of their term, with the lengths
    of their documents, and the totals of the corpus."""
    sizes = lengths(docs, key, text)
    rows = postings(docs, key, text).join(sizes, key).withColumn("head", F.substring("term", 1, 2))
    # Ranges of the order, so that a term of a third of all documents is spread over tasks too.
    rows.repartitionByRange("head", "term", key).sortWithinPartitions("head", "term").write.partitionBy("head").parquet(f"{path}/postings")
    sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")).write.parquet(f"{path}/totals")


def bm25_of_index(spark, path: str, key: str, terms: list[str], limit: int, prefix: bool = True) -> DataFrame:
    """``bm25`` over a written index: reads the postings of the terms alone, no text."""
    rows, found = spark.read.option("basePath", f"{path}/postings").schema(f"{key} long, term string, tf long, len long, head string").parquet(f"{path}/postings"), None
    for t in terms:
        fits = F.col("term").startswith(t) if prefix else F.col("term") == t
        head = F.col("head") == t[:2] if len(t) > 1 or not prefix else F.col("head").startswith(t)
        own = rows.where(head & fits).groupBy(key, "len").agg(F.sum("tf").alias("tf")).select(key, "len", F.lit(t).alias("term"), "tf")
        found = own if found is None else found.unionByName(own)
    return _bm25_score(found, spark.read.parquet(f"{path}/totals"), key, limit)


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], limit: int, prefix: bool = True) -> DataFrame:
    """``key, score``: top documents for the terms, each a prefix phrase unless told otherwise.

    Only the rows of the query's terms leave the scan of the texts, so the
    shuffle carries hits and not the whole index.
    """
    parts = tokenize(F.coalesce(F.col(text), F.lit("")))
    base = docs.select(key, F.size(parts).cast("long").alias("len"), parts.alias("parts"))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    fits = (lambda p, t: F.startswith(p, F.lit(t))) if prefix else (lambda p, t: p == t)

    def count_of(term: str) -> Column:
        return F.size(F.filter("parts", lambda p: fits(p, term))).cast("long")

    hits = base.select(key, "len", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), count_of(t).alias("tf")) for t in terms])).alias("h"))
    hits = hits.select(key, "len", "h.term", "h.tf").where("tf > 0")
    return _bm25_score(hits, total, key, limit)


def semantic(table: DataFrame, vector: list[float], limit: int, key: str, column: str, least: float = 0.1) -> DataFrame:
    """Cosine similarity to one vector, above ``least``, best first."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return table.select(key, sc.cosine(F.col(column), q).alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), key).limit(limit)


def snippet(text: Column, term: str, width: int = 32) -> Column:
    """Words around the first hit, the hit in brackets."""
    words = F.split(text, r"\s+")
    at = F.array_position(F.transform(words, lambda w: F.contains(F.lower(w), F.lit(term.lower()))), True).cast("int") - 1
    first = F.greatest(F.coalesce(at, F.lit(0)) - width // 2, F.lit(0))
    part = F.array_join(F.slice(words, first + 1, F.lit(width)), " ")
    return F.regexp_replace(part, rf"(?i)({term})", "[$1]")


#: Weights of the ranking signals; the last two only widen the denominator.
WEIGHTS = {"lexical": 0.25, "symbol": 0.2, "path": 0.15, "dependency": 0.15, "module": 0.1, "rule": 0.1, "recency": 0.05}
#: The weights of benchmark runs.
BENCHMARK_WEIGHTS = {"lexical": 0.35, "symbol": 0.2, "path": 0.15, "dependency": 0.1, "module": 0.1, "rule": 0.05, "recency": 0.05}


def retrieve(files: DataFrame, symbols: DataFrame, edges: DataFrame, hits: DataFrame, terms: list[str], intent: str = "", limit: int = 50) -> DataFrame:
    """``path, type, score``: scored sources of candidate files.

    ``files``: path; ``symbols``: path, name; ``edges``: src, dst, kind,
    confidence; ``hits``: path, score of the full-text search.  Keyword, symbol
    and path matches come first; one hop over the edges and the centrality of
    what was matched follow; the intent (bug, feature, refactor) adds boosts.
    """
    want = F.array(*[F.lit(t) for t in terms])
    keyword = hits.select("path", F.lit("keyword").alias("type"), F.greatest(F.lit(1.0), 5 + F.abs("score")).alias("score"))
    named = F.exists(want, lambda t: F.contains(F.lower("name"), t))
    symbol = symbols.where(named).select("path", F.lit("symbol").alias("type"), F.lit(5.5 if intent == "feature" else 4.0).alias("score"))
    by_path = files.select("path", F.lit("path").alias("type"), (3.5 * sc.path_score(F.col("path"), want)).alias("score")).where("score > 0")
    first = cut(keyword.unionByName(symbol).unionByName(by_path))
    keys = first.select("path").distinct()
    heir = F.when(F.col("kind").isin("extends", "implements"), 1.5).otherwise(1.0)
    conf = F.coalesce("confidence", F.lit(0.9))
    out = edges.join(keys.withColumnRenamed("path", "src"), "src", "left_semi")
    out = out.select(F.col("dst").alias("path"), F.lit("dependency").alias("type"), (F.lit(1.4 if intent == "feature" else 0.8) * conf * heir).alias("score"))
    back = edges.join(keys.withColumnRenamed("path", "dst"), "dst", "left_semi")
    back = back.select(F.col("src").alias("path"), F.lit("dependency").alias("type"), (F.lit(1.6 if intent == "bug" else 0.6) * conf).alias("score"))
    reached = cut(first.unionByName(out).unionByName(back))
    every = reached.select("path").distinct()
    most, step = (4.5, 0.6) if intent == "refactor" else (2.5, 0.3)
    centre = edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("k")).join(every, "path", "left_semi")
    centre = centre.select("path", F.lit("centrality").alias("type"), F.least(F.lit(most), step * F.col("k")).alias("score"))
    boosts = {"bug": (r"(?i)(test|spec)", 2.5), "feature": (r"(?i)(interface|model|type|schema)", 2.0), "refactor": (r"(?i)(index|api|public)", 2.0)}
    result = reached.unionByName(centre)
    if intent in boosts:
        pattern, add = boosts[intent]
        result = result.unionByName(every.where(F.col("path").rlike(pattern)).select("path", F.lit("intent").alias("type"), F.lit(add).alias("score")))
    top = result.groupBy("path").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "path").limit(limit)
    return result.join(F.broadcast(top.select("path")), "path", "left_semi")  # at most limit rows


def rank(sources: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``path, relevance``: weighted signals of each candidate, at most 1."""
    w = WEIGHTS | (weights or {})
    of = lambda kind: F.when(F.col("type") == kind, F.col("score"))
    capped = lambda kind: F.least(F.coalesce(F.sum(of(kind)), F.lit(0.0)), F.lit(1.0))
    s = sources.groupBy("path").agg(
        F.least(F.coalesce(F.max(of("keyword")), F.lit(0.0)) / 10, F.lit(1.0)).alias("lexical"),
        capped("symbol").alias("symbol"),
        capped("path").alias("by_path"),
        capped("dependency").alias("dependency"),
    )
    module = F.lower(F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    hit = sum((F.when(F.contains(module, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0)) / F.lit(float(max(len(terms), 1)))
    total = w["lexical"] * F.col("lexical") + w["symbol"] * F.col("symbol") + w["path"] * F.col("by_path") + w["dependency"] * F.col("dependency") + w["module"] * hit
    return s.select("path", F.round(F.least(total / sum(w.values()), F.lit(1.0)), 9).alias("relevance"))


def recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row a task: recall and precision, two digits.

    An expected file is a hit if a found path ends with it; hits over expected
    files, and hits over found paths (a hit counts once, by however many paths).
    """
    hit = expected.join(found, "task").where(F.col("path").endswith(F.col("expected")))
    a = expected.groupBy("task").agg(F.countDistinct("expected").alias("want"))
    b = found.groupBy("task").agg(F.countDistinct("path").alias("got"))
    c = hit.groupBy("task").agg(F.countDistinct("expected").alias("e"))
    out = a.join(b, "task", "left").join(c, "task", "left")
    two = lambda x, y: sc.half_up(F.coalesce(x / y, F.lit(0.0)), 2)
    return out.select("task", two(F.col("e"), F.col("want")).alias("recall"), two(F.col("e"), F.col("got")).alias("precision"))


def hash_vector(text: str) -> list[float]:
    return sc.hash_embedding(text)


def norm(v: list[float]) -> float:
    return math.sqrt(sum(x * x for x in v))
