"""Sharding: a Feistel permutation of global row numbers, DataFrame code only.

Rows get a global number, the number is permuted by a keyed Feistel network
over the mixed radix domain ``a * b >= n`` (``a = ceil(sqrt(n))``), and values
outside ``[0, n)`` walk along their cycle until they fall inside.  The permuted
number ``p`` gives ``shard = p mod shards`` and ``slot = p div shards``, so
shard sizes differ by one row at most, every slot is computable, and the same
table and seed give the same shuffle whatever its partitioning.

Defined results: a null text counts no bytes (size 8, checksum 0); a long text
is measured whole; null ids are
numbered like others; rows that agree in id, size and checksum are
interchangeable and each gets a slot of its own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import int_div, materialize, whole_text

ROUNDS = 6
#: Steps of the cycle walk.  The domain exceeds n by less than a, about the
#: square root of n, so a walk of more than 64 steps is impossible up to 4,000
#: rows and has a chance below (1/64)**64 a row beyond.
WALK = 64


def _keyed(value: Column, round_no: int, seed: int, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(round_no), F.lit(seed)), modulus)


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network over ``x = left * b + right``."""
    left, right = int_div(x, b), F.pmod(x, b)
    for k in range(0, ROUNDS, 2):
        left = F.pmod(left + _keyed(right, k, seed, a), a)
        right = F.pmod(right + _keyed(left, k + 1, seed, b), b)
    return left * b + right


def permute(x: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """The permutation of ``[0, n)`` by ``seed``, with cycle walking."""
    once = feistel(x, a, b, seed)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        once,
        lambda p, _: F.when(p >= n, feistel(p, a, b, seed)).otherwise(p),
    )
    checked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return F.when(once < n, once).otherwise(checked)


#: Rows that a bucket of the numbering holds about, and its least and most buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 100_000, 64, 100_000


def number_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``row_no`` (0 to n-1) and ``n_rows`` to a narrow table.

    The number depends on the values of ``keys`` alone: rows go to hash buckets,
    as many as the count of rows asks for, each bucket is ordered by the keys,
    and the offsets come from a table of a row a bucket, ``MOST_BUCKETS`` at
    most, which bounds what is broadcast.  Equal rows are counted before the
    shuffle, so copies of one row cannot fill a bucket.
    """
    counted = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")))
    buckets = min(max(LEAST_BUCKETS, counted.count() // BUCKET_ROWS + 1), MOST_BUCKETS)
    counted = counted.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
    offsets = sizes.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias("n_rows"),
    )
    within = Window.partitionBy("_bucket").orderBy(*keys)
    placed = counted.withColumn("_first", F.sum("_copies").over(within) - F.col("_copies")).join(F.broadcast(offsets), "_bucket")
    return placed.select(
        *keys,
        F.explode(F.sequence(F.col("_offset") + F.col("_first"), F.col("_offset") + F.col("_first") + F.col("_copies") - 1)).alias("row_no"),
        "n_rows",
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20240, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: ``id, size, text_crc32, law, shard, slot, grown_shard, row_no``."""
    text = whole_text(text_col)
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered = (
        number_rows(narrow, [id_col, "size", "text_crc32"])
        .withColumn("_a", F.greatest(F.ceil(F.sqrt(F.col("n_rows").cast("double"))), F.lit(1)).cast("long"))
        .withColumn("_b", int_div(F.col("n_rows") + F.col("_a") - 1, F.col("_a")))
    )
    moved = numbered.withColumn("_p", permute(F.col("row_no"), F.col("n_rows"), F.col("_a"), F.col("_b"), seed))
    return moved.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
        int_div(F.col("_p"), F.lit(shards).cast("long")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
