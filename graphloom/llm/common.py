"""Shared pieces of the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the corpus contracts define it: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` when set.

    Only where the setting is missing: a temporary folder for a local master,
    and a folder beside the warehouse on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        found = tempfile.mkdtemp(prefix="graphloom-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_graphloom"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor, and lets several
    consumers read a result that is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`."""
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("graphloom-") and folder.getParent() is not None:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows from which on a key may count as hot, and how many hot keys there can be at most.
HOT_ROWS, MOST_HOT = 100_000, 10_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and, as ``count``,
    how many rows of ``left`` have that key.

    Keys with more than ``HOT_ROWS`` and more than a ``MOST_HOT``th of all these
    rows are joined by broadcast, the others by a shuffle, so no task gets all
    rows of a hot key.  There are fewer than ``MOST_HOT`` hot keys whatever the
    input.  ``right`` should be a written table; ``left`` is read twice where
    there are hot keys.
    """
    total = right.agg(F.sum(count).alias("n"), F.max(count).alias("most")).first()
    bound = max(HOT_ROWS, (total["n"] or 0) // MOST_HOT)
    if (total["most"] or 0) <= bound:
        return left.join(right, on, how)
    hot = F.broadcast(right.where(F.col(count) > bound))
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(hot, on, "left_semi" if how == "left_semi" else "inner").unionByName(cold.join(right, on, how))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    module = sys.modules.setdefault("_graphloom_worker_cache", types.ModuleType("_graphloom_worker_cache"))
    return module.__dict__


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def int_div(a: Column, b: Column) -> Column:
    """Integer division of longs (a double quotient would lose digits)."""
    return F.call_function("div", a, b)
