"""Parquet tables with upserts, deletes and incremental indexing.

A table is a folder of versions.  A write makes a new version; readers take the
newest one that is complete, so a job that dies half way leaves the old table
in place, and a reader never sees half of a new one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_home(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where it is set.

    Without it a temporary folder, for a local master alone; on a cluster a
    folder beside the warehouse.
    """
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and master.startswith("local") and not master.startswith("local-cluster"):
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_graphloom").rstrip("/")


class Table:
    """A versioned Parquet table with keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(n for n in names if n.startswith("v") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.versions()[-1]}")

    def write(self, df: DataFrame) -> None:
        known = self.versions()
        n = int(known[-1][1:11]) + 1 if known else 0
        df.write.parquet(f"{self.path}/v{n:010d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """New rows replace old ones of the same key; within the batch the last by ``order`` counts."""
        if order:
            every = [c for c in rows.columns if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*every), order).alias("_r")).select(*self.keys, "_r.*")
        else:
            rows = rows.dropDuplicates(self.keys)
        if not self.exists():
            return self.write(rows)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        test = same[0]
        for s in same[1:]:
            test = test & s
        kept = self.read().alias("o").join(rows.select(*self.keys).alias("n"), test, "left_anti")
        return self.write(kept.unionByName(rows, allowMissingColumns=True))

    def append(self, rows: DataFrame) -> None:
        self.write(self.read().unionByName(rows) if self.exists() else rows)

    def delete(self, keys: DataFrame, on: list[str] | None = None) -> None:
        """Rows whose key is among ``keys`` go (a cascade passes the key of the parent)."""
        self.write(self.read().join(keys, on or self.keys, "left_anti"))

    def rollback(self, version: str) -> None:
        """Versions after ``version`` go, as if they had not been written."""
        fs, path = self._fs()
        for name in self.versions():
            if name > version:
                fs.delete(path(f"{self.path}/{name}"), True)

    def vacuum(self, keep: int = 2) -> None:
        fs, path = self._fs()
        for name in self.versions()[:-keep]:
            fs.delete(path(f"{self.path}/{name}"), True)


def patch(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows with the fields that an update of the same key carries; null fields and unknown keys change nothing."""
    new = updates.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in updates.columns if c != key])
    return rows.join(new, key, "left").select(key, *[F.coalesce(f"new_{c}", c).alias(c) if c in updates.columns else F.col(c) for c in rows.columns if c != key])


def delete_cascade(parent: Table, keys: DataFrame, children: list[tuple[Table, str]]) -> None:
    """Deletes from a table and from those that name its key; children first, so no row is left without its parent."""
    gone = keys.select(parent.keys[0])
    for child, column in children:
        if child.exists():
            child.delete(gone.withColumnRenamed(parent.keys[0], column), [column])
    parent.delete(gone, [parent.keys[0]])


class Savepoint:
    """Tables that go back to where they were if the block raises; savepoints nest."""

    def __init__(self, *tables: Table):
        self.tables = tables

    def __enter__(self) -> Savepoint:
        self.at = [(t, (t.versions() or [""])[-1]) for t in self.tables]
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if kind is not None:
            for table, version in self.at:
                table.rollback(version)
        return False


def index_files(files: DataFrame, paths: list[str], table: Table, dependents: list[Table] = (), derive=None) -> DataFrame:
    """Brings only the named files up to date; all others stay, and none is taken for deleted."""
    named = files.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    known = table.read() if table.exists() else None
    todo = files.join(F.broadcast(named), "path", "left_semi")  # paths that a caller lists
    rest = todo if known is None else known.join(F.broadcast(named), "path", "left_anti").select(*files.columns).unionByName(todo)
    return index(rest, table, dependents, derive).join(F.broadcast(named), "path", "left_semi")


def changes(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """``key, change``: added, changed, same or deleted, by key and content hash."""
    both = old.select(key, F.col(mark).alias("before")).join(new.select(key, F.col(mark).alias("after")), key, "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.select(key, kind.alias("change"))


def index(files: DataFrame, table: Table, dependents: list[Table] = (), derive=None) -> DataFrame:
    """Brings a file table up to date; returns the changes.

    Unchanged files are skipped by hash, vanished ones are deleted with their
    dependents, and ``derive(files) -> list of DataFrames`` makes the rows of
    the dependent tables for added and changed files alone.  Edges of files that
    did not change stay.
    """
    if not table.exists():
        diff = files.select("path", F.lit("added").alias("change"))
    else:
        diff = changes(table.read(), files)
    todo = files.join(diff.where("change in ('added', 'changed')"), "path", "left_semi")
    gone = diff.where("change in ('changed', 'deleted')").select("path")
    for dep, rows in zip(dependents, derive(todo) if derive else []):
        kept = dep.read().join(gone, "path", "left_anti") if dep.exists() else None
        dep.write(rows if kept is None else kept.unionByName(rows))
    dead = diff.where("change = 'deleted'").select("path")
    kept = table.read().join(gone.unionByName(dead).distinct(), "path", "left_anti") if table.exists() else None
    table.write(todo if kept is None else kept.unionByName(todo))
    return diff
