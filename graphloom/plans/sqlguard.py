"""Read-only SQL: a statement guard and a LIMIT, then the engine's own SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Words that make a statement writing.
WRITING = [
    "insert", "update", "delete", "drop", "alter", "create", "replace", "truncate", "attach", "detach", "pragma", "vacuum", "reindex", "merge",
]
MOST, DEFAULT = 500, 100


def guard(sql: str, limit: int | None = DEFAULT) -> str:
    """The statement with a LIMIT (1 to 500) unless it has one; ValueError where it may write."""
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with|explain)\b", text):
        raise ValueError("only SELECT, WITH and EXPLAIN are allowed")
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if ";" in bare:
        raise ValueError("one statement at a time")
    for word in WRITING:
        if re.search(rf"(?i)\b{word}\b(?!\s*\()", bare):
            raise ValueError(f"{word} is not allowed")
    if limit is None or re.search(r"(?i)\blimit\b", bare):
        return text
    return f"{text} LIMIT {max(1, min(MOST, limit))}"


def run(spark: SparkSession, sql: str, limit: int | None = DEFAULT) -> DataFrame:
    return spark.sql(guard(sql, limit))
