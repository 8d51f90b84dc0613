"""Services: exported and consumed endpoints from symbols, edges between services, their graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as sc
from graphloom.operators.metrics import service_edges

#: Parts of signatures and ends of names that mark a route; marks of a client call.
ROUTE_PARTS = ["@get", "@post", "@put", "@delete", "router.", "app.get", "app.post"]
ROUTE_ENDS = ["controller", "handler", "route"]
CLIENT_PARTS = ["fetch(", "axios.", "http."]
CLIENT_NAMES = ["client", "apicall", "servicecaller"]
#: Methods by a word in the signature, in order; GET otherwise.
METHODS = ["post", "put", "delete", "patch"]
QUOTED_PATH = r"['\"`](/[a-zA-Z0-9_\-/{}:]+)['\"`]"
QUOTED_URL = r"['\"`]((?:https?://[^'\"`]+)|/[a-zA-Z0-9_\-/{}:]+)['\"`]"


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def exported_apis(symbols: DataFrame) -> DataFrame:
    """Route symbols as endpoints: ``service, path, method, handler, source``.

    ``symbols``: service, name, kind, signature, file.
    """
    sig, name = F.lower(F.coalesce("signature", F.lit(""))), F.lower("name")
    route = (F.col("kind") == "route_handler") | _any(sig.contains(x) for x in ROUTE_PARTS) | _any(name.endswith(x) for x in ROUTE_ENDS)
    method = F.lit("GET")
    for word in reversed(METHODS):
        method = F.when(sig.contains(word), word.upper()).otherwise(method)
    quoted = F.regexp_extract(F.coalesce("signature", F.lit("")), QUOTED_PATH, 1)
    own = F.regexp_extract("name", r"^(/[a-zA-Z0-9_\-/{}:]+)", 1)
    made = F.concat(F.lit("/"), F.lower(F.regexp_replace("name", "(?i)controller|handler", "")))
    path = F.when(quoted != "", quoted).when(own != "", own).otherwise(made)
    return symbols.where(route).select("service", path.alias("path"), method.alias("method"), F.col("name").alias("handler"), F.col("file").alias("source"))


def consumed_apis(symbols: DataFrame) -> DataFrame:
    """Client calls as endpoints: ``service, path, source``."""
    sig, name = F.lower(F.coalesce("signature", F.lit(""))), F.lower("name")
    client = _any(sig.contains(x) for x in CLIENT_PARTS) | _any(name.contains(x) for x in CLIENT_NAMES)
    url = F.regexp_extract(F.coalesce("signature", F.lit("")), QUOTED_URL, 1)
    return symbols.where(client & (url != "")).select("service", url.alias("path"), F.col("file").alias("source"))


def package_edges(services: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``src, dst``: a dependency that names another service.

    ``services``: id, name; ``dependencies``: id, dep.  Names and ids join by
    equality.  The suffix test of scoped names joins on the part of the
    dependency behind its scope, so no service meets every dependency.
    """
    d = dependencies.select(F.col("id").alias("src"), F.col("dep"), F.lower("dep").alias("low")).distinct()
    by = services.select(F.col("id").alias("dst"), F.explode(F.array_distinct(F.array(F.lower("name"), F.col("id")))).alias("key"))
    direct = d.join(by, d.low == by.key).select("src", "dst")
    scoped = services.where(F.col("name").startswith("@") & F.col("name").contains("/")).select(F.col("id").alias("dst"), F.element_at(F.split("name", "/"), 2).alias("tail"))
    tails = d.select("src", F.explode(F.array_distinct(F.split("dep", r"[/@]"))).alias("tail")).where("tail <> ''")
    return direct.union(tails.join(scoped, "tail").select("src", "dst")).where("src <> dst").distinct()


def all_edges(services: DataFrame, exports: DataFrame, consumes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``src, dst, type, endpoint, weight``: API edges weigh 2, package edges 1."""
    api = service_edges(services, exports, consumes).select("src", "dst", F.lit("api").alias("type"), "endpoint", F.lit(2).alias("weight"))
    packages = package_edges(services, dependencies).select("src", "dst", F.lit("package_dep").alias("type"), F.lit("").alias("endpoint"), F.lit(1).alias("weight"))
    return api.unionByName(packages)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``document``: nodes and links as JSON for a viewer."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct(*edges.columns))).alias("links"))
    return n.join(F.broadcast(e)).select(F.to_json(F.struct("nodes", "links")).alias("document"))  # one row each


def node_size(apis: Column) -> Column:
    return F.least(F.lit(30.0), (8 + 2 * apis).cast("double"))


def service_id(name: Column) -> Column:
    return sc.slug(name)
