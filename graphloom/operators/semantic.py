"""Imports resolved to files, and heritage edges, of TypeScript and JavaScript files.

There is no compiler here: aliases come from the ``paths`` of a root
configuration, names from import clauses, heritage from the heads of classes
and interfaces at the start of a line.  A name that a barrel file hands on is
taken to be the barrel's.  Everything is DataFrame functions: expressions over
whole texts, probes of candidate paths against the table of files, and an
aggregation a source, target and kind.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import files as ff
from graphloom.functions import scalars as sc
from graphloom.operators.graph import cut

LANGUAGES = ("typescript", "javascript", "vue", "svelte", "astro")
#: Root configurations in order; endings tried behind an import path; weights of edges.
CONFIGS = ["tsconfig.json", "jsconfig.json", "tsconfig.base.json"]
ENDINGS = [".ts", ".tsx", ".d.ts", ".js", ".jsx"]
WEIGHTS = {"import": 1.0, "extends": 1.5, "implements": 1.2}

FROM = r"(?m)^(import|export)\s+(?:type\s+)?([\w$*{}\s,]+?)\s*\bfrom\s*['\"]([^'\"\n]+)['\"]"
BARE = r"(?m)^import\s*['\"]([^'\"\n]+)['\"]"
HEADS = r"(?m)^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(class|interface)\s+([\w$]+)([^{;]{0,2000})\{"


def path_map(files: DataFrame) -> dict[str, list[str]]:
    """Pattern -> targets, from the first root configuration there is (one small file, read by the driver)."""
    rows = files.where(F.col("path").isin(CONFIGS)).select("path", sc.strip_json_comments(F.col("content")).alias("text")).collect()
    if not rows:
        return {"*": ["*"]}
    options = json.loads(min(rows, key=lambda r: CONFIGS.index(r.path)).text).get("compilerOptions", {})
    base, rooted = options.get("baseUrl", "."), "baseUrl" in options
    found = {k: [f"{base}/{x}" for x in (v + [k] if rooted else v)] for k, v in options.get("paths", {}).items()}
    return {"*": [f"{base}/*"]} | found if rooted else found


def collapsed(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` segments."""

    def step(acc, x):
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def bindings(files: DataFrame) -> DataFrame:
    """``path, import_path, symbols, names``: an import or re-export each.

    ``symbols``: the default and named imports under their local names;
    ``names``: these and the name of a namespace import.
    """
    code = files.where(F.col("language").isin(*LANGUAGES))
    part = lambda k: F.regexp_extract_all("content", F.lit(FROM), F.lit(k))
    rows = F.arrays_zip(part(1).alias("word"), part(2).alias("clause"), part(3).alias("import_path"))
    bare = F.transform(F.regexp_extract_all("content", F.lit(BARE), F.lit(1)), lambda x: F.struct(F.lit("import").alias("word"), F.lit("").alias("clause"), x.alias("import_path")))
    each = code.select("path", F.explode(F.concat(rows, bare)).alias("r")).select("path", "r.*")
    given = F.split(F.regexp_replace("clause", "[{}]", ","), ",")
    local = F.transform(given, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^type |^(?!\*).* as ", ""))
    local = F.when(F.col("word") == "import", F.filter(local, lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    space = F.transform(local, lambda x: F.regexp_replace(x, r"^\* as ", ""))
    return each.select("path", "import_path", F.filter(local, lambda x: ~x.startswith("*")).alias("symbols"), space.alias("names"))


def _alias(import_path: Column, aliases: dict[str, list[str]]) -> Column:
    """Paths that an alias stands for: an exact pattern's, else those of the longest prefix."""
    out = F.array().cast("array<string>")
    for pattern in sorted(aliases, key=lambda p: ("*" not in p, len(p.split("*")[0]))):
        before, star, after = pattern.partition("*")
        rest = F.substring(import_path, F.lit(len(before) + 1), F.length(import_path) - len(before + after))
        fits = (import_path.startswith(before) & import_path.endswith(after) & (F.length(import_path) >= len(before + after))) if star else import_path == pattern
        made = [F.concat(F.lit(a), rest, F.lit(b)) if s else F.lit(a) for a, s, b in (t.partition("*") for t in aliases[pattern])]
        out = F.when(fits, F.array(*made)).otherwise(out)
    return out


def resolved(imports: DataFrame, files: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``path, import_path, target``: the first candidate that is a file; imports of packages have none and go."""
    at = F.col("import_path")
    own = F.concat(ff.dirname(F.col("path")), F.lit("/"), at)
    places = F.when(at.startswith("."), F.array(own)).otherwise(_alias(at, {"*": ["*"]} if aliases is None else aliases))

    def forms(place: Column) -> Column:
        stem = F.regexp_replace(place, r"\.jsx?$", "")
        typed = [F.when(stem != place, F.concat(stem, F.lit(x))) for x in (".ts", ".tsx", ".d.ts")]
        return F.array(*[F.concat(place, F.lit(x)) for x in ENDINGS], *typed, place, *[F.concat(place, F.lit("/index" + x)) for x in ENDINGS])

    wanted = imports.select("path", "import_path").distinct()
    placed = wanted.select("path", "import_path", F.posexplode(F.transform(places, collapsed)).alias("place_no", "place"))
    probes = placed.select("path", "import_path", "place_no", F.posexplode(forms(F.col("place"))).alias("form_no", "target")).where("target is not null")
    there = files.select(F.col("path").alias("target")).where("target not like '%node_modules%'")
    return probes.join(there, "target", "left_semi").groupBy("path", "import_path").agg(F.min_by("target", F.struct("place_no", "form_no")).alias("target"))


def heritage(files: DataFrame) -> DataFrame:
    """``path, entity, kind, parent``: what classes and interfaces extend and implement, type arguments apart."""
    code = files.where(F.col("language").isin(*LANGUAGES))
    part = lambda k: F.regexp_extract_all("content", F.lit(HEADS), F.lit(k))
    heads = code.select("path", F.explode(F.arrays_zip(part(2).alias("entity"), part(3).alias("rest"))).alias("h")).select("path", "h.*")
    plain = F.col("rest")
    for _ in range(6):  # type arguments within type arguments
        plain = F.regexp_replace(plain, r"<[^<>]*>", "")
    heads = heads.withColumn("rest", F.regexp_replace(plain, r"\s+", " "))
    clause = lambda kind: F.struct(F.lit(kind).alias("kind"), F.split(F.regexp_extract("rest", rf"\b{kind} (.*?)(?: (?:extends|implements) |$)", 1), ",").alias("list"))
    some = heads.select("path", "entity", F.explode(F.array(clause("extends"), clause("implements"))).alias("c"))
    names = some.select("path", "entity", "c.kind", F.explode("c.list").alias("parent")).withColumn("parent", F.trim("parent"))
    return names.where(F.col("parent").rlike(r"^[\w$.]+$"))


def semantic_edges(files: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``src, dst, kind, symbols, weight, confidence``: imports and heritage between files, one edge a kind."""
    bound = bindings(files)
    placed = cut(bound.join(resolved(bound, files, aliases), ["path", "import_path"]))  # read twice below
    links = placed.select("path", "target", F.lit("import").alias("kind"), "symbols")
    named = placed.select("path", "target", F.explode("names").alias("name")).distinct()
    heirs = heritage(files).withColumn("name", F.substring_index("parent", ".", 1)).join(named, ["path", "name"])
    links = links.unionByName(heirs.where("path <> target").select("path", "target", "kind", F.array("parent").alias("symbols")))
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return links.groupBy(F.col("path").alias("src"), F.col("target").alias("dst"), "kind").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"),
        F.max(F.element_at(weight, F.col("kind"))).alias("weight"),
        F.lit(1.0).alias("confidence"),
    )
