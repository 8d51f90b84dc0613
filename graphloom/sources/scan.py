"""Sources: a directory of files, git logs, rule files, configuration, other repositories."""

from __future__ import annotations

import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import files as ff

MOST_BYTES = 1_048_576
#: Names and patterns that a scan leaves out.
IGNORE = [
    "node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", ".svelte-kit", "coverage", ".cache", ".tmp", "__pycache__", ".venv", "venv",
    "target", "vendor", ".idea", ".vscode", ".DS_Store", "Thumbs.db", "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json",
    "pnpm-lock.yaml", "yarn.lock",
]
#: Package -> framework, in order.
FRAMEWORKS = {
    "next": "next", "react": "react", "vue": "vue", "svelte": "svelte", "@sveltejs/kit": "svelte", "@angular/core": "angular",
    "express": "express", "fastify": "fastify", "@nestjs/core": "nestjs",
}
#: Root file -> package manager, in order; files that mark a monorepo.
MANAGERS = [
    ("pnpm-lock.yaml", "pnpm"), ("pnpm-workspace.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("package-lock.json", "npm"), ("package.json", "npm"),
]
MONOREPO = ("pnpm-workspace.yaml", "lerna.json", "nx.json")
#: Rule file -> source; rule directory -> source; source -> priority (5 for others).
RULE_FILES = {
    "AGENTS.md": "agents.md", "CLAUDE.md": "claude.md", "GEMINI.md": "gemini.md", "ANTIGRAVITY.md": "custom", "DEEPSEEK.md": "deepseek", "QWEN.md": "qwen",
    "KIMI.md": "kimi", "GROK.md": "grok", "DEVIN.md": "devin", "OPENHANDS.md": "openhands", "REPLIT.md": "replit", "AMAZONQ.md": "amazonq",
    ".github/copilot-instructions.md": "copilot", ".cursorrules": "cursor", ".windsurfrules": "custom", ".clinerules": "custom", ".traerules": "trae",
    ".lingmarules": "lingma", ".comaterules": "comate", ".codegeexrules": "codegeex", ".roorules": "roo", ".augmentrules": "augment", ".continuerc.json": "continue",
}
RULE_FOLDERS = {".cursor/rules": "cursor", ".github/instructions": "copilot", ".continue/rules": "continue", ".trae/rules": "trae"}
RULE_PRIORITY = {
    "agents.md": 10, "claude.md": 8, "gemini.md": 8, "cursor": 6, "copilot": 6, "trae": 7, "deepseek": 8, "qwen": 7, "lingma": 7, "comate": 6, "codegeex": 6,
    "kimi": 7, "grok": 7, "replit": 6, "devin": 8, "openhands": 7, "continue": 6, "roo": 7, "augment": 6, "amazonq": 6,
}
LARGE_RULE = 10_000


def ignore_pattern(line: str) -> str | None:
    """One line of an ignore file as a regular expression over relative paths."""
    rule = line.strip()
    if not rule or rule.startswith("#"):
        return None
    rule = rule.lstrip("!")
    rooted, folder = rule.startswith("/") or "/" in rule.rstrip("/"), rule.endswith("/")
    body, i = "", 0
    rule = rule.strip("/")
    while i < len(rule):
        if rule[i : i + 2] == "**":
            body, i = body + ".*", i + 2
            continue
        c = rule[i]
        body += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()|^$[]{}\\" else c
        i += 1
    return ("^" if rooted else "(^|/)") + body + ("/" if folder else "(/|$)")


def ignored(path: Column, extra: list[str] = ()) -> Column:
    """Whether the default list or further ignore lines leave a path out; a later ``!`` line takes it in again."""
    out = F.lit(False)
    for line in [*IGNORE, *extra]:
        pattern = ignore_pattern(line)
        if pattern:
            out = F.when(path.rlike(pattern), F.lit(not line.strip().startswith("!"))).otherwise(out)
    hidden = path.rlike(r"(^|/)\.(?!github(/|$))[^/]+")
    return out | hidden


def scan(spark: SparkSession, root: str, extra_ignore: list[str] = (), most: int = MOST_BYTES) -> DataFrame:
    """Files below a folder: ``path, size, modified, language, module, is_test, is_generated, content, hash``.

    Sizes, names and extensions are filtered before contents are decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "^" + "".join("\\" + c if c in ".+()|^$[]{}\\*?" else c for c in base) + "/", "")
    found = raw.withColumn("rel", path).where((F.col("length") > 0) & (F.col("length") <= most))
    found = found.where(~ignored(F.col("rel"), extra_ignore) & ~ff.is_binary(F.col("rel")))
    text = F.decode("content", "utf-8")
    return found.select(
        F.col("rel").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        ff.language(F.col("rel")).alias("language"),
        ff.dirname(F.col("rel")).alias("module"),
        ff.is_test(F.col("rel")).alias("is_test"),
        ff.is_generated(F.col("rel")).alias("is_generated"),
        text.alias("content"),
        F.sha2("content", 256).alias("hash"),
    )


def project(files: DataFrame) -> DataFrame:
    """One row: package manager, frameworks, whether it is a monorepo.

    Root files only, so the rows that are aggregated are a handful.
    """
    name = F.col("path")
    manager = F.lit("unknown")
    for file, kind in reversed(MANAGERS):
        manager = F.when(F.array_contains("names", F.lit(file)), kind).otherwise(manager)
    package = F.from_json(F.max(F.when(name == "package.json", F.col("content"))), "dependencies map<string,string>, devDependencies map<string,string>, workspaces string")
    one = files.agg(F.collect_set(F.when(~name.contains("/"), name)).alias("names"), package.alias("p"))
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    known = F.create_map(*[F.lit(x) for pair in FRAMEWORKS.items() for x in pair])
    deps = F.array_union(keys(F.col("p.dependencies")), keys(F.col("p.devDependencies")))
    return one.select(
        manager.alias("package_manager"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(deps, lambda d: F.try_element_at(known, d))))).alias("frameworks"),
        (F.arrays_overlap("names", F.array(*[F.lit(x) for x in MONOREPO])) | F.col("p.workspaces").isNotNull()).alias("is_monorepo"),
    )


def workspaces(yaml: str) -> list[str]:
    """Package globs of a pnpm workspace file, read line by line."""
    out, inside = [], False
    for line in yaml.splitlines():
        if line.strip().startswith("packages:"):
            inside = True
        elif inside and line.strip().startswith("-"):
            out.append(line.strip()[1:].strip().strip("'\""))
        elif inside and line.strip():
            break
    return out


def git_log(spark: SparkSession, repository: str, limit: int = 250) -> DataFrame:
    """``commit, author, committed, file``: the newest commits with their files."""
    done = subprocess.run(["git", "-C", repository, "log", f"-{int(limit)}", "--name-only", "--format=%x01%H%x02%an%x02%aI"], capture_output=True, text=True, check=True)
    return parse_log(spark.createDataFrame([(done.stdout,)], "log string"))


def parse_log(logs: DataFrame) -> DataFrame:
    """Rows of ``git log --name-only --format=%x01%H%x02%an%x02%aI``."""
    entry = logs.select(F.explode(F.split("log", "\x01")).alias("e")).where("trim(e) <> ''")
    lines = F.split("e", "\n")
    head = F.split(F.get(lines, F.lit(0)), "\x02")
    files = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x) != "")
    rows = entry.select(F.get(head, F.lit(0)).alias("commit"), F.get(head, F.lit(1)).alias("author"), F.to_timestamp(F.get(head, F.lit(2))).alias("committed"), files.alias("files"))
    return rows.select("commit", "author", "committed", F.explode("files").alias("file"))


def _git(spark: SparkSession, repository: str, *words: str) -> DataFrame:
    """One row ``text``: what git prints (of one repository, so it fits the driver)."""
    done = subprocess.run(["git", "-C", repository, *words], capture_output=True, text=True, check=True)
    return spark.createDataFrame([(done.stdout,)], "text string")


def _revisions(*names: str) -> list[str]:
    if any(x.startswith("-") for x in names):
        raise ValueError("a revision must not start with '-'")
    return list(names)


def changed_files(spark: SparkSession, repository: str, base: str, head: str = "HEAD") -> DataFrame:
    """``status, path`` between two revisions."""
    return parse_name_status(_git(spark, repository, "diff", "--name-status", *_revisions(base, head), "--"))


def staged_files(spark: SparkSession, repository: str) -> DataFrame:
    """``status, path`` of what is staged."""
    return parse_name_status(_git(spark, repository, "diff", "--name-status", "--cached", "--"))


def work_status(spark: SparkSession, repository: str) -> DataFrame:
    """``staged, unstaged, path``: the two state letters of each changed file."""
    return parse_status(_git(spark, repository, "status", "--porcelain"))


def line_changes(spark: SparkSession, repository: str, base: str, head: str = "HEAD") -> DataFrame:
    """``path, first, added, removed``: the hunks between two revisions."""
    return parse_diff(_git(spark, repository, "diff", "--unified=0", *_revisions(base, head), "--"))


def _printed(texts: DataFrame) -> DataFrame:
    return texts.select(F.posexplode(F.split("text", "\n")).alias("no", "line"))


def parse_name_status(texts: DataFrame) -> DataFrame:
    """Rows of ``git diff --name-status``; a renamed file has its new name."""
    cells = F.split("line", "\t")
    return _printed(texts).where("line <> ''").select(F.substring(F.get(cells, F.lit(0)), 1, 1).alias("status"), F.element_at(cells, -1).alias("path"))


def parse_status(texts: DataFrame) -> DataFrame:
    """Rows of ``git status --porcelain``."""
    path = F.regexp_replace(F.substring("line", 4, 2**30), r"^.* -> ", "")
    return _printed(texts).where("line <> ''").select(F.substring("line", 1, 1).alias("staged"), F.substring("line", 2, 1).alias("unstaged"), path.alias("path"))


def parse_diff(texts: DataFrame) -> DataFrame:
    """Hunks of a unified diff, each ``text`` one diff: the file they are in, first new line, lines added and removed."""
    head = r"^@@ -[0-9]+(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    part = F.explode(F.split("text", r"(?m)^diff --git ")).alias("part")
    file = texts.select(part).where("part <> ''").select(F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?([^\t\n]*)", 1).alias("path"), F.explode(F.split("part", "\n")).alias("line"))
    number = lambda k: F.regexp_extract("line", head, k)
    count = lambda k: F.when(number(k) == "", 1).otherwise(number(k).try_cast("long")).cast("long")
    return file.where(F.col("line").rlike(head)).select("path", number(2).cast("long").alias("first"), count(3).alias("added"), count(1).alias("removed"))


def rule_files(files: DataFrame) -> DataFrame:
    """``rule_id, path, source, scope, priority, content``: files that hold rules for agents.

    Fixed root files are global; files below a rule directory have the scope
    ``path``, which ranks two higher.
    """
    source, scope = F.lit(None).cast("string"), F.lit("global")
    for folder, name in RULE_FOLDERS.items():
        inside = F.col("path").startswith(folder + "/")
        source, scope = F.when(inside, name).otherwise(source), F.when(inside, "path").otherwise(scope)
    for path, name in RULE_FILES.items():
        source = F.when(F.col("path") == path, name).otherwise(source)
    rank = F.create_map(*[F.lit(x) for pair in RULE_PRIORITY.items() for x in pair])
    hit = files.withColumns({"source": source, "scope": scope}).where("source is not null")
    priority = F.coalesce(F.try_element_at(rank, F.col("source")), F.lit(5)) + F.when(F.col("scope") == "path", 2).otherwise(0)
    return hit.select(F.substring(F.sha2("path", 256), 1, 12).alias("rule_id"), "path", "source", "scope", priority.cast("long").alias("priority"), "content")


#: Kind of conflict -> phrases of one way, phrases of the other; in order.
CONFLICTS = [
    ("indentation", ("use tabs", "indent with tabs"), ("use spaces", "use 2 spaces", "use 4 spaces")),
    ("quote style", ("single quote", "use '"), ("double quote", 'use "')),
    ("semicolons", ("no semicolon", "no-semi"), ("use semicolon", "always use semi")),
]


def rule_issues(rules: DataFrame) -> DataFrame:
    """``rule_id, other, issue, prefer``: empty, large and duplicate rules, and conflicting pairs.

    Conflicts join rules on opposite sides of one kind, never all with all; a
    pair's first kind counts, and the rule of higher priority is preferred (the
    first where they tie).
    """
    rules = rules if "priority" in rules.columns else rules.withColumn("priority", F.lit(0))
    low, none = F.lower("content"), F.lit(None).cast("string")
    plain = lambda df, other, issue: df.select("rule_id", other.alias("other"), F.lit(issue).alias("issue"), none.alias("prefer"))
    empty = plain(rules.where(F.trim("content") == ""), none, "empty")
    large = plain(rules.where(F.length("content") > LARGE_RULE), none, "large")
    first = rules.where(F.trim("content") != "").groupBy(F.trim("content").alias("t")).agg(F.min("rule_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    same = plain(rules.join(first, F.trim("content") == F.col("t")).where("rule_id <> first"), F.col("first"), "duplicate")

    def says(phrases) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | low.contains(p)
        return out

    side = lambda k, kind, which, test: F.when(test, F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(which).alias("side")))
    sides = [side(k, kind, which, says(p)) for k, (kind, a, b) in enumerate(CONFLICTS) for which, p in enumerate((a, b))]
    flags = rules.select("rule_id", "priority", F.explode(F.array_compact(F.array(*sides))).alias("f")).select("rule_id", "priority", "f.*")
    other = flags.select(F.col("rule_id").alias("other"), "k", F.col("side").alias("other_side"), F.col("priority").alias("other_priority"))
    pairs = flags.join(other, "k").where("side <> other_side and rule_id < other")
    prefer = F.when(F.col("priority") >= F.col("other_priority"), F.col("rule_id")).otherwise(F.col("other"))
    pairs = pairs.withColumn("prefer", prefer).groupBy("rule_id", "other").agg(F.min_by("kind", "k").alias("kind"), F.first("prefer").alias("prefer"))
    return empty.unionByName(large).unionByName(same).unionByName(pairs.select("rule_id", "other", F.concat(F.lit("conflict: "), "kind").alias("issue"), "prefer"))


def read_config(path: str, defaults: dict) -> dict:
    """A TOML file laid over defaults: a section replaces the default section whole."""
    file = Path(path)
    return defaults | (tomllib.loads(file.read_text()) if file.exists() else {})


def federate(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several repositories under one schema, with their alias."""
    out = None
    for alias, df in tables.items():
        name = "repo_" + "".join(c if c.isalnum() else "_" for c in alias)
        part = df.withColumn("repo", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
