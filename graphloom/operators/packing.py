"""Compression ladder (full, signature, digest), context packing, report texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as sc

#: Starts of declaration lines that a digest keeps, and how many.
DECLARATIONS = ("export ", "import ", "type ", "interface ", "class ", "def ", "fn ", "func ")
DIGEST_LINES = 30
#: Starts of lines that every signature keeps, by language.
KEPT = {
    "typescript": ("import ", "export type ", "type ", "export interface ", "interface ", "export enum ", "enum ", "//"),
    "python": ("import ", "from ", "class ", "@", "#"),
    "go": ("package ", "import ", "type ", "//"),
    "rust": ("use ", "pub use ", "mod ", "struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "//", "#["),
}
HEADERS = {
    "typescript": re.compile(
        r"^(export\s+)?(default\s+)?(async\s+)?function\b|^((public|private|protected|static|async|override)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b)\w+\s*\([^)]*\)\s*(:[^;{]+)?\{$"
        r"|^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s*)?\([^)]*\)\s*(:[^=]+)?=>\s*\{?$"
    ),
    "go": re.compile(r"^func\b"),
    "rust": re.compile(r"^(pub(\([^)]*\))?\s+)?(async\s+)?(unsafe\s+)?fn\b"),
}


def _brace_signature(code: str, language: str) -> str:
    """Lines outside function bodies; a body shrinks to its closing brace."""
    header, out, depth, floor = HEADERS.get(language, HEADERS["typescript"]), [], 0, None
    for raw in code.split("\n"):
        line, change = raw.strip(), raw.count("{") - raw.count("}")
        if floor is not None:
            depth += change
            if depth <= floor:
                out.append(raw[: len(raw) - len(raw.lstrip())] + "}")
                floor = None
            continue
        if header.match(line) and "{" in raw and change > 0:
            out.append(raw.rstrip() + " /* ... */")
            floor, depth = depth, depth + change
            continue
        depth += change
        out.append(raw)
    return "\n".join(out)


def _python_signature(code: str) -> str:
    """Imports, decorators, classes and function heads; a body becomes ``...``."""
    out, hidden = [], None
    for raw in code.split("\n"):
        line = raw.strip()
        indent = len(raw) - len(raw.lstrip())
        if not line:
            continue
        if hidden is not None and indent > hidden:
            continue
        hidden = None
        out.append(raw)
        if re.match(r"(async\s+)?def\b", line):
            out.append(" " * (indent + 4) + "...")
            hidden = indent
    return "\n".join(out)


def signature(code: str, language: str) -> str:
    return _python_signature(code) if language == "python" else _brace_signature(code, "typescript" if language == "javascript" else language)


def digest(code: str) -> str:
    lines = code.split("\n")
    kept = [x.strip() for x in lines if x.strip().startswith(DECLARATIONS)]
    return f"// [Compressed Code Digest - {len(lines)} lines summarized]\n" + "\n".join(kept[:DIGEST_LINES]) + f"\n// ... and {max(0, len(kept) - DIGEST_LINES)} more symbols"


def add_forms(files: DataFrame, text: str = "content", language: str = "language") -> DataFrame:
    """Adds ``signature`` and ``digest`` of every text (an Arrow UDF: the line machine has state)."""

    @F.pandas_udf("signature string, digest string")
    def forms(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        pairs = [(signature(t or "", lang or ""), digest(t or "")) for t, lang in zip(texts, languages)]
        return pd.DataFrame(pairs, columns=["signature", "digest"])

    return files.withColumn("forms", forms(F.col(text), F.col(language))).select(*files.columns, "forms.signature", "forms.digest")


def compress(files: DataFrame, budget: int | None, text: str = "content") -> DataFrame:
    """``mode, compressed, tokens, reduction`` of each file within a budget (none: the signature)."""
    full, short, least = sc.tokens(F.col(text)), sc.tokens(F.col("signature")), sc.tokens(F.col("digest"))
    fits = (lambda t: F.lit(False) if budget is None else t <= budget)
    mode = F.when(fits(full), "full").when((F.lit(True) if budget is None else fits(short)), "signature").otherwise("digest")
    pick = lambda a, b, c: F.when(F.col("mode") == "full", a).when(F.col("mode") == "signature", b).otherwise(c)
    out = add_forms(files).withColumn("mode", mode).withColumns({"compressed": pick(F.col(text), F.col("signature"), F.col("digest")), "tokens": pick(full, short, least)})
    saved = F.greatest(full - F.col("tokens"), F.lit(0))
    return out.withColumn("reduction", F.when(full > 0, sc.half_up(saved / F.greatest(full, F.lit(1)) * 100, 1)).otherwise(0.0))


def pack(candidates: DataFrame, budget: int, rule_tokens: int = 0, map_tokens: int = 0) -> DataFrame:
    """Greedy packing into a token budget: ``task, path, position, mode, tokens, left``.

    ``candidates``: task, path, relevance, full, signature, digest (token counts
    of the three forms).  Rules and map take at most 15% each of what is there.
    A file may fill the rest if it is among the first three and its relevance is
    over 0.5, else a quarter of the budget; a file that does not fit is skipped.
    The fold over an ordered array is the only sequential step, one a task, and
    it holds a task's candidates (at most the retrieval limit), not its texts.
    """
    rules = min(rule_tokens, int(budget * 0.15))
    rest = budget - rules
    rest -= min(map_tokens, int(rest * 0.15))
    item = F.struct((-F.col("relevance")).alias("r"), "path", "relevance", "full", "signature", "digest")
    listed = candidates.groupBy("task").agg(F.sort_array(F.collect_list(item)).alias("items"))
    out_type = "array<struct<path:string,position:bigint,mode:string,tokens:bigint,left:bigint>>"
    start = F.struct(F.lit(rest).cast("long").alias("left"), F.lit(0).cast("long").alias("i"), F.array().cast(out_type).alias("out"))

    def step(acc, x):
        cap = F.when((acc["i"] < 3) & (x["relevance"] > 0.5), acc["left"]).otherwise(F.least(acc["left"], F.lit(int(budget * 0.25)).cast("long")))
        mode = F.when(x["full"] <= cap, "full").when(x["signature"] <= cap, "signature").otherwise("digest")
        used = F.when(mode == "full", x["full"]).when(mode == "signature", x["signature"]).otherwise(x["digest"])
        takes = (acc["left"] > 0) & (used <= acc["left"])
        row = F.struct(x["path"].alias("path"), acc["i"].alias("position"), mode.alias("mode"), used.alias("tokens"), (acc["left"] - used).alias("left"))
        return F.struct(
            F.when(takes, acc["left"] - used).otherwise(acc["left"]).alias("left"),
            (acc["i"] + 1).alias("i"),
            F.when(takes, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"),
        )

    return listed.select("task", F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("f")).select("task", "f.*")


def order_rules(rules: DataFrame, task: str) -> DataFrame:
    """Rules that share a word with the task first, then by priority."""
    terms = [t for t in task.lower().split() if len(t) > 2]
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower("content"), F.lit(t))
    return rules.withColumn("matches", hit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("matches"), F.desc("priority"), "rule_id")))


#: Export target -> layout (rich markdown, comments, or rules and fenced files for all others).
LAYOUTS = {"markdown": "rich", "json": "json", "codex": "comment"}
TARGETS = [
    "markdown", "claude", "cursor", "copilot", "gemini", "agents", "antigravity", "codex", "aider", "windsurf", "cline", "trae", "deepseek", "qwen",
    "lingma", "comate", "codegeex", "kimi", "grok", "replit", "devin", "opencode", "vellum", "openhands", "continue", "roo", "augment", "amazonq",
    "json",
]


def layout_of(target: str) -> str:
    """The layout of an export target; an unknown target gets rich markdown."""
    return LAYOUTS.get(target, "plain" if target in TARGETS else "rich")


def export(pack_files: DataFrame, rules: list[str], task: str, layout: str = "plain", by: list[str] | None = None) -> DataFrame:
    """One row ``document``: a pack as text; ``pack_files``: path, language, content, position, tokens.

    With ``by`` there is one row a pack: these columns and its document.
    """
    by = by or []
    if layout == "json":
        one = F.to_json(F.struct("path", "language", "tokens", "content"))
    elif layout == "comment":
        one = F.concat(F.lit("# "), "path", F.lit("\n"), "content", F.lit("\n"))
    else:
        one = F.concat(F.lit("## "), "path", F.lit("\n```"), "language", F.lit("\n"), "content", F.lit("\n```\n"))
    body = pack_files.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", one.alias("t")))).alias("parts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"))
    text = F.array_join(F.transform("parts", lambda x: x["t"]), ",\n" if layout == "json" else "\n")
    head = "\n\n".join(rules)
    if layout == "json":
        return body.select(*by, F.concat(F.lit(f'{{"task": "{task}", "files": ['), text, F.lit("]}")).alias("document"))
    if layout == "rich":
        head = f"# Context Pack: {task}\n\n" + head
        return body.select(*by, F.concat(F.lit(head + "\n\n## Token Budget\n\nCode: "), F.format_number("n", 0), F.lit("\n\n"), text).alias("document"))
    return body.select(*by, F.concat(F.lit(head + "\n\n" if head else ""), text).alias("document"))


def mermaid(cycle: Column) -> Column:
    """A cycle (an array of texts) as a flow chart; the last node also points back to the first."""
    after = F.concat(F.slice(cycle, 2, F.greatest(F.size(cycle) - 1, F.lit(0))), F.slice(cycle, 1, 1))
    return F.concat(F.lit("graph TD\n"), F.array_join(F.zip_with(cycle, after, lambda x, y: F.concat(F.lit("  "), x, F.lit(" --> "), y)), "\n"))
