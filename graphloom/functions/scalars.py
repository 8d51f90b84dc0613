"""Column functions over text and numbers: rounding, formats, terms, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval leaves out of a query.
STOP_TERMS = [
    "the", "a", "an", "is", "it", "to", "in", "on", "of", "for", "and", "or", "but", "not", "with", "this", "that", "from", "add", "fix", "make",
    "implement", "create", "update", "change", "new", "get", "set", "use", "do", "be", "find", "how", "where", "what", "locate", "which", "who",
    "when", "why",
]
#: Words that full-text search leaves out of a query.
STOP_SEARCH = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was",
    "were", "will", "with", "how", "where", "what", "find", "which", "who", "when", "why", "can", "does", "do", "locate",
]
#: Search term -> terms added to the query.
SYNONYMS = {
    "network": ["api", "http", "fetch", "request", "axios"],
    "db": ["database", "sqlite", "sql", "query", "storage"],
    "ui": ["view", "component", "render", "react", "dom"],
    "error": ["exception", "catch", "fail", "crash", "bug"],
    "test": ["spec", "mock", "assert", "jest"],
    "config": ["settings", "env", "options", "setup", "toml", "json"],
    "auth": ["login", "token", "jwt", "session", "security"],
    "graph": ["node", "edge", "dependency", "tree", "ast"],
}


def half_up(x: Column, digits: int) -> Column:
    """Rounds half towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(float(scale))


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(x) + F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", ""))


def tokens(x: Column) -> Column:
    """Estimate: a token for every four UTF-16 units, rounded up."""
    return F.ceil(utf16_length(F.coalesce(x, F.lit(""))) / 4).cast("long")


def count_lines(x: Column) -> Column:
    return F.size(F.split(x, "\n"))


def fit_budget(x: Column, budget: Column | int) -> Column:
    return F.substring(x, F.lit(1), (F.lit(budget) if isinstance(budget, int) else budget) * 4)


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit up to GB, one digit from KB on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(out)
    return out


def format_number(n: Column) -> Column:
    return F.format_number(n, 0)


def format_duration(ms: Column) -> Column:
    minutes = F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "), F.floor(ms % 60000 / 1000).cast("string"), F.lit("s"))
    seconds = F.format_string("%.1fs", ms / 1000.0)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, seconds).otherwise(minutes)


def pluralize(n: Column, word: str, many: str | None = None) -> Column:
    return F.when(n == 1, word).otherwise(many or f"{word}s")


def retrieval_terms(query: Column) -> Column:
    """Terms of a query: lower case, hyphens kept, longer than one character, no stop words."""
    parts = F.split(F.regexp_replace(F.lower(query), r"[^A-Za-z0-9_\s-]", " "), r"\s+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(STOP_TERMS))


def search_terms(query: Column) -> Column:
    """Terms of a full-text query with their synonyms, each once, in order."""
    parts = F.split(F.trim(F.regexp_replace(query, r"[^A-Za-z0-9_\s]", " ")), r"\s+")
    kept = F.filter(F.transform(parts, F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_SEARCH))
    more = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.array_distinct(F.flatten(F.transform(kept, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(more, t), F.array().cast("array<string>"))))))


def path_score(path: Column, terms: Column) -> Column:
    """1.5 for each term in the file name, 1 for each elsewhere in the path, over the number of terms."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.when(F.contains(name, t), 1.5).when(F.contains(low, t), 1.0).otherwise(0.0))
    return F.when(F.size(terms) > 0, total / F.size(terms)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [-1, 1]; 0 for other lengths or a zero vector."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size))).otherwise(F.lit(0.0))


def complexity(code: Column) -> Column:
    """Cyclomatic complexity by counting branches and short-circuit operators."""
    return (F.lit(1) + F.regexp_count(code, F.lit(r"\b(if|for|while|catch|case|elif)\b|&&|\|\||\?\?|\?(?!\.)"))).cast("long")


def complexity_risk(c: Column) -> Column:
    return F.when(c > 15, "HIGH").when(c > 8, "MEDIUM").otherwise("LOW")


def api_path(path: Column) -> Column:
    """Endpoint path: lower case, without host, query and trailing slash."""
    bare = F.substring_index(F.regexp_replace(path, r"^https?://[^/]+", ""), "?", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "/+", "/"), "/$", ""))


def api_match(a: Column, b: Column) -> Column:
    """Whether two endpoint paths agree, ``:x`` and ``{x}`` segments being wildcards on either side."""
    pa, pb = F.split(a, "/"), F.split(b, "/")
    wild = lambda s: s.startswith(":") | s.startswith("{")
    return (a != "") & (b != "") & (F.size(pa) == F.size(pb)) & F.forall(F.zip_with(pa, pb, lambda x, y: (x == y) | wild(x) | wild(y)), lambda x: x)


#: A string, or a comment (the group is the line's end that stays).
JSON_TOKEN = r"(\"(?:\\(?s:.)|[^\"\\])*+\"|'(?:\\(?s:.)|[^'\\])*+')|//[^\n\r]*+|(?s:/\*.*?(?:\*/|$))"


def strip_json_comments(text: Column) -> Column:
    """JSON without line and block comments and without commas before a closing bracket; strings stay."""
    return F.regexp_replace(F.regexp_replace(text, JSON_TOKEN, "$1"), r",\s*([\]}])", "$1")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")


def hash_embedding(text: str, size: int = 128) -> list[float]:
    """A fixed-size embedding: words hashed to signed 32-bit values, L2-normalised."""
    import math
    import re

    out = [0.0] * size
    for word in re.findall(r"[a-z0-9_]+", text.lower()):
        h = 5381
        for c in word:
            h = (((h * 33) & 0xFFFFFFFF) ^ ord(c)) & 0xFFFFFFFF
            h = h - (1 << 32) if h >= 1 << 31 else h
        out[abs(h) % size] += 1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out
