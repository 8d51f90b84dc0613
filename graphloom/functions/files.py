"""Column functions over file paths: language, predicates, modules, layers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "c", "c": "c", "rb": "ruby",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "md": "markdown", "html": "html", "htm": "html", "css": "css", "scss": "scss",
    "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "php": "php", "phtml": "php",
    "prisma": "prisma", "dart": "dart", "scala": "scala", "sc": "scala", "lua": "lua", "ex": "elixir",
    "exs": "elixir", "erl": "erlang", "zig": "zig", "graphql": "graphql", "gql": "graphql", "vue": "vue",
    "svelte": "svelte", "astro": "astro",
}
#: File name -> language.
FILE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "shell"}
#: Languages that an extractor exists for.
PARSEABLE = [
    "typescript", "javascript", "python", "go", "rust", "java", "csharp", "cpp", "c", "ruby", "kotlin", "swift", "php", "prisma", "dart", "scala",
    "lua", "elixir", "erlang", "zig", "graphql", "vue", "svelte", "astro", "sql", "shell",
]
#: Parts of the paths of tests, and of generated files.
TEST_STARTS = ("test/", "tests/", "__tests__/")
TEST_PARTS = ("__tests__/", "__test__/", "/test/", "/tests/", ".test.", ".spec.", "_test.", "_spec.")
GENERATED_STARTS = ("dist/", "build/", "out/", "coverage/")
GENERATED_PARTS = ("/dist/", "/build/", "/out/", ".min.", ".generated.", ".d.ts", "/coverage/", "/__generated__/")
#: Extensions of binary files.
BINARY = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp3", ".mp4", ".avi", ".mov", ".webm",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".exe", ".dll", ".so", ".dylib", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".sqlite", ".db",
]
#: Names of files that are a module's public face.
PUBLIC_FILES = ["index.ts", "index.js", "public-api.ts", "public-api.js", "api.ts", "api.js", "main.ts", "main.js"]
#: Fixed values: (layer, directories, middles of file names) in order; the first that fits wins.
LAYERS = [
    ("presentation", ["controllers", "controller", "routes", "route", "views", "pages", "components", "handlers", "api", "web"], ["controller", "route", "handler"]),
    ("application", ["services", "service", "usecases", "use-cases", "commands", "queries", "workflows"], ["service", "usecase"]),
    ("domain", ["domain", "models", "model", "entities", "entity", "aggregates", "value-objects"], ["model", "entity"]),
    ("infrastructure", ["infra", "infrastructure", "repositories", "repository", "repos", "database", "db", "storage", "adapters"], ["repository", "repo", "adapter"]),
    ("shared", ["shared", "common", "utils", "util", "helpers", "core", "types"], []),
]
#: Words in a layer's name -> its type, in order.
LAYER_WORDS = [
    ("presentation", ["controller", "route", "view", "page", "presentation", "api", "web"]),
    ("application", ["service", "usecase", "application", "handler", "workflow"]),
    ("domain", ["domain", "model", "entity", "aggregate"]),
    ("infrastructure", ["infra", "repo", "database", "storage", "adapter"]),
    ("shared", ["shared", "common", "util", "core"]),
]
#: Ends of the paths of entry files (any case, unanchored on the left).
ENTRY = (
    r"(?i)((index|main|app|server|cli|bin|extension|rc)\.[a-z0-9]+|\.config\.[a-z0-9]+|\.d\.ts|/commands/[a-z0-9_-]+\.[a-z0-9]+)$"
)


def normalized(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent directory, or '.' at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Extension with its dot, lower-cased; '' without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """File name, then extension; an unknown alphanumeric extension is itself the language."""
    name, ext = basename(path), F.regexp_replace(extension(path), r"^\.", "")
    named = F.lit(None).cast("string")
    for file, lang in FILE_NAMES.items():
        named = F.when(name == file, lang).otherwise(named)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(named, F.try_element_at(known, ext), F.when(ext.rlike("^[a-z0-9]+$"), ext).otherwise("unknown"))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_test(path: Column) -> Column:
    p = normalized(path)
    return _any([p.startswith(x) for x in TEST_STARTS] + [p.contains(x) for x in TEST_PARTS])


def is_generated(path: Column) -> Column:
    p = F.lower(normalized(path))
    return _any([p.startswith(x) for x in GENERATED_STARTS] + [p.contains(x) for x in GENERATED_PARTS])


def is_parseable(lang: Column) -> Column:
    return lang.isin(PARSEABLE)


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY)


def is_hidden(path: Column) -> Column:
    return basename(path).startswith(".")


def is_public_api(path: Column) -> Column:
    return F.lower(basename(normalized(path))).isin(PUBLIC_FILES)


def is_entry(path: Column) -> Column:
    return path.rlike(ENTRY)


def glob_bare(pattern: str) -> str:
    """The literal text that a loose pattern looks for anywhere in a path.

    The directory form (``**/x/**``) and the middle form (``**/*.m.*``) are
    special cases of the bare substring test that ends the chain, so the text
    without stars and outer slashes decides alone.
    """
    return re.sub(r"^/+|/+$", "", pattern.replace("\\", "/").lower().replace("*", ""))


def glob_match(path: Column, pattern: str) -> Column:
    """The loose pattern test: a substring, any case."""
    bare = glob_bare(pattern)
    return F.lower(path).contains(bare) if bare else F.lit(False)


def default_patterns() -> list[tuple[str, list[str]]]:
    return [(name, [f"**/{d}/**" for d in dirs] + [f"**/*.{m}.*" for m in mids]) for name, dirs, mids in LAYERS]


def layer(path: Column, layers: list[tuple[str, list[str]]] | None = None) -> Column:
    """Name of the first layer with a pattern that fits, or null."""
    out, low = F.lit(None).cast("string"), F.lower(path)
    for name, patterns in reversed(default_patterns() if layers is None else layers):
        bare = [re.escape(x) for x in map(glob_bare, patterns) if x]
        out = F.when(low.rlike("|".join(bare)) if bare else F.lit(False), name).otherwise(out)
    return out


def layer_type(name: Column) -> Column:
    """Layer type by words in the layer's name."""
    low, out = F.lower(name), F.lit("custom")
    for kind, words in reversed(LAYER_WORDS):
        out = F.when(_any([low.contains(w) for w in words]), kind).otherwise(out)
    return out


def bounded_context(path: Column) -> Column:
    """Context name after packages/, apps/ or src/modules|domains|features|contexts/; '' without one."""
    return F.regexp_extract(path, r"(?i)(?:packages|apps|src/modules|src/domains|src/features|src/contexts)/([^/]+)", 1)


def depth_at_most(path: Column, depth: int) -> Column:
    return F.size(F.split(path, "/")) <= depth + 1
