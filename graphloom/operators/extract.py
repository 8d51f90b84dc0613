"""Symbols and imports by line rules, a table of (language, kind, expression).

Every line is trimmed and tested for import, type and function in this order;
the first hit counts.  In languages that keep a current class, functions after
a type line become its methods; the class is the last one seen, a window over
the lines of the file, so no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

W = r"([A-Za-z_$][A-Za-z0-9_$]*)"
#: language -> rules (role, kind, expression whose first group is the name).
RULES: dict[str, list[tuple[str, str, str]]] = {
    "typescript": [
        ("import", "import", r"^(?:import|export)\s+(?:.*?from\s+)?['\"]([^'\"]+)['\"]"),
        ("import", "import", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"),
        ("type", "class", rf"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{W}"),
        ("type", "interface", rf"^(?:export\s+)?interface\s+{W}"),
        ("type", "type", rf"^(?:export\s+)?type\s+{W}\s*[=<]"),
        ("type", "enum", rf"^(?:export\s+)?(?:const\s+)?enum\s+{W}"),
        ("function", "function", rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+{W}"),
        ("plain", "function", rf"^(?:export\s+)?const\s+{W}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
        ("plain", "constant", rf"^(?:export\s+)?(?:const|let|var)\s+{W}\s*[:=]"),
        ("method", "method", rf"^(?:(?:public|private|protected|static|async|override)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){W}\s*\([^)]*\)\s*(?::[^;{{]+)?\{{"),
    ],
    "python": [
        ("import", "import", r"^from\s+([\w.]+)\s+import\b"),
        ("import", "import", r"^import\s+([\w.]+)"),
        ("type", "class", rf"^class\s+{W}"),
        ("function", "function", rf"^(?:async\s+)?def\s+{W}"),
    ],
    "go": [
        ("import", "import", r"^import\s+(?:\w+\s+)?\"([^\"]+)\""),
        ("type", "struct", rf"^type\s+{W}\s+struct\b"),
        ("type", "interface", rf"^type\s+{W}\s+interface\b"),
        ("plain", "method", rf"^func\s+\([^)]*\)\s*{W}\s*\("),
        ("plain", "function", rf"^func\s+{W}\s*[\[(]"),
    ],
    "rust": [
        ("import", "import", r"^(?:pub\s+)?use\s+([^;]+);"),
        ("plain", "struct", rf"^(?:pub(?:\([^)]*\))?\s+)?struct\s+{W}"),
        ("plain", "enum", rf"^(?:pub(?:\([^)]*\))?\s+)?enum\s+{W}"),
        ("plain", "trait", rf"^(?:pub(?:\([^)]*\))?\s+)?trait\s+{W}"),
        ("plain", "function", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{W}"),
    ],
    "java": [
        ("import", "import", r"^import\s+(?:static\s+)?([\w.*]+);"),
        ("type", "class", rf"^(?:\w+\s+)*class\s+{W}"),
        ("type", "interface", rf"^(?:\w+\s+)*interface\s+{W}"),
        ("type", "enum", rf"^(?:\w+\s+)*enum\s+{W}"),
        ("function", "function", rf"^(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+{W}\s*\([^)]*\)[^;]*\{{"),
    ],
    "csharp": [
        ("import", "import", r"^using\s+([\w.]+);"),
        ("type", "class", rf"^(?:\w+\s+)*class\s+{W}"),
        ("type", "interface", rf"^(?:\w+\s+)*interface\s+{W}"),
        ("type", "struct", rf"^(?:\w+\s+)*struct\s+{W}"),
        ("type", "enum", rf"^(?:\w+\s+)*enum\s+{W}"),
        ("function", "function", rf"^(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[\w<>\[\], ?]+\s+{W}\s*\("),
    ],
    "cpp": [
        ("import", "import", r"^#include\s*[<\"]([^>\"]+)[>\"]"),
        ("type", "class", rf"^class\s+{W}"),
        ("type", "struct", rf"^struct\s+{W}"),
        ("type", "enum", rf"^enum\s+(?:class\s+)?{W}"),
        ("function", "function", rf"^(?!if\b|for\b|while\b|switch\b|return\b)[\w:<>*&\s]+?\s+\*?{W}\s*\([^)]*\)\s*(?:const\s*)?\{{"),
    ],
    "ruby": [
        ("import", "import", r"^(?:require|require_relative|load)\s+['\"]([^'\"]+)['\"]"),
        ("type", "class", r"^(?:class|module)\s+([A-Z]\w*)"),
        ("function", "function", r"^def\s+(?:self\.)?(\w+[?!]?)"),
    ],
    "kotlin": [
        ("import", "import", r"^import\s+([\w.*]+)"),
        ("type", "interface", rf"^(?:\w+\s+)*interface\s+{W}"),
        ("type", "class", rf"^(?:\w+\s+)*(?:class|object)\s+{W}"),
        ("function", "function", rf"^(?:\w+\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?{W}"),
    ],
    "swift": [
        ("import", "import", r"^import\s+(\w+)"),
        ("type", "class", rf"^(?:\w+\s+)*class\s+{W}"),
        ("type", "struct", rf"^(?:\w+\s+)*struct\s+{W}"),
        ("type", "enum", rf"^(?:\w+\s+)*enum\s+{W}"),
        ("type", "trait", rf"^(?:\w+\s+)*protocol\s+{W}"),
        ("function", "function", rf"^(?:\w+\s+)*func\s+{W}"),
    ],
    "php": [
        ("import", "import", r"^use\s+([\w\\]+)"),
        ("import", "import", r"^(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"),
        ("type", "class", rf"^(?:abstract\s+|final\s+)*class\s+{W}"),
        ("type", "interface", rf"^interface\s+{W}"),
        ("type", "trait", rf"^trait\s+{W}"),
        ("type", "enum", rf"^enum\s+{W}"),
        ("function", "function", rf"^(?:\w+\s+)*function\s+{W}"),
    ],
    "prisma": [("plain", "model", rf"^model\s+{W}"), ("plain", "enum", rf"^enum\s+{W}")],
    "dart": [
        ("import", "import", r"^import\s+['\"]([^'\"]+)['\"]"),
        ("plain", "class", rf"^(?:abstract\s+)?class\s+{W}"),
        ("plain", "enum", rf"^enum\s+{W}"),
        ("plain", "function", rf"^[\w<>?]+\s+{W}\s*\([^)]*\)\s*(?:async\s*)?(?:\{{|=>)"),
    ],
    "scala": [
        ("import", "import", r"^import\s+([\w.{}, _]+)"),
        ("plain", "interface", rf"^(?:\w+\s+)*trait\s+{W}"),
        ("plain", "class", rf"^(?:\w+\s+)*(?:class|object)\s+{W}"),
        ("plain", "function", rf"^(?:\w+\s+)*def\s+{W}"),
    ],
    "lua": [("import", "import", r"require\s*\(?\s*['\"]([^'\"]+)['\"]"), ("plain", "function", r"^(?:local\s+)?function\s+([\w.:]+)")],
    "elixir": [
        ("import", "import", r"^(?:alias|import|use|require)\s+([\w.]+)"),
        ("plain", "class", r"^defmodule\s+([\w.]+)"),
        ("plain", "function", r"^defp?\s+(\w+[?!]?)"),
    ],
    "erlang": [
        ("import", "import", r"^-include(?:_lib)?\(\s*\"([^\"]+)\""),
        ("plain", "class", r"^-module\(\s*(\w+)"),
        ("plain", "function", r"^([a-z]\w*)\s*\([^)]*\)\s*(?:when\b.*)?->"),
    ],
    "zig": [
        ("import", "import", r"@import\(\s*\"([^\"]+)\""),
        ("plain", "struct", rf"^(?:pub\s+)?const\s+{W}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b"),
        ("plain", "function", rf"^(?:pub\s+)?(?:export\s+)?fn\s+{W}"),
    ],
    "graphql": [
        ("plain", "interface", rf"^interface\s+{W}"),
        ("plain", "type", rf"^(?:type|input|enum|union|scalar)\s+{W}"),
        ("plain", "function", rf"^(?:query|mutation|subscription)\s+{W}"),
    ],
    "sql": [
        ("plain", "model", r"(?i)^create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)"),
        ("plain", "function", r"(?i)^create\s+(?:or\s+replace\s+)?(?:procedure|function)\s+[\"`\[]?([\w.]+)"),
    ],
}
RULES["javascript"] = RULES["vue"] = RULES["svelte"] = RULES["astro"] = RULES["typescript"]
RULES["c"] = RULES["cpp"]
COMMENT = {"python": "#", "ruby": "#", "elixir": "#", "lua": "--", "sql": "--", "erlang": "%", "prisma": "//", "graphql": "#"}


def exported(language: str, line: Column, name: Column) -> Column:
    """Whether a declaration is public, by its language."""
    if language in ("typescript", "javascript", "vue", "svelte", "astro"):
        return line.startswith("export")
    if language in ("python", "dart"):
        return ~name.startswith("_")
    if language == "go":
        return name.rlike("^[A-Z]")
    if language in ("rust", "zig"):
        return line.startswith("pub")
    if language in ("java", "csharp"):
        return line.contains("public")
    if language == "swift":
        return line.contains("public") | line.contains("open")
    if language == "kotlin":
        return ~line.contains("private")
    if language == "php":
        return ~(line.contains("private") | line.contains("protected"))
    if language == "lua":
        return ~line.startswith("local")
    if language == "elixir":
        return ~line.startswith("defp")
    return F.lit(True)


def _found(language: str) -> Column:
    line, out = F.col("line"), F.lit(None).cast("struct<role:string,kind:string,name:string,exported:boolean>")
    for role, kind, pattern in reversed(RULES[language]):
        name = F.regexp_extract(line, pattern, 1)
        row = F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), name.alias("name"), exported(language, line, name).alias("exported"))
        out = F.when(name != "", row).otherwise(out)
    return F.when(line.startswith(COMMENT.get(language, "//")) | line.startswith("/*") | line.startswith("*"), F.lit(None)).otherwise(out)


def declarations(files: DataFrame, key: str = "path") -> DataFrame:
    """``key, line_no, role, kind, name, exported, parent`` from ``key, language, content``."""
    lines = files.where(F.col("language").isin(list(RULES))).select(key, "language", F.posexplode(F.split("content", "\n")).alias("k", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", r"[\t\r]", " ")))
    found = F.lit(None).cast("struct<role:string,kind:string,name:string,exported:boolean>")
    for language in RULES:
        found = F.when(F.col("language") == language, _found(language)).otherwise(found)
    hits = lines.withColumn("f", found).where("f is not null").select(key, "language", (F.col("k") + 1).cast("long").alias("line_no"), "raw", "f.*")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    current = F.last(F.when(F.col("role") == "type", F.col("name")), ignorenulls=True).over(before)
    hits = hits.withColumn("current", current)
    inside = F.col("current").isNotNull() & F.col("role").isin("function", "method")
    inside = inside & ((F.col("language") != "python") | F.col("raw").rlike(r"^(    |\t)"))
    kind = F.when(inside, "method").otherwise(F.col("kind"))
    return hits.where(inside | (F.col("role") != "method")).select(
        key, "line_no", "role", kind.alias("kind"), "name", "exported", F.when(inside, F.col("current")).alias("parent")
    )


def symbols(files: DataFrame, key: str = "path") -> DataFrame:
    return declarations(files, key).where("role <> 'import'").drop("role")


def imports(files: DataFrame, key: str = "path") -> DataFrame:
    return declarations(files, key).where("role = 'import'").select(key, "line_no", F.col("name").alias("import_path"))


def framework_kind(path: Column, name: Column, line: Column) -> Column:
    """Hook, page, layout, route handler, controller, provider or module; null otherwise."""
    return (
        F.when(name.rlike("^use[A-Z]"), "hook")
        .when(path.rlike(r"(^|/)app/.*page\.[jt]sx?$"), "page")
        .when(path.rlike(r"(^|/)app/.*layout\.[jt]sx?$"), "layout")
        .when(path.rlike(r"(^|/)app/.*route\.[jt]s$"), "route_handler")
        .when(line.contains("@Controller"), "controller")
        .when(line.contains("@Injectable"), "provider")
        .when(line.contains("@Module"), "module")
    )
