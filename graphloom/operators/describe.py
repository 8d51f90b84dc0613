"""Signatures and doc comments of declarations.

A declaration's line is known from the line rules; its head (type parameters,
parameters, result, heritage, members of an enum) may run over several lines
and is read by a small machine over brackets, one file at a time in Arrow
batches.  Languages that only have line rules keep the line as signature.

Defined results: a signature longer than ``LONGEST`` characters is cut there
and ends in ``...``; a head is read for at most ``HEAD`` characters, more than a
cut signature can hold; a doc comment (``/** */`` right before the declaration,
blank lines apart) of more than ``DOC_LINES`` lines keeps all but the last one
of these and is closed; a null text has no declarations.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.extract import RULES, declarations

#: The longest signature, the longest plain line, members of an enum, lines of a comment.
LONGEST, LINE, MEMBERS, DOC_LINES = 300, 200, 8, 5
HEAD = 4000
SCRIPT = ("typescript", "javascript", "vue", "svelte", "astro")
#: What stands between parameters and result, in languages whose heads are read.
RESULT = dict.fromkeys(SCRIPT, ":") | {"python": "->", "rust": "->", "php": ":", "go": None}
OPEN, CLOSE = "([{<", ")]}>"


def _after(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``, or the end.

    ``>`` closes ``<`` alone (``=>`` and ``->`` nothing); another bracket also
    closes what a less-than sign seemed to open.
    """
    waiting = []
    for i in range(at, len(text)):
        c = text[i]
        if c in OPEN:
            waiting.append(CLOSE[OPEN.index(c)])
        elif c == ">":
            if waiting[-1] == ">" and text[i - 1] not in "=-":
                waiting.pop()
        elif c in CLOSE:
            while waiting and waiting[-1] == ">" != c:
                waiting.pop()
            if waiting:
                waiting.pop()
        if not waiting:
            return i + 1
    return len(text)


def _spaces(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _group(text: str, at: int, bracket: str) -> tuple[str, int]:
    """The bracketed group at ``at`` (blanks apart) and the place behind it; '' without one."""
    start = _spaces(text, at)
    if text[start : start + 1] != bracket:
        return "", at
    end = _after(text, start)
    return text[start:end], end


def _type(text: str, at: int, arrow: bool) -> str:
    """A type from ``at`` up to the body; an object type counts where a type must begin."""
    i = at
    while i < len(text):
        begins = not text[at:i].strip() or text[at:i].rstrip()[-1] in "|&:,"
        if text[i] in "([<" or (text[i] == "{" and begins):
            i = _after(text, i)
        elif text.startswith("=>", i) and not arrow:
            i += 2
        elif text[i] in "{;=" or (text[i] == "\n" and not begins):
            break
        else:
            i += 1
    return text[at:i].strip()


def _cut(text: str, longest: int) -> str:
    return text[:longest] + "..." if len(text) > longest else text


def _function(language: str, first: str, head: str, name: str) -> str:
    marks = [x for x in ("async", "static") if x + " " in first]
    m = re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$])", head)
    at = m.end() if m else 0
    value = re.match(r"\s*(?::[^=]+)?=\s*(?:async\b\s*)?(?!>)", head[at:]) if language in SCRIPT else None
    at += value.end() if value else 0
    types, at = _group(head, at, "[" if language == "go" else "<")
    params, at = _group(head, at, "(")
    sign, result = RESULT[language], ""
    start = _spaces(head, at)
    if sign and head.startswith(sign, start):
        start += len(sign)
        result = head[start:].split("\n")[0].rpartition(":")[0].strip() if language == "python" else _type(head, start, bool(value))
    tail = f": {result}" if result else ""
    shown = f"{types}{params or '()'}{tail} => ..." if value else f"function {name}{types}{params or '()'}{tail}"
    return _cut(" ".join([*marks, shown]), LONGEST)


def _named(word: str, head: str, name: str) -> str:
    """A class or an interface with type parameters and heritage, up to its body."""
    m = re.search(rf"\b{word}\s+{re.escape(name)}", head)
    at = m.end() if m else len(head)
    types, at = _group(head, at, "<")
    i = at
    while i < len(head) and head[i] not in "{;":
        i = _after(head, i) if head[i] in "(<" else i + 1
    heirs = head[at:i].strip() if re.match(r"\s*(extends|implements)\b", head[at:]) else ""
    return _cut(f"{word} {name}{types}" + (f" {heirs}" if heirs else ""), LONGEST)


def _enum(head: str, name: str) -> str:
    at = head.find("{")
    body = head[at + 1 : _after(head, at) - 1] if at >= 0 else ""
    parts = re.sub(r"//[^\n]*|/\*.*?\*/", "", body, flags=re.S).split(",")
    members = [re.split(r"[=,\s]", x.strip())[0] for x in parts if x.strip()]
    shown = members[:MEMBERS] + (["..."] if len(members) > MEMBERS else [])
    return _cut(f"enum {name}" + (f" {{ {', '.join(shown)} }}" if shown else ""), LONGEST)


def signature_of(language: str, kind: str, name: str, lines: list[str], at: int) -> str:
    """The signature of the declaration on line ``at`` (from 0)."""
    line = lines[at].strip()
    if language not in RESULT:
        return f"{kind} {name}" if language == "prisma" else line
    head, k = line, at + 1
    while len(head) < HEAD and k < len(lines):
        head, k = head + "\n" + lines[k].rstrip(), k + 1
    head = head[:HEAD]
    if kind in ("function", "method"):
        return _function(language, line, head, name)
    if kind in ("class", "interface") and language in (*SCRIPT, "php", "python"):
        return _named(kind, head, name) if language != "python" else f"class {name}"
    if kind == "type":
        return _cut(re.sub(r"\s*=\s*$", "", re.sub(r"^export\s+", "", line)), LONGEST)
    if kind == "enum":
        return _enum(head, name)
    return _cut(line, LINE)


def doc_of(lines: list[str], at: int, floor: int) -> str:
    """The ``/** */`` comment that ends right before line ``at`` and begins behind line ``floor``; else ''."""
    last = at - 1
    while last > floor and not lines[last].strip():
        last -= 1
    if last <= floor or not lines[last].rstrip().endswith("*/"):
        return ""
    first = last
    while first > floor and "/*" not in lines[first]:
        first -= 1
    text = lines[first].lstrip() if first > floor else ""
    if not text.startswith("/**"):
        return ""
    block = [text, *lines[first + 1 : last + 1]]
    block[-1] = block[-1].rstrip()
    return "\n".join(block if len(block) <= DOC_LINES else [*block[: DOC_LINES - 1], " */"])


def described(files: DataFrame, key: str = "path") -> DataFrame:
    """``key, line_no, kind, name, signature, doc`` of every declaration in ``key, language, content``."""
    found = declarations(files, key).where("role <> 'import'")
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "kind", "name"))).alias("found"))

    @F.pandas_udf("array<struct<line_no:bigint,kind:string,name:string,signature:string,doc:string>>")
    def details(contents: pd.Series, languages: pd.Series, hits: pd.Series) -> pd.Series:
        def one(content: str, language: str, rows) -> list[dict]:
            lines, floor, out = content.split("\n"), -1, []
            for r in rows:
                at = r["line_no"] - 1
                out.append({**r, "signature": signature_of(language, r["kind"], r["name"], lines, at), "doc": doc_of(lines, at, floor)})
                floor = at
            return out

        return pd.Series([one(*x) for x in zip(contents, languages, hits)])

    texts = files.where(F.col("language").isin(list(RULES))).select(key, "language", "content").join(listed, key)
    return texts.select(key, F.explode(details("content", "language", "found")).alias("d")).select(key, "d.*")
