"""Secret scans over a trigram inverted index.

Every rule's regular expression is parsed once; from its mandatory literals a
Boolean query over trigrams is derived.  Documents are indexed in segments (the
chunks of an Arrow batch): a segment's index maps each trigram that some rule
needs to the sorted list of documents that hold it.  A rule's query intersects
and unites these lists, and only the documents left are verified with the
expression itself.  Rules without mandatory trigrams scan every document.

Defined results: null and empty texts have no spans; long texts are scanned
whole; of matches of one kind that overlap the leftmost counts, across kinds all
count (ties go by place, then in the order of the kinds); repeated rows are
scanned alike; extra columns are ignored; an empty table gives no rows.  Places are
code points, ends exclusive.
"""

from __future__ import annotations

import re
from re import _parser as sre

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrowbytes as ab

#: Kind, expression, least length of a match (or of its group 2).
#: The first three are the base kinds; places and order follow this list.
RULES: list[tuple[str, str, int]] = [
    ("assign", r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 39),
    ("stripe", r"[sr]k_live_[0-9A-Za-z]{24,}", 32),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 28),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 27),
]
BASE = 3
ANY_CASE = {"assign"}
MOST_LITERALS = 64


def _strings(node) -> set[str] | None:
    """All strings a parsed piece can match when they are few, else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg)}
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is not sre.LITERAL:
                return None
            chars.add(chr(value))
        return chars if len(chars) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact(arg[-1])
    if op is sre.BRANCH:
        every = [_exact(x) for x in arg[1]]
        return set().union(*every) if all(x is not None for x in every) else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] in (0, 1) and arg[1] == 1:
        inner = _exact(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _exact(items) -> set[str] | None:
    out = {""}
    for node in items:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_LITERALS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _of_strings(strings: set[str]):
    """The query for a text that holds one of the strings; True where it asks nothing."""
    parts = []
    for s in sorted(strings):
        grams = sorted({s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)})
        if not grams:
            return True
        parts.append(("and", grams))
    return parts[0] if len(parts) == 1 else ("or", parts)


def trigram_query(pattern: str):
    """Boolean trigram query of an expression over ASCII-lowered text."""
    return _query(sre.parse(pattern))


def _query(items):
    parts, held = [], {""}

    def flush():
        nonlocal held
        q = _of_strings({s.lower() for s in held})
        if q is not True:
            parts.append(q)
        held = {""}

    for node in items:
        more = _strings(node)
        if more is not None and len(held) * len(more) <= MOST_LITERALS:
            held = {a + b for a in held for b in more}
            continue
        flush()
        if more is not None:
            held = more
        elif node[0] is sre.SUBPATTERN:
            parts.append(_query(node[1][-1]))
        elif node[0] is sre.BRANCH:
            every = [_query(x) for x in node[1][1]]
            parts.append(True if True in every else ("or", every))
        elif node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and node[1][0] >= 1:
            parts.append(_query(node[1][2]))
    flush()
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class SegmentIndex:
    """Posting lists of the wanted trigrams over one chunk of documents."""

    def __init__(self, bounds: np.ndarray, raw: np.ndarray, slots: np.ndarray, wanted: dict[bytes, int]):
        base, self.docs = bounds[0], len(bounds) - 1
        data = ab.ascii_lower_table()[raw[base : bounds[-1]]].astype(np.int32)
        self.wanted, self.lists = wanted, {}
        if len(data) < 3:
            return
        slot = slots[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(slot)
        owner = np.searchsorted(bounds[1:] - base, at, "right")
        both = np.unique(slot[at].astype(np.int64) * self.docs + owner)
        for s in np.unique(both // self.docs):
            self.lists[int(s)] = both[both // self.docs == s] % self.docs

    def select(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.docs)
        if isinstance(query, bytes):
            return self.lists.get(self.wanted[query], np.zeros(0, np.int64))
        op, parts = query
        got = None
        for part in parts:
            own = self.select(part)
            got = own if got is None else np.intersect1d(got, own, True) if op == "and" else np.union1d(got, own)
            if op == "and" and not len(got):
                break
        return got


class Scanner:
    """Compiled rules, their trigram queries, and the table of wanted trigrams."""

    def __init__(self, rules):
        self.rules = [
            (kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if kind in ANY_CASE else 0)), least, trigram_query(pattern))
            for kind, pattern, least in rules
        ]
        every = sorted(set().union(*(trigrams_of(q) for *_, q in self.rules)))
        self.wanted = {g: i + 1 for i, g in enumerate(every)}
        self.slots = np.zeros(1 << 24, np.uint8 if len(every) < 256 else np.uint16)
        for g, i in self.wanted.items():
            self.slots[int.from_bytes(g, "big")] = i

    def spans(self, text: str, rule: int) -> list[tuple[int, int, int]]:
        _, pattern, least, _ = self.rules[rule]
        group = 2 if pattern.groups >= 2 else 0
        return [(m.start(), m.end(), rule) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]

    def scan(self, bounds: np.ndarray, raw: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Spans (start, end, rule) of each document, by start and then rule."""
        index = SegmentIndex(bounds, raw, self.slots, self.wanted)
        out: list[list] = [[] for _ in range(index.docs)]
        texts: dict[int, str] = {}
        for r, (*_, query) in enumerate(self.rules):
            for d in index.select(query).tolist():
                if d not in texts:
                    texts[d] = raw[bounds[d] : bounds[d + 1]].tobytes().decode()
                out[d] += self.spans(texts[d], r)
        return [sorted(x, key=lambda s: (s[0], s[2])) for x in out]


def find_secrets(docs: DataFrame, rules=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: ``doc_id`` and ``found``, an array of (kind, start, end)."""
    import pyarrow as pa

    rules = list(RULES if rules is None else rules)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            bounds, raw = ab.text_buffers(batch.column("text"))
            out = []
            for first, last in ab.chunks(bounds):
                out += [[{"kind": rules[r][0], "start": a, "end": b} for a, b, r in x] for x in scanner.scan(bounds[first : last + 1], raw)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "found"])

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base kinds, and all spans, a row a document."""
    found = find_secrets(docs)
    kinds = [k for k, *_ in RULES[:BASE]]
    show = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    def of_kind(kind: str):
        return lambda x: x["kind"] == kind

    return found.select(
        "doc_id",
        *[F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.concat_ws(",", F.transform(F.filter("found", lambda x: x["kind"].isin(kinds)), show)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", show)).alias("spans"),
    )


def redact_secrets(text: str) -> str:
    """A text with every span replaced by the kind of its rule."""
    scanner = Scanner(RULES)
    spans = sorted(s for r in range(len(RULES)) for s in scanner.spans(text, r))
    out, at = [], 0
    for a, b, r in spans:
        if a >= at:
            out += [text[at:a], f"[{RULES[r][0]}]"]
            at = b
    return "".join([*out, text[at:]])
