"""The graph-pattern language: MATCH ... WHERE ... RETURN, compiled to joins.

Grammar: ``MATCH (v:Label {k: lit})`` with at most one edge to a second node
(``-[v:T]->``, ``<-[v:T]-``, ``--``), ``WHERE`` conditions joined by AND, and a
``RETURN`` list.  Nodes are ``id, label, properties map<string,string>``; edges
are ``source, target, type``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = [
    "MATCH", "WHERE", "RETURN", "AND", "OR", "NOT", "CONTAINS", "STARTS_WITH", "ENDS_WITH", "TRUE", "FALSE", "STARTS", "ENDS", "WITH", "AS",
]
TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_$][A-Za-z0-9_$.]*)
    |(?P<op><-|->|<=|>=|<>|!=|==|--|[()\[\]{}:,=<>\-*.]))""",
    re.VERBOSE,
)
OPERATORS = {"=", "==", "!=", "<>", ">", ">=", "<", "<=", "CONTAINS", "STARTS_WITH", "ENDS_WITH"}


class PatternError(ValueError):
    pass


@dataclass
class Node:
    variable: str = "node"
    label: str | None = None
    properties: dict = field(default_factory=dict)


@dataclass
class Edge:
    variable: str | None = None
    kind: str | None = None
    direction: str = "out"


@dataclass
class Query:
    source: Node
    edge: Edge | None
    target: Node | None
    where: list
    returns: list


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise PatternError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        at, kind = m.end(), m.lastgroup
        value = m[kind]
        if kind == "string":
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        elif kind == "word" and value.upper() in KEYWORDS:
            kind, value = "keyword", value.upper()
        out.append((kind, value))
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    def peek(self, value: str | None = None):
        kind, got = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return got == value if value is not None else (kind, got)

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, got = self.peek()
        if k == "end" or (value is not None and got != value) or (kind is not None and k != kind):
            raise PatternError(f"expected {value or kind}, got {got or 'the end'}")
        self.at += 1
        return got

    def maybe(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def literal(self):
        kind, value = self.peek()
        if kind not in ("string", "number", "word") and value not in ("TRUE", "FALSE"):
            raise PatternError(f"expected a literal, got {value!r}")
        self.at += 1
        if kind == "keyword":
            return value.lower()  # properties are texts
        return (float(value) if "." in value else int(value)) if kind == "number" else value

    def node(self) -> Node:
        self.take("(")
        out = Node()
        if self.peek()[0] == "word":
            out.variable = self.take()
        if self.maybe(":"):
            out.label = self.take(kind="word")
        if self.maybe("{"):
            while not self.maybe("}"):
                key = self.take(kind="word")
                self.take(":")
                out.properties[key] = self.literal()
                self.maybe(",")
        self.take(")")
        return out

    def edge(self) -> Edge | None:
        start = self.peek()[1]
        if start not in ("-", "<-", "--", "->"):
            return None
        self.at += 1
        if start == "--":
            return Edge(direction="out" if self.maybe(">") else "any")
        if start == "->":
            return Edge()
        out = Edge()
        if self.maybe("["):
            if self.peek()[0] == "word":
                out.variable = self.take()
            if self.maybe(":"):
                out.kind = self.take(kind="word")
            self.take("]")
            end = self.take(kind="op")
            if end not in ("-", "->"):
                raise PatternError(f"bad edge end {end!r}")
            out.direction = "in" if start == "<-" else "out" if end == "->" else "any"
        else:
            out.direction = "in" if start == "<-" else "out"
        return out

    def condition(self):
        name = self.take(kind="word")
        op = self.take()
        if op in ("STARTS", "ENDS"):
            self.take("WITH")
            op += "_WITH"
        if op not in OPERATORS:
            raise PatternError(f"unknown operator {op!r}")
        variable, _, prop = name.partition(".")
        return variable, prop or "name", {"==": "=", "<>": "!="}.get(op, op), self.literal()

    def query(self) -> Query:
        self.take("MATCH")
        source, edge = self.node(), self.edge()
        target = self.node() if edge else None
        where = []
        if self.maybe("WHERE"):
            where.append(self.condition())
            while self.maybe("AND"):
                where.append(self.condition())
            if self.peek("OR") or self.peek("NOT"):
                raise PatternError("OR and NOT are not supported")
        self.take("RETURN")
        returns = [self.take(kind="word")]
        while self.maybe(","):
            returns.append(self.take(kind="word"))
        return Query(source, edge, target, where, returns)


def parse(text: str) -> Query:
    return Parser(text).query()


def default_nodes(edges: DataFrame) -> DataFrame:
    """Nodes from edge ends: a Symbol where the id has a colon, else a File."""
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    props = F.create_map(F.lit("name"), F.col("id"))
    return ids.select("id", F.when(F.col("id").contains(":"), "Symbol").otherwise("File").alias("label"), props.alias("properties"))


def _value(entity: Column, prop: str) -> Column:
    own = entity[prop] if prop in ("id", "label") else F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(entity["properties"], F.lit(prop)), own)


def _fits(entity: Column, node: Node) -> Column:
    test = F.lit(True)
    if node.label:
        test = F.lower(entity["label"]) == node.label.lower()
    for k, v in node.properties.items():
        test = test & ((F.try_element_at(entity["properties"], F.lit(k)) == str(v)) | (entity["id"] == str(v)))
    return F.coalesce(test, F.lit(False))


def _holds(value: Column, op: str, want) -> Column:
    number, text = value.try_cast("double"), F.lower(value)
    low = str(want).lower()
    if op in ("=", "!="):
        wanted = F.lit(str(want)).try_cast("double")
        same = F.when(number.isNotNull(), F.coalesce(number == wanted, F.lit(False))).otherwise(text == low)
        test = same if op == "=" else ~same
    elif op == "CONTAINS":
        test = text.contains(low)
    elif op == "STARTS_WITH":
        test = text.startswith(low)
    elif op == "ENDS_WITH":
        test = text.endswith(low)
    else:
        other = F.lit(str(want)).try_cast("double")
        test = {">": number > other, ">=": number >= other, "<": number < other, "<=": number <= other}[op]
    return F.coalesce(value.isNotNull() & test, F.lit(False))


def run(text: str, edges: DataFrame, nodes: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """The rows of a query, a column a returned item (dots become underscores).

    Conditions on the source are filters below the join, so Catalyst pushes
    them into the node scan.  ``parity`` keeps the literal behaviour of an
    undirected edge, whose far end is always the edge's target.
    """
    q = parse(text)
    nodes = default_nodes(edges) if nodes is None else nodes
    as_struct = F.struct("id", "label", "properties")
    rows = nodes.select(as_struct.alias(q.source.variable)).where(_fits(F.col(q.source.variable), q.source))
    names = {q.source.variable}
    if q.edge:
        far = q.target.variable if q.target.variable != q.source.variable else "node2"
        e = edges if q.edge.kind is None else edges.where(F.upper("type") == q.edge.kind.upper())
        forward = e.select(F.col("source").alias("_from"), F.col("target").alias("_to"), "type")
        backward = e.select(F.col("target").alias("_from"), F.col("target" if parity else "source").alias("_to"), "type")
        if q.edge.direction == "in":
            backward = e.select(F.col("target").alias("_from"), F.col("source").alias("_to"), "type")
        links = {"out": forward, "in": backward, "any": forward.unionByName(backward)}[q.edge.direction]
        other = nodes.select(as_struct.alias(far)).where(_fits(F.col(far), q.target))
        rows = rows.join(links, F.col(f"{q.source.variable}.id") == F.col("_from")).join(other, F.col(f"{far}.id") == F.col("_to"))
        names.add(far)
        if q.edge.variable:
            edge = F.struct(F.concat_ws("->", "_from", "_to").alias("id"), F.col("type").alias("label"), F.create_map(F.lit("type"), F.col("type")).alias("properties"))
            rows = rows.withColumn(q.edge.variable, edge)
            names.add(q.edge.variable)
    for variable, prop, op, want in q.where:
        rows = rows.where(_holds(_value(F.col(variable), prop), op, want) if variable in names else F.lit(False))
    out = []
    for item in q.returns:
        variable, _, prop = item.partition(".")
        if variable not in names:
            value = F.lit(None).cast("string")
        elif prop:
            value = _value(F.col(variable), prop)
        else:
            value = F.to_json(F.map_concat(F.col(f"{variable}.properties"), F.create_map(F.lit("id"), F.col(f"{variable}.id"))))
        out.append(value.alias(item.replace(".", "_")))
    return rows.select(*out)


#: Languages that a question may name.
NAMED_LANGUAGES = [
    "typescript", "javascript", "python", "php", "go", "rust", "java", "html", "css", "scss", "sql", "c", "cpp", "ruby", "csharp", "swift", "kotlin",
]
WORD, PATH = r"['\"]?([a-zA-Z0-9_$]+)['\"]?", r"['\"]?([a-zA-Z0-9._\-/]+)['\"]?"
#: Question -> query, in order; English and Indonesian.
QUESTIONS = [
    (rf"(?:who calls|siapa yang memanggil|fungsi yang memanggil|calls to)\s+{WORD}", "MATCH (caller:Symbol)-[:CALLS]->(target:Symbol) WHERE target.name = '{}' RETURN caller"),
    (rf"(?:what does|fungsi yang dipanggil oleh)\s+{WORD}\s*(?:call)?", "MATCH (caller:Symbol)-[:CALLS]->(target:Symbol) WHERE caller.name = '{}' RETURN target"),
    (rf"(?:files importing|file yang (?:meng)?import|which files import|who imports)\s+{PATH}", "MATCH (f:File)-[:IMPORTS]->(t:File) WHERE t.name CONTAINS '{}' RETURN f"),
    (rf"(?:what does|apa yang di(?:-|\s*)?import oleh)\s+{PATH}\s*(?:import)?", "MATCH (f:File)-[:IMPORTS]->(t:File) WHERE f.name CONTAINS '{}' RETURN t"),
    (rf"(?:find function|cari fungsi|search function)\s+{WORD}", "MATCH (s:Symbol) WHERE s.name CONTAINS '{}' RETURN s"),
    (rf"(?:find class|cari class|cari kelas)\s+{WORD}", "MATCH (s:Symbol) WHERE s.name CONTAINS '{}' RETURN s"),
    (rf"(?:find file|cari file|search file)\s+{PATH}", "MATCH (f:File) WHERE f.name CONTAINS '{}' RETURN f"),
    (rf"(?:find|cari|search)\s+{PATH}", "MATCH (s:Symbol) WHERE s.name CONTAINS '{}' RETURN s"),
]


def translate(question: str) -> str | None:
    """A pattern query for a question in words, or None."""
    raw = question.strip()
    if re.search(r"(?i)\b(file|files|berkas|dokumen|code|source)\b", raw):
        for lang in NAMED_LANGUAGES:
            if re.search(rf"(?i)\b{lang}\b", raw):
                return f"MATCH (f:File) WHERE f.language = '{lang}' RETURN f"
    for pattern, query in QUESTIONS:
        if m := re.search(f"(?i){pattern}", raw):
            return query.format(m[1])
    return None


def to_query(text: str) -> str:
    """A valid pattern query: the text itself, its translation, or a search by name."""
    if text.strip().upper().startswith("MATCH"):
        return text
    found = translate(text)
    if found:
        try:
            parse(found)
            return found
        except PatternError:
            pass
    words = re.findall(r"[A-Za-z0-9_$]+", text)
    return f"MATCH (s:Symbol) WHERE s.name CONTAINS '{words[-1] if words else ''}' RETURN s"
