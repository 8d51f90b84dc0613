"""Every query with an oracle, against DuckDB over the smallest tables."""

import collections
import datetime
import os
import re

import duckdb
import pytest
from graphloom.functions import scalars
from graphloom.plans import queries_text, registry
from graphloom.plans.views import TABLES, VIEWS
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = collections.Counter(norm(tuple(r[c] for c in cols)) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = collections.Counter(norm(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_queries_without_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"r1_retrieve", "r7_rank", "b1_benchmark_run", "c1_compress", "c2_context_pack", "sk5_export", "x17_hash_embedding"}


def test_hash_embedding(spark):
    con = duckdb.connect()
    texts = dict(con.execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall())

    rows = [tuple(r) for r in registry.QUERIES["x17_hash_embedding"](spark, SF).collect()]
    vectors = {i: scalars.hash_embedding(t or "") for i, t in texts.items()}
    for i, t in texts.items():
        assert abs(sum(x * x for x in vectors[i]) - 1) < 1e-9 or not any(vectors[i])
    first = vectors[min(texts)]
    near = {i: round(sum(a * b for a, b in zip(first, v)), 9) for i, v in vectors.items()}
    want = sorted(((i, x) for i, x in near.items() if x > 0.1), key=lambda r: (-r[1], r[0]))[:10]
    assert [i for i, _ in rows] == [i for i, _ in want] and all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(rows, want))


def test_retrieval_by_hand(spark):
    """R1 and R7 recomputed from the tables in Python, but for the full-text scores, which have their own SQL."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    read = lambda name, cols: con.execute(f"WITH {', '.join(f'{n} AS ({VIEWS[n]})' for n in ('v_files', 'v_edges_doc', 'v_symbols'))} SELECT {cols} FROM {name}").fetchall()
    files = dict(read("v_files", "file_id, relative_path"))
    terms, got = ["services", "main", "blue"], collections.defaultdict(float)
    hits = queries_text.search.bm25(queries_text.view(spark, SF, "v_files").selectExpr("relative_path as path", "content"), "path", "content", ["the", "of"], 30).collect()
    first = collections.defaultdict(float)
    for r in hits:
        first[r.path, "keyword"] += max(1.0, 5 + abs(r.score))
    for f, name in read("v_symbols", "file_id, name"):
        if f in files and any(t in name.lower() for t in terms):
            first[files[f], "symbol"] += 4.0
    scores = spark.createDataFrame([(p,) for p in files.values()], "path string").select("path", scalars.path_score(F.col("path"), F.array(*[F.lit(t) for t in terms])).alias("s")).collect()
    for r in scores:
        if r.s > 0:
            first[r.path, "path"] += 3.5 * r.s
    known, edges = {p for p, _ in first}, read("v_edges_doc", "src, dst, kind, confidence")
    for src, dst, kind, confidence in edges:
        if src in known:
            first[dst, "dependency"] += 0.8 * confidence * (1.5 if kind in ("extends", "implements") else 1.0)
        if dst in known:
            first[src, "dependency"] += 1.6 * confidence
    reached, into = {p for p, _ in first}, collections.Counter(dst for _, dst, _, _ in edges)
    for p in reached:
        if into[p]:
            first[p, "centrality"] += min(2.5, 0.3 * into[p])
        if re.search("(?i)(test|spec)", p):
            first[p, "intent"] += 2.5
    for (p, _), x in first.items():
        got[p] += x
    top = set(sorted(got, key=lambda p: (-round(got[p], 9), p))[:50])
    rows = {(r.path, r.type): r.score for r in registry.QUERIES["r1_retrieve"](spark, SF).collect()}
    assert {p for p, _ in rows} == top and set(rows) == {k for k in first if k[0] in top}
    assert all(abs(rows[k] - first[k]) < 1e-5 for k in rows)
    ranks = {r.path: r.relevance for r in registry.QUERIES["r7_rank"](spark, SF).collect()}
    w, of = queries_text.search.WEIGHTS, lambda p, k: rows.get((p, k), 0.0)
    for p in top:
        module = sum(t in p.rpartition("/")[0].lower() for t in terms) / 3
        total = w["lexical"] * min(of(p, "keyword") / 10, 1) + sum(w[k] * min(of(p, k), 1) for k in ("symbol", "path", "dependency")) + w["module"] * module
        assert abs(ranks[p] - min(total / sum(w.values()), 1)) < 1e-6, p


def test_queries_see_every_edge(spark):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    every = con.execute("select count(*) - count(distinct l_orderkey) from lineitem").fetchone()[0]
    one = lambda name: registry.QUERIES[name](spark, SF)
    assert one("g1_graph_counts").first()["edges"] == one("a3_graph_summary").first()["edges"] == every
    assert {r.what: r.n for r in one("a1_counts").collect()}["edges"] == every


def test_strong_components(spark):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    pairs = con.execute(f"select distinct src, dst from ({VIEWS['v_edges']})").fetchall()
    ahead, behind = collections.defaultdict(set), collections.defaultdict(set)
    for a, b in pairs:
        ahead[a].add(b)
        behind[b].add(a)

    def walk(x, to):
        seen, todo = {x}, [x]
        while todo:
            new = to[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    want = {}
    for x in sorted({x for p in pairs for x in p}):
        if x not in want:
            want |= dict.fromkeys(walk(x, ahead) & walk(x, behind), x)
    rows = [tuple(r) for r in registry.QUERIES["g14_strong_components"](spark, SF).collect()]
    assert len(rows) == len(want) and dict(rows) == want and max(want) > 60


def small(spark, path, **tables):
    """A folder of tables: those given, and the others from the smallest tables."""
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet") if t not in tables else tables[t].write.parquet(str(path / f"{t}.parquet"))
    return str(path)


def test_packs_of_all_turns_and_conversations(spark, tmp_path):
    n = {1: 30, 7: 2, 9: 1100}
    turns = [(c, t, "user", f"text {t}", "en") for c, k in n.items() for t in range(k)]
    sf = small(spark, tmp_path, conversations=spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, lang string"))
    packs = registry.QUERIES["c2_context_pack"](spark, sf).collect()
    assert {r.task for r in packs} == set(n) and "t012" in {r.path for r in packs if r.task == 1} and all(r.position < n[r.task] for r in packs)
    documents = registry.QUERIES["sk5_export"](spark, sf).collect()
    assert sorted(r.task for r in documents) == sorted(n)
    for r in documents:
        assert r.document.startswith("# Context Pack: demo") and r.document.count("## t") >= min(n[r.task], 14), r.document
    assert [r.document.count("## t") for r in documents if r.task == 7] == [2]
    candidates = queries_text._candidates(spark, sf)
    assert candidates.count() == sum(n.values()) == candidates.select("task", "path").distinct().count()


def test_all_files_have_snippets_and_complexity(spark, tmp_path):
    texts = {i: t for i, t in enumerate(["a ? b : c ?? d?.e", "so THE other the", None, "", "no hit", *["x " * 40 + f"the {i}" for i in range(30)]])}
    sf = small(spark, tmp_path, documents=spark.createDataFrame([(i, t, "en", "web") for i, t in texts.items()], "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r.complexity for r in registry.QUERIES["x18_text_complexity"](spark, sf).collect()}
    branch = re.compile(r"\b(if|for|while|catch|case|elif)\b|&&|\|\||\?\?|\?(?!\.)")
    assert got == {i: 1 + len(branch.findall(f"{t or ''}\nif (a && b) for case " + "while " * (i % 9))) for i, t in texts.items()}
    marks = {r.file_id: r.snippet for r in registry.QUERIES["x26_snippet"](spark, sf).collect()}
    assert set(marks) == set(texts) and marks[1] == "so [THE] o[the]r [the]" and marks[2] is None and marks[4] == "no hit"
    assert all(marks[i].endswith(f"x [the] {i - 5}") for i in range(5, 35))
