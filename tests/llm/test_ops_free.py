"""Packing, toxicity, decontamination, n-gram join, secrets, pipeline: fixtures and brute force."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from graphloom.llm import bestfit, common, decontam, ngramjoin, secrets, toxicity
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=200))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    bins = collections.defaultdict(list)
    for length, first, n, each, at, offset in bestfit.plan(dict(collections.Counter(lengths)), capacity).tolist():
        for k in range(n):
            bins[at + k // each].append((offset + k % each * length, length))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(x for v in bins.values() for _, x in v) == sorted(lengths)
    rooms, opened = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i == len(rooms):
            opened, room = opened + 1, capacity
        else:
            room = rooms.pop(i)
        if room - x:
            bisect.insort(rooms, room - x)
    assert len(bins) == opened


@pytest.mark.parametrize("added", [True, False])
def test_packing(spark, added):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bestfit.default_tokenizer())
    if not added:
        tok.encode_special_tokens = True
    texts = [None, "", "hello world", "é😀 x" * 50, "word " * 3000, "<|endoftext|> a", "hello <|endoftext|> world<|endoftext|><|endoftext|>", "<|endoftext<|endoftext|>|>", "hello world", " \n\t\u3000 123456789 don't", "a" * 5000]
    rows = list(enumerate(texts))
    out = bestfit.pack_documents(docs(spark, rows).selectExpr("*", "1 as piece", "2 as ids"), 64, added_tokens=added).collect()
    got = collections.defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert sorted(got[i]) == [(p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(bestfit.cut(len(ids), 64))]
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 64
    assert bestfit.cut(130, 64) == [(0, 2), (2, 64), (66, 64)] and bestfit.cut(128, 64) == [(0, 64), (64, 64)]
    assert bestfit.pack_documents(docs(spark, []), 64).count() == 0
    assert (50256 in tok.encode(texts[6], add_special_tokens=False).ids) == added
    ids = bestfit.tokenize(docs(spark, [(1, "hello world")]), 64, keep_ids=True).first().ids
    assert tok.decode(ids[:-1]) == "hello world" and ids[-1] == 2


def test_toxicity(spark):
    assert toxicity.fold("You 1d10t! m0r0n") == " you idiot moron " and toxicity.fold("Ѕtuріd ｌｏｓｅｒ") == " stupid loser "
    m = toxicity.Matcher({" trash ": 2.0, " veq": 1.0, " vequ": 3.0})
    assert m.sum(toxicity.fold("the trash can is full")) == (0, 0) and m.sum(toxicity.fold("vequala trash")) == (5.0, 2)
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "stone"]) + rng.choice(["", "s", "ing"]) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = "zorbl" + rng.choice(["ag", "ix", "un"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None), (1001, ""), (0, rows[0][1])]
    d, lab = docs(spark, rows).selectExpr("*", "1 as score"), spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id < 1000:
            assert r.predicted == int(r.doc_id % 5 == 0)
    empty = toxicity.toxicity(d, lab.limit(0)).collect()
    assert len(empty) == len(rows) and toxicity.toxicity(docs(spark, []), lab).count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(1, passage), (2, "short ONE"), (3, None), (4, "!!"), (5, "short one"), (6, "ninß wörds")]
    rows = [(1, "x " + " ".join(f"W{i}" for i in range(5, 17)) + " y"), (2, "a SHORT, one short one. NINß-WÖRDS"), (3, None), (4, ""), (5, "one"), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (2, "clean"), (7, "é" * 3000000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sets = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            sets.setdefault(tuple(w[a : a + k]), set()).add(str(i))

    def brute(t):
        w, hit, found = WORDS.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in sets}:
            for a in range(len(w) - k + 1):
                if own := sets.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= own
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    want = collections.Counter((i, *brute(t)) for i, t in rows)
    d = docs(spark, rows).selectExpr("*", "1 as items", "2 as spans")
    assert collections.Counter(tuple(r) for r in decontam.digest(d, bench).collect()) == want
    for bound in ("MAX_WINDOWS", "MAX_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(decontam, bound, {"MAX_WINDOWS": 4, "MAX_BYTES": 40}[bound])  # several blocks, items cut between them
            assert len(list(decontam.blocks(bench, "item_id", "text", 10))) > 2
            assert collections.Counter(tuple(r) for r in decontam.digest(d, bench).collect()) == want
    cleaned = decontam.remove_spans(decontam.find_hits(d.where("doc_id = 1"), bench)).first().text
    assert cleaned == "x  y"
    same = spark.createDataFrame([(str(i), passage) for i in range(50)], "item_id string, text string")
    assert {(r.n_hit, r.n_items) for r in decontam.digest(d.where("doc_id = 1"), same).collect()} == {(12, 50)}
    assert decontam.digest(d, bench.limit(0)).where("contaminated").count() == 0 and decontam.digest(d.limit(0), bench).count() == 0


def components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root, links = list(range(len(sets))), [0] * len(sets)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[top(k)] = min(low.get(top(k), i), i)
    return collections.Counter((i, len(s), low[top(k)], links[k]) for k, (i, s) in enumerate(sets))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, unique=True).map(sorted), min_size=1, max_size=9), st.integers(1, 6), st.integers(0, 30))
def test_heap_merge(lists, least, last):
    counts = collections.Counter(x for own in lists for x in own)
    assert list(ngramjoin.merge_skip(lists, least, last)) == sorted((x, k) for x, k in counts.items() if k >= least and x <= last)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, unique=True).map(sorted), min_size=1, max_size=30))
def test_t_occurrence(lists):
    sets = sorted((np.array(x, np.int64) for x in lists), key=len)
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert {(q, p) for q, found in ngramjoin.t_occurrence(sets) for p in found.tolist()} == want


@pytest.mark.parametrize("block,hot", [(2_000_000, 100_000), (300, 1), (60, 100_000)])
def test_ngram_join(spark, monkeypatch, block, hot):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "MOST_HOT", 10_000 if hot > 1 else 20)
    monkeypatch.setattr(ngramjoin, "FEW_IDS", hot * 10)
    rng, base = random.Random(block), [f"w{k}" for k in range(60)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "x y"), (1004, "X  y"), (1005, "x y z"), (1006, "é y"), (1007, "a b c d e"), (1007, "a b c d e")]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(w[rng.randint(0, 15) if i % 4 == 0 else 0 :])))
    for i in range(200, 290):  # a chain: neighbours are near, the ends are not
        rows.append((i, " ".join(f"c{k}" for k in range(5 * (i - 200), 5 * (i - 200) + 70))))
    d = docs(spark, rows).selectExpr("*", "1 as n", "2 as cid").repartition(5)
    assert collections.Counter(tuple(r) for r in ngramjoin.join_documents(d).collect()) == components(rows)


def test_ngram_join_empty(spark):
    assert ngramjoin.join_documents(docs(spark, [])).count() == 0


def base_secrets(t):
    key = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    kinds = [("assign", "(" + key + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    n, spans = [], []
    for k, (kind, pattern) in enumerate(kinds):
        ok = [m for m in re.finditer(pattern, t or "") if (len(m[2]) >= 6 if k == 0 else len(m[0]) >= (20, 24)[k - 1])]
        n.append(len(ok))
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in ok]
    return (*n, hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest())


def test_secrets(spark):
    rows = [
        (1, None), (2, ""), (3, "é password: \"abcdef\" TOKEN='abc' api_key = A1+/_.=-b Kſecret:abcdefgh ghp_" + "a" * 36),
        (4, "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + "é0123456789abcdef01234567 0123456789ABCDEF01234567 " + "f" * 50000),
        (5, "token = token = abcdef secretsecret:=abcdef"), (5, "apikey=x apikey=xxxxxx"), (6, "-----BEGIN RSA PRIVATE KEY-----"),
    ]
    got = collections.Counter(tuple(r)[:5] for r in secrets.digest(docs(spark, rows).selectExpr("*", "1 as found")).collect())
    assert got == collections.Counter((i, *base_secrets(t)) for i, t in rows)
    spans = {r.doc_id: r.spans for r in secrets.digest(docs(spark, rows)).collect()}
    assert "github:" in spans[3] and spans[6].startswith("private_key:0:")
    assert secrets.trigram_query("[0-9a-f]{24,}") is True and secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", [b"aki", b"kia"])
    assert secrets.redact_secrets("x AKIA" + "A" * 16) == "x [access]" and secrets.digest(docs(spark, [])).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from graphloom.llm.common import materialize

    rng = random.Random(5)
    text = lambda n: "\n".join(" ".join(rng.choice(["the", "of", "and", *[f"w{rng.randrange(5000)}" for _ in range(5)]]) for _ in range(12)) for _ in range(n))
    clean = [text(12) for _ in range(12)]
    leak = " ".join(f"b{i}" for i in range(20))
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1].replace("w", "w", 1) + "\n" + text(1)), (102, text(12) + "\n" + leak), (103, "### " * 80), (104, None), (105, "too short")]
    d = docs(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    folder = tmp_path / "sf"
    d.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    out, kept = spark.read.parquet(str(folder / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, out, str(folder)))
        assert out.columns == d.columns
        kept.append({r.doc_id for r in out.collect()})
    assert kept[0] == set(range(12)) | {100, 101, 102} and 100 not in kept[1]
    assert kept[3] >= set(range(12)) and 102 not in kept[3] and 102 in kept[2]
    packed = corpus_pipeline.run(spark, str(folder))
    assert {r.doc_id for r in packed.collect()} == kept[3]
    # Repeated rows, rows without an id, names that the stages use themselves, then no rows at all.
    odd = d.where("doc_id < 5").unionByName(d.where("doc_id = 3")).unionByName(d.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.selectExpr("*", "1 as kept", "2 as n_words", "3 as ld_removed", "4 as all", "5 as id", "6 as h1", "7 as other", "8 as row", "9 as component_id")
    for docs_in, left in ((odd, [None, 0, 1, 2, 3, 4]), (odd.limit(0), [])):
        out = docs_in
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, out, str(folder)))
            assert out.columns == odd.columns and {tuple(r)[5:] for r in out.collect()} <= {(1, 2, 3, 4, 5, 6, 7, 8, 9)}
        assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is not None, x)) == left
        assert corpus_pipeline.STAGES[-1][1](spark, out, str(folder)).count() >= len(left)


def test_long_and_repeated_texts(spark):
    """Texts of megabytes, repeated rows and null ids at the operators that read whole texts."""
    long = " ".join(f"word{i}" for i in range(400_000))
    rows = [(1, long), (1, long), (2, long + " more"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "q w e r t y u i o p"), (None, "q w e r t y u i o p z"), (None, "alone in here")]
    d = docs(spark, rows)
    assert collections.Counter(tuple(r) for r in ngramjoin.join_documents(d).collect()) == collections.Counter(
        [(1, 399_996, 1, 2), (1, 399_996, 1, 2), (2, 399_997, 1, 2), (None, 2, 3, 1), (3, 2, 3, 1), (None, 6, None, 1), (None, 7, None, 1), (None, 1, None, 0)]
    )
    got = toxicity.toxicity(d, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) == 1 and not any(r.predicted for r in got)
    mixed = long + " idiot " * 3
    lone = secrets.digest(docs(spark, [(1, long + " AKIA" + "B" * 16), (1, None)])).collect()
    assert sorted(r.n_access for r in lone) == [0, 1]
    assert toxicity.fold(mixed).count("idiot") == 3
