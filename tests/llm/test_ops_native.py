"""Sharding, quality rules, personal data, line dedup, url filter: fixtures and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from graphloom.llm import common, linededup, pii, quality, sharding, urlfilter
from hypothesis import given, settings
from hypothesis import strategies as st

DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 25, 97])
def test_sharding(spark, n):
    d = spark.range(n).selectExpr("id as doc_id", "repeat('é', int(id % 4)) as text", "1 as shard", "2 as size")
    rows = sharding.shard_documents(d, shards=3).collect()
    by = collections.defaultdict(list)
    for r in rows:
        text = "é" * (r.doc_id % 4)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "rows", None)
        by[r.shard].append(r.slot)
    assert sorted(r.row_no for r in rows) == list(range(n))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values()), default=0) - min([len(by[s]) for s in range(3)]) <= 1


def feistel_in_python(n, seed, hashes):
    """The permutation of the README's definition, with hashes looked up by (value, round)."""
    a = max(1, math.isqrt(n - 1) + 1 if n else 1)
    b = -(-n // a)

    def once(x):
        left, right = divmod(x, b)
        for k in range(0, sharding.ROUNDS, 2):
            left = (left + hashes[right, k] % a) % a
            right = (right + hashes[left, k + 1] % b) % b
        return left * b + right

    out = []
    for x in range(n):
        p = once(x)
        while p >= n:
            p = once(p)
        out.append(p)
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 30, 97, 400])
def test_feistel_against_python(spark, monkeypatch, n):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    side = math.isqrt(n) + 2
    table = spark.range(side).selectExpr("id as v", *[f"xxhash64(id, {k}, 77) as h{k}" for k in range(sharding.ROUNDS)]).collect()
    hashes = {(r.v, k): r[f"h{k}"] for r in table for k in range(sharding.ROUNDS)}
    want = feistel_in_python(n, 77, hashes)
    d = spark.range(n).selectExpr("id as doc_id", "if(id = 3, repeat('é', 200000), 'x') as text")
    rows = sharding.shard_documents(d, shards=7, seed=77).collect()
    assert {r.row_no: (r.shard, r.slot) for r in rows} == {i: (p % 7, p // 7) for i, p in enumerate(want)} and sorted(want) == list(range(n))
    assert max(r.size for r in rows) == (400_008 if n > 3 else 9)


def test_sharding_repeats_and_partitions(spark):
    rows = [(1, "a")] * 5 + [(None, None)] * 4 + [(i, None) for i in range(20)]
    one = sharding.shard_documents(docs(spark, rows).repartition(1), shards=4).collect()
    two = sharding.shard_documents(docs(spark, rows).repartition(7), shards=4).collect()
    assert len(one) == 29 and sorted(map(str, one)) == sorted(map(str, two))
    assert len({(r.shard, r.slot) for r in one}) == 29


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b#é", max_size=60), max_size=6))
def test_quality_measures(spark, texts):
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "a b c a b c", "x " * 3000])]
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.quality_rules(docs(spark, rows)).collect()}
    assert got == {i: measures(t) for i, t in rows}


def test_quality_verdict(spark):
    clean = "the quick fox and the lazy dog are in a garden of the old house that stands by some water\n" + " ".join(f"word{i} the" for i in range(60))
    junk = " ".join(f"w{i}###" for i in range(80))
    d = docs(spark, [(1, clean), (2, junk), (3, None), (1, clean)]).selectExpr("*", "7 as n_words", "'x' as kept")
    got = sorted((r.doc_id, r.kept) for r in quality.quality_rules(d).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False)]
    assert quality.quality_rules(d).where("kept").count() == 2 and quality.quality_rules(d.limit(0)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_pii(t):
    n, out = [], []
    for kind, pattern in BASE.items():
        spans = []
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        n.append(len(spans))
        out += spans
    return (*n, hashlib.sha256(",".join(out).encode()).hexdigest())


HARD = [
    "a@b.c_x@e.f @x a@b..c a@b.cd@e.f",
    "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 00256.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111x5 -4111111111111111",
    "+1 (017) 555-7713 +12 +1((((2 ++1 23456789.",
    "😀😀 a@b.co 😀1.1.1.1 iban DE89370400440532013000 card amex 378282246310005",
    None,
    "",
    "1" * 20000 + " " + "2 " * 10000 + "a" * 20000 + "@",
]


def test_pii(spark):
    rows = list(enumerate(HARD))
    got = {r.doc_id: r for r in pii.pii_digest(docs(spark, rows).selectExpr("*", "1 as n_email")).collect()}
    for i, t in rows:
        assert tuple(got[i][c] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == base_pii(t), t and t[:60]
    assert "iban:24:46" in got[4].spans and "card:57:72" in got[4].spans
    plain = {
        "x a@b.co 1.2.3.4": "x <email> <ip>", "999.1.1.1 é 4111 1111 1111 1111!": "999.1.1.1 é <card>!", "DE89370400440532013000 and": "<iban> and",
        "+1 2 x +4930123456 a@10.0.0.1.de": "+1 2 x <phone> <email>", "visa 378282246310005": "visa <card>", "": "",
    }
    odd = docs(spark, list(enumerate(plain))).selectExpr("*", "1 as pii_email", "2 as all")
    assert {r.doc_id: (r.text, r.all, r.pii_email) for r in pii.redact_pii(odd).collect()} == {i: (v, 2, 1) for i, v in enumerate(plain.values())}
    assert pii.find_pii(odd).columns == ["doc_id", "text", "all", "pii_email", "pii_ip", "pii_card", "pii_phone", "pii_more"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a1@.+- 20(é", max_size=40), min_size=1, max_size=8))
def test_pii_random(spark, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id: tuple(r)[1:6] for r in pii.pii_digest(docs(spark, rows)).collect()}
    assert got == {i: base_pii(t) for i, t in rows}


LONG = "a b c d e f g h i j k l"
LINES = [
    (1, LONG + "\nshort one\n" + LONG),
    (2, "A  b c d e f X h i j k l\nother words in this line here and now go on"),
    (3, None),
    (4, ""),
    (5, "a b c d e f g h i j k\n\n a b c d e f g h i j k l m"),
    (6, "one two three four five"),
    (7, "one two three four six\none two three four five"),
    (8, "q w e r t y u i o p\nq w e r t y u i o p z"),
    (9, "w q e r t y u i o p"),
    (20, "Short  ONE"),
    (21, "short one\ntail\n tail "),
    (10, " ".join(f"v{i}" for i in range(3000))),
    (11, " ".join(f"v{i}" if i != 1700 else "zz" for i in range(3000))),
]


@pytest.mark.parametrize("hot", [100_000, 1])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "MOST_HOT", 10_000 if hot > 1 else 20)
    monkeypatch.setattr(linededup, "FEW_LINES", hot)
    d = docs(spark, LINES).selectExpr("*", "1 as row", "2 as n")
    got = sorted(tuple(r) for r in linededup.digest(d).collect())
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").toPandas())
    assert got == sorted(con.execute(linededup.ORACLE).fetchall())
    text = {r.doc_id: r.text for r in linededup.dedup_lines(d).collect()}
    assert text[1] == LONG + "\nshort one" and text[20] == "" and text[21] == "tail" and text[7] == "one two three four six" and text[11] == "" and text[3] is None
    odd = docs(spark, [(1, "a b\na b")]).selectExpr("*", "7 as row", "8 as doc", "9 as all", "'x' as ld_removed", "3 as removed")
    assert linededup.dedup_lines(odd).select("text", "row", "doc", "all", "removed").collect() == [("a b", 7, 8, 9, 3)]
    three = linededup.dedup_lines(d, least_words=5).collect()
    assert {r.doc_id: r.text for r in three}[21] == "short one\ntail\n tail "
    twice = docs(spark, [(1, LONG + "\nx"), (1, LONG + "\nx"), (None, LONG)])
    assert sorted((r.doc_id or -1, r.removed) for r in linededup.digest(twice).collect()) == [(-1, ""), (1, "0"), (1, "0")]
    assert linededup.digest(d.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=9, max_size=12), min_size=2, max_size=8))
def test_line_dedup_random(spark, lines):
    d = docs(spark, [(i, " ".join(x)) for i, x in enumerate(lines)])
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    assert sorted(tuple(r) for r in linededup.digest(d).collect()) == sorted(con.execute(linededup.ORACLE).fetchall())


def test_url_filter(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://NET"), (5, "http://a.NET/x://y?z"), (6, "HTTP://Example.NET/en/1#f"), (7, "x://sub.example.com/de/"), (8, "http://example.com/de?x"), (9, "http://a.org/fr/"), (10, "http://É.NET/Q"), (4, "http://NET")]
    d = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as label")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(d).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "net", "", None, "allow"),
        (5, "a.net", "/x://y", "net/", "block"), (6, "example.net", "/en/1", "example.net/en/", "allow"), (7, "sub.example.com", "/de/", "example.com/de/", "block"),
        (8, "example.com", "/de", None, "allow"), (9, "a.org", "/fr/", "org/fr/", "allow"), (10, "É.net", "/Q", "net/", "block"),
    }
    assert urlfilter.judge(d).count() == len(rows) and urlfilter.judge(d.limit(0)).count() == 0


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.com/{'spam' if i % 2 else 'good'}/{i}", i % 2 if i < 60 else None) for i in range(100)]
    rows += [(200 + i, f"http://h.com/word{'abcdefghijklmnopqrstuvwxyz'[i]}x", None) for i in range(26)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), label_col="bad").collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(100))
    assert got[1].template == "/spam/<num>"


def test_wide_nodes_become_wildcards(spark):
    rows = [(i, f"http://h.com/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).select("template").distinct().collect()
    assert [r.template for r in got] == ["/user/*"]


def brute_templates(rows):
    """(host, template, purity, rejected) of each (url, label) by a recursive tree in plain Python."""

    def shape(x):
        if re.fullmatch("[0-9]+", x):
            return "<num>"
        if re.fullmatch(r"[0-9]+\.[A-Za-z]+", x):
            return re.sub("^[0-9]+", "<num>", x)
        return "<id>" if re.search("[0-9]", x) else "<slug>" if len(x) > 40 else x

    pages = []
    for url, label in rows:
        host, path = re.match("^.*?://([^/?#]*)([^?#]*)", url).groups()
        parts, depth = [shape(x) for x in path.split("/") if x], urlfilter.DEPTH
        pages.append((host.lower(), tuple(parts if len(parts) < depth else [*parts[: depth - 1], "/".join(parts[depth - 1 :])]), label))
    share = lambda own: (sum(x or 0 for *_, x in own), sum(x is not None for *_, x in own))
    out = {}

    def descend(own, d, name):
        out.update({(h, s): name for h, s, _ in own if len(s) == d})
        kids = collections.defaultdict(list)
        for p in own:
            if len(p[1]) > d:
                kids[p[1][d]].append(p)
        seldom = [k for k, v in kids.items() if len(v) < urlfilter.SELDOM]
        if len(seldom) > urlfilter.MANY_CHILDREN:
            for k in seldom:
                kids["*"] += kids.pop(k)
        whole, merged = share([p for v in kids.values() for p in v]), collections.defaultdict(list)
        for k, v in kids.items():
            (b, n), put = share(v), k
            rb, rn = whole[0] - b, whole[1] - n
            if n >= urlfilter.LEAST_LABELS and rn >= urlfilter.LEAST_LABELS:
                pooled = (b + rb) / (n + rn)
                if abs(b / n - rb / rn) <= urlfilter.Z * (pooled * (1 - pooled) * (1 / n + 1 / rn)) ** 0.5:
                    put = "{any}"
            merged[put] += v
        for k, v in merged.items():
            descend(v, d + 1, f"{name}/{k}")

    hosts = collections.defaultdict(list)
    for p in pages:
        hosts[p[0]].append(p)
    for own in hosts.values():
        descend(own, 0, "")
    bad, known = share(pages)
    got = []
    for h, s, _ in pages:
        hb, hn = share(hosts[h])
        mb, mn = share([p for p in hosts[h] if out[h, p[1]] == out[h, s]])
        prior = (hb + urlfilter.PSEUDO * bad / max(known, 1)) / (hn + urlfilter.PSEUDO)
        purity = (mb + urlfilter.PSEUDO * prior) / (mn + urlfilter.PSEUDO)
        got.append((h, out[h, s], round(purity, 9), hn >= urlfilter.LEAST_LABELS and purity >= urlfilter.PURITY))
    return got


@pytest.mark.parametrize("hot", [100_000, 1])
def test_url_tree_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "MOST_HOT", 10_000 if hot > 1 else 20)
    monkeypatch.setattr(urlfilter, "DEPTH", 4)
    rng = random.Random(hot)
    rows = []
    for i in range(3000):
        host, top = f"{rng.choice('aab')}.com", rng.choice(["news", "shop", "spam", "tag", "x" * 50])
        rest = rng.choice([[str(i)], [f"{i}.html"], ["deep", "er", "and", rng.choice("pq"), "end"], [], [f"v{i}", "about"], ["w" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10]]])
        bad = rng.random() < {"spam": 0.97, "shop": 0.3}.get(top, 0.01) + 0.4 * (rest[:1] > ["w"])
        rows.append((i, f"http://{host}/{'//'.join([top, *rest])}{rng.choice(['', '/', '?q=1', '#x'])}", int(bad) if i % 4 else None))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int").repartition(3)
    got = {r.page_id: (r.host, r.template, r.purity, r.verdict == "block") for r in urlfilter.judge(df, rules=[], label_col="bad").collect()}
    want = brute_templates([(u, b) for _, u, b in rows])
    assert got == {i: want[i] for i in range(3000)}
    names = {w[1] for w in want}
    assert len(names) > 15 and any("{any}" in x for x in names) and any("*" in x for x in names) and sum(w[3] for w in want) > 100, names


def test_url_labels_are_not_the_rules(spark):
    rows = [(i, f"http://www.casino-win.example.com/en/{i}") for i in range(60)] + [(100 + i, f"http://calm.example.com/en/{i}") for i in range(60)]
    rows += [(300, "http://www.casino-win.example.net/en/5"), (301, None), (302, "http://a.example.com/" + "z/" * 5000 + "q")]
    d = urlfilter.seed_labels(spark.createDataFrame(rows, "page_id long, url string"))
    hidden = {r.page_id for r in d.where("seed is null").collect()}
    assert hidden == {i for i, u in rows if u is None or zlib.crc32(str(i).encode()) % 3 == 1}
    got = {r.page_id: r.verdict for r in urlfilter.judge(d, label_col="seed").collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[100 + i] for i in range(60)} == {"allow"} and len(hidden & set(range(60))) > 10
    assert got[300] == got[301] == got[302] == "allow"
    same = spark.createDataFrame([(1, "http://x.a.b/c/d")], "page_id long, url string")
    ties = [("allow", "a.b", "/c/"), ("block", "x.a.b", "/c"), ("block", "b", "/c/d"), ("allow", "b", "/c/")]
    assert urlfilter.judge(same, rules=ties).first().rule == "x.a.b/c"
    assert urlfilter.judge(same, rules=[("allow", "a.b", "/c"), ("block", "b", "/c/d")]).first().verdict == "block"

def test_pii_zero_parts(spark):
    texts = ["10.0.0.1", "at 0.0.0.0.", "192.168.00.1 and 192.168.0.1", "10.00.1.1 000.0.00.0", "0256.0.0.1 256.0.0.0 0.0.0", "0" * 4000 + ".0.0." + "0" * 4000 + "256"]
    rows = list(enumerate(texts))
    got = {r.doc_id: tuple(r)[1:6] for r in pii.pii_digest(docs(spark, rows)).collect()}
    assert got == {i: base_pii(t) for i, t in rows} and [got[i][1] for i in range(6)] == [1, 1, 2, 2, 0, 0]


def test_pii_iban_before_words(spark):
    de, spaced, gb = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    cases = {
        f"{de} Please pay": [de], f"{spaced} AND": [spaced], f"{de} 12 {gb} X": [de, gb], f"to {gb} Bank 7": [gb], f"{de}\n{spaced}.": [de, spaced],
        f"BE71096123456769 {de}": ["BE71096123456769", de], f"{de}x": [], f"{de}7": [], f"x{de}": [], f"{de[:-1]} 1 AND": [], f"😀 {de} Ä": [de],
        "NO93 8601 1117 947 A B C D E F G H I J K L M N O P Q R S T U V W X Y Z": ["NO93 8601 1117 947"],
    }
    rows = list(enumerate(cases))
    got = {r.doc_id: r.pii_more for r in pii.find_pii(docs(spark, rows)).collect()}
    for i, t in rows:
        spans = [(x.start, x.end) for x in got[i] if x.kind == "iban"]
        assert [t[a:b] for a, b in spans] == cases[t], t
