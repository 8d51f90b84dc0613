"""URL filters: explicit rules, then a path-template tree judged by labelled purity.

Rules (host and its subdomains, path prefix; the longest wins, of equally long
ones a block) decide first.  For the other urls a tree of path templates is
grown for each host, level by level, with aggregations only:

1. segments that look variable (numbers, ids with digits, long slugs) become
   wildcards, and all pages of one generalised path become one counted row;
2. at every node, if many children are seldom seen, these become ``*``
   (children seen often keep their name);
3. sibling branches whose labelled shares do not differ significantly from the
   other branches of their node (a two-proportion z test) become one branch,
   ``{any}``, and the subtrees below them are joined;
4. a template is rejected when its smoothed purity - labelled bad shares pulled
   towards the host's, and the host's towards the corpus's - is high enough and
   rests on enough labels: of its host, so that a template with few labels
   follows its host, or, where rules are the labels, of its own, since rules
   label whole branches and say nothing of the others.

The tree has one level a segment; from ``DEPTH`` segments on, the rest of a path
is one last segment, generalised part by part, so nothing of it is lost.  Nodes
with very many children and templates with very many pages are joined apart.

Labels come from a column that the caller names; without one, the verdicts of
the rules are the labels.  ``seed_labels`` makes labels from words in the url
alone, for all pages but a held-out third.

Defined results: null urls and urls without ``://`` have empty host and path
and are allowed unless labels speak against the empty template; a path ends
with its last segment that is not empty; very long urls are read whole; null
labels are unknown; repeated pages are judged alike; extra columns stay out of
the result; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, materialize

#: Fixed values: (verdict, host, path) of the rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words of hosts and paths that label a page as bad.
BAD_WORDS = ["adult", "ads", "bets", "betting", "casino", "escort", "gambling", "payday", "pills", "poker", "porn", "viagra", "xxx"]
#: Segments that have a level of their own; children of a wide node, and pages of a seldom child.
DEPTH = 8
MANY_CHILDREN, SELDOM = 20, 5
LEAST_LABELS, Z = 5, 1.96
PSEUDO, PURITY = 4.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=None) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, prefix in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column, depth: int | None = None) -> Column:
    """The generalised segments of a path; from ``depth`` on the rest is one segment."""
    depth = depth or DEPTH

    def shape(raw: Column) -> Column:
        number = F.when(raw.rlike(r"^[0-9]+$"), "<num>").when(raw.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.regexp_replace(raw, r"^[0-9]+", "<num>"))
        return number.when(raw.rlike("[0-9]"), "<id>").when(F.length(raw) > 40, "<slug>").otherwise(raw)

    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), shape)
    rest = F.array_join(F.slice(parts, depth, F.greatest(F.size(parts) - depth + 1, F.lit(0))), "/")
    return F.when(F.size(parts) < depth, parts).otherwise(F.concat(F.slice(parts, 1, depth - 1), F.array(rest)))


def _alike(bad: Column, known: Column, rest_bad: Column, rest_known: Column) -> Column:
    """Whether two labelled shares rest on enough labels and do not differ significantly."""
    one = lambda x: F.greatest(x, F.lit(1))
    pooled = (bad + rest_bad) / one(known + rest_known)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / one(known) + 1 / one(rest_known)))
    gap = F.abs(bad / one(known) - rest_bad / one(rest_known))
    return (known >= LEAST_LABELS) & (rest_known >= LEAST_LABELS) & (gap <= Z * spread)


def grow(paths: DataFrame) -> DataFrame:
    """Adds ``template`` to ``host, segs, n, bad, known``: the tree, from the root down.

    At each level the children of every node are counted, seldom children of
    wide nodes become ``*``, and branches like their siblings ``{any}``.
    """
    paths = paths.withColumn("template", F.lit(""))
    depth = paths.agg(F.max(F.size("segs")).alias("d")).first()["d"] or 0
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "known")]
    for d in range(depth):
        here = paths.where(F.size("segs") > d).withColumn("child", F.get("segs", F.lit(d)))
        children = materialize(here.groupBy(*node, "child").agg(*sums, F.count(F.lit(1)).alias("rows")))
        nodes = materialize(children.groupBy(*node).agg(F.count_if(F.col("n") < SELDOM).alias("seldom"), F.count(F.lit(1)).alias("kids")))
        name = F.when((F.col("seldom") > MANY_CHILDREN) & (F.col("n") < SELDOM), "*").otherwise(F.col("child"))
        named = materialize(join_counted(children, nodes, node, "kids").withColumn("branch", name).drop("seldom", "kids"))
        branches = materialize(named.groupBy(*node, "branch").agg(*sums, F.count(F.lit(1)).alias("kids")))
        whole = branches.groupBy(*node).agg(F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"), F.count(F.lit(1)).alias("siblings"))
        tested = join_counted(branches, materialize(whole), node, "siblings")
        same = _alike(F.col("bad"), F.col("known"), F.col("all_bad") - F.col("bad"), F.col("all_known") - F.col("known"))
        tested = materialize(tested.select(*node, "branch", "kids", F.when(same, "{any}").otherwise(F.col("branch")).alias("put")))
        put = materialize(join_counted(named.select(*node, "child", "branch", "rows"), tested, [*node, "branch"], "kids").select(*node, "child", "rows", "put"))
        longer = join_counted(here, put, [*node, "child"], "rows").withColumn("template", F.concat("template", F.lit("/"), "put"))
        paths = materialize(paths.where(F.size("segs") <= d).unionByName(longer.select(*paths.columns)))
    return paths


def templates(pages: DataFrame, of_host: bool = True) -> DataFrame:
    """``host, segs, n, template, purity, reject`` of every generalised path.

    ``pages`` has ``host, path, label`` (1 bad, 0 good, null unknown);
    ``of_host``: whether the labels of the host are enough to reject.
    """
    keyed = pages.select("host", segments(F.col("path")).alias("segs"), "label")
    paths = keyed.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("label", F.lit(0))).alias("bad"), F.count("label").alias("known"))
    paths = grow(materialize(paths))
    by_template = paths.groupBy("host", "template").agg(F.sum("bad").alias("m_bad"), F.sum("known").alias("m_known"), F.count(F.lit(1)).alias("rows"))
    by_template = materialize(by_template)
    by_host = by_template.groupBy("host").agg(F.sum("m_bad").alias("host_bad"), F.sum("m_known").alias("host_known"), F.count(F.lit(1)).alias("in_host"))
    by_host = materialize(by_host)
    corpus = by_host.agg(F.sum("host_bad").alias("all_bad"), F.sum("host_known").alias("all_known"))
    prior = F.coalesce(F.col("all_bad"), F.lit(0)) / F.greatest(F.coalesce(F.col("all_known"), F.lit(0)), F.lit(1))
    judged = (
        join_counted(by_template, by_host, ["host"], "in_host")
        .join(F.broadcast(corpus))  # one row
        .withColumn("host_share", (F.col("host_bad") + PSEUDO * prior) / (F.col("host_known") + PSEUDO))
        .withColumn("purity", (F.col("m_bad") + PSEUDO * F.col("host_share")) / (F.col("m_known") + PSEUDO))
        .withColumn("reject", (F.col("host_known" if of_host else "m_known") >= LEAST_LABELS) & (F.col("purity") >= PURITY))
        .select("host", "template", "rows", "purity", "reject")
    )
    return materialize(join_counted(paths, materialize(judged), ["host", "template"], "rows").select("host", "segs", "n", "template", "purity", "reject"))


def seed_labels(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", name: str = "seed") -> DataFrame:
    """Adds labels that do not come from the rules: 1 where a word of host or path is
    one of ``BAD_WORDS``, else 0; unknown (null) for null urls and for the third of
    the pages whose crc32 of the id leaves 1, which are held out."""
    words = F.split(F.lower(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^?#]*)", 1)), "[^a-z0-9]+")
    bad = F.arrays_overlap(words, F.array(*[F.lit(x) for x in BAD_WORDS])).cast("int")
    held_out = F.crc32(F.col(id_col).cast("string")) % 3 == 1
    return pages.withColumn(name, F.when(F.col(url_col).isNotNull() & ~F.coalesce(held_out, F.lit(False)), bad))


def judge(pages: DataFrame, rules=None, label_col: str | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every page."""
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), label.alias("given"))
    df = df.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "given")
    df = df.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit.verdict") == "allow", 0)
    df = df.withColumn("label", F.col("given") if label_col else by_rule)
    known = templates(df.select("host", "path", "label"), of_host=label_col is not None)
    out = join_counted(df.withColumn("segs", segments(F.col("path"))), known, ["host", "segs"], "n")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"),
        "template",
        F.round("purity", 9).alias("purity"),
    )
