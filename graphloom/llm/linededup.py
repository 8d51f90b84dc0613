"""Line dedup over a corpus: a deletion-neighbourhood join on words.

A line is its words (lower-cased, white space collapsed).  Every line with
``least_words`` words or more (1: every line with a word) is deduplicated: of
equal lines the earliest occurrence stays, and a line of ``near_words`` words or
more also goes when an earlier line of that many words lies within one edit (a
word put in, taken out or replaced).  Earlier means smaller (document id, line number) of the first occurrence; the
earlier line counts whether or not it stays itself, so the result does not
depend on any order of work and the earliest line of a group always stays.

DataFrame functions only, in these steps:

1. Equal lines become one row with its first place.
2. An edit leaves the first or the second half of the words alone, so only
   lines that share a hashed half with another line go on.  No pair is lost.
3. These lines emit hashed deletion variants: for every word, the line with a
   hole in its place (equal keys: one word replaced) and the line without it,
   which equals a shorter line at the same gap (one word put in or taken out).
4. Each key keeps its earliest line alone, by aggregation, so a variant shared
   by a third of all lines makes neither pairs nor a large group.
5. The words of each line and its earlier neighbour are compared: the edit
   distance is verified, a collision of hashes removes nothing.

Lines, keys of variants and documents that a large share of all rows has are
joined by broadcast of a bounded number of such keys (``join_counted``); what
else is broadcast is bounded by its count of entries.

Defined results: null and empty texts have one empty line, which stays, as do
all lines without words; rows that repeat id and text are one document and get
equal results; null ids come first; of places with equal ids the smaller hash of
the text comes first, then the smaller line number; long texts and lines are
read whole; extra columns stay, but for ``ld_removed``, which is replaced; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, materialize, whole_text

LEAST_WORDS, NEAR_WORDS = 1, 10
#: Candidate lines (some 50 bytes each) whose places may be broadcast; beyond, a shuffled join.
FEW_LINES = 400_000


def _document(id_col: str, text_col: str) -> list[Column]:
    """``doc, row``: the key of a document, its id and a hash of id and text."""
    number = F.col(id_col).cast("long")
    return [F.coalesce(number, F.lit(-1)).alias("doc"), F.xxhash64(number, whole_text(text_col)).alias("row")]


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, doc, row, plain``: the text lower-cased, blanks within a line collapsed."""
    text = whole_text(text_col)
    blanks = r" {2,}|\x20*[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*"
    return docs.select(F.col(id_col).cast("long").alias("id"), *_document(id_col, text_col), F.lower(F.regexp_replace(text, blanks, " ")).alias("plain"))


def _rows(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``id, row, line_no, s, n``: a row a line, its n words joined by single blanks."""
    keyed = _plain(docs, id_col, text_col)
    lines = keyed.select("id", "row", F.posexplode(F.split("plain", "\n")).alias("line_no", "line")).withColumn("s", F.trim("line")).drop("line")
    blanks_in = F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit("")))
    return lines.where("s <> ''").withColumn("n", F.explode(F.array(blanks_in + 1))).where(F.col("n") >= least)  # counted once


def _halves(s: Column, n: Column, near_words: int) -> Column:
    """(hash, whether it is a first half) of the first and last floor(n/2) and ceil(n/2) words."""
    low, high = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")

    def half(k: Column, first: bool) -> Column:
        part = F.call_function("substring_index", s, F.lit(" "), k if first else -k)
        return F.struct(F.xxhash64(F.lit(first), k, part).alias("half"), F.lit(first).alias("head"))

    none = F.array().cast("array<struct<half:bigint,head:boolean>>")
    both = lambda *k: F.array(*[half(x, f) for x in k for f in (True, False)])
    return F.when(n < near_words, none).when(n % 2 == 0, both(low)).otherwise(both(low, high))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one edit at most, in linear time."""
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)) <= 1

    def put_in(longer: Column, shorter: Column) -> Column:
        n = F.size(shorter)
        at = F.array_position(F.zip_with(shorter, F.slice(longer, F.lit(1), n), lambda x, y: x == y), False).cast("int")
        rest = F.greatest(n - at + 1, F.lit(0))
        return (at == 0) | (F.slice(shorter, F.greatest(at, F.lit(1)), rest) == F.slice(longer, at + 1, rest))

    gap = F.size(a) - F.size(b)
    return F.when(gap == 0, replaced).when(gap == 1, put_in(a, b)).when(gap == -1, put_in(b, a)).otherwise(False)


def _variants(lines: DataFrame) -> DataFrame:
    """``h1, h2, at, role, key``: the deletion neighbourhood of every line.

    The words before a place are hashed with their positions from the start,
    those after it with their positions from the end, both as running
    exclusive ors, so a line of n words costs n rows and no n copies.
    ``hole``: the word at i left open; ``less``: taken out; ``gap``: the place
    before word i, where a longer line may have one more word.
    """
    words = lines.select("h1", "h2", "at", "heads", "tails", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    line = Window.partitionBy("h1", "h2")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    after = line.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    from_end = F.xxhash64(F.lit("end"), F.col("n") - 1 - F.col("i"), "word")
    hashed = words.withColumns({"a": F.xxhash64(F.lit("start"), "i", "word"), "z": from_end})
    hashed = hashed.withColumns(
        {"p": F.coalesce(F.bit_xor("a").over(before), F.lit(0).cast("long")), "q": F.coalesce(F.bit_xor("z").over(after), F.lit(0).cast("long"))}
    )
    row = lambda role, *key: F.struct(F.lit(role).alias("role"), F.xxhash64(*key).alias("key"))
    n, i, none = F.col("n"), F.col("i"), F.lit(0).cast("long")
    made = [
        row("hole", F.lit("hole"), n, i, F.col("p"), F.col("q")),
        row("less", F.lit("gap"), n - 1, i, F.col("p"), F.col("q")),
        row("gap", F.lit("gap"), n, i, F.col("p"), F.col("q").bitwiseXOR(F.col("z"))),
        F.when(i == n - 1, row("gap", F.lit("gap"), n, n, F.col("p").bitwiseXOR(F.col("a")), none)),
    ]
    # With a first half in common the edit lies behind it, with a last half before it.
    middle = F.floor(n / 2)
    hashed = hashed.where((F.col("heads") & (i >= middle - 1)) | (F.col("tails") & (i <= n - middle)))
    return hashed.select("h1", "h2", "at", F.explode(F.array_compact(F.array(*made))).alias("v")).select("h1", "h2", "at", "v.*")


def _near(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``h1, h2`` of the lines that an earlier line is within one edit of."""
    halves = lines.where(F.size("halves") > 0).select("h1", "h2", F.explode("halves").alias("x")).select("h1", "h2", "x.*")
    common = halves.groupBy("half").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("half")
    candidates = halves.join(common, "half", "left_semi").groupBy("h1", "h2").agg(F.max("head").alias("heads"), F.min("head").alias("no_tail"))
    places = materialize(
        lines.join(candidates, ["h1", "h2"])
        .groupBy(F.coalesce("first.id", F.lit(-1)).alias("doc"), F.col("first.row").alias("row"))
        .agg(F.collect_set(F.struct("h1", "h2", F.col("first.id").alias("id"), F.col("first.line_no").alias("line_no"), "heads", (~F.col("no_tail")).alias("tails"))).alias("take"))
    )
    held = places.agg(F.sum(F.size("take")).alias("n")).first()["n"] or 0
    small = F.broadcast if held <= FEW_LINES else lambda df: df
    text = _plain(docs, id_col, text_col).join(small(places), ["doc", "row"])
    texts = text.select("row", F.explode(F.arrays_zip("take", F.transform("take", lambda x: F.get(F.split("plain", "\n"), x["line_no"])).alias("line"))).alias("x"))
    lines2 = materialize(
        texts.select("x.take.h1", "x.take.h2", F.struct("x.take.id", "row", "x.take.line_no").alias("at"), "x.take.heads", "x.take.tails", F.split(F.trim("x.line"), " ").alias("words"))
        .dropDuplicates(["h1", "h2"])  # rows that repeat
    )
    emitted = _variants(lines2)
    of = lambda role: F.min(F.when(F.col("role") == role, F.struct("at", "h1", "h2"))).alias(f"first_{role}")
    keys = materialize(emitted.groupBy("key").agg(F.count(F.lit(1)).alias("k"), of("gap"), of("less"), of("hole")).where("k > 1"))
    other = F.when(F.col("role") == "hole", F.col("first_hole")).when(F.col("role") == "less", F.col("first_gap")).otherwise(F.col("first_less"))
    pairs = join_counted(emitted, keys, ["key"], "k").select("h1", "h2", "at", other.alias("o")).where("o is not null and o.at < at")
    pairs = pairs.select("h1", "h2", F.col("o.h1").alias("g1"), F.col("o.h2").alias("g2")).distinct()
    words = lines2.select("h1", "h2", "words")
    earlier = lines2.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("other"))
    return pairs.join(words, ["h1", "h2"]).join(earlier, ["g1", "g2"]).where(within_one_edit(F.col("words"), F.col("other"))).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``doc, row, removed``: per document (its key) an array of (line_no, near)."""
    hashed = _rows(docs, id_col, text_col, least_words).select(
        "id", "row", "line_no", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"), _halves(F.col("s"), F.col("n"), max(near_words, 2)).alias("halves")
    )
    hashed = materialize(hashed)
    lines = materialize(
        hashed.groupBy("h1", "h2")
        .agg(F.min(F.struct(F.struct("id", "row", "line_no").alias("first"), "halves")).alias("m"), F.count(F.lit(1)).alias("copies"))
        .select("h1", "h2", "copies", "m.first", "m.halves")
    )
    near = _near(docs, lines, id_col, text_col).withColumn("near", F.lit(True))
    matter = lines.join(near, ["h1", "h2"], "left").where("copies > 1 or near").select("h1", "h2", "copies", "first", F.coalesce("near", F.lit(False)).alias("near"))
    found = join_counted(hashed.select("id", "row", "line_no", "h1", "h2"), materialize(matter), ["h1", "h2"], "copies")
    gone = found.where(F.col("near") | (F.col("first") < F.struct("id", "row", "line_no")))
    return gone.groupBy(F.coalesce("id", F.lit(-1)).alias("doc"), "row").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("line_no", "near")))).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents with their duplicate lines taken out of the text, and
    ``ld_removed`` (line_no, near), null where nothing went."""
    removed = removed_lines(docs, id_col, text_col, least_words, near_words)
    own = [c for c in docs.columns if c != "ld_removed"]
    whole = F.struct(*own).alias("all")  # columns of any name
    marked = docs.select(whole, *_document(id_col, text_col)).join(removed, ["doc", "row"], "left").select("all.*", F.col("removed").alias("ld_removed"))
    lines = F.split(whole_text(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform("ld_removed", lambda x: x["line_no"]))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return marked.withColumn(text_col, F.when(F.col("ld_removed").isNotNull(), text).otherwise(F.col(text_col)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_equal, n_near, removed``: what goes from each document."""
    removed = removed_lines(docs, id_col, text_col)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), *_document(id_col, text_col), F.size(F.split(whole_text(text_col), "\n")).cast("long").alias("n_lines")
    )
    out = narrow.join(removed, ["doc", "row"], "left")
    gone = F.coalesce("removed", F.array().cast("array<struct<line_no:int,near:boolean>>"))
    near = F.size(F.filter(gone, lambda x: x["near"])).cast("long")
    return out.select(
        "doc_id",
        "n_lines",
        (F.size(gone) - near).alias("n_equal"),
        near.alias("n_near"),
        F.array_join(F.transform(gone, lambda x: x["line_no"].cast("string")), ",").alias("removed"),
    )


#: The digest in SQL, from the definition: no halves, no hashes.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, n_lines, unnest(l) AS line, unnest(range(n_lines)) AS line_no
  FROM (SELECT doc_id, l, len(l) AS n_lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), w AS (
  SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM l
), k AS (
  SELECT doc_id, line_no, words, array_to_string(words, ' ') AS s, len(words) AS n FROM w WHERE len(words) >= greatest({LEAST_WORDS}, 1)
), d AS (
  SELECT s, any_value(words) AS words, any_value(n) AS n, min({{'a': doc_id, 'b': line_no}}) AS place FROM k GROUP BY s
), v AS (
  SELECT s, n, place, unnest(range(n)) AS i, words FROM d WHERE n >= {NEAR_WORDS}
), x AS (
  SELECT s, n, place, i, md5(concat(array_to_string(words[:i], ' '), '|', array_to_string(words[i + 2:], ' '))) AS hole,
         array_to_string(list_concat(words[:i], words[i + 2:]), ' ') AS less FROM v
), near AS (
  SELECT s FROM (SELECT s, place, min(place) OVER (PARTITION BY n, i, hole) AS f FROM x) WHERE f < place
  UNION SELECT x.s FROM x JOIN d ON x.less = d.s WHERE d.n >= {NEAR_WORDS} AND d.place < x.place
  UNION SELECT d.s FROM x JOIN d ON x.less = d.s WHERE d.n >= {NEAR_WORDS} AND x.place < d.place
), gone AS (
  SELECT k.doc_id, k.line_no, k.s IN (SELECT s FROM near) AS near
  FROM k JOIN d USING (s) WHERE k.s IN (SELECT s FROM near) OR d.place < {{'a': k.doc_id, 'b': k.line_no}}
), g AS (
  SELECT doc_id, count(*) FILTER (NOT near) AS n_equal, count(*) FILTER (near) AS n_near, string_agg(line_no, ',' ORDER BY line_no) AS removed
  FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(n_equal, 0) AS n_equal,
       coalesce(n_near, 0) AS n_near, coalesce(removed, '') AS removed
FROM documents LEFT JOIN g USING (doc_id)
"""
