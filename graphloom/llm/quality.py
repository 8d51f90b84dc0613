"""Quality rules: a threshold table compiled into one projection, no user functions.

Defined results: null and empty texts have no words, fail the base rule and are
not kept; long texts are measured whole; of lines and windows that tie the first
counts as the original; repeated rows are judged alike; extra columns stay, but one that is
named like a measure or verdict is replaced by it; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import whole_text

#: What separates words.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German, Spanish.
STOP_WORDS = (
    "the of and to in that is was for it with as be on by this are or at from an "
    "le la les de des du et en un une que qui pour dans est sur avec "
    "der die das und ist mit den zu von auf ein eine "
    "el los las y del por con una se no"
).split()

#: (rule, measure, lowest, highest); None leaves that side open.  Documents
#: outside any bound are rejected.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 50, None),
    ("mean_word_length", "mean_word_chars", 2.0, 14.0),
    ("repeated_windows", "repeat_ratio", None, 0.5),
    ("symbols", "symbol_ratio", None, 0.05),
    ("shouting", "exclaim_ratio", None, 0.4),
    ("stop_words", "stop_ratio", 0.05, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_ratio", None, 0.5),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: A packed window keeps the upper 40 bits of its hash and 24 bits of position.
HASH_BITS = 0xFFFFFFFFFF000000 - (1 << 64)
POSITION_BITS = 0xFFFFFF


def _window(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _with_equal_neighbour(items: Column, same) -> Column:
    """Those elements of a sorted array that equal one beside them."""
    last = F.size(items) - 1
    return F.filter(items, lambda x, i: ((i > 0) & same(x, F.get(items, i - 1))) | ((i < last) & same(x, F.get(items, i + 1))))


def _add_repeats(df: DataFrame) -> DataFrame:
    """``q_exact``: (hash, position) of the 3-word windows found twice or more.

    Each window becomes a long of hash bits and position.  After a sort of
    longs, neighbours with equal hash bits are candidates, and only these pay
    for a sort by the whole 64-bit hash.  Texts of more than 2**24 words have
    every window as a candidate.
    """
    words, n = F.col("q_words"), F.col("n_words").cast("int")
    starts = F.sequence(F.lit(0), n - 3)
    small = n <= POSITION_BITS
    pack = F.transform(starts, lambda i: _window(words, i).bitwiseAND(F.lit(HASH_BITS)).bitwiseOR(i.cast("long")))
    df = df.withColumn("q_packed", F.when((n >= 3) & small, F.sort_array(pack)).otherwise(F.array().cast("array<bigint>")))
    close = _with_equal_neighbour(F.col("q_packed"), lambda x, y: x.bitwiseAND(F.lit(HASH_BITS)) == y.bitwiseAND(F.lit(HASH_BITS)))
    df = df.withColumn(
        "q_close",
        F.when(small, F.transform(close, lambda x: x.bitwiseAND(F.lit(POSITION_BITS)).cast("int"))).otherwise(starts),
    )
    df = df.withColumn("q_near", F.sort_array(F.transform("q_close", lambda i: F.struct(_window(words, i).alias("h"), i.alias("i")))))
    return df.withColumn("q_exact", _with_equal_neighbour(F.col("q_near"), lambda x, y: x["h"] == y["h"]))


def add_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures of the whole text as columns.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the
    ratios that the threshold table names.
    """
    text = whole_text(text_col)
    given = docs.columns
    own = ["q_words", "q_lines", "q_packed", "q_close", "q_near", "q_exact"]
    df = docs.withColumn("q_words", words_of(text)).withColumn(
        "q_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    df = _add_repeats(df.withColumn("n_words", F.size("q_words").cast("long")))
    covered = F.array_distinct(F.flatten(F.transform("q_exact", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "n_repeat_words": F.size(covered).cast("long"),
        }
    )
    some = lambda x: F.greatest(x, F.lit(1)).cast("double")
    n_words, n_lines = some(F.col("n_words")), some(F.size("q_lines"))
    share = lambda test: F.size(F.filter("q_lines", test)).cast("double") / n_lines
    plain = words_of(F.regexp_replace(F.lower(text), r"[.,;:!?\"'()]+", ""))
    df = df.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / n_words,
            "repeat_ratio": F.col("n_repeat_words") / n_words,
            "symbol_ratio": F.col("n_symbols") / some(F.col("word_chars")),
            "exclaim_ratio": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) / n_words,
            "stop_ratio": F.size(F.filter(plain, lambda w: w.isin(STOP_WORDS))) / n_words,
            "dup_line_ratio": F.col("n_dup_lines") / n_lines,
            "bullet_ratio": share(lambda x: F.ltrim(x).rlike("^[-*•]")),
            "ellipsis_ratio": share(lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$")),
        }
    )
    measures = [c for c in df.columns if c not in own and c not in given]
    return df.select(*[c for c in given if c not in measures], *measures)


def compile_rules(thresholds=None) -> Column:
    """The names of the rules that fail, as one array column."""
    bad = []
    for rule, measure, low, high in THRESHOLDS if thresholds is None else thresholds:
        test = F.lit(False)
        if low is not None:
            test = test | (F.col(measure) < low)
        if high is not None:
            test = test | (F.col(measure) > high)
        bad.append(F.when(test, F.lit(rule)))
    return F.array_compact(F.array(*bad))


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds=None) -> DataFrame:
    """All columns, the measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        add_measures(docs, text_col)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", compile_rules(thresholds))
        # A generator of one row: a filter on the verdict stays above it.  Pushed below
        # the projections, the filter would compute every measure again.
        .withColumn("kept", F.explode(F.array(~F.col("base_failed") & (F.size("failed_rules") == 0))))
    )
