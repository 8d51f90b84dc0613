"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Text is folded before matching: compatibility forms and homoglyphs become
Latin letters, digits and signs inside words become the letters they stand
for, and words are joined by single blanks.  The lexicon holds whole words
(" idiot ") and word beginnings (" vequ"): a small fixed list, and entries that
labelled documents show to go with toxicity (a G test keeps chance findings out;
the weight is the smoothed log odds).
Matches inside exception phrases do not count, and of the entries that start at
one word only the heaviest counts.  The sum of weights, normalised by length,
goes through a logistic curve fitted on the same labelled documents.

Learning reads at most ``SAMPLE`` labelled documents, those with the smallest
hash of their id; scoring reads every whole text.

Defined results: null and empty texts get the score of a text without matches;
labels without a value or without a document are ignored; a document with
several labels counts as toxic if one says so; without labelled documents the
fixed list and a default curve apply; repeated rows get equal scores; entries
that tie in G are taken in the order of their letters; long texts are scored
whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 30_000
#: Entries of the learned lexicon, at most.
ENTRIES = 2_000
#: Toxic documents that must hold an entry, its least weight, and the least value
#: of its G statistic (a chance of about 6e-7 for one entry).
LEAST_DOCS, LEAST_WEIGHT, LEAST_G = 4, 1.5, 25.0
THRESHOLD = 0.7
PREFIXES = range(3, 10)

#: Whole words that insult.
SEED = "idiot idiots moron morons scum trash stupid loser losers clown pathetic worthless disgusting imbecile dumbass bastard".split()
SEED_WEIGHT = 4.0
#: Phrases in which such words are harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "class clown", "idiot proof",
    "sore loser", "pond scum", "stupid question", "take out the trash",
)
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "аеорсухіѕјԁһкмтвнАЕОРСУХІЅЈКМТВНαοειυνρτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ",
    "aeopcyxisjdhkmtbhAEOPCYXISJKMTBHaoeiuvptkABEZHIKMNOPTYXig",
)
#: Digits and signs that stand for letters inside words.
LEET = str.maketrans("0134578@$!|", "oieasTbasil".lower())
MIXED = re.compile(r"(?=[0-9@$!|]*[a-z])(?=[a-z]*[0-9@$!|])[a-z0-9@$!|]*[a-z][a-z0-9@$!|]*", re.ASCII)
HINT = re.compile(r"[a-z][0134578@$!|]+[a-z]|\b[0134578@$|]+[a-z]", re.ASCII)
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower-case words, folded, each with one blank before and after."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(HOMOGLYPHS)
    text = text.lower()
    if HINT.search(text):
        text = MIXED.sub(lambda m: m[0].rstrip("!|").translate(LEET) + m[0][len(m[0].rstrip("!|")) :], text)
    return " " + " ".join(WORD.findall(text)) + " "


def features(folded: str) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) >= 3}
    for w in words:
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


class Matcher:
    """The lexicon as an automaton; sums the weights that count in a text."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in EXCEPTIONS:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def sum(self, folded: str) -> tuple[float, int]:
        """Sum of weights and number of matched words."""
        best, spared = {}, []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in spared:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values()), len(best)


def curve_inputs(total: float, hits: int, n_words: int) -> tuple[float, float]:
    """Sum of weights, and the sum a hundred words, both damped."""
    return math.log1p(total), math.log1p(100.0 * total / max(n_words, 25))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``sample`` labelled documents."""
    ids = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def learn(sample: DataFrame) -> dict:
    """Lexicon and curve from a table of ``text, toxic`` (0 or 1)."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            seen, n = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n[toxic] += 1
                seen.update((f, toxic) for f in features(fold(text or "")))
            rows = [("", t, k) for t, k in n.items()] + [(f, t, k) for (f, t), k in seen.items()]
            for a in range(0, len(rows), 50_000):
                cols = list(zip(*rows[a : a + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["f", "toxic", "n"])

    narrow = sample.select("text", F.col("toxic").cast("int").alias("toxic"))
    counted = narrow.mapInArrow(count, "f string, toxic int, n long")
    totals = counted.groupBy("f").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    kept = totals.where(F.col("t") >= LEAST_DOCS).orderBy(F.col("t").desc(), "c", "f")
    # The totals of the sample come first: no feature is in more toxic documents.
    top = [tuple(r) for r in kept.where((F.col("f") == "") | (F.col("t") > 4 * F.col("c"))).limit(20 * ENTRIES).collect()]
    all_t, all_c = next(((t, c) for f, t, c in top if f == ""), (0, 0))
    lexicon = {f" {w} ": SEED_WEIGHT for w in SEED}
    if all_t and all_c:
        learned = {}
        for f, t, c in top:
            if f == "":
                continue
            share = all_t / (all_t + all_c)
            g = 2 * sum(k * math.log(k / ((t + c) * p)) for k, p in ((t, share), (c, 1 - share)) if k)
            weight = math.log((t + 0.5) / (all_t + 1)) - math.log((c + 0.5) / (all_c + 1))
            if weight >= LEAST_WEIGHT and g >= LEAST_G:
                learned[f] = (g, weight)
        best = sorted(learned, key=lambda f: (-learned[f][0], f))[:ENTRIES]
        lexicon |= {f: max(learned[f][1], lexicon.get(f, 0.0)) for f in best}

    def score(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                folded = fold(text or "")
                out.append(curve_inputs(*matcher.sum(folded), folded.count(" ") - 1))
            x, y = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64()), batch.column("toxic")], ["x", "y", "toxic"])

    rows = narrow.mapInArrow(score, "x double, y double, toxic int").toPandas() if all_t and all_c else None
    return {"lexicon": lexicon, "curve": fit_curve(rows) if rows is not None else (-6.0, 1.0, 1.5)}


def fit_curve(rows) -> tuple[float, float, float]:
    """Logistic regression on the two inputs, with a small ridge."""
    x = np.column_stack([np.ones(len(rows)), rows["x"], rows["y"]]).astype(float)
    y = rows["toxic"].to_numpy(float)
    beta, ridge = np.array([-3.0, 0.5, 0.5]), np.diag([0.01, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge @ beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, hits`` of every document."""
    import pyarrow as pa

    lexicon, (b0, b1, b2) = model["lexicon"], model["curve"]

    def run(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            scores, hits = [], []
            for text in batch.column("text").to_pylist():
                folded = fold(text or "")
                total, n = matcher.sum(folded)
                x, y = curve_inputs(total, n, folded.count(" ") - 1)
                z = b0 + b1 * x + b2 * y
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "score", "hits"])

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, "doc_id long, score double, hits long")


def held_out(id_col: str = "doc_id"):
    """Documents never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = learn(labelled_sample(docs, labels.where(~held_out()), sample))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
