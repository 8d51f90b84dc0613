"""Benchmark decontamination: a broadcast set of n-gram windows, scanned and verified.

The windows of the benchmark are hashed into a sorted array that is broadcast:
a number and a place in the normalised text a window, and each text once.  Its
size is bounded: a benchmark with more than ``MAX_WINDOWS`` windows or
``MAX_BYTES`` of text is cut into blocks (a long item too), and the documents
pass through one scan a block, written in between, so that one block at a time
lives on the driver and the executors.  Documents are scanned as bytes: a table
lower-cases A-Z, prefix sums give the hash of every window of words, a bit table
and a binary search find candidates, and the words of each candidate are
compared, so hash collisions cannot count as hits.

Defined results: null and empty texts have no words, no hits and no items;
items without words match nothing, null item ids and texts are ignored; equal
passages in several items count for each of these items; repeated rows are
scanned alike; a long text is scanned whole, in chunks of whole documents;
extra columns are ignored by the scan; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrowbytes as ab
from graphloom.llm.common import materialize

WINDOW = 10
#: What one block may hold: some 40 bytes a window, and its text.
MAX_WINDOWS, MAX_BYTES = 1_000_000, 64_000_000
SPANS = "array<struct<start:int,end:int>>"
BETWEEN = f"doc_id long, text string, items array<string>, runs {SPANS}"
HITS = f"doc_id long, text string, n_words long, n_hit long, items array<string>, spans {SPANS}"


def word_table() -> np.ndarray:
    """True for the bytes of words: digits, a-z, and all of non-ASCII characters."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


class WindowSet:
    """Windows of benchmark items, gathered until a block is full.

    ``tables`` gives, by window size, the sorted hashes of the distinct windows,
    a bit table over their top bits, the place of each in the text, and its items.
    """

    def __init__(self):
        self.texts, self.size, self.windows = [], 0, 0
        self.rows: dict[int, list[tuple]] = {}
        self.items: list[str] = []

    def full(self) -> bool:
        return self.windows >= MAX_WINDOWS or self.size >= MAX_BYTES

    def add(self, item: str, words: list[bytes], size: int, hashes: np.ndarray) -> None:
        """Windows of ``size`` words, one at every word from which on there are enough."""
        text = b" ".join(words) + b" "
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        n = len(words) - size + 1
        first, last = starts[:n] + self.size, ends[size - 1 :] - 1 + self.size
        self.rows.setdefault(size, []).append((hashes, first, last, np.full(n, len(self.items), np.int64)))
        self.items.append(item)
        self.texts.append(text)
        self.size += len(text)
        self.windows += n

    def tables(self) -> tuple:
        text, out = b"".join(self.texts), {}
        for k, rows in self.rows.items():
            hashes, first, last, item = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(hashes, kind="stable")
            hashes, first, last, item = hashes[order], first[order], last[order], item[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            for i in np.flatnonzero(~new).tolist():  # equal hashes: the same words, or a collision
                new[i] = text[first[i] : last[i]] != text[first[i - 1] : last[i - 1]]
            at = np.flatnonzero(new)
            bits = np.zeros(1 << min(max(20, int(len(at)).bit_length() + 3), 25), bool)
            shift = np.uint64(64 - (len(bits).bit_length() - 1))
            bits[hashes[at] >> shift] = True
            out[k] = (hashes[at], bits, shift, first[at], last[at], np.append(at, len(item)), item)
        return text, self.items, out


def scan_chunk(bounds: np.ndarray, raw: np.ndarray, tables: dict):
    """Words a document, and hits: (n_words, {doc: [(first, last word)]}, {doc: items}, starts, ends)."""
    base = bounds[0]
    data = ab.ascii_lower_table()[raw[base : bounds[-1]]]
    docs = len(bounds) - 1
    starts, ends = ab.word_bounds(word_table()[data], bounds[:-1] - base)
    owner = np.searchsorted(bounds[1:] - base, starts, "right")
    hashes = ab.hasher()
    words = hashes.words(data, starts, ends)
    runs: dict[int, list] = {}
    items: dict[int, set] = {}
    text = None
    known, names, by_size = tables
    for k, (keys, bits, shift, first, last, edges, item) in by_size.items():
        window = hashes.windows(words, k)
        near = np.flatnonzero(bits[window >> shift])
        near = near[owner[near] == owner[near + k - 1]]
        lo, hi = np.searchsorted(keys, window[near], "left"), np.searchsorted(keys, window[near], "right")
        some = hi > lo
        for i, a, b in zip(near[some].tolist(), lo[some].tolist(), hi[some].tolist()):
            text = data.tobytes() if text is None else text
            key = b" ".join(text[starts[j] : ends[j]] for j in range(i, i + k))
            for e in range(a, b):  # one, but for collisions
                if known[first[e] : last[e]] == key:
                    d = int(owner[i])
                    runs.setdefault(d, []).append((i, i + k))
                    items.setdefault(d, set()).update(names[x] for x in item[edges[e] : edges[e + 1]])
    return np.bincount(owner, minlength=docs), runs, items, starts, ends, data


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int):
    """Window sets of bounded size over the whole benchmark, read a partition at a time.

    An item that does not fit goes on in the next block, from the first word
    whose window is not yet there.
    """
    held, hashes = WindowSet(), ab.hasher()
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if item is None or not text:
            continue
        data = ab.ascii_lower_table()[np.frombuffer(text.encode(), np.uint8)]
        starts, ends = ab.word_bounds(word_table()[data], np.zeros(1, np.int64))
        if not len(starts):
            continue
        k = min(size, len(starts))
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        windows = hashes.windows(hashes.words(data, starts, ends), k)
        done, n = 0, len(words) - k + 1
        while done < n:
            if held.full():
                yield held
                held = WindowSet()
            more = min(n - done, MAX_WINDOWS - held.windows)
            weight = np.cumsum([len(w) + 1 for w in words[done : done + more + k - 1]])
            more = max(1, min(more, int(np.searchsorted(weight, MAX_BYTES - held.size)) - k + 1))
            held.add(item, words[done : done + more + k - 1], k, windows[done : done + more])
            done += more
    if held.windows:
        yield held


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row a document: ``doc_id, text, n_words, n_hit, items, spans`` (code points)."""
    import pyarrow as pa

    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    pairs = lambda own: [{"start": int(a), "end": int(b)} for a, b in own]

    def scan(shared, last_pass: bool):
        """One block; runs of hit words and items so far are carried along."""

        def run(batches):
            tables = shared.value
            for batch in batches:
                bounds, raw = ab.text_buffers(batch.column("text"))
                old_items = batch.column("items").to_pylist() if "items" in batch.schema.names else None
                old_runs = batch.column("runs").to_pylist() if old_items else None
                n_words, n_hit, items_out, runs_out = [], [], [], []
                for first, last in ab.chunks(bounds):
                    counts, runs, items, starts, ends, data = scan_chunk(bounds[first : last + 1], raw, tables)
                    word0 = np.concatenate([[0], np.cumsum(counts)])
                    n_words += counts.tolist()
                    for d in range(last - first):
                        own = [(a - word0[d], b - word0[d]) for a, b in runs.get(d, ())]
                        got = items.get(d, set())
                        if old_items:
                            own += [(x["start"], x["end"]) for x in old_runs[first + d]]
                            got = got.union(old_items[first + d])
                        own = merged(own)
                        n_hit.append(sum(b - a for a, b in own))
                        items_out.append(sorted(got))
                        if last_pass and own:
                            at, to = bounds[first + d] - bounds[first], bounds[first + d + 1] - bounds[first]
                            place = np.concatenate([[0], np.cumsum((data[at:to] & 0xC0) != 0x80)])
                            own = [(place[starts[word0[d] + a] - at], place[ends[word0[d] + b - 1] - at]) for a, b in own]
                        runs_out.append(pairs(own))
                ids, found = [batch.column("doc_id"), batch.column("text")], pa.array(items_out, pa.list_(pa.string()))
                if last_pass:
                    yield pa.RecordBatch.from_arrays(
                        [*ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), found, pa.array(runs_out, span_type)],
                        ["doc_id", "text", "n_words", "n_hit", "items", "spans"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([*ids, found, pa.array(runs_out, span_type)], ["doc_id", "text", "items", "runs"])

        return run

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    source = blocks(benchmark, item_col, item_text, size)
    block = next(source, WindowSet())
    while (after := next(source, None)) is not None:
        shared = send(block.tables())
        df = materialize(df.mapInArrow(scan(shared, False), BETWEEN))
        shared.destroy()
        block = after
    return df.mapInArrow(scan(send(block.tables()), True), HITS)


def remove_spans(hits: DataFrame) -> DataFrame:
    """The texts of ``find_hits`` without the spans that it found."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(
        x["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])).alias("out")
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return hits.withColumn("text", F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("text")))


def digest(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    hits = find_hits(docs, benchmark, size)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
