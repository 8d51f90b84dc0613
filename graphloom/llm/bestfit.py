"""Best-fit decreasing packing of documents into sequences.

Best fit only looks at lengths, and pieces of one length are interchangeable.
So the cluster counts pieces by length (at most ``capacity`` counts reach the
driver, whatever the corpus), the driver packs that histogram with a segment
tree over remaining capacities, and the plan - runs of equal pieces in equal
bins - is applied to the pieces by their ordinal among those of their length.
The result equals best-fit decreasing over all documents at once.

The number of runs depends on the capacity, not on the corpus: every length
splits at most two ranges of equal bins.

Defined results: a null text is empty and packs as its end token alone; a text
longer than a sequence is cut and nothing of it is lost; repeated rows are
packed once each; equal lengths (ties) take bins in the order of a hash; extra
columns are ignored; an empty table gives no rows; the string of an added token
is that token, or ordinary text where ``added_tokens`` is false.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import materialize, worker_cache

END_ID = 2
#: Pieces are numbered within buckets of at least so many rows, and there are
#: at most MAX_BUCKETS buckets besides one a length: the table of their offsets
#: has a size that does not grow with the corpus and may be broadcast.
BUCKET_ROWS, MAX_BUCKETS = 1000, 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


class SegmentTree:
    """Open ranges of equal bins by remaining capacity; finds the tightest fit."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.width)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int, there: bool) -> None:
        i = room + self.width
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.ranges[room].append((first, count))
            if len(self.ranges[room]) == 1:
                self._set(room, True)

    def take(self, room: int) -> tuple[int, int]:
        got = self.ranges[room].pop()
        if not self.ranges[room]:
            self._set(room, False)
        return got

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that is >= length."""
        i = length + self.width
        if self.any[i]:
            return length
        while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.width:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.width


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of the packing: length, first ordinal, pieces, a bin, first bin, offset."""
    tree, bins, runs = SegmentTree(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = capacity // length
                opened = -(-left // each)
                first, count = bins, opened
                bins += opened
            else:
                first, count = tree.take(room)
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, done, full * each, each, first, capacity - room))
                tree.put(room - each * length, first, full)
                done, left = done + full * each, left - full * each
                first, count = first + full, count - full
            if left and count and left < each:
                runs.append((length, done, left, left, first, capacity - room))
                tree.put(room - left * length, first, 1)
                done, left = done + left, 0
                first, count = first + 1, count - 1
            tree.put(room, first, count)
    return np.array(runs, np.int64).reshape(-1, 6)


def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by the tiktoken engine.

    Both give the same ids (checked by test), added tokens included; this engine
    is several times faster in one thread.  Ids of such a vocabulary are its
    merge ranks.  Added tokens must stand for their plain string.
    """
    import json
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    cache = worker_cache()
    if ("encoder", path) not in cache:
        model = json.loads(Path(path).read_text())
        special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        if model.get("normalizer") or any(x.get(k) for x in model.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only byte-level files without a normalizer and with plain added tokens")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        by_char = {chr(b): b for b in plain}
        by_char |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(by_char[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        cache["encoder", path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return cache["encoder", path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes the remainder."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenize(docs: DataFrame, capacity: int, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32, salt`` (and ``ids``)."""
    import pyarrow as pa

    path = tokenizer or default_tokenizer()

    def run(batches):
        enc, salt = encoder(path), 0
        added = enc.special_tokens_set if added_tokens else set()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows, ids_out = [], []
            for k, doc_id in enumerate(doc_ids):
                ids = np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(texts[k].as_py() or "", added), np.uint32)
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own.tobytes()), salt))
                    salt += 1
                    if keep_ids:
                        ids_out.append(own.astype(np.int32))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 4))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                if keep_ids:
                    cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces."""
    import pyarrow as pa

    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(counts, capacity)
    rows = max(BUCKET_ROWS, -(-sum(counts.values()) // MAX_BUCKETS))
    by_length = spark.createDataFrame([(k, -(-n // rows)) for k, n in counts.items()], "length long, buckets long")
    marked = pieces.join(F.broadcast(by_length), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.col("buckets"))
    )
    sizes = marked.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(
        "length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "salt")
    placed = marked.withColumn("ordinal", F.row_number().over(within)).join(F.broadcast(offsets), ["length", "bucket"])
    placed = placed.select(*pieces.columns, (F.col("before") + F.col("ordinal") - 1).alias("ordinal"))

    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches):
        for batch in batches:
            lengths, ordinals = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "ordinal"))
            at = np.searchsorted(keys, (lengths << 48) + ordinals, "right") - 1
            own = runs[at]
            k = ordinals - own[:, 1]
            batch = batch.drop_columns(["ordinal"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own[:, 4] + k // own[:, 3]), pa.array(own[:, 5] + k % own[:, 3] * lengths)],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False, added_tokens: bool = True) -> DataFrame:
    """Tokenizes, cuts and packs every document; a row a piece."""
    pieces = materialize(tokenize(docs, capacity, tokenizer, end_id, keep_ids, added_tokens=added_tokens))
    return pack(pieces, capacity).drop("salt")
