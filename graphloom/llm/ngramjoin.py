"""N-gram Jaccard join: exact links at a similarity of 0.8, by T-occurrence search.

A document's set is its distinct 5-word shingles (64-bit hashes).  Two sets with
a Jaccard similarity of t or more share at least ceil(t * size) shingles of
either, and this is used three times, each time without losing a link:

1. *Survivors.*  A document with a link shares ceil(t * size) of its shingles
   with that one document, so at least as many of them occur elsewhere.  All
   shingles are counted, by buckets of packed arrays; each batch sends a shingle
   once, and shingles shared inside a batch are settled there, so a passage in a
   third of all documents costs one entry a batch.
2. *Candidates.*  Equal sets become one class.  In the order of hashes, linked
   classes share their first l common shingles (l a fifth of the set) within
   their first ``n - ceil(t n) + l``; only these are sent.  Ordered by rarity,
   all but l - 1 of them form the prefix (l of the smallest partner); linked
   classes share a prefix shingle, so they lie in one connected component of
   the graph of prefix shingles.
3. *T-occurrence.*  Components are dealt out as blocks of bounded size: small
   ones together, a large one as pairs of chunks or by its prefix shingles,
   whichever copies less (a pair that meets in several blocks counts in the one
   of its first common prefix shingle).  A block has an inverted index over its
   classes in the order of their sizes; for each class DivideSkip merges the
   short posting lists by a heap that skips what cannot reach T minus the number
   of long lists, and probes the long lists by binary search.  A partner at
   least as large as a set of n shares 8/9 n with it, which is T.

Blocks return a row a class (links and a spanning forest), never the links
themselves, so a group of n near copies costs n rows.  Components of links come
from a distributed star contraction.

Defined results: texts without words (null, empty) have no shingles, no links
and are a component of their own; fewer than five words form one shingle; rows
that share an id count as separate documents with one label, and each gets the
smallest label among the components of that id's rows; long texts are read
whole; extra columns are ignored; an empty table gives no rows; documents
without an id are linked like others, and the label of a component of such
documents alone is null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrowbytes as ab
from graphloom.llm.common import join_counted, materialize, release

SHINGLE = 5
#: Similarity as numerator and denominator.
NUM, DEN = 4, 5
#: Shingles that a counting bucket holds about; tokens a mapper gathers before it
#: sends; documents whose counts are summed together.
BUCKET, FLUSH, DOCS = 500_000, 2_000_000, 20_000
#: Rows of ids and places of classes that may be broadcast (some 40 bytes each); beyond, a shuffled join.
FEW_IDS = 1_000_000
#: Shingles that one T-occurrence block holds about: at most, and at least where the work is to be spread.
BLOCK, LEAST_BLOCK = 2_000_000, 10_000
#: Weight of a probe of a long list against the merge of a short one in DivideSkip.
MU = 0.01


def least(n):
    """ceil(t n): shingles that a set of n shares with any linked set."""
    return -(-NUM * n // DEN)


def extra(n):
    """l: the common shingles that the first part of a set must hold."""
    return -(-n // 5)


def first_part(n):
    """Shingles, by hash, among which linked sets share l."""
    return n - least(n) + extra(n)


def prefix_size(n):
    """Of these, the rarest ones that hold one common shingle at least."""
    return first_part(n) - extra(least(n)) + 1


def space_table() -> np.ndarray:
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


def shingle_sets(bounds: np.ndarray, raw: np.ndarray, size: int = SHINGLE):
    """Sorted distinct shingle hashes of each document of a chunk."""
    base = bounds[0]
    data = ab.ascii_lower_table()[raw[base : bounds[-1]]]
    docs = len(bounds) - 1
    starts, ends = ab.word_bounds(space_table()[data], bounds[:-1] - base)
    hashes = ab.hasher()
    words = hashes.words(data, starts, ends)
    word0 = np.searchsorted(starts, np.append(bounds[:-1] - base, len(data) + 1))
    full = hashes.windows(words, size)
    for d in range(docs):
        a, b = word0[d], word0[d + 1]
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            yield hashes.windows(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sign_documents(docs: DataFrame, with_tokens: bool = False) -> DataFrame:
    """``doc_id, n, s1, s2``: set size and a 128-bit signature (and the set itself)."""
    import pyarrow as pa

    def run(batches):
        salt = np.uint64(0x5851F42D4C957F2D)
        for batch in batches:
            bounds, raw = ab.text_buffers(batch.column("text"))
            for first, last in ab.chunks(bounds):
                sets = list(shingle_sets(bounds[first : last + 1], raw))
                cols = [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(_signed(np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64))),
                    pa.array(_signed(np.array([ab.mix(x ^ salt).sum(dtype=np.uint64) for x in sets], np.uint64))),
                ]
                names = ["doc_id", "n", "s1", "s2"]
                if with_tokens:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                    flat = _signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    names.append("tokens")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n long, s1 long, s2 long" + (", tokens array<long>" if with_tokens else "")
    return docs.mapInArrow(run, schema)


def _low_bits(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each sorted token, and the next 24 bits (sorted within the bucket)."""
    x = (tokens >> np.uint64(16)) * np.uint64(buckets)
    return x >> np.uint64(48), ((x >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.uint32)


def _squeeze(sorted24: np.ndarray) -> bytes:
    """Sorted 24-bit numbers as counts of their upper 8 bits and their lower 16 bits."""
    counts = zlib.compress(np.bincount(sorted24 >> 16, minlength=256).astype(np.uint32).tobytes(), 1)
    return len(counts).to_bytes(4, "little") + counts + (sorted24 & 0xFFFF).astype(np.uint16).tobytes()


def _unsqueeze(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    counts = np.frombuffer(zlib.decompress(blob[4 : 4 + size]), np.uint32)
    return (np.repeat(np.arange(256, dtype=np.uint32), counts) << np.uint32(16)) | np.frombuffer(blob, np.uint16, offset=4 + size)


def count_shared(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """``doc_id, shared``: how many of its shingles another document has too.

    May count too many (24 bits of a shingle are compared within a bucket),
    never too few.  Both shuffles carry packed arrays, a row a bucket and batch
    or a row a bucket and group of documents.
    """
    import pyarrow as pa

    names = ["bucket", "tokens", "owners", "ids"]

    def send(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)

    def pack_ids(ids: np.ndarray) -> bytes:
        return zlib.compress(np.diff(ids, prepend=0).tobytes(), 1)

    def unpack_ids(blob: bytes) -> np.ndarray:
        return np.cumsum(np.frombuffer(zlib.decompress(blob), np.int64))

    def pack(held, ids):
        """One row a bucket: tokens, owner of each (65535: several), ids of owners."""
        tokens = np.concatenate([t for _, t in held])
        owner = np.concatenate([np.full(len(t), k, np.uint16) for k, t in held])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff(np.append(at, len(tokens)))
        credit = np.bincount(owner[np.repeat(size > 1, size)], minlength=len(ids))
        salt = int(tokens[0] % np.uint64(1 << 20))
        tokens, owner = tokens[at], np.where(size > 1, np.uint16(65535), owner[at])
        bucket, low = _low_bits(tokens, buckets)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        if credit.any():
            have = np.flatnonzero(credit)
            rows.append((-1 - salt, b"", credit[have].astype(np.uint32).tobytes(), pack_ids(ids[have])))
        for b in np.flatnonzero(np.diff(edges)):
            o = owner[edges[b] : edges[b + 1]]
            used, place = np.unique(o, return_inverse=True)
            several = int(used[-1] == 65535)
            place = np.where(o == 65535, 65535, place).astype(np.uint16)
            rows.append((int(b), _squeeze(low[edges[b] : edges[b + 1]]), place.tobytes(), pack_ids(ids[used[: len(used) - several]])))
        return rows

    def spread(batches):
        held, ids, size = [], [], 0
        for batch in batches:
            no_id = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            bounds, raw = ab.text_buffers(batch.column("text"))
            for first, last in ab.chunks(bounds):
                for d, tokens in enumerate(shingle_sets(bounds[first : last + 1], raw), first):
                    if not len(tokens):
                        continue
                    held.append((len(ids), tokens))
                    # A document without an id is counted under the sum of its hashes.
                    ids.append(_signed(tokens.sum(dtype=np.uint64, keepdims=True))[0] if no_id[d] else doc_ids[d])
                    size += len(tokens)
                    if size >= FLUSH or len(ids) == 65535:
                        yield send(pack(held, np.array(ids, np.int64)))
                        held, ids, size = [], [], 0
        if held:
            yield send(pack(held, np.array(ids, np.int64)))

    def by_group(ids: np.ndarray, credits: np.ndarray):
        group = ab.mix(ids.view(np.uint64)) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        ids, credits, group = ids[order], credits[order], group[order]
        edges = np.searchsorted(group, np.arange(groups + 1))
        return [
            (int(g), ids[edges[g] : edges[g + 1]].tobytes(), credits[edges[g] : edges[g + 1]].astype(np.uint32).tobytes())
            for g in np.flatnonzero(np.diff(edges))
        ]

    def meet(table: pa.Table) -> pa.Table:
        """All rows of a bucket: credits the owners of tokens that came twice."""
        tokens, owners, ids, base, out = [], [], [], 0, []
        for t, o, i in zip(*(table.column(c).to_pylist() for c in names[1:])):
            own = unpack_ids(i)
            if not t:
                out += by_group(own, np.frombuffer(o, np.uint32))
                continue
            o = np.frombuffer(o, np.uint16).astype(np.int64)
            tokens.append(_unsqueeze(t))
            owners.append(np.where(o == 65535, -1, o + base))
            ids.append(own)
            base += len(own)
        if tokens:
            token, owner, id_of = np.concatenate(tokens), np.concatenate(owners), np.concatenate(ids)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            same = token[1:] == token[:-1]
            shared = np.zeros(len(token), bool)
            shared[1:] |= same
            shared[:-1] |= same
            credit = np.bincount(owner[shared & (owner >= 0)], minlength=len(id_of))
            have = np.flatnonzero(credit)
            out += by_group(id_of[have], credit[have])
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["part", "ids", "credits"])

    def total(table: pa.Table) -> pa.Table:
        """All credits of a group of documents, summed by id."""
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        credits = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("credits").to_pylist()])
        each, place = np.unique(ids, return_inverse=True)
        return pa.table([pa.array(each), pa.array(np.bincount(place, weights=credits).astype(np.int64))], ["doc_id", "shared"])

    blobs = docs.mapInArrow(spread, "bucket int, tokens binary, owners binary, ids binary")
    met = blobs.groupBy("bucket").applyInArrow(meet, "part int, ids binary, credits binary")
    return met.groupBy("part").applyInArrow(total, "doc_id long, shared long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node of ``edges(a, b)``.

    Alternates the large-star and small-star contractions until only stars are
    left; each round is written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct())
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = materialize(small.select("e.*").where("a <> b").distinct())
        release(edges.sparkSession, edges)
        release(edges.sparkSession, large)
        edges = after
        # Done when only stars are left: one root a node, and no root below another.
        heads = edges.select(F.col("a").alias("b"))
        if edges.join(heads, "b", "left_semi").isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merge_skip(lists: list[list[int]], least: int, last: int):
    """(ordinal, count) of the ordinals up to ``last`` that ``least`` lists or more hold.

    A heap has the head of every list.  Where too few lists share the smallest
    head, the heads below the next possible answer are skipped by bisection.
    """
    many = len(lists)
    heap, at = [x[0] * many + j for j, x in enumerate(lists)], [0] * many
    heapify(heap)
    while len(heap) >= least:
        top = heap[0] // many
        if top > last:
            return
        popped, bound = [], (top + 1) * many
        while heap and heap[0] < bound:
            popped.append(heappop(heap) % many)
        if len(popped) >= least:
            yield top, len(popped)
            goal = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap) % many)
            if not heap:
                return
            goal = heap[0] // many
        for j in popped:
            own = lists[j]
            k = at[j] + 1 if own[at[j]] < goal else at[j]
            if k < len(own) and own[k] < goal:
                k = bisect_left(own, goal, k)
            at[j] = k
            if k < len(own):
                heappush(heap, own[k] * many + j)


def t_occurrence(sets: list[np.ndarray], side: np.ndarray | None = None):
    """Links within a block, or between its two sides; ``sets`` from small to large.

    Yields (query, partners): ordinals after the query whose sets are similar.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((owner, flat))
    token, posting = flat[order], owner[order]
    ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.concatenate([[0], np.cumsum(sizes)])
    reach = np.searchsorted(sizes, sizes * DEN // NUM, "right") - 1
    for q in range(len(sets)):
        if reach[q] <= q:
            continue
        lo = place[first[q] : first[q + 1]] + 1  # behind its own posting
        hi = ends[np.searchsorted(ends, lo - 1, "right")]
        some = (lo < hi) & (posting[np.minimum(lo, len(posting) - 1)] <= reach[q])
        lo, hi = lo[some], hi[some]
        need = -(-2 * NUM * int(sizes[q]) // (NUM + DEN))
        if len(lo) < need:
            continue
        by_length = np.argsort(hi - lo, kind="stable")
        lo, hi = lo[by_length], hi[by_length]
        n_long = min(need - 1, int(need / (MU * np.log2(int(hi[-1] - lo[-1]) + 1) + 1)))
        short = [posting[a:b].tolist() for a, b in zip(lo[: len(lo) - n_long], hi[: len(lo) - n_long])]
        merged = list(merge_skip(short, need - n_long, int(reach[q])))
        if not merged:
            continue
        found, counts = np.array(merged, np.int64).T
        if side is not None:
            apart = side[found] != side[q]
            found, counts = found[apart], counts[apart]
        for k, (a, b) in enumerate(zip(lo[len(short) :], hi[len(short) :])):
            if not len(found):
                break
            own = posting[a:b]
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            counts = counts + (own[at] == found)
            if k % 8 == 7:  # what can no longer reach T goes
                ok = counts + (n_long - k - 1) >= need
                found, counts = found[ok], counts[ok]
        union = sizes[found] + sizes[q] - counts
        hit = found[DEN * counts >= NUM * union]
        if len(hit):
            yield q, hit


def _first_common(own: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number that each other sorted array has in common with ``own``, and whether there is one."""
    top = np.iinfo(np.int64).max
    out, there = np.full(len(others), top, np.int64), np.zeros(len(others), bool)
    flat = np.concatenate(others) if others else np.zeros(0, np.int64)
    if len(own) and len(flat):
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        of = np.repeat(np.arange(len(others)), [len(x) for x in others])[hit]
        np.minimum.at(out, of, flat[hit])
        there[of] = True
    return out, there


def block_links(blocks: DataFrame, buckets: int) -> DataFrame:
    """``cid, links, near``: a row a class and block, ``near`` a class of its local component."""
    import pyarrow as pa

    def arrays(table: pa.Table, name: str, order: np.ndarray) -> list[np.ndarray]:
        column = table.column(name).combine_chunks()
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return [flat[offsets[i] : offsets[i + 1]] for i in order]

    def run(table: pa.Table) -> pa.Table:
        column = table.column("tokens").combine_chunks()
        order = np.argsort(np.diff(column.offsets.to_numpy()), kind="stable")
        sets = arrays(table, "tokens", order)
        cid, copies, sides = (table.column(c).to_numpy()[order] for c in ("cid", "copies", "side"))
        across, bucket, hot = (table.column(c)[0].as_py() for c in ("across", "bucket", "hot"))
        by_token = bucket is not None or hot is not None
        light, heavy = (arrays(table, c, order) if by_token else None for c in ("light", "heavy"))
        root = np.arange(len(cid))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = np.zeros(len(cid), np.int64)
        for q, partners in t_occurrence(sets, sides if across else None):
            if by_token:  # only the links of this block's own shingles
                common, there = _first_common(light[q], [light[p] for p in partners])
                if bucket is not None:
                    own = there & (common % buckets == bucket)
                else:
                    rare, _ = _first_common(heavy[q], [heavy[p] for p in partners])
                    own = ~there & (rare == hot)
                partners = partners[own]
            links[q] += copies[partners].sum()
            links[partners] += copies[q]
            for p in partners.tolist():
                a, b = top(q), top(p)
                if a != b:
                    root[max(a, b)] = min(a, b)
        near = np.array([cid[top(i)] for i in range(len(cid))], np.int64)
        some = links > 0
        return pa.table({"cid": pa.array(cid[some]), "links": pa.array(links[some]), "near": pa.array(near[some])})

    return blocks.groupBy("block").applyInArrow(run, "cid long, links long, near long")


def deal(sets: DataFrame, prefix: DataFrame, joint: DataFrame, reach: DataFrame) -> tuple[DataFrame, int]:
    """The classes in blocks of bounded size, as ``block_links`` reads them, and its buckets.

    ``prefix``: cid, n, token; ``joint``: token, k, weight (its classes and their
    shingles), for tokens of two classes or more; ``reach``: node, root.
    """
    spark = sets.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    sized = reach.join(sets.select("cid", "n"), F.col("cid") == F.col("node")).select("cid", "root", "n")
    in_root = materialize(sized.groupBy("root").agg(F.sum("n").alias("tokens_in"), F.count(F.lit(1)).alias("members")))
    total = in_root.agg(F.sum("tokens_in").alias("n")).first()["n"] or 0
    block = min(BLOCK, max(LEAST_BLOCK, total // (2 * tasks) + 1))
    parts = F.ceil(F.col("tokens_in") / block).cast("int").alias("parts")
    dealt = materialize(join_counted(sized, in_root, ["root"], "members").select("cid", "root", "n", "members", parts))
    seen = dealt.agg(F.sum(F.when(F.col("parts") == 1, F.col("n"))).alias("light"), F.max("parts").alias("parts")).first()
    bins = max(tasks, int((seen["light"] or 0) // block) + 1)
    none, numbers = F.lit(None).cast("long"), F.array().cast("array<bigint>")
    fields = lambda bucket=none, hot=none: [F.col("cid"), F.col("block"), F.col("side"), F.col("across"), bucket.alias("bucket"), hot.alias("hot")]

    def pairs(rows: DataFrame, chunks: str, *label) -> DataFrame:
        """Each row in one block for every pair of chunks that holds its own."""
        rows = rows.withColumn("side", F.pmod(F.xxhash64("cid"), F.col(chunks)).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(chunks).cast("int") - 1)))
        name = F.concat_ws("-", *label, F.least("side", "other"), F.greatest("side", "other"))
        return rows.withColumn("block", name).withColumn("across", F.col("side") != F.col("other"))

    alone = dealt.where("parts = 1").withColumn("block", F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(bins))))
    placed = alone.withColumn("side", F.lit(0)).withColumn("across", F.lit(False)).select(*fields())
    rows, buckets = sets.select("cid", "copies", "tokens").withColumn("light", numbers).withColumn("heavy", numbers), 1
    if (seen["parts"] or 0) > 1:
        buckets = int((joint.where(F.col("weight") <= block).agg(F.sum("weight").alias("w")).first()["w"] or 0) // block) + 1
        tokens = join_counted(prefix, joint, ["token"], "k").select("cid", "token", "weight")
        tokens = tokens.join(dealt.where("parts > 1"), "cid")
        is_light, bucket = F.col("weight") <= block, F.pmod("token", F.lit(buckets))
        heavy = F.when(~is_light, F.struct("token", F.ceil(F.col("weight") / block).cast("int").alias("chunks")))
        marks = tokens.groupBy("cid", "root", "n", "members", "parts").agg(
            F.sort_array(F.collect_set(F.when(is_light, F.col("token")))).alias("light"),
            F.collect_set(F.when(is_light, bucket)).alias("in_buckets"),
            F.sort_array(F.collect_set(heavy)).alias("heavy"),
        )
        marks = materialize(marks.withColumn("times", F.size("in_buckets") + F.aggregate("heavy", F.lit(0), lambda a, x: a + x["chunks"])))
        by_root = materialize(
            marks.groupBy("root").agg(F.count(F.lit(1)).alias("members"), (F.sum(F.col("n") * F.col("times")) / F.sum("n")).alias("spread"))
        )
        chosen = materialize(join_counted(marks.drop("members"), by_root, ["root"], "members").withColumn("by_token", F.col("spread") < F.col("parts")))
        split = pairs(chosen.where("not by_token"), "parts", "root").select(*fields())
        own = chosen.where("by_token")
        few = own.withColumn("bucket", F.explode("in_buckets")).withColumn("block", F.concat(F.lit("t"), "bucket"))
        few = few.withColumn("side", F.lit(0)).withColumn("across", F.lit(False)).select(*fields(F.col("bucket")))
        many = pairs(own.withColumn("x", F.explode("heavy")).withColumn("chunks", F.col("x.chunks")), "chunks", F.lit("h"), F.col("x.token"))
        placed = placed.unionByName(split).unionByName(few).unionByName(many.select(*fields(hot=F.col("x.token"))))
        marked = own.select("cid", F.col("light").alias("own_light"), F.transform("heavy", lambda x: x["token"]).alias("own_heavy"))
        rows = rows.join(marked, "cid", "left").select(
            "cid", "copies", "tokens", F.coalesce("own_light", "light").alias("light"), F.coalesce("own_heavy", "heavy").alias("heavy")
        )
    placed = materialize(placed)
    small = F.broadcast if placed.count() <= FEW_IDS else lambda df: df
    return rows.join(small(placed), "cid"), buckets


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(sign_documents(docs))
    size = signed.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")).first()
    tokens = size["tokens"] or 0
    shared = count_shared(docs, int(tokens // BUCKET) + 1, size["docs"] // DOCS + 1)
    enough = F.floor((F.col("n") * NUM + DEN - 1) / DEN)
    counted = shared.withColumnRenamed("doc_id", "counted_as")
    survivors = signed.join(counted, F.coalesce("doc_id", "s1") == F.col("counted_as")).where((F.col("n") > 0) & (F.col("shared") >= enough))
    key = ["n", "s1", "s2"]
    classes = materialize(
        # Numbers of rows in a written table: distinct, and the same for every reader.
        survivors.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("cid", F.monotonically_increasing_id())
    )
    few = classes.count() <= FEW_IDS
    small = F.broadcast if few else lambda df: df
    reps = docs.join(small(classes.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = sign_documents(reps, with_tokens=True).join(small(classes), key).select("cid", "n", "copies", "tokens")
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows
        sets = sets.dropDuplicates(["cid"])
    nameless = classes.where("rep is null")
    if not nameless.isEmpty():
        own = sign_documents(docs.where("doc_id is null"), with_tokens=True).join(nameless, key)
        sets = sets.unionByName(own.select(*sets.columns).dropDuplicates(["cid"]))
    sets = materialize(sets)

    # Tokens are sorted as unsigned numbers, so the first ones are the first by hash.
    least_n = f"cast(floor((n * {NUM} + {DEN - 1}) / {DEN}) as int)"
    first_n = f"cast(n as int) - {least_n} + cast(floor((n + 4) / 5) as int)"
    prefix_n = f"({first_n}) - cast(floor(({least_n} + 4) / 5) as int) + 1"
    rows = sets.select("cid", F.explode(F.expr(f"slice(tokens, 1, {first_n})")).alias("token"))
    df = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    ranked = join_counted(rows, df, ["token"], "df").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("rare"))
    ranked = ranked.join(sets.select("cid", "n", F.expr(first_n).alias("first_n"), F.expr(prefix_n).alias("prefix_n")), "cid")
    prefix = materialize(
        ranked.select("cid", "n", F.explode(F.expr("slice(rare, 1, greatest(prefix_n - (first_n - size(rare)), 0)).token")).alias("token"))
    )
    joint = prefix.groupBy("token").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("weight"))
    joint = materialize(joint.where("k > 1"))
    reach = components(join_counted(prefix, joint, ["token"], "k").select(F.col("cid").alias("a"), "b"))
    blocks, buckets = deal(sets, prefix, joint, reach)
    found = materialize(block_links(blocks, buckets))

    linked = components(found.select(F.col("cid").alias("a"), F.col("near").alias("b")))
    root_of = materialize(classes.join(linked, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("root", "cid").alias("root")))
    label = materialize(root_of.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")))
    label = join_counted(root_of, label, ["root"], "members").select("cid", "component_id")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    info = classes.join(label, "cid").join(links, "cid", "left").select(*key, "copies", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    some = join_counted(signed.where("n > 0"), materialize(info), key, "copies", "left")
    none = signed.where("n = 0").select(*signed.columns, *[F.lit(None).cast("long").alias(c) for c in ("copies", "component_id", "links")])
    return some.unionByName(none).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
    )
