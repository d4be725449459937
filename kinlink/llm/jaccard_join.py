"""N-gram Jaccard join: which documents are connected by links of similarity at or above a threshold.

Sets of word shingles are compared exactly, but only where that can matter:

1. Signatures. Two sets of sizes a and b link only if they differ in at most (1-t)/(1+t)*(a+b) tokens. Tokens are dealt
   by value over more parts than that, so a linked pair has parts with equal contents: each document sends signatures of
   its heaviest parts (at its own size class and the next, as linked sizes are in one class or neighbours).
2. Cells. Documents that share a signature meet at the smallest document that has it. Cells whose
   sets are many in sum are split into blocks, each with that pivot.
3. Token-group matrix. In a block similar documents form groups; the matrix holds each group's token union. A query's
   overlap with every group's union is counted through the matrix, and only groups that could hold a linked
   member are opened and compared, member by member, unless already connected.
4. Components of the links found. Within a split cell, documents that did not end up with the pivot then visit
   the other blocks that share a signature with them; that completes every pair.

Equal sets within a task are one node from the start. A set's tokens never travel: signatures do, and
the texts of documents that share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import int_id, materialize, small, space_words, table

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S = [np.uint64(x) for x in (29, 32)]
#: Distinct words whose hash a worker remembers before it forgets them all.
HASHES_KEPT = 400_000
#: The bitmap of repeated signatures has 2**BITMAP bits, made in 2**CHUNKS parts.
BITMAP, CHUNKS = 27, 8
#: Members of a group, so that its union says something.
GROUP = 48


class WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        self[word] = h = xxhash.xxh3_64_digest(word)
        return h


_hashes = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _P[0]
    return x ^ (x >> _S[1])


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; a shorter text is one shingle; without words, none."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > HASHES_KEPT:
        _hashes.clear()
    w = np.frombuffer(b"".join(map(_hashes.__getitem__, words)), np.uint64)
    n = max(1, len(w) - width + 1)
    x = np.full(n, np.uint64(min(width, len(w))))
    for k in range(min(width, len(w))):
        x = _mix(x + w[k : k + n] * _P[k % 3])
    return np.unique(x)


def size_classes(percent: int, upto: int = 1 << 40) -> np.ndarray:
    """Starts of the size classes: sets that link are in one class or in neighbours."""
    out = [1]
    while out[-1] < upto:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


def signatures(tokens: np.ndarray, level: int, starts: np.ndarray, percent: int) -> np.ndarray:
    """Of a set at a level: one for each of its heaviest parts, of which a linked set of that level has one too.

    There are more parts than needed. If at most d tokens can differ from any linked set, all but d parts are shared. Both sets
    order their parts alike (by tokens, then signature) and keep the d + 1 heaviest, so the heaviest shared part is kept by both:
    were it left out by one, so would all shared parts be, which are more than the set leaves out.
    """
    n, largest = len(tokens), int(starts[level + 1]) - 1
    parts = (((100 - percent) * 2 * largest // (100 + percent)) + 1) * 8 // 5
    differ = (100 - percent) * (n + min(largest, 100 * n // percent)) // (100 + percent)
    part = ((tokens >> _S[1]) * np.uint64(parts) >> _S[1]).astype(np.int64)
    upto = np.searchsorted(part, np.arange(parts + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(tokens * _P[1]))])
    held = sums[upto[1:]] - sums[upto[:-1]]
    found = _mix(_mix(held + np.arange(parts, dtype=np.uint64) * _P[2]) + np.full(1, level, np.uint64) * _P[3])
    return found[np.lexsort((found, np.diff(upto)))[-differ - 1 :]].astype(np.int64)


def _sketch(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, nodes = size_classes(percent), {}
        for batch in batches:
            for lo in range(0, len(batch), 512):
                some = batch.slice(lo, 512)
                sizes, node, found, ends = [], [], [], [0]
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    tokens = shingles(text, width)
                    sizes.append(len(tokens))
                    own = None
                    if len(tokens) and doc is not None:
                        own = nodes.setdefault(xxhash.xxh3_128_digest(tokens.tobytes()), doc)
                        if own == doc:
                            level = int(np.searchsorted(starts, len(tokens), "right")) - 1
                            found += [signatures(tokens, k, starts, percent) for k in (level, level + 1)]
                    node.append(own)
                    ends.append(ends[-1] + (len(found[-1]) + len(found[-2]) if own is not None and own == doc else 0))
                values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(node, pa.int64()), lists], ["doc_id", "n_shingles", "node", "signatures"])

    return run


def _with_repeated(sets: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, signature) of the signatures that may be among ``repeated``: none of these is missing.

    A bitmap of fixed size stands for them. Where they are very many it lets more through, which the next step sorts out.
    """
    chunk = F.shiftrightunsigned("signature", 64 - CHUNKS).alias("chunk")
    place = F.shiftrightunsigned("signature", 64 - BITMAP).bitwiseAND((1 << BITMAP - CHUNKS) - 1).alias("place")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, place = b.column("chunk").to_numpy(), b.column("place").to_numpy()
            for c in np.unique(chunk).tolist():
                chunks.setdefault(c, np.zeros(1 << BITMAP - CHUNKS, np.uint8))[place[chunk == c]] = 1
        packed = [np.packbits(v, bitorder="little").tobytes() for v in chunks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array(packed, pa.binary())], ["chunk", "bits"])

    marked = repeated.select(chunk, place).repartition("chunk").mapInArrow(mark, "chunk bigint, bits binary").collect()
    bitmap = np.zeros(1 << BITMAP - 3, np.uint8)
    size = 1 << BITMAP - CHUNKS - 3
    for c, bits in marked:
        bitmap[c * size : (c + 1) * size] = np.frombuffer(bits, np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            lists = b.column("signatures")
            values, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            at = values.view(np.uint64) >> np.uint64(64 - BITMAP)
            there = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            row = pa.array(np.repeat(np.arange(len(counts)), counts)[there])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("n_shingles").take(row), pa.array(values[there])], ["doc_id", "n_shingles", "signature"])

    return sets.filter("size(signatures) > 0").select("doc_id", "n_shingles", "signatures").mapInArrow(run, "doc_id bigint, n_shingles bigint, signature bigint")


class Matrix:
    """The token-group matrix of a block: by token its groups, by group its members."""

    def __init__(self, percent: int):
        self.percent = percent
        self.of: dict[int, list[int]] = {}
        self.members: list[list[int]] = []
        self.least: list[int] = []

    def add(self, group: int | None, member: int, tokens: frozenset) -> None:
        if group is None:
            group = len(self.members)
            self.members.append([])
            self.least.append(len(tokens))
        self.members[group].append(member)
        self.least[group] = min(self.least[group], len(tokens))
        for t in tokens:
            own = self.of.setdefault(t, [])
            if not own or own[-1] != group and group not in own:
                own.append(group)

    def open(self, tokens: frozenset) -> list[int]:
        """Groups that could hold a set linked with ``tokens``: it shares t/(1+t) of both sizes at least, so the union does."""
        seen: list[int] = []
        get = self.of.get
        for t in tokens:
            if own := get(t):
                seen += own
        if not seen:
            return []
        overlap = np.bincount(seen, minlength=len(self.members))
        p, n = self.percent, len(tokens)
        smallest = np.maximum(np.array(self.least), -(-p * n // 100))
        return np.flatnonzero(overlap * (100 + p) >= p * (n + smallest)).tolist()


def linked(a: frozenset, b: frozenset, percent: int) -> bool:
    la, lb = len(a), len(b)
    if 100 * min(la, lb) < percent * max(la, lb):
        return False
    shared = len(a & b)
    return 100 * shared >= percent * (la + lb - shared)


def link_block(ids: list[int], sets: list[frozenset], labels: list[int], visits: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links that connect all of a block's documents that links connect; equal labels are connected already, and visitors meet residents only."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    matrix, out = Matrix(percent), []
    for q in sorted(range(len(ids)), key=lambda i: (visits[i], len(sets[i]), ids[i])):
        home = None
        for g in matrix.open(sets[q]):
            for m in matrix.members[g]:
                if find(labels[q]) != find(labels[m]) and linked(sets[q], sets[m], percent):
                    top[find(labels[q])] = find(labels[m])
                    out.append((ids[q], ids[m]))
            if home is None and len(matrix.members[g]) < GROUP and find(labels[q]) == find(labels[matrix.members[g][0]]):
                home = g
        if not visits[q]:
            matrix.add(home, q, sets[q])
    return out


def _link(width: int, percent: int):
    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        return link_block([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], percent) if len(rows) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            found = []
            for pivot, block, doc, label, visit, text in zip(*(batch.column(c).to_pylist() for c in ("pivot", "block", "doc_id", "label", "visit", "text")), strict=True):
                if (pivot, block) != key:
                    found += solve(rows)
                    key, rows = (pivot, block), []
                rows.append((doc, frozenset(shingles(text, width).tolist()), label, visit))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        found = solve(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): label is the smallest node connected with it.

    Each round moves every node to the smallest neighbour, follows that once more and contracts the edges, so a star goes in a
    round and a path in a logarithm of its length. Every round is written down.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        least = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("b"))).groupBy("a").agg(F.min("b").alias("b")), "least")
        step = materialize(least.alias("x").join(least.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("v"), F.col("y.b").alias("to")), "step")
        if labels is None:
            labels = step.select(F.col("v").alias("node"), F.col("to").alias("label"))
        else:
            labels = materialize(labels.join(step, F.col("label") == F.col("v"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        moved = edges.join(step, F.col("a") == F.col("v")).select(F.col("to").alias("a"), "b")
        moved = materialize(moved, "moved").join(step, F.col("b") == F.col("v")).select("a", F.col("to").alias("b"))
        edges = materialize(moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def jaccard_components(documents: DataFrame, *, width: int = 3, percent: int = 90, block_tokens: int = 100_000, id_column: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``documents``.

    Rows are documents by their integer id: rows that repeat an id count as one document with any of their texts. Null and
    empty texts have no shingle and stay alone; a null id stays null and alone. ``block_tokens`` bounds what a task holds of
    a cell. The broadcasts hold ids of documents that share a signature, five numbers a row and at most ``broadcast_rows``; beyond,
    joins shuffle.
    """
    docs = int_id(documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")))
    sets = materialize(docs.mapInArrow(_sketch(width, percent), "doc_id bigint, n_shingles bigint, node bigint, signatures array<bigint>"), "sets")
    exploded = sets.select("doc_id", "n_shingles", F.explode("signatures").alias("signature"))
    repeated = materialize(exploded.groupBy("signature").count().filter("count > 1").select("signature"), "repeated")
    kept = materialize(_with_repeated(sets, repeated), "kept")
    shared = materialize(kept.groupBy("signature").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("other")).filter("pivot < other").select("signature", "pivot"), "shared")
    members = materialize(kept.join(shared, "signature").groupBy("pivot", "doc_id").agg(F.max("n_shingles").alias("n")), "members")
    split = materialize(members.groupBy("pivot").agg(F.sum("n").alias("n")).filter(F.col("n") > block_tokens).select("pivot", F.ceil(F.col("n") / block_tokens).cast("bigint").alias("blocks")), "split")
    n_split = split.count()
    blocks = members.join(small(split, n_split, broadcast_rows), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    placed = materialize(blocks.select("pivot", "doc_id", F.explode(F.when(F.col("doc_id") == F.col("pivot"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(own)).alias("block")), "placed")

    def link(rows: DataFrame, n: int) -> DataFrame:
        texts = docs.join(small(rows, n, broadcast_rows), "doc_id").select("pivot", "block", "doc_id", "label", "visit", "text")
        return texts.repartition(min(n // 1000 + 1, 20_000), "pivot", "block").sortWithinPartitions("pivot", "block", "visit", "doc_id").mapInArrow(_link(width, percent), "a bigint, b bigint")

    links = materialize(link(placed.withColumn("label", F.col("doc_id")).withColumn("visit", F.lit(False)), placed.count()), "links")
    links = links.union(sets.filter("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    labels = materialize(components(links), "components")
    if n_split:
        labelled = materialize(placed.join(small(split, n_split, broadcast_rows), "pivot").join(labels, F.col("doc_id") == F.col("node"), "left").select("pivot", "block", "doc_id", F.coalesce("label", "doc_id").alias("label")), "labelled")
        home = labelled.filter("doc_id = pivot").select("pivot", F.col("label").alias("home")).distinct()
        strays = materialize(labelled.join(home, "pivot").filter("label <> home").drop("home"), "strays")
        if strays.limit(1).count():
            held = materialize(kept.join(shared.join(small(split, n_split, broadcast_rows).select("pivot"), "pivot"), "signature").select("pivot", "signature", "doc_id"), "held")
            rows = held.join(labelled, ["pivot", "doc_id"])
            matrix = materialize(rows.groupBy("pivot", "signature", "block").agg(F.min("label").alias("low"), F.max("label").alias("high")), "matrix")
            asks = held.join(strays.withColumnRenamed("block", "home"), ["pivot", "doc_id"])
            visits = asks.join(matrix, ["pivot", "signature"]).filter("block <> home and (low <> label or high <> label)").select("pivot", "block", "doc_id", "label").distinct().withColumn("visit", F.lit(True))
            rows = materialize(visits.unionByName(labelled.select("pivot", "block", "doc_id", "label").withColumn("visit", F.lit(False))), "visits")
            rows = rows.join(rows.filter("visit").select("pivot", "block").distinct(), ["pivot", "block"])
            more = materialize(link(rows, rows.count()), "more")
            if more.limit(1).count():
                labels = materialize(components(links.union(more)), "components")
    named = labels.select(F.col("node").alias("doc_id"), F.col("label"))
    return sets.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
