"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A sketch has cells with a count, a sum of paragraph digests and a sum of their check values; each digest lies in three of them. The
difference of two sketches holds only what one of the texts has and the other hasn't, and peeling (a cell with one digest
gives it away, and it goes from its other cells) recovers these digests. Where the cells are too few for that, both
sketches are made again four times as large.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import int_id, table

#: Cells of a fingerprint, and how many of them a digest is in.
CELLS, TIMES = 24, 3
#: A paragraph ends with a line or a sentence; one that is longer is cut, from its start.
LONGEST = 400
_ENDS = re.compile(r"([.!?]) ")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[k]
    return x ^ (x >> np.uint64(29))


def paragraphs(text: str) -> list[str]:
    out = []
    for p in _ENDS.sub(r"\1\n", text).split("\n"):
        out += [p] if len(p) <= LONGEST else [p[i : i + LONGEST] for i in range(0, len(p), LONGEST)]
    return [p for p in out if p]


def digests(text: str) -> np.ndarray:
    """A digest of each paragraph; an equal one's second, third... occurrence has a digest of its own."""
    seen: dict[bytes, int] = {}
    found = []
    for p in paragraphs(text):
        h = xxhash.xxh3_64_digest(p.encode())
        n = seen[h] = seen.get(h, 0) + 1
        found.append(h if n == 1 else xxhash.xxh3_64_digest(h + n.to_bytes(8, "little")))
    return np.frombuffer(b"".join(found), np.uint64)


class Sketch:
    def __init__(self, keys: np.ndarray, cells: int):
        self.cells = cells
        at = places(keys, cells)
        self.count = np.bincount(at.ravel(), minlength=cells)
        self.sums, self.checks = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        np.add.at(self.sums, at, keys[:, None])
        np.add.at(self.checks, at, _mix(keys, 3)[:, None])

    def __sub__(self, other: Sketch) -> Sketch:
        out = object.__new__(Sketch)
        out.cells, out.count, out.sums, out.checks = self.cells, self.count - other.count, self.sums - other.sums, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests that only the first and only the second has, or None if cells remain."""
        count, sums, checks = self.count.copy(), self.sums.copy(), self.checks.copy()
        plus, minus = [], []
        while True:
            key = np.where(count < 0, np.uint64(0) - sums, sums)
            check = np.where(count < 0, np.uint64(0) - checks, checks)
            pure = np.flatnonzero((np.abs(count) == 1) & (check == _mix(key, 3)))
            if not len(pure):
                break
            keys, first = np.unique(key[pure], return_index=True)
            sign = count[pure][first]
            plus.append(keys[sign > 0])
            minus.append(keys[sign < 0])
            at = places(keys, self.cells)
            signed = np.where(sign < 0, np.uint64(0) - keys, keys)
            checked = np.where(sign < 0, np.uint64(0) - _mix(keys, 3), _mix(keys, 3))
            np.subtract.at(count, at, sign[:, None])
            np.subtract.at(sums, at, signed[:, None])
            np.subtract.at(checks, at, checked[:, None])
        if count.any() or sums.any() or checks.any():
            return None
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(plus or none), np.concatenate(minus or none)

    def text(self) -> str:
        return base64.b64encode(self.count.astype("<i4").tobytes() + self.sums.astype("<u8").tobytes() + self.checks.astype("<u4").tobytes()).decode()


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each key, one in each third."""
    third = cells // TIMES
    return np.stack([(_mix(keys, k) % np.uint64(third)).astype(np.int64) + k * third for k in range(TIMES)], axis=1)


class Fingerprint:
    """A text's digests with its sketches by size, made when asked for."""

    def __init__(self, text: str):
        self.keys = digests(text)
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, cells: int) -> Sketch:
        if cells not in self.sketches:
            self.sketches[cells] = Sketch(self.keys, cells)
        return self.sketches[cells]

    def likeness(self, other: Fingerprint) -> float:
        """Shared paragraphs over all: 1 for equal texts."""
        a, b = len(self.keys), len(other.keys)
        if not a + b:
            return 1.0
        cells = CELLS
        while cells < abs(a - b):
            cells *= 4  # at least so many differ
        while (found := (self.sketch(cells) - other.sketch(cells)).peel()) is None:
            cells *= 4
            if cells > 64 * (a + b) + CELLS:  # equal digests' places: as good as impossible
                found = np.setdiff1d(self.keys, other.keys), np.setdiff1d(other.keys, self.keys)
                break
        d = len(found[0]) + len(found[1])
        return (a + b - d) / (a + b + d)


#: Parts that the rows of one id can have, as a power of two.
PARTS = 20


def neighbours(documents: DataFrame, *, rows_each: int = 250, most: int = 20_000) -> tuple[DataFrame, int]:
    """(bucket, ghost, doc_id, k, h, text): documents dealt into runs, and into each run a copy of the row that follows it; and how many.

    Order is descending doc_id, rows without an id last, rows with equal ids by a hash of their text, then the text; after the last
    comes the first. Borders are approximate quantiles of the ids, and around every id that has more than two runs' rows, which
    are dealt by their hash; so the driver sees at most about twice ``most`` borders and tops of runs.
    """
    docs = documents.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("h"), "text")
    n = docs.count()
    runs = max(1, min(most, n // rows_each))
    each = max(1, n // runs)
    cut = [i / runs for i in range(1, runs)]
    quantiles = docs.agg(F.percentile_approx("k", F.array(*map(F.lit, cut)), F.lit(max(10_000, 50 * runs)))).first()[0] if cut else []
    heavy = {r.k: int(r["count"] // each) + 1 for r in docs.groupBy("k").count().filter(F.col("count") > 2 * each).collect()}
    edges = np.array(sorted({*quantiles, *heavy, *(k - 1 for k in heavy if k > -(2**63))}), np.int64)
    own = np.array(sorted(heavy), np.int64)
    parts = np.array([min(heavy[k], 1 << PARTS) for k in own.tolist()], np.int64)

    def run_of(k: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of a row's run; a row with a higher number comes first."""
        bucket = np.searchsorted(edges, k).astype(np.int64) << PARTS
        if len(own):
            at = np.minimum(np.searchsorted(own, k), len(own) - 1)
            share = ((h >> 32) + (1 << 31)) * parts[at] >> 32
            bucket += np.where(own[at] == k, parts[at] - 1 - share, 0)
        return bucket

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(run_of(b.column("k").to_numpy(), b.column("h").to_numpy())), b.column("k"), b.column("h")], ["bucket", "k", "h"])

    firsts = docs.select("k", "h").mapInArrow(numbered, "bucket bigint, k bigint, h bigint").groupBy("bucket").agg(F.max(F.struct("k", F.bitwise_not("h").alias("h"))).alias("top")).collect()
    tops = {r.bucket: (r.top.k, ~r.top.h) for r in firsts}
    held = sorted(tops)
    above = {tops[b]: held[(i + 1) % len(held)] for i, b in enumerate(held)}  # whose run this row follows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, h = b.column("k").to_numpy(), b.column("h").to_numpy()
            copied = [(i, above[x]) for i, x in enumerate(zip(k.tolist(), h.tolist(), strict=True)) if x in above]
            take = pa.array(np.concatenate([np.arange(len(k)), np.array([i for i, _ in copied], np.int64)]))
            to = np.concatenate([run_of(k, h), np.array([x for _, x in copied], np.int64)])
            ghost = np.concatenate([np.zeros(len(k), bool), np.ones(len(copied), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(ghost), *(b.column(c).take(take) for c in ("doc_id", "k", "h", "text"))], ["bucket", "ghost", "doc_id", "k", "h", "text"])

    return docs.mapInArrow(deal, "bucket bigint, ghost boolean, doc_id bigint, k bigint, h bigint, text string"), len(held)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple | None = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        rows = []
        for bucket, ghost, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")), strict=True):
            own = Fingerprint(text)
            if last is not None and last[0] == bucket and not last[4]:
                _, before, prior, fingerprint, _ = last
                n = len(prior)
                k = n // 3
                edited = prior[: n - k] + text[:k]
                changed = Fingerprint(edited) if edited != prior else fingerprint
                rows.append((before, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint.sketch(CELLS).text(), changed.sketch(CELLS).text(), fingerprint.likeness(changed), fingerprint.likeness(own)))
            last = (bucket, doc, text, own, ghost)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def fingerprint_documents(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    A null text is empty. Rows without an id come last, rows with equal ids follow each other by a hash of their text; a lone row is
    its own next. The edited text is the row's with its last third replaced by the start of the next row's. Ids are integers.
    """
    docs = int_id(documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    dealt, runs = neighbours(docs)
    dealt = dealt.repartition(runs // 16 + 1, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("k"), "h", "text").drop("k", "h")
    return dealt.mapInArrow(_fingerprints, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
