"""Best-fit packing: a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits a sequence. Multiplicative weights hold a price for
each length; a knapsack dynamic program finds the configurations worth most at these prices, each is
used until it saturates some length, and lengths that are covered become cheaper, until all are covered.
The fractional use of the configurations is rounded down and the rest is packed best-fit, still by length
and not by piece, so the driver sees 2048 counts however many pieces there are.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small, table

#: Distinct chunks and words a worker remembers the ids of, before it forgets them all.
CHUNKS_KEPT, WORDS_KEPT = 400_000, 600_000
#: Configurations tried at the prices of one knapsack.
AROUND = 32
#: Marks that end a chunk and make a token of their own after letters; the apostrophe can't be among them.
TAIL = ".,;:!?%#$&*|"


#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from code point 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordIds(dict):
    """Chunks between blanks to their ids (unsigned 32 bit, little-endian), found as they are asked for.

    The tokenizer's splits never cross white space, and they part letters from marks, so a chunk of Latin-1 letters and
    then marks has the ids of the two in turn; letter case is folded before anything else, and a run of letters goes
    straight to the merges. Other chunks are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        head = chunk.rstrip(TAIL)
        if head.isalpha() and (head.isascii() or max(head) < "\u0100"):
            tail, ids = chunk[len(head) :], self._word(head.lower())
            if tail:
                ids += self._word(tail)
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes() if chunk else b""
        self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            written = word if word.isascii() else word.encode().decode("latin-1").translate(_WRITTEN)
            ids = self.words[word] = array("I", [t.id for t in self.merge(written)]).tobytes()
        return ids

    def trim(self) -> None:
        if len(self) > CHUNKS_KEPT:
            self.clear()
        if len(self.words) > WORDS_KEPT:
            self.words.clear()


def _folded(text: str) -> str:
    """The text in lower case, as the tokenizer makes it anyway, if all of it is Latin-1: fewer distinct chunks."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


_ids: dict[str, WordIds] = {}


def tokenize_pieces(documents: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and ids (binary) if ``with_ids``.

    A document is its text's ids and then ``end_id``; only a longer one is cut, at multiples of ``capacity``. A null or
    empty text is the end alone. ``part`` and ``rank`` number the pieces of each length within the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        if tokenizer not in _ids:
            _ids[tokenizer] = WordIds(tokenizer)
        words, part, seen = _ids[tokenizer], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for lo in range(0, len(batch), 256):
                some = batch.slice(lo, 256)
                split = [_folded(t).replace("\n", " ").split(" ") if t else [] for t in some.column("t").to_pylist()]
                words.trim()
                rows: list[tuple] = []
                for doc, own in zip(some.column("d").to_pylist(), split, strict=True):
                    data = b"".join(map(words.__getitem__, own)) + end
                    for piece, at in enumerate(range(0, len(data), step)):
                        cut = data[at : at + step]
                        n = len(cut) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(cut), part, seen[n]) + ((cut,) if with_ids else ()))
                        seen[n] += 1
                kinds = [batch.schema.field("d").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    kind = documents.schema[id_column].dataType.simpleString()
    ddl = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids binary" * with_ids
    return documents.select(F.col(id_column).alias("d"), F.col(text).alias("t")).mapInArrow(run, ddl)


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """With repetition, for each capacity: the most that ``lengths`` (ascending) within it are worth, and which comes last."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fits[c]
        worth[c] = worth[c - 1]
        if k:
            value = worth[c - lengths[:k]] + prices[:k]
            best = int(value.argmax())
            if value[best] > worth[c]:
                worth[c], last[c] = value[best], best
    return worth, last


def _chosen(lengths: np.ndarray, last: np.ndarray, c: int) -> dict[int, int]:
    used: dict[int, int] = {}
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            used[int(last[c])] = used.get(int(last[c]), 0) + 1
            c -= int(lengths[last[c]])
    return used


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of ``lengths`` (ascending) within ``capacity`` that is worth most."""
    return _chosen(lengths, _knapsack(lengths, prices, capacity)[1], capacity)


def program(histogram: dict[int, int], capacity: int, *, epsilon: float = 0.15) -> list[tuple[dict[int, int], float]]:
    """Configurations and their fractional use, which covers every length exactly.

    A round prices all lengths by one knapsack, which also has the best configuration around each length. Those within
    ``epsilon`` of the best at the prices of their turn are used, the longest lengths' first, until each saturates some
    length; rounds go on until all are. A length starts at slightly more than its share of a sequence.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(n)] for n in lengths], np.float64)
    rest, logs, out = need.copy(), 1.05 * np.log(lengths / capacity), []
    while len(alive := np.flatnonzero(rest > 0)):
        own, top = lengths[alive], 0.0
        worth, last = _knapsack(own, np.exp(logs[alive]), capacity)
        top = worth[capacity]
        around = np.exp(logs[alive]) + worth[capacity - own]
        for i in [*np.flatnonzero(around >= (1 - epsilon) * top)[::-1][:AROUND], int(around.argmax())]:
            used = _chosen(own, last, capacity - int(own[i]))
            used[int(i)] = used.get(int(i), 0) + 1
            at, copies = alive[list(used)], np.array(list(used.values()), np.float64)
            if (rest[at] <= 0).any() or (np.exp(logs[at]) * copies).sum() < (1 - epsilon) * top:
                continue
            step = rest[at] / copies
            first = int(step.argmin())
            out.append(({int(n): int(k) for n, k in zip(lengths[at], copies, strict=True)}, float(step[first])))
            rest[at] = np.maximum(rest[at] - step[first] * copies, 0)
            rest[at[first]] = 0
            logs[at] += np.log1p(-epsilon * step[first] * copies / need[at])
    return out


def solve(histogram: dict[int, int], capacity: int, *, epsilon: float = 0.15) -> list[tuple[dict[int, int], int]]:
    """Configurations (length: copies) and how many sequences are filled by each, holding every piece exactly once."""
    left, out = dict(histogram), []
    for own, x in sorted(program(histogram, capacity, epsilon=epsilon), key=lambda e: -e[1]):
        times = min(int(x + 1e-9), *(left[n] // k for n, k in own.items()))
        if times > 0:
            for n, k in own.items():
                left[n] -= times * k
            out.append((own, times))
    return out + _best_fit({n: k for n, k in left.items() if k}, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over what rounding leaves, a whole group of equal sequences at a time."""
    out, order = [], sorted(left, reverse=True)
    while order:
        room, own = capacity, {}
        for n in order:
            if n <= room and (k := min(left[n], room // n)):
                own[n] = k
                room -= k * n
        times = min(left[n] // k for n, k in own.items())
        for n, k in own.items():
            left[n] -= times * k
        out.append((own, times))
        order = [n for n in order if left[n]]
    return out


def _places(configurations: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """By (length, rank): the first sequence, the copies in each, and the place of the first copy."""
    rows, taken, base = [], {}, 0
    for own, times in configurations:
        at = 0
        for n, k in sorted(own.items()):
            rows.append((n, taken.get(n, 0), k, base, at))
            taken[n] = taken.get(n, 0) + k * times
            at += n * k
        base += times
    rows.sort()
    names = ("length", "first", "copies", "base", "at")
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(names)}


#: Ranks stay under this, so that length and rank make one number.
RANKS = 1 << 50


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """``pieces`` (of tokenize_pieces, written down) with sequence_id and offset; as few sequences as the program finds.

    A piece's rank among those of its length is its rank within its task plus the count of that length in the tasks
    before: no task sees more than its own rows, even if most pieces have one length.
    """
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(_places(solve(histogram, capacity)))
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = pieces.join(small(before, counts.count(), 1_000_000), ["length", "part"])
    keep = [f for f in pieces.schema.fields if f.name not in ("part", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        keys = p["length"] * RANKS + p["first"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            k = np.searchsorted(keys, length * RANKS + rank, "right") - 1
            nth = rank - p["first"][k]
            sequence = p["base"][k] + nth // p["copies"][k]
            offset = p["at"][k] + nth % p["copies"][k] * length
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [pa.array(sequence), pa.array(offset)], [f.name for f in keep] + ["sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, ddl)


def pack_documents(documents: DataFrame, tokenizer: str, *, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack ``documents``: a row for each piece with its sequence and place. No documents, no pieces."""
    return pack(materialize(tokenize_pieces(documents, tokenizer, capacity=capacity, with_ids=with_ids), "pieces"), capacity=capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
