"""Language-model scores from a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Three layers of Chinese restaurants: one for each context of two words, whose customers are the training tokens; one for each
context of one word, the parent of all contexts that end in that word; and the corpus, the parent of these. Customers of a
parent are the tables of its children. The corpus opens a table for every word and leaves the rest to the unknown word.

A sweep removes all customers of a dish and seats them anew: the number of tables comes from its conditional distribution given
the other dishes' tables, with generalised Stirling numbers up to ``EXACT`` customers; beyond by the normal approximation around its
saddle point, or its limit where few tables are likely. Dishes of a layer move together, given the tables of the sweep before (as in distributed Gibbs samplers).
Predictive probabilities are averaged over the sweeps after the burn-in.

Restaurants of one-word contexts are dealt to parts by a hash of the word, with all the two-word contexts above them, so a part is
seated alone. A word that more than ``split`` tokens follow has several restaurants, told apart by a hash of the word before it.
Texts are held in blocks of about ``block`` tokens; a block sends each part its distinct trigrams and gets their probabilities
back. The corpus is counted from a first pass over all parts and used in the second.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, space_words, table

#: The end of a text, which no word equals, and what stands for the words before its first.
END, START = b"\n", 0
#: Customers of a dish up to which its tables are drawn from the exact conditional.
EXACT = 256
#: Tables at the saddle point below which the limit stands for it.
FEW = 12
#: Discount of the contexts until counted, and the strength of all restaurants.
DISCOUNT, STRENGTH = 0.8, 1.0
#: The most frequent words, which driver and executors know by a number, and the numbers in a shard of their table counts.
FREQUENT, SHARD = 1 << 20, 1 << 16
#: Sweeps of the first pass, and of the second with its burn-in.
FIRST, SWEEPS, BURN_IN = 1, 4, 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str | None) -> list[bytes]:
    return [*space_words(text), END]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of hashes."""
    x = a * _A ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some place of each distinct key, in order of the keys, and of each place the number of its key."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def press(values: np.ndarray) -> bytes:
    """Unsigned 32- or 64-bit numbers, a plane for each byte, compressed."""
    size = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, size).T.tobytes()
    return struct.pack("<Q", len(planes)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpress(data: bytes, kind: type = np.uint32) -> np.ndarray:
    n = struct.unpack_from("<Q", data)[0]
    size = np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Frequent:
    """The most frequent training words: sorted hashes with their counts, and the number of training tokens and words."""

    def __init__(self, word: np.ndarray, n: np.ndarray, total: int, known: int):
        order = np.argsort(word)
        self.word, self.n, self.total, self.known = word[order], n[order], total, known

    def codes(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32-bit codes of words, and the hashes of the rare ones: their codes are from len(self.word) on."""
        first, which = groups(word)
        one = word[first]
        at = np.minimum(np.searchsorted(self.word, one), max(len(self.word) - 1, 0))
        found = self.word[at] == one if len(self.word) else np.zeros(len(one), bool)
        code = np.where(found, at, len(self.word) + np.cumsum(~found) - 1).astype(np.uint32)
        return code[which], one[~found]

    def some(self, code: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same codes where only some of the rare words occur, and these."""
        at = np.flatnonzero(code >= len(self.word))
        used, which = np.unique(code[at], return_inverse=True)
        out = code.copy()
        out[at] = len(self.word) + which
        return out, rare[used - len(self.word)]

    def words(self, code: np.ndarray, rare: np.ndarray) -> np.ndarray:
        often = code < len(self.word)
        out = np.empty(len(code), np.uint64)
        out[often], out[~often] = self.word[code[often]], rare[code[~often] - len(self.word)]
        return out


@cache
def _ratios(discount: float) -> list[np.ndarray]:
    """For n customers: the generalised Stirling numbers of t + 1 tables over those of t, t from 1."""
    row, out = np.array([0.0]), [np.zeros(0), np.zeros(0)]
    for n in range(1, EXACT):
        row = np.logaddexp(np.append(np.log(n - discount * np.arange(1, n + 1)) + row, -np.inf), np.append(-np.inf, row))
        out.append(np.exp(np.diff(row)))
    return out


def draw(n: np.ndarray, p: np.ndarray, others: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with n customers whose parent's probability is p, given the restaurant's other tables.

    t has a weight of S(n, t) * p**t * (strength + discount * others) * ... * (strength + discount * (others + t - 1)).
    """
    tables = np.minimum(n, 1).astype(np.float64)
    size = np.minimum(n, EXACT + 1).astype(np.uint16)
    order = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[order], np.arange(EXACT + 3))
    for m in range(2, EXACT + 1):
        at = order[ends[m] : ends[m + 1]]
        if len(at):
            step = _ratios(discount)[m] * p[at, None] * (STRENGTH + discount * (others[at, None] + np.arange(1, m)))
            log = np.concatenate([np.zeros((len(at), 1)), np.cumsum(np.log(step), axis=1)], axis=1) if m > 2 else np.log(np.append(np.ones((len(at), 1)), step, axis=1))
            weight = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + ((rng.random(len(at)) * weight[:, -1])[:, None] > weight[:, :-1]).sum(axis=1)
    at = order[ends[EXACT + 1] :]
    if len(at):
        tables[at] = _draw_many(n[at].astype(np.float64), p[at], others[at], discount, rng)
    return tables


def _draw_many(n: np.ndarray, p: np.ndarray, others: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The same for many customers: around the saddle point of the weights, or, where few tables are likely, by their limit for
    n without end, a negative binomial."""

    def slope(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables whose Stirling number has its saddle point at 1 - exp(s), and the slope of the log weight there."""
        rest = -np.expm1(discount * s)
        t = n * np.exp(s * (1 - discount)) * rest / (discount * -np.expm1(s))
        return t, np.log(rest / discount) - np.log(t) + np.log(p * (STRENGTH + discount * (others + t)))

    low, high = np.full(len(n), -300.0), np.full(len(n), -1e-9)
    for _ in range(45):
        mid = (low + high) / 2
        up = slope(mid)[1] > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    (t0, g0), (t1, g1) = slope(low - 1e-3 * np.abs(low)), slope(low)
    tables = np.rint(t1 + np.sqrt(np.maximum((t1 - t0) / np.maximum(g0 - g1, 1e-12), 0)) * rng.standard_normal(len(n)))
    few = t1 < FEW
    tables[few] = 1 + rng.poisson(rng.gamma(STRENGTH / discount + others[few] + 1) * p[few] / (1 - np.minimum(p[few], 0.999)))
    return np.clip(tables, 1, n)


def seat(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, base: np.ndarray, discounts: tuple[float, float], sweeps: int, burn_in: int, rng: np.random.Generator):
    """Averaged probabilities of distinct trigrams (restaurant u above v, dish w) with n customers each, by any v's restaurants alone.

    ``base`` is the corpus's probability of w. Also returns the index of each one's bigram, the bigrams' tables, and customers.
    """
    d3, d2 = discounts
    _, c = groups(mix(u, v))
    first, b = groups(mix(v, w))
    _, r = groups(v[first])
    base2 = base[first]
    total3 = np.bincount(c, n)
    some, many = n > 0, np.flatnonzero(n > 1)
    t3 = some.astype(np.float64)
    c2 = np.bincount(b, t3, len(first))
    t2 = np.minimum(c2, 1)
    out = np.zeros(len(n))
    for sweep in range(sweeps):
        all2, open2 = np.bincount(r, c2), STRENGTH + d2 * np.bincount(r, t2)
        p2 = (c2 - d2 * t2 + open2[r] * base2) / (STRENGTH + all2[r])
        sum3 = np.bincount(c, t3)
        if len(many):
            t3[many] = draw(n[many], p2[b[many]], sum3[c[many]] - t3[many], d3, rng)
        c2 = np.bincount(b, t3, len(first))
        t2 = draw(c2, base2, np.bincount(r, t2)[r] - t2, d2, rng)
        if sweep >= burn_in:
            all2, open2 = np.bincount(r, c2), STRENGTH + d2 * np.bincount(r, t2)
            p2 = (c2 - d2 * t2 + open2[r] * base2) / (STRENGTH + all2[r])
            out += (n - d3 * t3 + (STRENGTH + d3 * np.bincount(c, t3))[c] * p2[b]) / (STRENGTH + total3[c])
    return out / max(sweeps - burn_in, 1), first, c2, t2


def restaurants(u: np.ndarray, v: np.ndarray, code: np.ndarray, frequent: Frequent, split: int) -> np.ndarray:
    """The word before, and with it a hash of the one before that where very many tokens follow the word."""
    often = code < len(frequent.word)
    buckets = np.ones(len(v), np.uint64)
    buckets[often] = frequent.n[code[often]] // split + 1
    at = np.flatnonzero(buckets > 1)
    out = mix(v, v)
    out[at] = mix(v[at], mix(u[at], v[at]) % buckets[at])
    return out


class Texts:
    """A block of texts: what it sends to the parts, and where the answers belong."""

    def __init__(self, row: dict, frequent: Frequent, parts: int, split: int):
        self.ids, self.held, self.lengths = row["ids"], np.array(row["held"]), np.array(row["lengths"])
        codes, self.rare = unpress(row["codes"]), unpress(row["rare"], np.uint64)
        self.start = np.uint32(len(frequent.word) + len(self.rare))  # the code of what stands before a text
        self.rare = np.append(self.rare, np.uint64(START))
        starts = np.cumsum(self.lengths) - self.lengths
        back = [codes]
        for _ in range(2):
            before = np.append(self.start, back[-1][:-1])
            before[starts] = self.start
            back.append(before)
        w, v, u = (frequent.words(x, self.rare) for x in back)
        r = restaurants(u, v, back[1], frequent, split)
        key = mix(mix(u, v), w)
        # by part, restaurant and trigram; where hashes tie the whole key decides, so that the order is always the same
        near = r >> np.uint64(32) << np.uint64(32) | key >> np.uint64(32)
        order = np.argsort(near)
        same = near[order][1:] == near[order][:-1]
        if (same & (key[order][1:] != key[order][:-1])).any():
            order = np.lexsort((key, near))
            same = near[order][1:] == near[order][:-1]
        new = np.append(True, ~same | (key[order][1:] != key[order][:-1]))
        first = order[new]
        self.which = np.empty(len(key), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.n = np.bincount(self.which, np.repeat(~self.held, self.lengths), len(first)).astype(np.uint32)
        self.u, self.v, self.w = (x[first] for x in back[::-1])
        part = ((r[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        self.part, self.pieces = part[cuts], [slice(a, b) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True)]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[at], np.diff(np.append(at, len(values))).astype(np.uint32)


def _pieces(row: dict, shared) -> Iterator[tuple[int, int, bytes]]:
    frequent, parts, split = shared.value
    texts = Texts(row, frequent, parts, split)
    for part, at in zip(texts.part.tolist(), texts.pieces, strict=True):
        codes, lengths = _runs(texts.v[at])
        every, rare = frequent.some(np.concatenate([texts.u[at], texts.w[at], codes]), texts.rare)
        size = len(texts.u[at])
        arrays = [press(x) for x in (every[:size], every[size : 2 * size], every[2 * size :], rare, lengths, texts.n[at])]
        yield part, row["block"], b"".join(struct.pack("<Q", len(a)) + a for a in arrays)


def _send(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                part, block, data = zip(*_pieces(batch.slice(k, 1).to_pylist()[0], shared), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], ["part", "block", "data"])

    return run


def _received(rows: pa.Table, frequent: Frequent, split: int):
    """Blocks, their row counts and rare words, the place of each row among the distinct trigrams, and these: context, restaurant, w, n."""
    rows = rows.sort_by("block")
    out, sizes, rares = [], [], []
    for data in rows.column("data").to_pylist():
        arrays, at = [], 0
        while at < len(data):
            size = struct.unpack_from("<Q", data, at)[0]
            arrays.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        rare = unpress(arrays[3], np.uint64)
        v = np.repeat(unpress(arrays[2]), unpress(arrays[4]))
        words = [frequent.words(x, rare) for x in (unpress(arrays[0]), v, unpress(arrays[1]))]
        out.append((*words, restaurants(words[0], words[1], v, frequent, split), unpress(arrays[5])))
        sizes.append(len(v))
        rares.append(rare)
    u, v, w, r, n = (np.concatenate(x) for x in zip(*out, strict=True))
    first, which = groups(mix(mix(u, v), w))
    return rows.column("block").to_pylist(), sizes, rares, which, u[first], r[first], w[first], np.bincount(which, n, len(first))


_LAYERS = "kind int, part bigint, word bigint, tables double, data binary"


def _first_pass(shared):
    """Kind 0: tables of a shard of the frequent words; 1: of a rare word; 2: how many trigrams and bigrams have one and two customers."""

    def run(rows: pa.Table) -> pa.Table:
        (frequent, _, split), part = shared.value, rows.column("part")[0].as_py()
        _, _, _, _, u, r, w, n = _received(rows, frequent, split)
        first, which = groups(w)
        one = w[first]
        code, rare = frequent.codes(one)
        often = code < len(frequent.word)
        spare = max(frequent.total - int(frequent.n.sum()), 1) / max(frequent.known - len(frequent.word), 1)
        guess = np.where(often, frequent.n[np.where(often, code, 0)] if len(frequent.n) else 1, spare) / max(frequent.total, 1)
        _, first, c2, t2 = seat(u, r, w, n, guess[which], (DISCOUNT, DISCOUNT), FIRST, FIRST, np.random.default_rng([part, 1]))
        tables = np.bincount(which[first], t2, len(one))
        out = [(2, k, float(x), None) for k, x in enumerate([(n == 1).sum(), (n == 2).sum(), (c2 == 1).sum(), (c2 == 2).sum()])]
        dense = np.zeros(len(frequent.word), np.uint32)
        dense[code[often]] = tables[often]
        out += [(0, k, None, press(dense[k * SHARD : (k + 1) * SHARD])) for k in range(-(-len(dense) // SHARD))]
        m = len(rare)
        kind, word, number, data = zip(*out, strict=True)
        return pa.table(
            {
                "kind": pa.array(np.concatenate([kind, np.full(m, 1)]), pa.int32()), "part": pa.array(np.full(len(kind) + m, part)),
                "word": pa.array(np.concatenate([np.array(word, np.int64), rare.view(np.int64)])), "tables": pa.array([*number, *tables[~often].tolist()], pa.float64()),
                "data": pa.array([*data, *[None] * m], pa.binary()),
            }
        )

    return run


def _sum_shard(rows: pa.Table) -> pa.Table:
    total = sum(unpress(d).astype(np.int64) for d in rows.column("data").to_pylist())
    return pa.table({"word": pa.array(np.arange(len(total)) + rows.column("word")[0].as_py() * SHARD), "tables": pa.array(total)})


def _second_pass(shared, corpus):
    def run(rows: pa.Table, rare: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "p": pa.array([], pa.binary()), "n": pa.array([], pa.binary())})
        (frequent, _, split), part = shared.value, rows.column("part")[0].as_py()
        blocks, sizes, rares, which, u, r, w, n = _received(rows, frequent, split)
        often, unknown, discounts = corpus.value
        rare = rare.filter(pc.is_valid(rare.column("word"))).sort_by("word")
        words, p1, counts = rare.column("word").to_numpy(), rare.column("p").to_numpy(), rare.column("n").to_numpy()

        def known(some: np.ndarray, keys: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
            if not len(keys):
                return np.full(len(some), other)
            at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
            return np.where(keys[at] == some, values[at], other)

        first, which1 = groups(w)
        one = w[first]
        base = known(one, frequent.word, often, np.nan)
        base = np.where(np.isnan(base), known(one.view(np.int64), words, p1, unknown), base)[which1]
        p = seat(u, r, w, n, base, discounts, SWEEPS, BURN_IN, np.random.default_rng([part, 2]))[0].astype(np.float32)[which]
        return pa.table(
            {
                "block": pa.array(blocks, pa.int64()), "part": pa.array([part] * len(blocks), pa.int64()),
                "p": pa.array([x.tobytes() for x in np.split(p, np.cumsum(sizes)[:-1])], pa.binary()),
                "n": pa.array([press(known(x.view(np.int64), words, counts, 0).astype(np.uint64)) for x in rares], pa.binary()),
            }
        )

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct training words of each four million tokens."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.append(hashes(tokens(text)))
            size += len(held[-1])
            if size > 4_000_000:
                yield rows()
                size = 0
    if held:
        yield rows()


def _make_blocks(frequent, block: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, words, made, size = [], [], [], TaskContext.get().partitionId() << 32, 0

        def row() -> pa.RecordBatch:
            code, rare = frequent.value.codes(np.concatenate(words))
            columns = {"block": ([made], pa.int64()), "ids": ([list(ids)], pa.list_(kind)), "held": ([list(held)], pa.list_(pa.bool_())), "lengths": ([[len(x) for x in words]], pa.list_(pa.int64())), "codes": ([press(code)], pa.binary()), "rare": ([press(rare)], pa.binary())}
            for x in (ids, held, words):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(*x) for x in columns.values()], list(columns))

        for batch in batches:
            for doc, own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text")), strict=True):
                ids.append(doc)
                held.append(own)
                words.append(hashes(tokens(text)))
                size += len(words[-1])
                if size >= block:
                    yield row()
                    made, size = made + 1, 0
        if ids:
            yield row()

    return run


def score_documents(documents: DataFrame, *, block: int = 1_000_000, part: int = 1_500_000, split: int = 1_000_000, frequent: int = FREQUENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, log10_perplexity) for each row.

    Trained on the rows whose crc32 of the id (as text; of nothing for a null) isn't 0 modulo 10. A null or empty text is its
    end alone; a word that no training text has counts as an unknown word, whichever it is; repeated rows count as often as they
    occur. Without a training row the base is uniform and all mass is the unknown word's. Ids can be of any type. Texts are
    held in blocks of ``block`` tokens and restaurants in parts of ``part``; a longer text is a block of its own.
    """
    spark, col = documents.sparkSession, F.col
    held = F.crc32(F.coalesce(col(id_column).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = documents.select(col(id_column).alias("doc_id"), held.alias("held"), col(text).alias("text"))
    words = materialize(docs.filter("not held").select("text").mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    known, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = words.orderBy(F.desc("n"), "word").limit(frequent).toArrow()  # bounded by ``frequent``
    often = Frequent(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy(), total, known)
    alone = spark.sparkContext.broadcast(often)
    kind = documents.schema[id_column].dataType
    ddl = f"block bigint, ids array<{kind.simpleString()}>, held array<boolean>, lengths array<bigint>, codes binary, rare binary"
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = materialize(docs.mapInArrow(_make_blocks(alone, block, to_arrow_type(kind)), ddl), "blocks")
    size = blocks.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()[0]
    parts = size // part + 1
    tasks = min(max(parts, spark.sparkContext.defaultParallelism), 100_000)
    shared = spark.sparkContext.broadcast((often, parts, split))
    sent = blocks.mapInArrow(_send(shared), "part bigint, block bigint, data binary").repartition(tasks, "part")

    layers = materialize(sent.groupBy("part").applyInArrow(_first_pass(shared), _LAYERS), "layers")
    n1, n2, m1, m2 = ({r.word: r.x for r in layers.filter("kind = 2").groupBy("word").agg(F.sum("tables").alias("x")).collect()}.get(k, 0.0) for k in range(4))
    shards = layers.filter("kind = 0").select("word", "data").groupBy("word").applyInArrow(_sum_shard, "word bigint, tables bigint").toArrow().sort_by("word")
    rare = materialize(layers.filter("kind = 1").groupBy("word").agg(F.sum("tables").alias("tables")).join(words, "word"), "rare")
    tables = shards.column("tables").to_numpy().astype(np.float64)
    r0, r1, r2 = (float(x or 0) for x in rare.agg(F.sum("tables"), F.sum((col("tables") == 1).cast("long")), F.sum((col("tables") == 2).cast("long"))).first())
    d1 = _discount((tables == 1).sum() + r1, (tables == 2).sum() + r2)
    mass = STRENGTH + tables.sum() + r0
    unknown = (STRENGTH + d1 * known) / mass if known else 1.0
    corpus = spark.sparkContext.broadcast(((tables - d1) / mass, unknown, (_discount(n1, n2), _discount(m1, m2))))
    asked = layers.filter("kind = 1").select("part", "word").join(rare.select("word", "n", ((col("tables") - d1) / mass).alias("p")), "word").repartition(tasks, "part")
    answers = materialize(sent.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_second_pass(shared, corpus), "block bigint, part bigint, p binary, n binary"), "answers")
    discard(layers, rare, words)
    out = pa.schema([("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        texts, frequent = Texts(row, *shared.value), shared.value[0]
        answers = answers.sort_by("part")
        p = np.concatenate([np.frombuffer(x, np.float32) for x in answers.column("p").to_pylist()]).astype(np.float64)
        count = np.concatenate([frequent.n, np.zeros(len(texts.rare), np.int64)])
        for at, n in zip(texts.pieces, answers.column("n").to_pylist(), strict=True):  # of the rare words of a piece, in order
            codes = np.unique(np.concatenate([texts.u[at], texts.v[at], texts.w[at]]))
            codes = codes[codes >= len(frequent.word)]
            count[codes] = np.maximum(count[codes], unpress(n, np.uint64).astype(np.int64))  # a part knows those that are a last word there
        n = count[texts.w]
        starts = np.cumsum(texts.lengths) - texts.lengths
        add = lambda x: np.add.reduceat(x[texts.which], starts)
        columns = [row["ids"], texts.held, texts.lengths, add((n > 0).astype(np.int64)), np.full(len(starts), total), add(np.log10((n + 0.1) / (total + 0.1 * (known + 1)))), add(np.log10(p))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumn("log10_perplexity", -col("score") / col("n_tokens"))


def _discount(one: float, two: float) -> float:
    return float(min(max(one / (one + 2 * two or 1), 0.1), 0.95))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
