"""Quality classifier: interpolated modified Kneser-Ney models of trusted text, one for each language and one of all.

The n-grams are of real characters (code points), four at most; a word that repeats the word before it is one symbol. Texts are
read in chunks, each of which sends its distinct n-grams with their counts; these are summed by n-gram, lower orders count the
distinct symbols before, and a join by context gives each n-gram its share and each context the weight that it leaves to the order
below. A text's perplexity is held against a quantile of the perplexities of trusted texts, of the same language, that the models
weren't trained on.

A chunk needs the shares of its distinct n-grams only. While the joined model has at most ``broadcast_rows`` rows it is sent to
all; beyond, the n-grams that a chunk has are joined with it by a hash of the n-gram and go back to the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, int_id, materialize, small, table
from .language_model import groups, mix

ORDER = 4
#: Stands before a text; stands for a word that repeats the word before it. Both are code points that text doesn't use.
START, REPEAT = 0, "\x01"
#: Below the single characters all code points are equally likely.
CODE_POINTS = 0x110000
#: Symbols that are worked on at once.
CHUNK = 1_000_000
#: Trusted texts of a language from which on it has a model and a threshold of its own.
LEAST = 40
_C = [f"c{k}" for k in range(1, ORDER + 1)]


def symbols(text: str | None) -> np.ndarray:
    """The text's symbols: blanks are one space."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint32)
    line = words[0] + "".join([" " + b if b != a else REPEAT for a, b in zip(words, words[1:], strict=False)])  # the mark stands for blank and word
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of full order of texts (a row for each), and for each symbol the number of the one it ends.

    Contexts pass over the marks of repeated words, so a run of them isn't likelier with every word.
    """
    pad = np.full(ORDER - 1, START, np.uint32)
    line = np.concatenate([x for t in texts for x in (pad, t)])
    starts = np.cumsum([0, *(len(t) + ORDER - 1 for t in texts[:-1])])
    keep = np.ones(len(line), bool)
    for k in range(ORDER - 1):
        keep[starts + k] = False
    present = np.zeros(CODE_POINTS, bool)
    present[line] = True
    number = np.cumsum(present, dtype=np.uint64) - 1
    size, ends = int(number[-1]) + 1, np.flatnonzero(keep)
    plain = np.flatnonzero(line != ord(REPEAT))
    before = np.searchsorted(plain, ends) if len(plain) < len(line) else ends  # how many plain symbols
    back = [ends, *(plain[before - k] for k in range(1, ORDER))]
    key = number[line[back[-1]]]
    for at in back[-2::-1]:
        key = key * np.uint64(size) + number[line[at]] if size**ORDER < 1 << 64 else mix(key, number[line[at]])
    first, which = groups(key)
    return np.stack([line[at[first]] for at in back[::-1]], axis=1), which


def _language(lang: str | None) -> np.uint64:
    return np.uint64(0 if lang is None else xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) | 1)


def keys(lang: np.ndarray, rows: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n-grams (the last ``order`` columns) in languages: the hashes of the contexts and of the n-grams."""
    context = mix(lang, np.full(len(rows), order, np.uint64))
    for k in range(ORDER - order, ORDER - 1):
        context = mix(context, rows[:, k].astype(np.uint64))
    return context, mix(context, rows[:, -1].astype(np.uint64) + np.uint64(1))


class Shares:
    """Sorted hashes of contexts and n-grams with the weights they leave and the shares they have."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        key = key.view(np.uint64)
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]

    def find(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), np.nan)
        order = np.argsort(key)  # sorted ones are found much faster
        at = np.empty(len(key), np.int64)
        at[order] = np.minimum(np.searchsorted(self.key, key[order]), len(self.key) - 1)
        return np.where(self.key[at] == key, self.value[at], np.nan)

    def has(self, lang: str | None) -> bool:
        return not np.isnan(self.find(mix(np.array([_language(lang)]), np.ones(1, np.uint64)))[0])

    def log(self, lang: str | None, rows: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of n-grams' last symbols."""
        p, own = np.full(len(rows), 1 / CODE_POINTS), np.full(len(rows), _language(lang))
        for order in range(1, ORDER + 1):
            context, gram = keys(own, rows, order)
            left, share = self.find(context), self.find(gram)
            p = np.where(np.isnan(share), 0, share) + np.where(np.isnan(left), 1, left) * p
        return np.log(p)


def _chunks(texts: list[str | None], langs: list[str | None]) -> Iterator[tuple[str | None, list[int], list[np.ndarray]]]:
    """Of each language the texts' places and symbols, about CHUNK of them at a time; texts without a word are left out."""
    held: dict[str | None, tuple[list, list]] = {}
    size: dict[str | None, int] = {}
    for k, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        if len(s := symbols(t)):
            own = held.setdefault(lang, ([], []))
            own[0].append(k)
            own[1].append(s)
            size[lang] = size.get(lang, 0) + len(s)
            if size[lang] >= CHUNK:
                yield lang, *held.pop(lang)
                size[lang] = 0
    for lang, own in held.items():
        yield lang, *own


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, langs in _gather(batches):
        for lang, _, own in _chunks(texts, langs):
            rows, which = grams(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *(pa.array(rows[:, k].astype(np.int32)) for k in range(ORDER)), pa.array(np.bincount(which))], ["lang", *_C, "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Texts and languages of several batches, about CHUNK characters."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            texts.append(t)
            langs.append(lang)
            size += len(t or "")
            if size >= CHUNK:
                yield texts, langs
                texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.column("lang").to_pylist()
        hashed = {x: _language(x) for x in set(names)}
        lang = np.array([hashed[x] for x in names], np.uint64)
        order, whole = b.column("k").to_numpy(), b.column("gram").to_numpy(zero_copy_only=False)
        rows = np.stack([b.column(c).to_numpy() for c in _C], axis=1)
        key = np.zeros(len(b), np.uint64)
        for k in range(1, ORDER + 1):
            context, gram = keys(lang, rows, k)
            key = np.where(order == k, np.where(whole, gram, context), key)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("value")], ["key", "value"])


def train(trusted: DataFrame) -> DataFrame:
    """(key, value): of contexts the weight they leave, of n-grams their share, by language (null: of all texts).

    ``trusted`` has text, lang and own: whether its language has a model of its own.
    """
    col = F.col
    counted = materialize(trusted.select("text", F.when(col("own"), col("lang")).alias("lang")).mapInArrow(_count, "lang string, " + ", ".join(f"{c} int" for c in _C) + ", n bigint").groupBy("lang", *_C).agg(F.sum("n").alias("n")), "grams")
    every = counted.groupBy(*_C).agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), *_C, "n")
    top = counted.filter("lang is not null").unionByName(every)
    orders, written = {ORDER: materialize(top, "order4")}, [counted]
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols before
        orders[k] = materialize(orders[k + 1].groupBy("lang", *_C[ORDER - k :]).agg(F.count("*").alias("n")), f"order{k}")
    out = []
    for k in range(1, ORDER + 1):  # each order is written by itself: one plan of all took the driver several hundred MB
        have = [F.sum((col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.when(col("n1") + col("n2") > 0, col("n1") / (col("n1") + 2 * col("n2"))).otherwise(0.5)
        cut = [F.when((col(f"n{i}") > 0) & (col(f"n{i + 1}") > 0), F.least(F.greatest(i - (i + 1) * y * col(f"n{i + 1}") / col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(0.5).alias(f"d{i}") for i in (1, 2, 3)]
        cuts = materialize(orders[k].groupBy("lang").agg(*have).select(col("lang").alias("__lang"), *cut), f"cuts{k}")
        of = orders[k].join(small(cuts, cuts.count(), 10_000), col("lang").eqNullSafe(col("__lang")))
        of = of.withColumn("cut", F.when(col("n") == 1, col("d1")).when(col("n") == 2, col("d2")).otherwise(col("d3")))
        context = _C[ORDER - k : -1]
        totals = materialize(of.groupBy("lang", *context).agg(F.sum("n").alias("total"), F.sum("cut").alias("left")), f"totals{k}")
        none = [F.lit(0).alias(c) for c in _C[: ORDER - k]]
        left = totals.select("lang", *none, *context, F.lit(0).alias(_C[-1]), F.lit(k).alias("k"), F.lit(False).alias("gram"), (col("left") / col("total")).alias("value"))
        share = of.join(totals.select(col("lang").alias("__of"), *(col(c).alias(f"__{c}") for c in context), "total"), _same(context))
        share = share.select("lang", *none, *context, _C[-1], F.lit(k).alias("k"), F.lit(True).alias("gram"), ((col("n") - col("cut")) / col("total")).alias("value"))
        out.append(materialize(left.unionByName(share).mapInArrow(_keyed, "key bigint, value double"), f"shares{k}"))
        written += [cuts, totals]
    model = reduce(DataFrame.unionByName, out)
    discard(*written, *orders.values())
    return model


def _same(context: list[str]):
    out = F.col("lang").eqNullSafe(F.col("__of"))
    for c in context:
        out = out & (F.col(c) == F.col(f"__{c}"))
    return out


def _scored(texts: list[str | None], langs: list[str | None], shares: Shares) -> tuple[list[int], list[float | None], list[bool]]:
    """Symbols and perplexity of each text, and whether its language has a model of its own."""
    n, value = [0] * len(texts), [None] * len(texts)
    has = {x: x is not None and shares.has(x) for x in set(langs)}
    for lang, places, own in _chunks(texts, [x if has[x] else None for x in langs]):
        rows, which = grams(own)
        lengths = np.array([len(t) for t in own])
        total = np.add.reduceat(shares.log(lang, rows)[which], np.cumsum(lengths) - lengths)
        for k, m, x in zip(places, lengths.tolist(), np.exp(-total / lengths).tolist(), strict=True):
            n[k], value[k] = m, x
    return n, value, [has[x] for x in langs]


_NEW = {"n_symbols": (pa.int64(), "bigint"), "perplexity": (pa.float64(), "double"), "own_model": (pa.bool_(), "boolean")}


def _with_scores(table: pa.Table, kept: list[str], shares: Shares, text: str) -> pa.Table:
    out = _scored(table.column(text).to_pylist(), table.column("__lang").to_pylist(), shares)
    return pa.table([*(table.column(c) for c in kept), *(pa.array(x, kind[0]) for x, kind in zip(out, _NEW.values(), strict=True))], names=[*kept, *_NEW])


def score(documents: DataFrame, model: DataFrame, *, text: str = "text", lang: str = "lang", broadcast_rows: int = 4_000_000) -> DataFrame:
    """``documents`` with n_symbols, perplexity (null without a word), and own_model: whether the language has a model of its own."""
    spark = documents.sparkSession
    kept = [f.name for f in documents.schema.fields if f.name not in _NEW]
    if text not in kept:
        documents, text = documents.withColumn("__text", F.col(text)), "__text"
    source = documents.select(*dict.fromkeys([*kept, text]), F.col(lang).cast("string").alias("__lang"))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in kept] + [f"{c} {kind[1]}" for c, kind in _NEW.items()])
    if model.count() <= broadcast_rows:
        rows = model.toArrow()
        shared = spark.sparkContext.broadcast((rows.column("key").to_numpy(), rows.column("value").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shares = Shares(*shared.value)
            for some in _tables(batches, text):
                yield from _with_scores(some, kept, shares, text).combine_chunks().to_batches()

        return source.mapInArrow(run, ddl)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for k, some in enumerate(_tables(batches, text)):
            yield from some.append_column("__chunk", pa.array([at + k] * len(some), pa.int64())).combine_chunks().to_batches()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("__chunk").to_numpy()
            for chunk in np.unique(chunks):
                some = batch.filter(pa.array(chunks == chunk))
                texts, langs = some.column(text).to_pylist(), some.column("__lang").to_pylist()
                need = [mix(np.array([_language(x) for x in set(langs)]), np.ones(len(set(langs)), np.uint64))]
                for own in {None, *langs}:
                    for _, _, s in _chunks([t for t, x in zip(texts, langs, strict=True) if own is None or x == own], [None] * (len(texts) if own is None else langs.count(own))):
                        rows = grams(s)[0]
                        need += [k for order in range(1, ORDER + 1) for k in keys(np.full(len(rows), _language(own)), rows, order)]
                every = np.unique(np.concatenate(need)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk)] * len(every), pa.int64()), pa.array(every)], ["__chunk", "key"])

    written = materialize(source.mapInArrow(numbered, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", __chunk bigint"), "chunks")
    answers = written.select("__chunk", text, "__lang").mapInArrow(asked, "__chunk bigint, key bigint").distinct().join(model, "key")

    def answered(texts: pa.Table, rows: pa.Table) -> pa.Table:
        return _with_scores(texts, kept, Shares(rows.column("key").to_numpy(), rows.column("value").to_numpy()), text)

    return written.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(answered, ddl)


def _tables(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """Batches put together or cut to about CHUNK characters."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum([len(t or "") for t in batch.column(text).to_pylist()])
        lo = 0
        while lo < len(batch):
            hi = int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + CHUNK - size)) + 1
            part = batch.slice(lo, hi - lo)
            held.append(part)
            size += int(lengths[min(hi, len(batch)) - 1] - (lengths[lo - 1] if lo else 0))
            lo = hi
            if size >= CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def classify(documents: DataFrame, labels: DataFrame, *, quantile: float = 0.99, margin: float = 1.5, spread: float = 4.0, broadcast_rows: int = 4_000_000) -> DataFrame:
    """``documents`` with n_symbols, perplexity, own_model, threshold and keep.

    Trusted are the documents that ``labels`` (doc_id, quality) calls 1. Those whose crc32 of the id is 0 modulo 4 set the
    thresholds, the others train. A language's threshold is ``margin`` times the ``quantile`` of its perplexities; a language with
    fewer than LEAST trusted texts takes model and threshold of all. A mean over n symbols varies with 1/sqrt(n), so for a text
    the threshold is ``spread``/sqrt(n) wider. A text without a word has no perplexity and isn't kept; without trusted texts
    everything that has a word is kept. Labels for no document, null or repeated ones don't matter; ids that are no integers
    have no label; repeated documents stay.
    """
    col, by_id = F.col, lambda c: F.expr(f"try_cast({c} as bigint)")
    good = labels.filter("quality = 1").select(by_id("doc_id").alias("__id")).filter("__id is not null").distinct()
    trusted = documents.join(small(good, good.count(), 500_000), by_id("doc_id") == col("__id"), "left_semi").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    many = materialize(trusted.groupBy("lang").agg(F.count("*").alias("n")).filter(f"n >= {LEAST} and lang is not null").select(col("lang").alias("__lang")), "languages")
    trusted = trusted.join(small(many, many.count(), 10_000), col("lang") == col("__lang"), "left")
    judge = F.crc32(by_id("doc_id").cast("string").cast("binary")) % 4 == 0
    model = train(trusted.filter(~judge).select("text", "lang", col("__lang").isNotNull().alias("own")))
    judges = trusted.filter(judge).select("lang", "text")
    both = judges.unionByName(judges.withColumn("lang", F.lit(None).cast("string")))
    seen = materialize(score(both, model, broadcast_rows=broadcast_rows).filter("perplexity is not null").select(F.when(col("own_model"), col("lang")).alias("lang"), "perplexity", "n_symbols"), "judges")
    wider = 1 + spread / F.sqrt(F.greatest("n_symbols", F.lit(1)))
    cut = F.percentile_approx(col("perplexity") / wider, F.lit(quantile), F.lit(10_000)) * margin
    overall = seen.filter("lang is null").agg(cut).first()[0]
    by = materialize(seen.filter("lang is not null").groupBy(col("lang").alias("__lang")).agg(cut.alias("__cut")), "thresholds")
    out = score(documents, model, broadcast_rows=broadcast_rows).join(small(by, by.count(), 100_000), col("own_model") & (col("lang") == col("__lang")), "left")
    out = out.withColumn("threshold", F.coalesce("__cut", F.lit(float("inf") if overall is None else overall)) * wider).drop("__lang", "__cut")
    return out.withColumn("keep", F.coalesce(col("perplexity") <= col("threshold"), F.lit(False)))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_symbols", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "keep")
