"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Every benchmark word gets one symbol, so a text becomes a string with a symbol for each word and the
automaton scans that string once: the end of a match is a word number, and word numbers map to
offsets in the original. Words that no item has share a symbol that no window holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, table

#: Words in the original, before A-Z is lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
MISS = "\0"
#: Symbols there are: code points but 0 and the surrogates. Beyond so many words, a word has two, each from one half of them.
SYMBOLS = 0x110000 - 0x801


def _symbol(i: int) -> str:
    return chr(i + 1) if i + 1 < 0xD800 else chr(i + 1 + 0x800)


class Windows:
    """The automaton of one block of items, made in each Python worker from the items' texts."""

    def __init__(self, items: list[tuple[str, str]], width: int, *, symbols: int = SYMBOLS):
        import ahocorasick

        number: dict[bytes, int] = {}
        for _, text in items:
            for w in alnum_words(text):
                number.setdefault(w, len(number))
        self.size, half = 1 + (len(number) > symbols), symbols // 2
        self.vocabulary = {w: _symbol(i) if self.size == 1 else _symbol(i // half) + _symbol(half + i % half) for w, i in number.items()}
        self.owners: dict[str, list[str]] = {}
        for item, text in items:
            line, step = "".join(map(self.vocabulary.__getitem__, alnum_words(text))), self.size
            for i in range(0, max(1, len(line) - width * step + 1) if line else 0, step):
                own = self.owners.setdefault(line[i : i + width * step], [])
                if not own or own[-1] != item:
                    own.append(item)
        self.automaton = ahocorasick.Automaton()
        for window in self.owners:
            self.automaton.add_word(window, window)
        if self.owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges hit (end exclusive, in order of their ends) and the items with an occurring window."""
        ranges, found = [], set()
        if self.owners and words:
            get, size = self.vocabulary.get, self.size
            for end, window in self.automaton.iter("".join([get(w, MISS * size) for w in words])):
                ranges.append(((end + 1 - len(window)) // size, (end + 1) // size))
                found.add(window)
        return ranges, {item for window in found for item in self.owners[window]}


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[int, Windows] = {}


def _scan(items, key: int, width: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()  # one automaton a worker
            _built[key] = Windows(items.value, width)
        windows = _built[key]
        for batch in batches:
            n_words, hits, found, spans = [], [], [], []
            texts = batch.column("text").to_pylist()
            before = [None] * len(texts) if first else zip(batch.column("word_ranges").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, old in zip(texts, before, strict=True):
                words = alnum_words(text)
                ranges, items_hit = windows.scan(words)
                if old is not None:
                    ranges += [(r["start"], r["end"]) for r in old[0]]
                    items_hit |= set(old[1])
                ranges = merge(ranges)
                n_words.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in ranges])
                found.append(sorted(items_hit))
                at = [m.span() for m in WORD.finditer(text)] if ranges else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            new = {"n_words": pa.array(n_words, pa.int64()), "word_ranges": pa.array(hits, span), "items": pa.array(found, pa.list_(pa.string())), "spans": pa.array(spans, span)}
            kept = {c: batch.column(c) for c in batch.schema.names if c not in new}
            yield pa.RecordBatch.from_pydict(kept | new)

    return run


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_chars: int = 16_000_000) -> DataFrame:
    """``documents`` with n_words, word_ranges, items (as strings), spans (offsets in the original) and n_hit.

    A window is ``width`` consecutive words of an item, or a shorter item's whole word sequence. The benchmark is read
    to the driver in blocks of about ``block_chars`` characters, and each block's automaton is a further narrow pass over
    the same rows; an ordinary benchmark is one block. Nulls have no words, repeated rows stay apart, columns of
    ``documents`` named like a new one are replaced, and an empty benchmark hits nothing.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).filter("i is not null")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    out = documents.withColumn("text", F.col(text)).drop("n_words", "word_ranges", "items", "spans", "n_hit")
    span = "array<struct<start:bigint,end:bigint>>"
    for b in range(blocks):
        own = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(own)
        kept = [f for f in out.schema.fields if f.name not in ("n_words", "word_ranges", "items", "spans")]
        ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"n_words bigint, word_ranges {span}, items array<string>, spans {span}"])
        out = out.mapInArrow(_scan(shared, shared._jbroadcast.id(), width, b == 0), ddl)
    return out.withColumn("n_hit", F.expr("aggregate(word_ranges, 0L, (a, r) -> a + r.end - r.start)"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
