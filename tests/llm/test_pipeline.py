"""The pipeline's stages, each on its own input, against brute force."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from kinlink.llm import decontamination, packing, pii, quality

from .test_llm import LONG, SCHEMA, alnum, components_by_force


def test_registered(spark):
    names = [k for k in __spark_entry__.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = [alnum(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    kept = stages["quality classifier"](spark, docs, sf_dir)
    want = {r.doc_id for r in quality.classify(docs, labels).filter("keep").collect()}
    assert kept.columns == docs.columns and set(rows(kept)) == want

    single = stages["n-gram Jaccard join"](spark, kept, sf_dir)
    groups = components_by_force([(i, r.text) for i, r in rows(kept).items()], 80, 5)
    assert set(rows(single)) == {i for i, (_, c) in groups.items() if c == i}

    clean = stages["benchmark decontamination"](spark, single, sf_dir)
    windows = {tuple(w[k : k + 10]) for w in bench for k in range(max(1, len(w) - 9))}

    def hit(text):
        w = alnum(text)
        return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    assert set(rows(clean)) == {i for i, r in rows(single).items() if not hit(r.text)}

    redacted = stages["PII"](spark, clean, sf_dir)
    before, after = rows(clean), rows(redacted)
    assert set(before) == set(after) and redacted.columns == docs.columns
    field = pii.trained()
    for i, r in after.items():
        own, more = pii.find_spans(before[i].text, field)
        assert (r.text == before[i].text) == (not own and not more) and not pii.base_spans(r.text)
        assert r.n_chars == (len(r.text) if own or more else before[i].n_chars)

    packed = stages["best-fit packing"](spark, redacted, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(after)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for r in packed:
        ids = tokenizer.encode(after[r.doc_id].text, add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + 2048], "<u4").tobytes())
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(packed)


ODD = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, LONG, "en", None, 5), (4, "a b c d e f", "xx", "a", 1), (4, "a b c d e f", "xx", "a", 1), (5, "a b c d e f", "xx", None, 1), (4, "something else at all here", "en", "a", 1), (None, "no id, but mail a@b.example", "en", "a", 1), (None, "no id, but mail a@b.example", "en", "a", 1)]
#: What each stage leaves of these rows: ids with the starts of texts.
LEFT = {
    "n-gram Jaccard join": [(1, None), (2, ""), (3, "lorem"), (4, "a b c"), (4, "somet"), (None, "no id")],
    "benchmark decontamination": [(1, None), (2, ""), (3, "lorem"), (4, "a b c"), (4, "a b c"), (4, "somet"), (5, "a b c"), (None, "no id"), (None, "no id")],
    "PII": [(1, None), (2, ""), (3, "lorem"), (4, "a b c"), (4, "a b c"), (4, "somet"), (5, "a b c"), (None, "no id"), (None, "no id")],
}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, sf_dir, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    odd = spark.createDataFrame(ODD, SCHEMA).withColumn("keep", F.lit("mine")).withColumn("spans", F.lit(1)).withColumn("__key", F.lit(2))
    got = f(spark, odd, sf_dir)
    rows = got.collect()
    if stage in LEFT:
        assert got.columns == corpus_pipeline.COLUMNS
        assert sorted(((r.doc_id, r.text and r.text[:5]) for r in rows), key=str) == sorted(LEFT[stage], key=str)
    if stage == "PII":
        assert [r.text for r in rows if r.doc_id is None] == ["no id, but mail [EMAIL]"] * 2 and all(r.n_chars == 1 for r in rows if r.doc_id in (4, 5))
    if stage == "quality classifier":
        assert all((r.text or "").strip() for r in rows) and {r.doc_id for r in rows} <= {3, 4, 5, None}
    if stage == "best-fit packing":
        assert len([r for r in rows if r.doc_id in (1, 2)]) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        assert len([r for r in rows if r.doc_id == 4]) == 3 and sum(r.length for r in rows if r.doc_id == 3) > 200_000
    empty = f(spark, odd.limit(0), sf_dir)
    assert empty.count() == 0 and empty.columns == got.columns
