import hashlib

import pytest
from pyspark.sql import functions as F

from kinlink.functions.text import prepare, prepare_variant
from kinlink.operators import blocking, features, metrics, sampling
from kinlink.plans.params import Params, TokenPass

COLUMNS = "entity_id string, business_name string, business_address string, country string"


def entities(spark, rows, prep=prepare):
    return prep(spark.createDataFrame([(i, n, a, "US") for i, n, a in rows], COLUMNS))


def pairs_of(df):
    return {(r.entity_id_s1, r.entity_id_s2s3) for r in df.collect()}


def test_token_bags(spark):
    left, right = entities(spark, [("S1-1", "foo bar", ""), ("S1-2", "foo", "")]), entities(spark, [("S2-1", "foo foo", ""), ("S2-2", "bar", "")])
    got = blocking.block_tokens(left, right, TokenPass(2, 100, 3, 10), "T").collect()
    assert [(r.entity_id_s1, r.n) for r in got] == [("S1-1", 2)]


def test_token_limits(spark):
    left = entities(spark, [("S1-1", "alpha beta", "")])
    right = entities(spark, [(f"S2-{i}", "alpha beta" if i < 3 else "beta gamma", "") for i in range(6)])
    assert pairs_of(blocking.block_tokens(left, right, TokenPass(2, 5, 3, 10), "T")) == set()  # beta is too frequent
    assert len(pairs_of(blocking.block_tokens(left, right, TokenPass(2, 6, 3, 2), "T"))) == 2
    assert pairs_of(blocking.block_tokens(left, right, TokenPass(1, 6, 3, 2), "T")) == {("S1-1", "S2-0"), ("S1-1", "S2-1")}


def test_candidates_and_cap(spark):
    left = entities(spark, [("S1-1", "Acme Trading Ltd", ""), ("S1-2", "", "")])
    right = entities(spark, [(f"S3-{i}", "Trading Acme", "") for i in range(4)] + [("S2-9", "acme trading", ""), ("S2-8", "", "")])
    got = blocking.candidates(left, right, Params(candidate_cap=3)).orderBy("entity_id_s2s3").collect()
    assert [(r.entity_id_s2s3, r.block, r.n_blocks) for r in got] == [("S2-9", "C,E,L,S,T", 5), ("S3-0", "L,S,T", 3), ("S3-1", "L,S,T", 3)]
    nothing = entities(spark, [("S1-0", "x", "")]).limit(0)
    assert blocking.candidates(nothing, right).count() == 0


def test_early_cap_changes_nothing(spark):
    left = entities(spark, [(f"S1-{i}", f"name {'abc'[i % 3]} shared", "") for i in range(30)])
    right = entities(spark, [(f"S2-{i:03d}", f"name {'abc'[i % 3]} shared", "") for i in range(90)])
    late = blocking.cap_candidates(blocking.union_blocks([blocking.block_exact(left, right), blocking.block_sorted(left, right)]), 7)
    early = blocking.cap_candidates(blocking.union_blocks([blocking.block_exact(left, right, 7), blocking.block_sorted(left, right, 7)]), 7)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))


def test_variant_blocks(spark):
    left = entities(spark, [("S1-1", "Acme Trading", "99 Main 123456")], prepare_variant)
    right = entities(spark, [("S2-1", "acmet rade", "x 123456"), ("S2-2", "trading acme", ""), ("S2-3", "zzz", "99")], prepare_variant)
    got = {r.entity_id_s2s3: (r.methods, r.n_methods) for r in blocking.candidates_variant(left, right).collect()}
    assert got == {"S2-1": ("addr_number,prefix", 2), "S2-2": ("sorted,token", 2)}
    feats = features.pair_features_variant(blocking.candidates_variant(left, right), left, right)
    assert feats.columns[2:] == features.NAMES_VARIANT and len(features.NAMES_VARIANT) == 31
    row = feats.filter("entity_id_s2s3 = 'S2-2'").first()
    assert (row.name_token_sort, row.has_sorted_block, row.has_prefix_block, row.addr_missing_any, row.addr_missing_both) == (1.0, 1.0, 0.0, 1.0, 0.0)


def test_features(spark):
    left, right = entities(spark, [("S1-1", "Royal Tea House", "1 Road")]), entities(spark, [("S2-1", "Tea Royal", "")])
    pairs = spark.createDataFrame([("S1-1", "S2-1", "T", 1), ("S1-1", "S2-404", "E", 1)], "entity_id_s1 string, entity_id_s2s3 string, block string, n_blocks long")
    rows = {r.entity_id_s2s3: r for r in features.pair_features(pairs, left, right).collect()}
    r = rows["S2-1"]
    assert (r.name_ratio, r.name_tsort, r.name_tset) == pytest.approx((5 / 12, 0.75, 1.0))
    assert (r.addr_miss, r.addr_ratio, r.country_eq, r.is_s2, r.blk_T, r.blk_E) == (1.0, 0.0, 1.0, 1.0, 1.0, 0.0)
    assert set(rows["S2-404"].asDict()[c] for c in features.NAMES) == {0.0}  # one record is unknown
    assert len(features.NAMES) == 26


def test_metrics(spark):
    roster = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 5)], "entity_id_s1 string")
    pairs = spark.createDataFrame([("S1-1", x) for x in ("S2-00047", "S2-00193", "S3-00812")] + [("S1-3", "S2-1"), ("S1-4", "S2-2")], "entity_id_s1 string, entity_id_s2s3 string")
    truth = spark.createDataFrame([("S1-1", "S2-00047"), ("S1-1", "S3-00812"), ("S1-4", "S2-3")], "entity_id_s1 string, entity_id_s2s3 string")
    got = {r.entity_id_s1: r.f05 for r in metrics.entity_f05(metrics.entity_counts(roster, pairs, truth)).collect()}
    assert got == pytest.approx({"S1-1": 0.714286, "S1-2": 1.0, "S1-3": 0.0, "S1-4": 0.0}, abs=1e-6)
    s = metrics.evaluate(roster, pairs, truth).first()
    assert (s.macro_f05, s.tp, s.fp, s.fn, s.singleton_accuracy) == pytest.approx((0.428571, 2, 3, 1, 0.5), abs=1e-6)
    out = metrics.output_summary(roster, pairs).first()
    assert (out.n_entities, out.matched, out.singletons, out.links) == (4, 3, 1, 5)
    assert tuple(metrics.outside_candidates(pairs, truth).first()) == (3, 3)


def test_sweep_equals_single_thresholds(spark):
    roster = spark.createDataFrame([(f"S1-{i}",) for i in range(6)], "entity_id_s1 string")
    scored = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", ((7 * i + 3 * j) % 10) / 10) for i in range(5) for j in range(6)], "entity_id_s1 string, entity_id_s2s3 string, score double")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(4)], "entity_id_s1 string, entity_id_s2s3 string")
    steps = (0.1, 0.5, 0.9)
    sweep = {r.threshold: r for r in metrics.threshold_sweep(roster, scored, truth, steps).collect()}
    for t in steps:
        one = metrics.evaluate(roster, metrics.predict(scored, t), truth).first()
        assert [sweep[t][c] for c in one.__fields__] == pytest.approx(list(one))
    best = max(sweep.values(), key=lambda r: (r.macro_f05, -r.threshold))
    assert metrics.best_threshold(metrics.threshold_sweep(roster, scored, truth, steps)).first().threshold == best.threshold


def test_sampling(spark):
    s1 = entities(spark, [(f"S1-{i}", "n", "") for i in range(103)])
    parts = sampling.split_exact(s1, 0.2).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"validation": 20, "train": 83}
    assert sampling.sample_per_country(s1, 10).count() == 10 and sampling.sample_overall(s1, 7).count() == 7
    right = entities(spark, [("S2-1", "n", ""), ("S2-2", "m", "")])
    found = blocking.candidates(s1.filter("entity_id in ('S1-1', 'S1-2')"), right)
    truth = spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S2-1"), ("S1-1", "S2-404")], "entity_id_s1 string, entity_id_s2s3 string")
    assert {r.n_blocks for r in sampling.inject_truth(found, truth, s1, right, methods=1).filter("block = 'G'").collect()} <= {1}
    per = spark.createDataFrame([(f"S1-{i}", "US" if i % 3 else None) for i in range(3000)], "entity_id string, country string")
    some = sampling.sample_per_country(per, 700).collect()
    slow = lambda c: {e for _, e in sorted((hashlib.md5(f"{r.entity_id}|42".encode()).hexdigest(), r.entity_id) for r in per.collect() if r.country == c)[:700]}
    assert all({r.entity_id for r in some if r.country == c} == slow(c) for c in ("US", None))
    got = {(r.entity_id_s2s3, r.block, r.n_blocks) for r in sampling.inject_truth(found, truth, s1, right).filter(F.col("entity_id_s1") == "S1-1").collect()}
    assert ("S2-2", "G", 0) in got and not any(x[0] == "S2-404" for x in got)
    assert metrics.class_counts(metrics.with_labels(found, truth)).first().positives == found.filter("entity_id_s1 = 'S1-1' and entity_id_s2s3 = 'S2-1'").count()
