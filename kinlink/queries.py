"""The registered queries of the engine, over the corpora that fixtures makes; each has a text of SQL in oracle if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import similarity as sim
from .functions import text as tx
from .operators import blocking, features, metrics, sampling, validate
from .plans import model as gbt
from .plans.params import DEFAULT
from .sources import tsv

#: Settings at which caps bite even in the small tables.
TOP = replace(DEFAULT, candidate_cap=5, variant_cap=5)
#: Settings of a model that trains in seconds.
SMALL_MODEL = replace(DEFAULT, trees=10, depth=4, min_leaf=5)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.prepare(fixtures.document_entities(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.sides(_documents(spark, sf_dir))


def _variant(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Kept, as candidates and features read the records many times and preparing them reads whole texts."""
    return fixtures.sides(tx.prepare_variant(fixtures.document_entities(spark, sf_dir)).drop("business_name", "business_address", "truth_key").persist())


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.truth_pairs(fixtures.document_entities(spark, sf_dir))


def _roster(s1: DataFrame) -> DataFrame:
    return s1.select(F.col("entity_id").alias("entity_id_s1"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Scans and normalisation


@query
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("entity_id", "nn")


@query
def norm_name_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("entity_id", "nnf")


@query
def norm_addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("entity_id", "na")


@query
def sorted_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("entity_id", "sn")


@query
def compact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("entity_id", "cn", "cl", "source")


@query
def gt_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth lists, written as lists and taken apart again."""
    entities = fixtures.document_entities(spark, sf_dir)
    lists = tsv.id_lists(_roster(fixtures.sides(entities)[0]), fixtures.truth_pairs(entities))
    return tsv.explode_list(lists)


@query
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.document_entities(spark, sf_dir)
    return tsv.union_sources(e.filter("src = 2"), e.filter("src = 3")).groupBy("src", "country").agg(F.count("*").alias("n"))


@query
def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.document_entities(spark, sf_dir).select("country").distinct()


# Candidates


@query
def block_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_exact(*_sides(spark, sf_dir), DEFAULT.candidate_cap)


@query
def block_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sorted(*_sides(spark, sf_dir), DEFAULT.candidate_cap)


@query
def block_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_compact(*_sides(spark, sf_dir), DEFAULT.candidate_cap)


@query
def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.token_freq(_sides(spark, sf_dir)[1])


@query
def block_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_tokens(*_sides(spark, sf_dir), DEFAULT.tokens, "T")


@query
def block_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_tokens(*_sides(spark, sf_dir), DEFAULT.rare_tokens, "L")


@query
def block_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidates(*_sides(spark, sf_dir))


@query
def cand_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidates(*_sides(spark, sf_dir), TOP)


# Features


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = _sides(spark, sf_dir)
    return blocking.candidates(a, b), a, b


@query
def feat_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_records(*_pairs(spark, sf_dir))
    return _rounded(df.select("entity_id_s1", "entity_id_s2s3", *(v.alias(k) for k, v in features.set_features().items())))


def _part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts by brand and type, whose names mostly differ."""
    e = tx.prepare(fixtures.part_entities(spark, sf_dir))
    a, b = fixtures.sides(e)
    pairs = blocking.key_block(a.withColumn("k", F.substring_index("na", " ", 3)), b.withColumn("k", F.substring_index("na", " ", 3)), F.col("k"), "E", DEFAULT.candidate_cap)
    return features.with_records(pairs, a, b)


@query
def feat_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _part_pairs(spark, sf_dir).select("a_nn", "b_nn").distinct()
    a, b = F.col("a_nn"), F.col("b_nn")
    return _rounded(df.select("a_nn", "b_nn", sim.lcs_len(a, b).alias("lcs"), sim.ratio(a, b).alias("ratio"), sim.token_sort_ratio(a, b).alias("token_sort")))


@query
def feat_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _part_pairs(spark, sf_dir).select("a_nn", "b_nn").distinct()
    return _rounded(df.select("a_nn", "b_nn", sim.token_set_ratio(F.col("a_nn"), F.col("b_nn")).alias("token_set")))


@query
def feat_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _part_pairs(spark, sf_dir).select("a_nn", "b_nn").distinct()
    return _rounded(df.select("a_nn", "b_nn", sim.partial_ratio(F.col("a_nn"), F.col("b_nn")).alias("partial")))


@query
def feat_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.pair_features(*_pairs(spark, sf_dir)))


# Figures


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs, a, b = _pairs(spark, sf_dir)
    df = features.with_records(pairs, a, b)
    feats = df.select("entity_id_s1", "entity_id_s2s3", *(v.alias(k) for k, v in features.set_features().items()))
    return _roster(a), gbt.linear_score(feats), _truth(spark, sf_dir)


@query
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_labels(_pairs(spark, sf_dir)[0], _truth(spark, sf_dir)).select("entity_id_s1", "entity_id_s2s3", "label")


@query
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_counts(labels(spark, sf_dir))


@query
def entity_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster, scored, truth = _scored(spark, sf_dir)
    return _rounded(metrics.entity_f05(metrics.entity_counts(roster, metrics.predict(scored, 0.6), truth)))


@query
def macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster, scored, truth = _scored(spark, sf_dir)
    return _rounded(metrics.evaluate(roster, metrics.predict(scored, 0.6), truth))


@query
def cand_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, a, _ = _pairs(spark, sf_dir)
    return _rounded(metrics.candidate_recall(_roster(a), pairs, _truth(spark, sf_dir)))


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.threshold_sweep(*_scored(spark, sf_dir), DEFAULT.thresholds))


@query
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_threshold(metrics.threshold_sweep(*_scored(spark, sf_dir), DEFAULT.thresholds)))


# Outputs and their checks


@query
def results_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster, scored, _ = _scored(spark, sf_dir)
    return tsv.id_lists(roster, metrics.predict(scored, 0.6))


@query
def cand_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return tsv.id_lists(_roster(a), blocking.candidates(a, b, TOP), "candidate_entity_ids")


@query
def output_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster, scored, _ = _scored(spark, sf_dir)
    return metrics.output_summary(roster, metrics.predict(scored, 0.6))


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with mistakes: repeated rows and ids, ids of the wrong source, rows left out."""
    lists = results_list(spark, sf_dir).withColumn("k", F.floor(F.substring("source1_entity_id", 4, 99).cast("bigint") / 3) % 10)
    bad = F.when(F.col("k") == 1, F.concat("matched_entity_ids", F.lit(","), "source1_entity_id")).when(F.col("k") == 2, F.concat("matched_entity_ids", F.lit(",S4-1"))).when(F.col("k") == 3, F.concat("matched_entity_ids", F.lit(",S2-1,S2-1")))
    rows = lists.withColumn("ids", F.coalesce(bad, F.col("matched_entity_ids"))).filter("k <> 4")
    rows = rows.union(rows.filter("k = 5"))
    line = F.row_number().over(blocking.Window.partitionBy("k").orderBy("source1_entity_id", "ids")) * 10 + F.col("k")
    return rows.select(line.alias("line"), F.col("source1_entity_id").alias("entity_id"), "ids", F.lit(True).alias("has_tab"))


@query
def validate_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _damaged(spark, sf_dir)
    twice = validate.duplicate_ids(validate.listed(rows)).select("entity_id", F.lit("id in list").alias("what"))
    return validate.duplicate_rows(rows).select("entity_id", F.lit("row").alias("what")).union(twice)


@query
def validate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = validate.listed(_damaged(spark, sf_dir))
    return items.groupBy(validate.prefix_kind(F.col("id")).alias("kind")).agg(F.count("*").alias("n"))


@query
def validate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = _sides(spark, sf_dir)[0].select("entity_id")
    missing, extra = validate.coverage(_damaged(spark, sf_dir), required)
    return missing.select("entity_id", F.lit("missing").alias("what")).union(extra.select("entity_id", F.lit("unexpected").alias("what")))


@query
def validate_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster, scored, _ = _scored(spark, sf_dir)
    a, b = _sides(spark, sf_dir)
    return metrics.outside_candidates(metrics.predict(scored, 0.6), blocking.candidates(a, b, TOP))


# Splits and samples


@query
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_exact(_sides(spark, sf_dir)[0])


@query
def sample_per_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_country(_sides(spark, sf_dir)[0], 20).select("country", "entity_id")


@query
def sample_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_overall(_sides(spark, sf_dir)[0], 50).select("entity_id")


@query
def inject_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, a, b = _pairs(spark, sf_dir)
    return sampling.inject_truth(pairs, _truth(spark, sf_dir), a, b)


# The variant


@query
def norm_name_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tx.prepare_variant(fixtures.document_entities(spark, sf_dir))
    return e.select("entity_id", "nn", "nnf", "sn", "cn")


@query
def addr_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.prepare_variant(fixtures.document_entities(spark, sf_dir)).select("entity_id", "na")


@query
def addr_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tx.prepare_variant(fixtures.part_entities(spark, sf_dir))
    return e.select("entity_id", F.concat_ws(",", F.array_sort("numbers")).alias("numbers"))


@query
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tx.prepare_variant(fixtures.part_entities(spark, sf_dir))
    return e.select("entity_id", F.concat_ws(",", F.array_sort(tx.char_ngrams(F.col("cn")))).alias("grams"))


@query
def block_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_prefix(*_variant(spark, sf_dir), DEFAULT.name_prefix_len, DEFAULT.variant_cap)


@query
def block_addr_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By shared numbers of any length, among parts of one name: the documents' addresses have hardly any number."""
    parts = fixtures.part_entities(spark, sf_dir).withColumn("country", F.col("business_name"))
    return blocking.block_addr_numbers(*fixtures.sides(tx.prepare_variant(parts)), least=1)


@query
def block_token_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_token_sets(*_variant(spark, sf_dir))


@query
def cand_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidates_variant(*_variant(spark, sf_dir), TOP)


@query
def feat_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _variant(spark, sf_dir)
    return _rounded(features.pair_features_variant(blocking.candidates_variant(a, b, TOP), a, b))


# The same at the caps of production


@query
def cand_list_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return tsv.id_lists(_roster(a), blocking.candidates(a, b, DEFAULT), "candidate_entity_ids")


@query
def cand_mod_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidates_variant(*_variant(spark, sf_dir), DEFAULT)


@query
def feat_mod_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _variant(spark, sf_dir)
    return _rounded(features.pair_features_variant(blocking.candidates_variant(a, b, DEFAULT), a, b))


# The model


def _model(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    pairs, a, b = _pairs(spark, sf_dir)
    truth = _truth(spark, sf_dir)
    feats = features.pair_features(sampling.inject_truth(pairs, truth, a, b), a, b).persist()
    return gbt.train(metrics.with_labels(feats, truth), SMALL_MODEL), feats


@query
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(gbt.score(*_model(spark, sf_dir)))


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(gbt.feature_importance(spark, _model(spark, sf_dir)[0]))
