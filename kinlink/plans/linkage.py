"""The two runs of the engine: training with validation, and linking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prepare, prepare_variant
from ..operators import blocking, features, metrics, sampling
from ..sources import tsv
from .model import feature_importance, score, train
from .params import DEFAULT, Params


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    threshold: float
    sweep: DataFrame
    metrics: DataFrame
    candidate_recall: DataFrame
    classes: dict[str, int]


def train_linkage(s1: DataFrame, s23: DataFrame, truth: DataFrame, params: Params = DEFAULT, *, variant: bool = False) -> Trained:
    """Train on a sample of each country and validate on another; the truth is injected into training pairs only.

    s1, s23: (entity_id, business_name, business_address, country). truth: (entity_id_s1, entity_id_s2s3).
    """
    prep = prepare_variant if variant else prepare
    block = blocking.candidates_variant if variant else blocking.candidates
    feat = features.pair_features_variant if variant else features.pair_features
    names = features.NAMES_VARIANT if variant else features.NAMES
    left, right = prep(s1), prep(s23).persist()
    parts = sampling.split_exact(left, params.validation_share, params.seed)
    halves = {}
    for part in ("train", "validation"):
        ids = parts.filter(F.col("part") == part)
        halves[part] = sampling.sample_per_country(sampling.restrict(left, ids), params.sample_per_country, params.seed).persist()
    labelled = training_features(block(halves["train"], right, params), truth, halves["train"], right, variant=variant).persist()
    model = train(labelled, params, names)
    classes = metrics.class_counts(labelled).first().asDict()
    labelled.unpersist()
    offered = block(halves["validation"], right, params).persist()
    scored = score(model, feat(offered, halves["validation"], right)).persist()
    roster = halves["validation"].select(F.col("entity_id").alias("entity_id_s1"))
    own = truth.join(roster, "entity_id_s1", "left_semi")
    sweep = metrics.threshold_sweep(roster, scored, own, params.thresholds)
    best = metrics.best_threshold(sweep).first()["threshold"]
    return Trained(model, best, sweep, metrics.evaluate(roster, metrics.predict(scored, best), own), metrics.candidate_recall(roster, offered, own), classes)


def training_features(pairs: DataFrame, truth: DataFrame, s1: DataFrame, s23: DataFrame, *, variant: bool = False) -> DataFrame:
    """Features and labels of candidate pairs of prepared records, with the true pairs among these records that blocking missed."""
    if not variant:
        return metrics.with_labels(features.pair_features(sampling.inject_truth(pairs, truth, s1, s23), s1, s23), truth)
    named = pairs.withColumnsRenamed({"methods": "block", "n_methods": "n_blocks"})
    named = sampling.inject_truth(named, truth, s1, s23, methods=1).withColumnsRenamed({"block": "methods", "n_blocks": "n_methods"})
    return metrics.with_labels(features.pair_features_variant(named, s1, s23), truth)


def link(model: PipelineModel, threshold: float, s1: DataFrame, s23: DataFrame, params: Params = DEFAULT, *, variant: bool = False, pairs_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) of all records of s1. With ``pairs_path`` candidates are written there and read back, so blocking runs once."""
    prep = prepare_variant if variant else prepare
    left, right = prep(s1), prep(s23)
    pairs = (blocking.candidates_variant if variant else blocking.candidates)(left, right, params)
    if pairs_path:
        pairs.write.mode("overwrite").parquet(pairs_path)
        pairs = left.sparkSession.read.schema(pairs.schema).parquet(pairs_path)
    feats = (features.pair_features_variant if variant else features.pair_features)(pairs, left, right)
    return metrics.predict(score(model, feats), threshold), pairs


def run(spark: SparkSession, train_dir: str, test_dir: str, out_dir: str, params: Params = DEFAULT, *, variant: bool = False) -> Trained:
    """Train from the tab-separated files in train_dir, link those in test_dir, and write both result files."""
    read = lambda d, kind, k: tsv.scan(spark, f"{d}/{kind}_source{k}.tsv")
    both = lambda d, kind: tsv.union_sources(read(d, kind, 2), read(d, kind, 3))
    _, truth = tsv.scan_truth(spark, f"{train_dir}/train_ground_truth.tsv")
    trained = train_linkage(read(train_dir, "train", 1), both(train_dir, "train"), truth, params, variant=variant)
    test = read(test_dir, "test", 1).withColumn("place", F.monotonically_increasing_id())
    matches, pairs = link(trained.model, trained.threshold, test.drop("place"), both(test_dir, "test"), params, variant=variant, pairs_path=f"{out_dir}/pairs")
    roster = test.select(F.col("entity_id").alias("entity_id_s1"), "place")
    tsv.write_lists(roster, matches, f"{out_dir}/matching_results", order="place")
    tsv.write_lists(roster, pairs, f"{out_dir}/candidate_pairs", "candidate_entity_ids", order="place")
    counts = {"records": roster.count(), "candidates": pairs.count(), "matches": matches.count()}
    report(spark, trained, counts, variant=variant).coalesce(1).write.mode("overwrite").csv(f"{out_dir}/report", sep="\t", header=True)
    return trained


def report(spark: SparkSession, trained: Trained, counts: dict[str, int], *, variant: bool = False) -> DataFrame:
    """(item, value): what a run did. Its counts, classes of the training pairs, threshold, metrics, candidate recall, first 15 features."""
    rows = [*counts.items(), *((f"training {k}", v) for k, v in trained.classes.items()), ("threshold", trained.threshold)]
    for name, df in (("validation", trained.metrics), ("candidates", trained.candidate_recall)):
        rows += [(f"{name} {k}", v) for k, v in df.first().asDict().items()]
    names = features.NAMES_VARIANT if variant else features.NAMES
    rows += [(f"importance {r.feature}", r.importance) for r in feature_importance(spark, trained.model, names=names).collect()]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "item string, value string")
