"""Labels, thresholds and quality figures of predicted pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["entity_id_s1", "entity_id_s2s3"]


def with_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``pairs`` with label 1 where the truth has the pair, else 0."""
    known = truth.select(*PAIR).distinct().withColumn("__true", F.lit(1))
    return pairs.join(known, PAIR, "left").withColumn("label", F.coalesce("__true", F.lit(0)).cast("int")).drop("__true")


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"), F.sum(1 - F.col("label")).cast("bigint").alias("negatives"))


def predict(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("score") >= threshold).select(*PAIR)


def entity_counts(roster: DataFrame, pairs: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each roster id (and each value of ``by`` in the roster) predicted, true and shared partners."""
    keys = [*by, "entity_id_s1"]
    p = pairs.select(*by, *PAIR).distinct().withColumn("p", F.lit(1))
    t = truth.select(*PAIR).distinct().withColumn("t", F.lit(1))
    hits = p.join(t, PAIR, "left").groupBy(*keys).agg(F.sum("p").alias("n_pred"), F.sum(F.coalesce("t", F.lit(0))).alias("n_hit"))
    true = t.groupBy("entity_id_s1").agg(F.sum("t").alias("n_true"))
    out = roster.select(*keys).distinct().join(hits, keys, "left").join(true, "entity_id_s1", "left")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_pred", "n_true", "n_hit")))


def entity_f05(counts: DataFrame) -> DataFrame:
    """F0.5 of each entity: 1 if nothing is predicted and nothing true, 0 if only one of them is or none is shared."""
    p, r = F.col("n_hit") / F.col("n_pred"), F.col("n_hit") / F.col("n_true")
    value = F.when((F.col("n_pred") == 0) & (F.col("n_true") == 0), 1.0).when(F.col("n_hit") == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    return counts.withColumn("f05", value)


def summary(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro F0.5 over all entities, micro precision and recall, totals, and how many singletons stay alone."""
    scored = entity_f05(counts)
    tp, pred, true = F.sum("n_hit"), F.sum("n_pred"), F.sum("n_true")
    alone = F.sum((F.col("n_true") == 0).cast("bigint"))
    kept = F.sum(((F.col("n_true") == 0) & (F.col("n_pred") == 0)).cast("bigint"))
    aggs = [
        F.avg("f05").alias("macro_f05"),
        F.when(pred > 0, tp / pred).otherwise(0.0).alias("precision"),
        F.when(true > 0, tp / true).otherwise(0.0).alias("recall"),
        tp.alias("tp"),
        (pred - tp).alias("fp"),
        (true - tp).alias("fn"),
        F.when(alone > 0, kept / alone).otherwise(1.0).alias("singleton_accuracy"),
        F.count("*").alias("n_entities"),
    ]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def evaluate(roster: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return summary(entity_counts(roster, pairs, truth))


def candidate_recall(roster: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true pairs among the candidates, and candidates for each entity."""
    c = entity_counts(roster, pairs, truth)
    true = F.sum("n_true")
    return c.agg(F.when(true > 0, F.sum("n_hit") / true).otherwise(0.0).alias("recall"), F.sum("n_hit").alias("found"), true.alias("n_true"), F.avg("n_pred").alias("avg_candidates"))


def threshold_sweep(roster: DataFrame, scored: DataFrame, truth: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """The summary at each threshold, in one pass.

    A pair counts at every threshold up to its score, so its level (how many that are) is enough: entities sum pairs by
    level, and the few thresholds multiply entities, never pairs.
    """
    spark = scored.sparkSession
    steps = sorted(thresholds)
    level = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("score")))
    best = scored.groupBy(*PAIR).agg(F.max("score").alias("score")).select(*PAIR, level.alias("level"))  # the score is computed once
    t = truth.select(*PAIR).distinct().withColumn("t", F.lit(1))
    by_level = best.join(t, PAIR, "left").groupBy("entity_id_s1", "level").agg(F.count("*").alias("n"), F.sum(F.coalesce("t", F.lit(0))).alias("hit"))
    grid = F.broadcast(spark.createDataFrame([(i + 1, x) for i, x in enumerate(steps)], "step int, threshold double"))
    reached = by_level.join(grid, F.col("level") >= F.col("step")).groupBy("entity_id_s1", "threshold").agg(F.sum("n").alias("n_pred"), F.sum("hit").alias("n_hit"))
    true = t.groupBy("entity_id_s1").agg(F.sum("t").alias("n_true"))
    every = roster.select("entity_id_s1").distinct().join(true, "entity_id_s1", "left").crossJoin(grid.select("threshold")).join(reached, ["entity_id_s1", "threshold"], "left")
    counts = every.select("threshold", "entity_id_s1", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_pred", "n_true", "n_hit")))
    return summary(counts, ("threshold",))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the largest macro F0.5; the lowest threshold among equals."""
    return sweep.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def output_summary(roster: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities, matched ones, singletons and links."""
    c = roster.select("entity_id_s1").distinct().join(pairs.select(*PAIR).distinct().groupBy("entity_id_s1").count(), "entity_id_s1", "left")
    n = F.coalesce("count", F.lit(0))
    return c.agg(F.count("*").alias("n_entities"), F.sum((n > 0).cast("bigint")).alias("matched"), F.sum((n == 0).cast("bigint")).alias("singletons"), F.sum(n).cast("bigint").alias("links"))


def outside_candidates(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many entities have a match that is no candidate, and such matches."""
    extra = pairs.select(*PAIR).distinct().join(candidates.select(*PAIR), PAIR, "left_anti")
    return extra.agg(F.count_distinct("entity_id_s1").alias("n_entities"), F.count("*").alias("n_pairs"))
