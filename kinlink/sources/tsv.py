"""Tab-separated inputs and outputs, and tables that stand in for them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import NULL_CELLS, filled

SOURCE = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def _cells(df: DataFrame) -> DataFrame:
    """Cells that mean a missing value become null."""
    return df.select([F.when(~F.col(c).isin(NULL_CELLS), F.col(c)).alias(c) for c in df.columns])


def scan(spark: SparkSession, path: str, schema: str = SOURCE) -> DataFrame:
    """A tab-separated file with a header; every column is a string, missing text is empty."""
    df = _cells(spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"'))
    return df.select([F.col(c) if c.endswith("entity_id") else filled(F.col(c)).alias(c) for c in df.columns])


def scan_country(spark: SparkSession, path: str, country: str) -> DataFrame:
    return scan(spark, path).filter(F.col("country") == country)


def scan_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids in a file's first column, whatever the header calls it; only that column is read."""
    ids = spark.read.schema("entity_id string").csv(path, sep="\t", header=True, quote="")
    return ids.select(F.trim("entity_id").alias("entity_id")).filter("entity_id <> ''").distinct()


def scan_targets(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The ids of several files together; None if one of them is missing."""
    try:
        found = [scan_ids(spark, p) for p in paths]
    except AnalysisException:
        return None
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def explode_list(df: DataFrame, key: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(entity_id_s1, entity_id_s2s3) for each id in a comma list; an empty list gives no row, so keep the roster beside it."""
    split = F.filter(F.split(filled(F.col(ids)), ","), lambda x: x != "")
    return df.select(F.col(key).alias("entity_id_s1"), F.explode(split).alias("entity_id_s2s3"))


def scan_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(roster, pairs) of a file of comma lists."""
    df = scan(spark, path, TRUTH)
    return df.select(F.col("source1_entity_id").alias("entity_id_s1")).distinct(), explode_list(df).distinct()


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a file, or of several in the order of their paths, numbered from 1.

    A line's number is its place in its split plus the lines of the splits before; only a row for each split meets in one task.
    """
    at = ["file", "split"]
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    splits = rows.groupBy(*at).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = splits.select(*at, "first", (F.sum("n").over(Window.orderBy(*at)) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), at).select((F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), "value")


def id_lists(roster: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """A row for each roster id: its partners ascending, comma-joined; empty without any."""
    lists = pairs.groupBy("entity_id_s1").agg(F.concat_ws(",", F.array_sort(F.collect_set("entity_id_s2s3"))).alias(name))
    return roster.join(lists, "entity_id_s1", "left").withColumn(name, filled(F.col(name))).withColumnRenamed("entity_id_s1", "source1_entity_id")


def write_lists(roster: DataFrame, pairs: DataFrame, path: str, name: str = "matched_entity_ids", order: str | None = None) -> None:
    """The lists as one tab-separated file with a header, in the order of the roster's column ``order`` (the id without one)."""
    keep = roster.select("entity_id_s1", *([order] if order else []))
    out = id_lists(keep, pairs, name).orderBy(order or "source1_entity_id").select("source1_entity_id", name)
    out.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="", escape="")
