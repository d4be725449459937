"""Entity corpora made from the driver's tables: documents (skewed names, accents, missing addresses) and parts (regular)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = "[ \\n\\t\\r]+"


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, business_name, business_address, country, src, truth_key) of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = F.split(F.trim(F.coalesce("text", F.lit("")), F.lit(" \n\t\r")), BLANKS, 26)  # the words 1-25 are used; behind them stands the rest
    src = (F.pmod("doc_id", F.lit(3)) + 1).cast("int")
    return docs.select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("entity_id"),
        F.concat_ws(" ", F.slice(w, 1, 5)).alias("business_name"),
        F.concat_ws(" ", F.slice(w, 6, 10)).alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
        src.alias("src"),
        F.concat_ws(" ", F.slice(w, 6, 20)).alias("truth_key"),
    )


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of ``part``: name, brand as country, and a key that name, brand and type make."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    src = F.when(F.pmod("p_partkey", F.lit(5)) == 0, 1).when(F.pmod("p_partkey", F.lit(5)) <= 2, 2).otherwise(3)
    return part.select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("entity_id"),
        F.col("p_name").alias("business_name"),
        F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("business_address"),
        F.col("p_brand").alias("country"),
        src.alias("src"),
        F.concat_ws("|", "p_name", "p_brand", "p_type").alias("truth_key"),
    )


def sides(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reference source, and the two others together."""
    return entities.filter("src = 1"), entities.filter("src > 1")


def truth_pairs(entities: DataFrame) -> DataFrame:
    """(entity_id_s1, entity_id_s2s3) that agree in country and a key that isn't empty."""
    a, b = sides(entities.filter("truth_key <> ''"))
    return a.select("country", "truth_key", F.col("entity_id").alias("entity_id_s1")).join(b.select("country", "truth_key", F.col("entity_id").alias("entity_id_s2s3")), ["country", "truth_key"]).select("entity_id_s1", "entity_id_s2s3")
