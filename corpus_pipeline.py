"""A pipeline from raw documents to packed training sequences; part of the subpackage ``kinlink.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import decontamination, jaccard_join, packing, pii, quality
from kinlink.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    A null, empty or blank text goes; nulls elsewhere, repeated rows and very long texts don't matter: each row is judged by its whole
    text. A null language is judged by the model of all. No documents, none; extra columns are dropped.
    """
    return quality.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels")).filter("keep").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id: five-word shingles, similarity 0.8 or more.

    Groups are of rows: rows that repeat an id or have none are documents of their own, equal ones of these are one, and a group keeps
    an id before none and, among rows of one id, the one with the smallest hash. Null, empty and blank texts have no shingle and are
    linked with nothing but equal rows. Ids are integers. No documents, none; extra columns are dropped.
    """
    docs, col = docs.select(COLUMNS), F.col
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        groups = jaccard_join.jaccard_components(docs, width=5, percent=80)
        gone = materialize(groups.filter("component_id <> doc_id").select(col("doc_id").alias("__gone")).distinct(), "gone")
        return docs.join(jaccard_join.small(gone, gone.count(), 2_000_000), col("doc_id").cast("bigint") == col("__gone"), "left_anti").select(COLUMNS)
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = materialize(jaccard_join.jaccard_components(keyed, width=5, percent=80, id_column="__key").select(col("doc_id").alias("__key"), "component_id").distinct(), "groups")
    named = keyed.select("__key", F.struct(col("doc_id").isNull(), col("doc_id").cast("bigint"), "__key").alias("rank")).distinct().join(groups, "__key")
    best = materialize(named.groupBy("component_id").agg(F.min("rank").alias("best")).select(col("best.__key").alias("__kept")), "kept")
    rows = keyed.join(jaccard_join.small(best, best.count(), 1_000_000), col("__key") == col("__kept"), "left_semi")
    repeated = materialize(rows.groupBy("__key").count().filter("count > 1").select(col("__key").alias("__kept")), "repeated")
    twice = jaccard_join.small(repeated, repeated.count(), 1_000_000)
    once = rows.join(twice, col("__key") == col("__kept"), "left_anti")
    return once.unionByName(rows.join(twice, col("__key") == col("__kept"), "left_semi").dropDuplicates(["__key"])).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A null or empty text has no words and stays; repeated rows stay or go together, long texts are scanned whole. No documents, none;
    extra columns are dropped.
    """
    return decontamination.find_contamination(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by the name of its kind, and n_chars of the new text where it is another.

    A null text stays null and an empty one empty; repeated rows are redacted alike. No documents, none; extra columns are dropped.
    """
    clean = pii.find_personal_data(docs.select(COLUMNS), redact=True)
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and places.

    A null or empty text is one piece of the end alone; repeated rows are packed each; a long text is cut into as many pieces as it
    needs. No documents, no pieces; the columns of the documents but the id are dropped.
    """
    packed = packing.pack_documents(docs, packing.tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: SQL expresses neither the classifier nor the field; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
