"""What the text operators share: table access, materialised intermediates and word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of these bytes once A-Z is lowered: digits, a-z and everything beyond ASCII.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
#: Only A-Z is lowered; white space stays and splits.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-case alphanumeric words as UTF-8, whole text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinlink-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Frees the shuffles of an execution when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs no upstream work.

    The shuffles of the write are freed with it; the files go by ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinlink-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out._written = where
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in written:
        df._written.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._written, True)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast when the counted ``rows`` are at most ``most``; beyond it Spark plans a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def int_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("bigint"))
