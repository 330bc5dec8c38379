"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.functions.lineage import saved  # noqa: F401  for the operators
from lattiq.functions.shipping import ship

#: Rows and bytes of one Arrow batch: what a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once and bound the Arrow batches that Python workers get."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` saved, and how many rows it has."""
    seen = Observation()
    return saved(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def remainder(id_column: str, modulus: int):
    """crc32 of an id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, bytes_per_class: int = 16 << 20) -> DataFrame:
    """At most ``per_class`` labelled documents, of ``bytes_per_class`` bytes together, of each class of ``label`` as
    (doc_id, text, label).

    The rows taken are the first in the order of a hash of their id, so that the sample is the same on every run. A doc_id
    labelled twice counts with its larger label, one with several texts with the first of them in order; null ids and labels
    are left out, as are texts of more than a 64th of those bytes. Only ids of the sample are broadcast, 2 x ``per_class``
    rows at most; texts are taken whole. Sizes are summed first (a doc_id with several texts counts with its longest), so
    no other text than the sample's is shuffled.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    taken = marks.where("label = 1").orderBy(*order).limit(per_class).unionByName(marks.where("label = 0").orderBy(*order).limit(per_class))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = docs.select("doc_id", "text", size.alias("bytes")).where(F.col("bytes") <= bytes_per_class // 64)
    sizes = short.select("doc_id", "bytes").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "label").agg(F.max("bytes").alias("bytes"))
    upto = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of a bounded number of rows
    chosen = saved(sizes.withColumn("bytes", F.sum("bytes").over(upto)).where(F.col("bytes") <= bytes_per_class).select("doc_id", "label"))
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "label")
