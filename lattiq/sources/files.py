"""Text and binary files of vectors, graphs, layouts, labels and neighbour lists.

Rows of the text forms get their ids from their place in the file. Places are counted over the partitions of the file: each
counts its own rows, and the sums of those before it are added, so a file is read in parallel."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.functions.shipping import ship

#: Lines that are numbered together.
RUN = 1 << 20
EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("w", T.DoubleType())])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, fields): the non-empty lines, numbered from 0 in file order, split at white space."""
    text = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.split(F.trim("value"), r"\s+").alias("fields"))
    counts = text.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    # One row for each block of the file.
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("seq")
    return text.withColumn("row", F.row_number().over(inside) - 1).join(F.broadcast(counts), ["file", "block"]).select((F.col("before") + F.col("row")).cast("long").alias("at"), "fields")


def numbers(fields: Column, kind: str = "double") -> Column:
    return F.transform(fields, lambda f: f.cast(kind))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of a file ``n d`` and one row of d numbers a line."""
    return lines(spark, path).where("at > 0").select((F.col("at") - 1).alias("id"), numbers(F.col("fields")).alias("v"))


def read_graph(spark: SparkSession, path: str, dedupe: bool = False) -> DataFrame:
    """(u, v, w) of a file ``n m`` and ``u v w`` a line; a missing weight is 1."""
    from lattiq.operators.graph import canonical

    edges = lines(spark, path).where("at > 0").select(F.get("fields", F.lit(0)).cast("long").alias("u"), F.get("fields", F.lit(1)).cast("long").alias("v"), F.coalesce(F.get("fields", F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))
    return canonical(edges, dedupe=True) if dedupe else edges


def header(spark: SparkSession, path: str) -> tuple[int, int]:
    first = spark.read.text(path).first()
    a, b = first[0].split()[:2]
    return int(a), int(b)


def read_layout(spark: SparkSession, path: str, id_column: bool = True) -> DataFrame:
    """(id, x, y) of a file ``n 2`` and one position a line; a line of three has an id in front, which is left out if
    ``id_column`` allows for one. Ids are places in the file."""
    skip = F.when((F.size("fields") == 3) & F.lit(id_column), F.lit(1)).otherwise(F.lit(0))
    return lines(spark, path).where("at > 0").select((F.col("at") - 1).alias("id"), F.get("fields", skip).cast("double").alias("x"), F.get("fields", skip + 1).cast("double").alias("y"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of integers separated by white space, wherever lines break."""
    fields = lines(spark, path).withColumn("run", F.floor(F.col("at") / RUN)).withColumn("n", F.size("fields"))
    # Lines are counted in runs of RUN lines, and the runs, few as they are, after one another.
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = fields.groupBy("run").agg(F.sum("n").alias("all"))
    runs = runs.select("run", F.coalesce(F.sum("all").over(before().orderBy("run")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(before("run").orderBy("at")), F.lit(0))
    starts = fields.withColumn("inside", inside).join(F.broadcast(runs), "run").select((F.col("first") + F.col("inside")).alias("start"), "fields")
    return starts.select("start", F.posexplode("fields").alias("i", "label")).select((F.col("start") + F.col("i")).alias("id"), F.col("label").cast("int").alias("label"))


def classes(labels: DataFrame) -> DataFrame:
    return labels.agg((F.max("label") + 1).alias("classes"))


def read_knn(spark: SparkSession, path: str) -> DataFrame:
    """(id, nbr, rank) of one neighbour list a line."""
    return lines(spark, path).select(F.col("at").alias("id"), F.posexplode("fields").alias("rank", "nbr")).select("id", F.col("nbr").cast("long").alias("nbr"), (F.col("rank") + 1).alias("rank"))


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """One text file of the ``line`` column in the order of ``order`` (``at``, if none is given); the order is made in
    parallel, the file by one writer."""
    df.orderBy(*(order or ("at",))).select("line").coalesce(1).write.mode("overwrite").text(path)


def headed(spark: SparkSession, body: DataFrame, head: Column | str, source: DataFrame) -> DataFrame:
    top = source.agg(head).select(F.lit(-1).cast("long").alias("at"), F.col("line"))
    return top.unionByName(body)


def write_layout(layout: DataFrame, path: str) -> None:
    body = layout.select(F.col("id").cast("long").alias("at"), F.format_string("%.6f %.6f", "x", "y").alias("line"))
    write_lines(headed(layout.sparkSession, body, F.concat(F.count("*").cast("string"), F.lit(" 2")).alias("line"), layout), path)


def write_knn(knn: DataFrame, path: str) -> None:
    lists = knn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr"))).alias("near"))
    write_lines(lists.select(F.col("id").alias("at"), F.array_join(F.transform("near", lambda n: n["nbr"].cast("string")), " ").alias("line")), path)


def write_graph(edges: DataFrame, path: str) -> None:
    n = edges.select(F.greatest("u", "v").alias("m")).agg(F.max("m") + 1).first()[0] or 0
    body = edges.select(F.lit(0).alias("at"), "u", "v", F.format_string("%d %d %s", "u", "v", F.col("w").cast("string")).alias("line"))
    top = edges.agg(F.concat(F.lit(f"{n} "), F.count("*").cast("string")).alias("line")).withColumn("at", F.lit(-1))
    write_lines(top.unionByName(body, allowMissingColumns=True), path, "at", "u", "v", "line")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A file ``n d`` and one row of d numbers a line, in the order of ids."""
    body = vectors.select(F.col("id").cast("long").alias("at"), F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("line"))
    size = F.concat_ws(" ", F.count("*").cast("string"), F.coalesce(F.max(F.size("v")), F.lit(0)).cast("string"))
    write_lines(headed(vectors.sparkSession, body, size.alias("line"), vectors), path)


def write_labels(labels: DataFrame, path: str) -> None:
    """One integer a line, in the order of ids."""
    write_lines(labels.select(F.col("id").alias("at"), F.col("label").cast("string").alias("line")), path)


def write_groups(membership: DataFrame, path: str) -> None:
    """One community a line: the ids of its vertices, ascending; communities in their order."""
    held = membership.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), " ").alias("line"))
    write_lines(held.withColumnRenamed("community", "at"), path)


def binary(spark: SparkSession, path: str, parse, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows of binary files by ``parse(content)``, which gives columns; a file is read by one task, files in parallel."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                columns = parse(name, content)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, ddl)


def read_knn_binary(spark: SparkSession, path: str) -> DataFrame:
    """(id, nbr, rank): each row is its number of neighbours and their ids, all unsigned 32-bit."""

    def parse(_: str, content: bytes):
        values, at, row = memoryview(content).cast("I"), 0, 0
        ids, near, ranks = [], [], []
        while at < len(values):
            k = values[at]
            ids += [row] * k
            near += values[at + 1 : at + 1 + k].tolist()
            ranks += range(1, k + 1)
            at, row = at + 1 + k, row + 1
        return ids, near, ranks

    return binary(spark, path, parse, pa.schema([("id", pa.int64()), ("nbr", pa.int64()), ("rank", pa.int32())]), "id long, nbr long, rank int")


def write_knn_binary(knn: DataFrame, path: str) -> None:
    """The same form; rows stream to the file in order, a partition at a time."""
    lists = knn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr"))).alias("near")).orderBy("id")
    with open(path, "wb") as f:
        for row in lists.toLocalIterator():
            f.write(struct.pack(f"<{len(row['near']) + 1}I", len(row["near"]), *(n["nbr"] for n in row["near"])))


def read_codes(spark: SparkSession, path: str, shift: int = 0, bits: int = 32) -> DataFrame:
    """(tbl, id, code) of files ``<name>_<table>``: one code a row (that is 1), their length, their number, then the codes.
    Codes of 64 bits are the same bits as a signed number."""

    def parse(name: str, content: bytes):
        _, length, n = struct.unpack_from("<3i", content)
        if length - shift > bits or length < shift:
            raise ValueError(f"codes of {length} bits, shifted by {shift}, do not fit {bits}")
        codes = np.frombuffer(content, "<u4" if bits <= 32 else "<u8", n, 12).astype(np.uint64) >> np.uint64(shift)
        table = int(name.rsplit("_", 1)[1].split(".")[0])
        return [table] * n, range(n), codes.view(np.int64)

    return binary(spark, path, parse, pa.schema([("tbl", pa.int32()), ("id", pa.int64()), ("code", pa.int64())]), "tbl int, id long, code long")


def catalogue(folder: str) -> list[str]:
    """Graphs in a folder that have a layout beside them: ``x.txt`` with ``x_vec.txt``."""
    names = set(os.listdir(folder))
    return sorted(n[:-8] for n in names if n.endswith("_vec.txt") and f"{n[:-8]}.txt" in names)
