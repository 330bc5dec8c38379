"""Tables that the queries are run on, made from the given ones; each as a DataFrame and as SQL text for the oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.rng import uniform, uniform_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for one run's files, in the shared folder that the session names (a temporary one only where it is unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lattiq-files")
    return f"{root}/files/{name}-{uuid.uuid4().hex}"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


VECTORS = "vectors as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v, label from embeddings)"


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations (100 + key) and their suppliers (1000 + key)."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    top = nation.select(F.col("n_regionkey").cast("long").alias("u"), (F.col("n_nationkey") + 100).cast("long").alias("v"), F.lit(1.0).alias("w"))
    return top.unionByName(supplier.select((F.col("s_nationkey") + 100).cast("long").alias("u"), (F.col("s_suppkey") + 1000).cast("long").alias("v"), F.lit(1.0).alias("w")))


GEO = """edges as (
    select cast(n_regionkey as bigint) as u, cast(n_nationkey + 100 as bigint) as v, 1.0::double as w from nation
    union all select cast(s_nationkey + 100 as bigint), cast(s_suppkey + 1000 as bigint), 1.0::double from supplier)"""


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts ordered from them, weighted 1 to 3 by part."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return rows.select(F.col("l_suppkey").cast("long").alias("u"), (F.col("l_partkey") + 1000000).cast("long").alias("v"), (F.col("l_partkey") % 3 + 1).cast("double").alias("w"))


PART_SUPP = """edges as (
    select distinct cast(l_suppkey as bigint) as u, cast(l_partkey + 1000000 as bigint) as v, cast(l_partkey % 3 + 1 as double) as w
    from lineitem)"""

ARCS = "arcs as (select u as src, v as dst, w from edges union all select v, u, w from edges)"
NODES = "nodes as (select u as id from edges union select v from edges)"


def geo_layout(nodes: DataFrame, seed: int = 1) -> DataFrame:
    return nodes.select("id", uniform("id", seed).alias("x"), uniform("id", seed + 1).alias("y"))


def geo_layout_sql(seed: int = 1, name: str = "layout") -> str:
    return f"{name} as (select id, {uniform_sql('id', seed)} as x, {uniform_sql('id', seed + 1)} as y from nodes)"


def vector_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))


VECTOR_LAYOUT = "layout as (select id, v[1] as x, v[2] as y from vectors)"


def nation_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers belong to their nation, nations and regions to themselves."""
    own = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("id"), (F.col("s_nationkey") + 100).cast("long").alias("sun"), F.lit(1.0).alias("dist"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"))
    region = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("id")).distinct()
    alone = nation.unionByName(region).select("id", F.col("id").alias("sun"), F.lit(0.0).alias("dist"))
    return own.unionByName(alone).withColumn("cluster", F.col("sun"))


NATION_LEVEL = """level as (
    select cast(s_suppkey + 1000 as bigint) as id, cast(s_nationkey + 100 as bigint) as sun, 1.0::double as dist, cast(s_nationkey + 100 as bigint) as cluster from supplier
    union all select n_nationkey + 100, n_nationkey + 100, 0.0, n_nationkey + 100 from nation
    union all select distinct n_regionkey, n_regionkey, 0.0, n_regionkey from nation)"""
