"""Partitions of a layout: quadtree cells, k-means, and what is computed per part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions.linalg import l2sq
from lattiq.functions.lineage import saved
from lattiq.operators.graph import components


def extent(layout: DataFrame) -> DataFrame:
    """One row: the mean and half the width of a square that holds all positions."""
    at = layout.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return at.select("cx", "cy", (F.greatest(F.col("x1") - F.col("cx"), F.col("cx") - F.col("x0")) + 1e-5).alias("wx"), (F.greatest(F.col("y1") - F.col("cy"), F.col("cy") - F.col("y0")) + 1e-5).alias("wy"))


def quad_cells(layout: DataFrame, capacity: int = 50, depth: int = 16) -> DataFrame:
    """(id, x, y, cell): a cell is the path of quadrants from the root; one with more than ``capacity`` positions is split, to
    ``depth`` at most. Quadrants: 0 south-west, 1 south-east, 2 north-west, 3 north-east; a border belongs to the higher one.

    All cells of a level are split at once; positions in cells that are small enough are left alone."""
    root = extent(layout)
    state = layout.join(F.broadcast(root), F.lit(True)).withColumn("cell", F.lit(""))
    state = saved(state.withColumn("open", F.lit(True)))
    for _ in range(depth):
        n = state.where("open").groupBy("cell").agg(F.count("*").alias("n"))
        split = state.join(n, "cell", "left").withColumn("open", F.coalesce(F.col("n") > capacity, F.lit(False)))
        east, north = (F.col("x") >= F.col("cx")).cast("int"), (F.col("y") >= F.col("cy")).cast("int")
        cell = F.when(F.col("open"), F.concat("cell", (east + 2 * north).cast("string"))).otherwise(F.col("cell"))
        half = lambda c, w, up: F.when(F.col("open"), F.col(c) + (2 * up - 1) * F.col(w) / 2).otherwise(F.col(c)).alias(c)
        state = saved(split.select("id", "x", "y", half("cx", "wx", east), half("cy", "wy", north), F.when(F.col("open"), F.col("wx") / 2).otherwise(F.col("wx")).alias("wx"), F.when(F.col("open"), F.col("wy") / 2).otherwise(F.col("wy")).alias("wy"), cell.alias("cell"), "open"))
        if state.where("open").limit(1).count() == 0:
            break
    return state.select("id", "x", "y", "cell")


def in_cell(layout: DataFrame, cx: float, cy: float, wx: float, wy: float) -> DataFrame:
    return layout.where((F.abs(F.col("x") - cx) <= wx) & (F.abs(F.col("y") - cy) <= wy))


def centres_of_mass(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def numbered_cells(cells: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, cluster): leaves numbered from 1 in the order of their paths; vertices without a cell get numbers of their own behind them.

    Numbers run over distinct cells, and over the ids without one."""
    names = cells.select("cell").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("cell")).cast("long"))
    out = cells.join(names, "cell").select("id", "cluster")
    if nodes is None:
        return out
    alone = nodes.join(out, "id", "left_anti").withColumn("n", F.row_number().over(Window.orderBy("id")))
    return out.unionByName(alone.join(names.agg(F.count("*").alias("c")), F.lit(True)).select("id", (F.col("c") + F.col("n")).cast("long").alias("cluster")))


def locality(cells: DataFrame, knn: DataFrame) -> DataFrame:
    """(cell, n, linked, share): of the ordered pairs in a cell, those in which one is among the other's neighbours.

    Counted from the neighbour lists, so that no cell's pairs are formed."""
    pair = knn.where("id <> nbr").select(F.least("id", "nbr").alias("u"), F.greatest("id", "nbr").alias("v")).distinct()
    c = cells.select("id", "cell")
    both = pair.join(c.select(F.col("id").alias("u"), "cell"), "u").join(c.select(F.col("id").alias("v"), "cell"), ["v", "cell"])
    linked = both.groupBy("cell").agg((F.count("*") * 2).alias("linked"))
    sizes = c.groupBy("cell").agg(F.count("*").alias("n")).join(linked, "cell", "left").na.fill(0, ["linked"])
    return sizes.withColumn("share", F.when(F.col("n") > 1, F.col("linked") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))


def parts_in_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): connected parts of what the graph has inside each cell."""
    c = cells.select("id", "cell")
    inside = edges.join(c.select(F.col("id").alias("u"), "cell"), "u").join(c.select(F.col("id").alias("v"), "cell"), ["v", "cell"]).select("u", "v", "w")
    return components(inside, c.select("id"))


def moved_clusters(layout: DataFrame, membership: DataFrame, offsets: DataFrame) -> DataFrame:
    """Each position shifted by its cluster's offset (cluster, dx, dy)."""
    m = membership.select("id", "cluster").join(offsets, "cluster")
    return layout.join(m, "id", "left").select("id", (F.col("x") + F.coalesce("dx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("dy", F.lit(0.0))).alias("y"))


def first_centres(vectors: DataFrame, k: int) -> DataFrame:
    return vectors.orderBy("id").limit(k).select((F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"), F.col("v").alias("centre"))


def assigned(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, v, cluster): the nearest centre of each row, ties to the lowest number. There are few centres by definition."""
    listed = centres.select(F.struct("cluster", "centre").alias("c")).agg(F.array_sort(F.collect_list("c")).alias("centres"))
    best = F.array_min(F.transform("centres", lambda c: F.struct(l2sq(F.col("v"), c["centre"]).alias("d2"), c["cluster"].alias("cluster"))))
    return vectors.join(F.broadcast(listed), F.lit(True)).select("id", "v", best["cluster"].alias("cluster"))


def kmeans(vectors: DataFrame, k: int, rounds: int = 100, threshold: float = 0.001, move_singletons: bool = False) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), (cluster, centre)) by Lloyd's rounds from the first ``k`` rows by id, until the share of rows that change is
    ``threshold`` or less. The centre of a cluster of one row stays, unless ``move_singletons``."""
    vectors = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    centres, before, n = saved(first_centres(vectors, k)), None, None
    dims = centres.agg(F.max(F.size("centre")).alias("d")).first()["d"] or 0
    for _ in range(rounds):
        now = saved(assigned(vectors, centres).select("id", "cluster"))
        means = vectors.join(now, "id").groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(dims)]).alias("mean"))
        fine = F.col("n") > (0 if move_singletons else 1)
        centres = saved(centres.join(means, "cluster", "left").select("cluster", F.when(fine, F.col("mean")).otherwise(F.col("centre")).alias("centre")))
        if before is not None:
            n = n or now.count()
            if now.join(before.withColumnRenamed("cluster", "old"), "id").where("cluster <> old").count() <= threshold * n:
                break
        before = now
    return now, centres
