"""Edges, arcs, breadth-first search, components and modularity. An undirected graph is ``edges(u, v, w)``, one row an edge;
its arcs ``(src, dst, w)`` are both directions of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.lineage import saved


def arcs(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select(F.explode(both).alias("a"), "w").select("a.src", "a.dst", "w")


def canonical(edges: DataFrame, dedupe: bool = False) -> DataFrame:
    """Ends in order; with ``dedupe``, the first of parallel edges only (the smallest weight) and no loops."""
    out = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    return out.where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w")) if dedupe else out


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def symmetrise(directed: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions: the mean of an arc and its mirror, a missing one counting as 0."""
    pair = directed.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg((F.sum("w") / 2).alias("w"))
    return arcs(pair)


def degrees(edges: DataFrame) -> DataFrame:
    return arcs(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))


def bfs(edges: DataFrame, sources: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(src, id, dist) of all vertices within ``depth`` steps (or at all) of the ``sources`` (id; all vertices if none are given).

    Every level's frontier is joined with the arcs, without the pairs seen before; it ends with an empty frontier."""
    step = saved(arcs(edges).select(F.col("src").alias("id"), "dst").distinct())
    start = vertices(edges) if sources is None else sources.select("id").distinct()
    seen = saved(start.select(F.col("id").alias("src"), "id", F.lit(0).alias("dist")))
    frontier, level = seen, 0
    parts = [seen]
    while depth is None or level < depth:
        level += 1
        reached = frontier.select("src", "id").join(step, "id").select("src", F.col("dst").alias("id")).distinct()
        # A vertex at this level has been met, if at all, in one of the two levels before.
        for before in parts[-2:]:
            reached = reached.join(before.select("src", "id"), ["src", "id"], "left_anti")
        frontier = saved(reached.withColumn("dist", F.lit(level)))
        if frontier.limit(1).count() == 0:
            break
        parts.append(frontier)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def within(edges: DataFrame, hops: int) -> DataFrame:
    """The graph with an edge of weight d between vertices d steps apart, 1 < d <= ``hops``, besides its own."""
    if hops <= 1:
        return edges.select("u", "v", "w")
    far = bfs(edges, depth=hops).where("dist > 1 and src < id")
    return edges.select("u", "v", F.col("w").cast("double").alias("w")).unionByName(far.select(F.col("src").alias("u"), F.col("id").alias("v"), F.col("dist").cast("double").alias("w")))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that a vertex is connected with.

    Labels spread along edges and jump along themselves, so the rounds grow with the logarithm of the diameter."""
    step = saved(arcs(edges).where("src <> dst").select("src", "dst").distinct())
    nodes = vertices(edges) if nodes is None else nodes.select("id").distinct()
    labels = saved(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = step.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = spread.join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", "old", F.least("label", "next").alias("label"))
        labels = saved(jump)
        if labels.where("old <> label").limit(1).count() == 0:
            return labels.select("id", F.col("label").alias("component"))


def connectivity(edges: DataFrame) -> DataFrame:
    """One row: number of components, largest component and largest degree."""
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest")).join(degrees(edges).agg(F.max("degree").alias("max_degree")), F.lit(True))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, inside, ends, q): shares of edges inside a community and of edge ends in it, and its part of the modularity.

    ``membership``: (id, community). Parallel edges count once, loops not at all."""
    simple = canonical(edges, dedupe=True)
    m = simple.agg(F.count("*").alias("m"))
    c = membership.select("id", "community")
    both = simple.join(c.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    ends = both.select(F.explode(F.array("cu", "cv")).alias("community")).groupBy("community").agg(F.count("*").alias("ends"))
    inside = both.where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("inside"))
    out = ends.join(inside, "community", "left").join(F.broadcast(m), F.lit(True))
    share, end = F.coalesce("inside", F.lit(0)) / F.col("m"), F.col("ends") / (2 * F.col("m"))
    return out.select("community", share.alias("inside"), end.alias("ends"), (share - end * end).alias("q"))


def delta_q(edges: DataFrame) -> DataFrame:
    """(i, j, dq) of all linked pairs when every vertex is its own community: 2 (e_ij - a_i a_j)."""
    simple = canonical(edges, dedupe=True)
    m = F.broadcast(simple.agg(F.count("*").alias("m")))
    a = degrees(simple).select("id", "degree")
    both = arcs(simple).select(F.col("src").alias("i"), F.col("dst").alias("j")).join(m, F.lit(True))
    both = both.join(a.select(F.col("id").alias("i"), F.col("degree").alias("di")), "i").join(a.select(F.col("id").alias("j"), F.col("degree").alias("dj")), "j")
    return both.select("i", "j", (2 * (1 / (2 * F.col("m")) - F.col("di") * F.col("dj") / (4 * F.col("m") * F.col("m")))).alias("dq"))
