"""Greedy modularity communities."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions.shipping import ship
from lattiq.operators.graph import canonical, components


def greedy(edges: DataFrame, cut_at_max_q: bool = False) -> tuple[DataFrame, DataFrame]:
    """((step, i, j, dq, q) merges, (id, community)): communities are merged by the largest gain in modularity, ties to the
    smaller pair, until no two linked ones are left (or up to the largest modularity, with ``cut_at_max_q``).

    Merging is sequential inside a connected component and components do not touch one another, so each is a task of its own;
    the global order of merges, and so the running modularity, follows from their gains."""
    ship(edges.sparkSession)
    simple = canonical(edges, dedupe=True)
    m = simple.count()
    part = components(simple)
    schema = pa.schema([("component", pa.int64()), ("at", pa.int32()), ("i", pa.int64()), ("j", pa.int64()), ("dq", pa.float64())])

    def merge(rows: pa.Table) -> pa.Table:
        out = merges(list(zip(rows.column("u").to_pylist(), rows.column("v").to_pylist())), m)
        name = rows.column("component")[0].as_py()
        return pa.Table.from_pylist([{"component": name, "at": k, "i": i, "j": j, "dq": d} for k, (i, j, d) in enumerate(out)], schema=schema)

    of = simple.join(part.select(F.col("id").alias("u"), "component"), "u")
    made = of.groupBy("component").applyInArrow(merge, "component long, at int, i long, j long, dq double")
    # Within a component a merge can gain more than one before it; it waits for that one, so its place is by the least gain up to it.
    due = F.min("dq").over(Window.partitionBy("component").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ordered = made.withColumn("due", due)
    place = Window.orderBy(F.desc("due"), "component", "at")  # the merges of one result, fewer than vertices
    degree = canonical(edges, dedupe=True).select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    q0 = degree.agg(-F.sum(F.col("d") * F.col("d")) / (4.0 * m * m)).first()[0] or 0.0
    steps = ordered.select(F.row_number().over(place).alias("step"), "i", "j", "dq", (F.lit(q0) + F.sum("dq").over(place.rowsBetween(Window.unboundedPreceding, 0))).alias("q"))
    if cut_at_max_q:
        best = steps.agg(F.max_by("step", F.struct("q", -F.col("step"))).alias("s"), F.max("q").alias("q")).first()
        steps = steps.where(F.col("step") <= (best["s"] if best["q"] is not None and best["q"] > q0 else 0))
    joined = components(steps.select(F.col("i").alias("u"), F.col("j").alias("v"), F.lit(1.0).alias("w")), part.select("id"))
    return steps, joined.select("id", F.col("component").alias("community"))


def merges(edges: list[tuple[int, int]], m: int) -> list[tuple[int, int, float]]:
    """Merges (kept, folded, gain) in one component."""
    near: dict[int, dict[int, float]] = {}
    for u, v in edges:
        near.setdefault(u, {})[v] = 0.0
        near.setdefault(v, {})[u] = 0.0
    a = {u: len(links) / (2 * m) for u, links in near.items()}
    heap = []
    for u, links in near.items():
        for v in links:
            links[v] = 2 * (1 / (2 * m) - a[u] * a[v])
            if u < v:
                heap.append((-links[v], u, v))
    heapq.heapify(heap)
    out = []
    while heap:
        gain, u, v = heapq.heappop(heap)
        if u not in near or v not in near[u] or near[u][v] != -gain or math.isnan(gain):
            continue
        keep, fold = (u, v) if len(near[u]) >= len(near[v]) else (v, u)
        out.append((keep, fold, -gain))
        mine, other = near[keep], near.pop(fold)
        del mine[fold], other[keep]
        for x in {*mine, *other}:
            if x in mine and x in other:
                value = mine[x] + other[x]
            elif x in other:
                value = other[x] - 2 * a[keep] * a[x]
            else:
                value = mine[x] - 2 * a[fold] * a[x]
            near[x].pop(fold, None)
            mine[x] = near[x][keep] = value
            heapq.heappush(heap, (-value, min(x, keep), max(x, keep)))
        a[keep] += a.pop(fold)
    return out


def sizes(membership: DataFrame) -> DataFrame:
    """(size, n, share): how many communities have each size."""
    own = membership.groupBy("community").agg(F.count("*").alias("size"))
    total = own.agg(F.count("*").alias("total"))
    return own.groupBy("size").agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True)).select("size", "n", (F.col("n") / F.col("total")).alias("share"))


def statistics(membership: DataFrame) -> DataFrame:
    own = membership.groupBy("community").agg(F.count("*").alias("size"))
    return own.agg(F.count("*").alias("communities"), F.min("size").alias("smallest"), F.avg("size").alias("mean"), F.max("size").alias("largest"))


def coarse_network(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(u, v, w): communities joined by as many edges as run between them."""
    c = membership.select("id", "community")
    both = canonical(edges, dedupe=True).join(c.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    return both.where("cu <> cv").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.count("*").cast("double").alias("w"))
