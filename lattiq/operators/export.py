"""What plots and the layout service get: normalised positions, sampled edges, lengths and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions.rng import pair_key, uniform

#: Below so many edges, the share of them that is kept; the service's third tier keeps less than the next.
PLOT_TIERS = ((600_000, 1.0), (3_000_000, 1 / 10), (None, 1 / 100))
SERVICE_TIERS = ((300_000, 1.0), (500_000, 1 / 5), (1_000_000, 1 / 100), (2_000_000, 1 / 20), (5_000_000, 1 / 50), (10_000_000, 1 / 100), (20_000_000, 1 / 200), (50_000_000, 1 / 600), (None, 1 / 1000))
#: The stops of the colour map (red, green, blue) in equal steps, from its high end down to its low one.
JET = ((0.0, 0.0, 0.5), (0.0, 0.0, 1.0), (0.0, 0.5, 1.0), (0.0, 1.0, 1.0), (0.5, 1.0, 0.5), (1.0, 1.0, 0.0), (1.0, 0.5, 0.0), (1.0, 0.0, 0.0), (0.5, 0.0, 0.0))


def plot_normal(layout: DataFrame) -> DataFrame:
    """Both axes from 0, divided by the largest coordinate after that."""
    low = F.broadcast(layout.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")))
    scale = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    fit = lambda c: F.when(scale > 0, (F.col(c) - F.col(f"{c}0")) / scale).otherwise(0.0).alias(c)
    return layout.join(low, F.lit(True)).select("id", fit("x"), fit("y"))


def service_normal(layout: DataFrame) -> DataFrame:
    """All coordinates less their one common mean, divided by the largest of them (not of their absolute values)."""
    low = F.broadcast(layout.agg(((F.avg("x") + F.avg("y")) / 2).alias("mean"), F.max(F.greatest("x", "y")).alias("most")))
    top = F.col("most") - F.col("mean")
    fit = lambda c: F.when(top != 0, (F.col(c) - F.col("mean")) / top).otherwise(0.0).alias(c)
    return layout.join(low, F.lit(True)).select("id", fit("x"), fit("y"))


def share_of(count: int, tiers) -> float:
    return next(share for most, share in tiers if most is None or count < most)


def sampled_edges(edges: DataFrame, tiers=PLOT_TIERS, seed: int = 23, loops: bool = False) -> DataFrame:
    """Edges (without loops) kept with a probability that depends on their number, by a seeded number of the ends."""
    fine = edges if loops else edges.where("u <> v")
    share = share_of(edges.count(), tiers)
    return fine if share >= 1 else fine.where(uniform(pair_key("u", "v"), seed) < share)


def lengths(edges: DataFrame, layout: DataFrame, least_gap: float = 0.0) -> DataFrame:
    """(u, v, x1, y1, x2, y2, length, scaled): lengths and where they lie between the shortest and the longest.

    ``least_gap``: the two count as this far apart, if they are closer."""
    a, b = layout.select(F.col("id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1")), layout.select(F.col("id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = edges.select("u", "v").join(a, "u").join(b, "v")
    both = both.withColumn("length", F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2"))))
    ends = F.broadcast(both.agg(F.min("length").alias("low"), F.max("length").alias("top")))
    gap = F.greatest(F.col("top") - F.col("low"), F.lit(least_gap))
    return both.join(ends, F.lit(True)).withColumn("scaled", F.when(gap > 0, (F.col("length") - F.col("low")) / gap).otherwise(0.0)).drop("low", "top")


def jet(value: Column) -> dict[str, Column]:
    """Red, green and blue of a number in [0, 1], linear between the stops; 0 is the low end."""
    steps = len(JET) - 1
    at = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor(value * steps).cast("int")))
    part = value * steps - at
    out = {}
    for i, name in enumerate(("red", "green", "blue")):
        stops = F.array(*[F.lit(stop[i]) for stop in reversed(JET)])
        low, high = F.get(stops, at), F.get(stops, at + 1)
        out[name] = low + (high - low) * part
    return out


def coloured(edges: DataFrame, layout: DataFrame, least_gap: float = 0.1) -> DataFrame:
    made = lengths(edges, layout, least_gap)
    return made.select("*", *(c.alias(n) for n, c in jet(F.col("scaled")).items()))


def links(edges: DataFrame, layout: DataFrame, tiers=SERVICE_TIERS) -> DataFrame:
    """(source_x, source_y, target_x, target_y, u, v) as the service sends them."""
    made = lengths(sampled_edges(edges, tiers, loops=True), service_normal(layout))
    return made.select("u", "v", F.col("x1").alias("source_x"), F.col("y1").alias("source_y"), F.col("x2").alias("target_x"), F.col("y2").alias("target_y"))


def response_lines(edges: DataFrame, layout: DataFrame, tiers=SERVICE_TIERS) -> DataFrame:
    """(line): the service's answer, a line for its head and one for each link, so that no row holds all links."""
    head = layout.agg(F.count("*").alias("node_num")).join(edges.agg(F.count("*").alias("edge_num")), F.lit(True))
    body = links(edges, layout, tiers).select(F.to_json(F.struct("source_x", "source_y", "target_x", "target_y")).alias("line"))
    return head.select(F.to_json(F.struct("node_num", "edge_num")).alias("line")).unionByName(body)
