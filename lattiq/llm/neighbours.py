"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on the driver from a bounded sample: a node splits at the plane midway between two of its vectors, or at
the median of a random direction. Every row is put into its leaf of every tree. A query walks down all trees at once: one
priority queue over all of them gives the open branch closest to the query next, until the leaves found hold enough rows.
The candidates are then ranked by their exact cosine. Equal vectors are one point, so that a vector that a third of all rows
share makes no large leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.bpe import _arrow
from lattiq.llm.common import partitions, ready, record, saved


@dataclass(frozen=True)
class Settings:
    """``sample`` rows at most are brought to the driver to grow ``trees`` trees; a leaf should hold about ``leaf`` rows.

    A query looks at leaves until they hold a number of rows (counted once for each tree) that is found by trial: the exact
    neighbours of ``trials`` queries are looked up, and ``recall`` of them have to lie in the leaves looked at. So vectors
    with structure are searched in few leaves, and those without any in as many as it takes."""

    trees: int = 24
    leaf: int = 256
    sample: int = 20_000
    trials: int = 128
    recall: float = 0.975
    seed: int = 11


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: ``normal . x > offset`` goes to ``high``, else to ``low``; a leaf's children are -1."""

    roots: np.ndarray
    normal: np.ndarray
    offset: np.ndarray
    low: np.ndarray
    high: np.ndarray


def grow(points: np.ndarray, s: Settings, total: int) -> Forest:
    """A forest for ``total`` unit vectors of which ``points`` are a sample."""
    random = np.random.default_rng(s.seed)
    least = max(2.0, s.leaf * len(points) / max(total, 1))
    normal, offset, low, high, roots = [], [], [], [], []

    def node(members: np.ndarray) -> int:
        me = len(normal)
        normal.append(np.zeros(points.shape[1], np.float32))
        offset.append(0.0)
        low.append(-1)
        high.append(-1)
        if len(members) <= least:
            return me
        for attempt in range(4):
            a, b = points[random.choice(members, 2, replace=False)] if attempt < 3 else (random.normal(size=points.shape[1]), 0.0)
            direction = (a - b).astype(np.float32)
            side = points[members] @ direction
            cut = float(np.median(side)) if attempt == 3 else float((a @ direction + b @ direction) / 2)
            up = side > cut
            if min(up.sum(), len(up) - up.sum()) >= 0.1 * len(up):
                break
        if not 0 < up.sum() < len(up):
            return me
        normal[me], offset[me] = direction / max(float(np.linalg.norm(direction)), 1e-12), cut / max(float(np.linalg.norm(direction)), 1e-12)
        low[me], high[me] = node(members[~up]), node(members[up])
        return me

    for _ in range(s.trees):
        roots.append(node(np.arange(len(points))))
    return Forest(np.array(roots), np.array(normal, np.float32).reshape(len(normal), -1), np.array(offset, np.float32), np.array(low), np.array(high))


def leaves(forest: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree."""
    out = np.empty((len(x), len(forest.roots)), np.int64)
    for t, root in enumerate(forest.roots):
        at = np.full(len(x), root)
        live = np.flatnonzero(forest.low[at] >= 0)
        while len(live):
            here = at[live]
            up = np.einsum("ij,ij->i", x[live], forest.normal[here]) > forest.offset[here]
            at[live] = np.where(up, forest.high[here], forest.low[here])
            live = live[forest.low[at[live]] >= 0]
        out[:, t] = at
    return out


def nearest_leaves(forest: Forest, size: dict[int, int], x: np.ndarray) -> Iterator[int]:
    """Leaves that hold rows, those of the closest branches of all trees first: how far a branch is from ``x`` is the sum of
    the squared distances to the planes between them."""
    margins = forest.normal @ x - forest.offset
    queue = [(0.0, int(root)) for root in forest.roots]
    while queue:
        away, at = heapq.heappop(queue)
        while forest.low[at] >= 0:
            margin = float(margins[at])
            near, far = (forest.high[at], forest.low[at]) if margin > 0 else (forest.low[at], forest.high[at])
            heapq.heappush(queue, (away + margin * margin, int(far)))
            at = int(near)
        if size.get(at):
            yield at


def probes(forest: Forest, size: dict[int, int], x: np.ndarray, enough: int) -> list[int]:
    """Leaves that one query looks into until they hold ``enough`` rows."""
    found, held = [], 0
    for leaf in nearest_leaves(forest, size, x):
        found.append(leaf)
        held += size[leaf]
        if held >= enough:
            break
    return found


def depth(forest: Forest, size: dict[int, int], x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many rows the leaves looked at hold until each row of ``wanted`` (its leaves) is among them."""
    out, held = np.zeros(len(wanted), np.int64), 0
    for leaf in nearest_leaves(forest, size, x):
        held += size[leaf]
        out[(out == 0) & (wanted == leaf).any(axis=1)] = held
        if out.all():
            break
    return out


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with one vector in double precision, the same whatever rows stand beside them."""
    return np.einsum("ij,j->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("j,j->", q, q)))


def best_of(query: np.ndarray, point: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best different points of each query, by descending score and then point."""
    order = np.lexsort((point, -score, query))
    query, point, score = query[order], point[order], score[order]
    same = np.zeros(len(query), bool)
    same[1:] = (query[1:] == query[:-1]) & (point[1:] == point[:-1])
    query, point, score = query[~same], point[~same], score[~same]
    first = np.ones(len(query), bool)
    first[1:] = query[1:] != query[:-1]
    at = np.arange(len(query))
    keep = at - np.maximum.accumulate(np.where(first, at, 0)) < k
    return query[keep], point[keep], score[keep]


def points_of(rows: DataFrame, id_column: str, vector_column: str, keep: int) -> DataFrame:
    """(point, ids, vector): the vectors that can take part, equal ones once, with their ``keep`` smallest ids, ascending.

    Left out are null and empty vectors, zero vectors, and those that hold nulls or non-finite numbers; of the rest, those
    of a length other than the most frequent one (of equally frequent ones, the longest)."""
    v = F.col("vector")
    plain = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    fine = plain.where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0))
    length = fine.groupBy(F.size(v).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    fine = fine.where(F.size(v) == (length[0]["n"] if length else 0)).withColumn("vector", F.transform(v, lambda c: c + F.lit(0.0).cast(fine.schema["vector"].dataType.elementType)))  # -0.0 as 0.0
    # The limit is applied before the shuffle too, so few rows of a frequent vector meet.
    ranked = fine.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("rank") <= keep)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("point"), "ids", "vector")


def calibrated(points: DataFrame, question: DataFrame, forest: Forest, sizes: dict[int, int], k: int, s: Settings) -> int:
    """How many rows a query's leaves have to hold, by the exact neighbours of a bounded number of queries.

    They are found by comparing these queries with all rows, a block at a time; only the ``k`` best of each query come to
    the driver."""
    trial = question.orderBy(F.xxhash64("point", F.lit(1)), "point").limit(s.trials).toArrow().combine_chunks()
    if not trial.num_rows:
        return 1
    names, x = trial.column("point").to_numpy(), matrix(pa.concat_arrays(trial.column("vector").chunks))
    schema = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64()), ("vector", pa.list_(pa.float64()))])
    norm = x / np.linalg.norm(x, axis=1, keepdims=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, list[float]]]] = [[] for _ in names]
        for batch in batches:
            if not len(batch):
                continue
            y, ids = matrix(batch.column("vector")), batch.column("point").to_numpy()
            score = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ norm.T
            score[ids[:, None] == names[None, :]] = -np.inf
            top = np.argpartition(-score, min(k, len(y) - 1), axis=0)[:k]
            for q in range(len(names)):
                best[q] = heapq.nlargest(k, best[q] + [(float(score[i, q]), int(ids[i]), y[i].tolist()) for i in top[:, q] if np.isfinite(score[i, q])], key=lambda b: (b[0], -b[1]))
        rows = [(int(names[q]), point, score, vector) for q, found in enumerate(best) for score, point, vector in found]
        if rows:
            yield record(schema, *zip(*rows))

    near = points.select("point", "vector").mapInArrow(compare, "query long, point long, score double, vector array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toArrow()
    if not near.num_rows:
        return 1
    of, home = near.column("query").to_numpy(), leaves(forest, unit(matrix(pa.concat_arrays(near.column("vector").chunks))))
    needed = np.concatenate([depth(forest, sizes, unit(x[i : i + 1])[0], home[of == name]) for i, name in enumerate(names)])
    return int(np.quantile(needed, s.recall, method="higher"))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, s: Settings = Settings(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows found of every row whose id is among ``queries`` (a column of that
    name), itself left out, by descending cosine and then id.

    Rows with the same vector are near copies like any other. An id that occurs twice counts as one row for each of its
    vectors. A query whose vector cannot take part, or without another row, has no result.
    """
    spark = ready(rows.sparkSession)
    points = saved(points_of(rows, id_column, vector_column, k + 1))
    total = points.count()
    sample = points.orderBy(F.xxhash64("point"), "point").limit(s.sample).select("vector").toArrow()
    forest = grow(unit(matrix(pa.concat_arrays(sample.column("vector").chunks))), s, total) if total else grow(np.zeros((1, 1)), s, 1)
    shared = spark.sparkContext.broadcast(forest)  # fewer nodes than twice the sample in each tree

    place_schema = pa.schema([("point", pa.int64()), ("leaf", pa.list_(pa.int64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield record(place_schema, batch.column("point").cast(pa.int64()), leaves(shared.value, unit(matrix(batch.column("vector")))).tolist())

    placed = points.select("point", "vector").mapInArrow(place, "point long, leaf array<long>")
    placed = saved(placed.select("point", F.explode("leaf").alias("leaf")))
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # fewer than the forest's nodes
    size = spark.sparkContext.broadcast(sizes)

    asked = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).join(queries.select(F.col(id_column).alias("id")).distinct(), "id")
    # Queries with equal vectors are asked once.
    asked = asked.withColumn("vector", F.transform("vector", lambda c: c + F.lit(0.0).cast(rows.schema[vector_column].dataType.elementType)))
    asked = saved(asked.join(points.select("vector", "point"), "vector").select("id", "point"))
    question = saved(asked.select("point").distinct().join(points.select("point", "vector"), "point"))

    enough = calibrated(points, question, forest, sizes, k, s)
    kind = points.schema["vector"].dataType
    probe_schema = pa.schema([("leaf", pa.int64()), ("query", pa.int64()), ("at", _arrow(kind))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows_ = unit(matrix(batch.column("vector"))), batch.column("vector")
            for i, name in enumerate(batch.column("point").to_pylist()):
                found = probes(shared.value, size.value, x[i], enough)
                yield record(probe_schema, found, [name] * len(found), rows_.take(pa.array([i] * len(found), pa.int32())).cast(probe_schema.field("at").type))

    probed = question.repartition(partitions(spark), "point").mapInArrow(probe, f"leaf long, query long, at {kind.simpleString()}")
    # A leaf's rows and the queries that look into it meet in the task of that leaf, rows first; rows of a leaf without a
    # query are dropped before they get their vectors.
    wanted = saved(probed)
    members = placed.join(wanted.select("leaf").distinct(), "leaf").join(points.select("point", "vector"), "point")
    both = members.select("leaf", F.lit(0).alias("kind"), F.col("point").alias("name"), "vector").unionByName(wanted.select("leaf", F.lit(1).alias("kind"), F.col("query").alias("name"), F.col("at").alias("vector")))
    both = both.repartition(partitions(spark), "leaf").sortWithinPartitions("leaf", "kind", "name")
    near_schema = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, parts, names, held, out, n = None, [], [], None, [], 0
        for batch in batches:
            x, of, kinds, ids = matrix(batch.column("vector")), batch.column("leaf").to_numpy(), batch.column("kind").to_numpy(), batch.column("name").to_numpy()
            edges = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0))
            for lo, hi in zip(edges, [*edges[1:], len(of)]):
                if of[lo] != leaf:
                    leaf, parts, names, held = of[lo], [], [], None
                if kinds[lo] == 0:
                    parts.append(x[lo:hi])
                    names.append(ids[lo:hi])
                    continue
                if held is None and parts:
                    held = np.concatenate(parts), np.concatenate(names)
                for i in range(lo, hi if held else lo):
                    score = cosine(held[0], x[i])
                    some = np.arange(len(score)) if len(score) <= 4 * k else np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
                    out.append(best_of(np.full(len(some), ids[i]), held[1][some], score[some], k + 1))
                    n += len(out[-1][0])
            if n > 100_000:
                yield record(near_schema, *best_of(*map(np.concatenate, zip(*out)), k + 1))
                out, n = [], 0
        if out:
            yield record(near_schema, *best_of(*map(np.concatenate, zip(*out)), k + 1))

    ranked = both.mapInArrow(rank, "query long, point long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    top = ranked.groupBy("query", "point").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    found = top.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("other"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k + 1)
    # At most k + 1 rows for each question; a query leaves itself out and takes k of the rest.
    answers = asked.distinct().join(found.withColumnRenamed("query", "point"), "point").where("id <> other")
    last = Window.partitionBy("id", "point").orderBy(F.desc("score"), "other")
    return answers.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_column), "score")
