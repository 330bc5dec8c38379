"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

The score of features x is w0 + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): all pairwise interactions in time
linear in the number of features. Words enter as the square root of their share of the text, statistics standardised.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.bpe import _arrow
from lattiq.llm.common import labelled_sample, ready, record, remainder, texts

BUCKETS, RANK, STATS = 1 << 14, 8, 16
BYTES = np.arange(256)
UPPER = (BYTES >= 65) & (BYTES <= 90)
LETTER = UPPER | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES >= 128)
DIGIT = (BYTES >= 48) & (BYTES <= 57)
SPACE = (BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13))
END = np.isin(BYTES, [33, 44, 46, 63])  # ! , . ?
MARK = ~(LETTER | DIGIT | SPACE | END)


class Buckets(dict):
    """Bucket by word; cleared when it has grown large, which changes no result."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = bucket = zlib.crc32(re.sub(r"\d", "0", word.lower()).encode("utf-8", "replace")) % BUCKETS
        return bucket


def features(text: str, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values (squares sum to 1) and the statistics of one whole text."""
    words = text.split()
    counts = Counter(words)
    n = max(1, len(words))
    where = np.fromiter(map(buckets.__getitem__, counts), np.int32, len(counts))
    value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / n)
    data = text.encode("utf-8", "replace")
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = max(1, len(data))
    letters = max(1, int(histogram[LETTER].sum()))
    lines = [x for x in text.split("\n") if x]
    top = counts.most_common(1)[0][1] if counts else 0
    share = np.array(list(counts.values()) or [1]) / n
    stats = [
        histogram[UPPER].sum() / letters,
        histogram[DIGIT].sum() / total,
        histogram[MARK].sum() / total,
        histogram[END].sum() / total,
        histogram[33] / n,
        histogram[124] / n,
        len(words) / total,
        math.log1p(len(words)),
        math.log1p(len(data)),
        len(counts) / n,
        top / n,
        float((share * np.log(1 / share)).sum()) / math.log(n + 1),
        len(set(lines)) / max(1, len(lines)),
        math.log1p(len(lines)),
        len(data) / max(1, len(lines)) / 1000,
        float(not words),
    ]
    return where, value, stats


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray  # buckets, then statistics
    factors: np.ndarray  # (buckets + statistics) x rank
    mean: np.ndarray
    scale: np.ndarray

    def score(self, where: np.ndarray, value: np.ndarray, stats: np.ndarray) -> float:
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        rows, tail = self.factors[where], self.factors[BUCKETS:]
        total = value @ rows + x @ tail
        squares = (value**2) @ (rows**2) + (x**2) @ (tail**2)
        margin = self.bias + value @ self.linear[where] + x @ self.linear[BUCKETS:] + 0.5 * float((total**2 - squares).sum())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, margin))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float], int]], share: float, epochs: int = 25, batch: int = 256, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Adagrad on the logistic loss; ``share`` is the share of label 1 among all labelled rows, which the sample need not have."""
    random = np.random.default_rng(9)
    y = np.array([r[3] for r in rows], dtype=float)
    stats = np.array([r[2] for r in rows], dtype=float).reshape(-1, STATS)
    mean, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-6) if len(rows) else (np.zeros(STATS), np.ones(STATS))
    x = np.clip((stats - mean) / scale, -4, 4)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) if len(rows) else y
    w, v = np.zeros(BUCKETS + STATS), random.normal(0, 0.02, (BUCKETS + STATS, RANK))
    bias, gw, gv, gb = math.log(share / (1 - share)), np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    own = np.arange(BUCKETS, BUCKETS + STATS)
    if not 0 < y.sum() < len(y):
        return Model(bias, w, 0 * v, mean, scale)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            some = order[lo : lo + batch]
            column = np.concatenate([np.concatenate([rows[i][0], own]) for i in some]).astype(np.int64)
            value = np.concatenate([np.concatenate([rows[i][1], x[i]]) for i in some])
            size = np.array([len(rows[i][0]) + STATS for i in some])
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            # One factor at a time: all of them for every word of a batch of long texts would be much of the driver's memory.
            total, margin = np.empty((len(some), RANK)), bias + np.add.reduceat(w[column] * value, start)
            for f in range(RANK):
                vx = v[column, f] * value
                total[:, f] = np.add.reduceat(vx, start)
                margin += 0.5 * (total[:, f] ** 2 - np.add.reduceat(vx**2, start))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]) * weight[some] / len(some)
            per = np.repeat(slope, size) * value
            names, at = np.unique(column, return_inverse=True)
            dw, dv = np.bincount(at, per) + decay * w[names], decay * v[names]
            for f in range(RANK):
                dv[:, f] += np.bincount(at, per * (np.repeat(total[:, f], size) - v[column, f] * value))
            gw[names] += dw**2
            w[names] -= rate * dw / np.sqrt(gw[names])
            gv[names] += dv**2
            v[names] -= rate * dv / np.sqrt(gv[names])
            gb += slope.sum() ** 2
            bias -= rate * slope.sum() / math.sqrt(gb)
    return Model(bias, w, v, mean, scale)


def feature_rows(rows: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    buckets = Buckets()
    for batch in rows:
        made = [features(t, buckets) for t in texts(batch, "text")]
        yield record(schema, batch.column("doc_id"), batch.column("label"), *([m[i].tolist() if i < 2 else m[i] for m in made] for i in range(3)))


def score_rows(rows: Iterator[pa.RecordBatch], model: Model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    buckets = Buckets()
    for batch in rows:
        score = []
        for text in texts(batch, "text"):
            where, value, stats = features(text, buckets)
            score.append(model.score(where, value, np.array(stats)))
        yield record(schema, *(batch.column(n) for n in schema.names[:-1]), score)


def split(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's list."""
    return [x.values.to_numpy() for x in column]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, fold: int | None = 3) -> Model:
    """A model from at most ``per_class`` labelled documents (and 16 MiB of text) of each class; with ``fold``, rows whose crc32 of the id modulo
    ``fold`` is 1 are kept out. Without labels of both classes every score is the share of label 1, a half if
    there is no label."""
    ready(docs.sparkSession)
    marks = labels.where(remainder("doc_id", fold) != 1) if fold else labels
    counts = {r["quality"]: r["n"] for r in marks.where(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    sample = labelled_sample(docs, marks, "quality", per_class)
    kind = sample.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", _arrow(kind)), ("label", pa.int32()), ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("stats", pa.list_(pa.float64()))])
    made = sample.mapInArrow(partial(feature_rows, schema=schema), f"doc_id {kind.simpleString()}, label int, bucket array<int>, value array<double>, stats array<double>")
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", F.hash("bucket")).toArrow()
    return fit(list(zip(split(got.column("bucket")), split(got.column("value")), got.column("stats").to_pylist(), got.column("label").to_pylist())), share)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1, by its text alone.

    Null and empty texts are scored as texts without words; repeated rows repeat; a null id stays null."""
    spark = ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    schema = pa.schema([(id_column, _arrow(kind)), ("score", pa.float64())])
    shared = spark.sparkContext.broadcast(model)  # (BUCKETS + STATS) x (RANK + 1) numbers

    def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return score_rows(rows, shared.value, schema)

    return docs.select(id_column, F.col(text_column).alias("text")).mapInArrow(scored, f"{id_column} {kind.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (columns as they are) that the model does not reject."""
    spark = ready(docs.sparkSession)
    schema = pa.schema([(f.name, _arrow(f.dataType)) for f in docs.schema])
    shared = spark.sparkContext.broadcast(model)

    def kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = pa.schema([("text", pa.string()), ("score", pa.float64())])
        for batch in rows:
            batch = batch.cast(schema)
            for out in score_rows(iter([batch]), shared.value, scored):
                yield batch.filter(pa.array(out.column("score").to_numpy() >= threshold))

    return docs.mapInArrow(kept, docs.schema)
