"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

A piece's length is all that packing needs, so the pieces are counted by length: at most ``capacity`` numbers, whatever the
corpus. The driver runs best-fit decreasing over these classes. A segment tree over remaining capacities tells in
logarithmic time which is the tightest that still has open sequences; as all pieces of a class and all sequences with the
same room are alike, whole runs of them are placed at once, with the outcome of placing one piece after another. The runs
then go out to the executors, where every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.bpe import _arrow, codec, encode_text
from lattiq.llm.common import ready, record, saved, texts


class Capacities:
    """Segment tree over capacities 0..n that holds how many sequences are open at each."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += count
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more at which a sequence is open."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces: runs (length, first rank, pieces a sequence, first sequence, offset).

    In a run, pieces of consecutive ranks fill consecutive sequences, each of them from the offset on.
    """
    tree, room = Capacities(capacity), [deque() for _ in range(capacity + 1)]  # intervals (first sequence, count) by room
    runs, opened = [], 0

    def leave(left: int, first: int, count: int) -> None:
        if count and left:
            room[left].append((first, count))
            tree.add(left, count)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = tree.tightest(length)
            if at is None:
                at, first, there = capacity, opened, -(-todo // (capacity // length))
                opened += there
            else:
                first, there = room[at].popleft()
                tree.add(at, -there)
            each = at // length
            full, rest = divmod(min(todo, there * each), each)
            runs.append((length, rank, each, first, capacity - at))
            leave(at - each * length, first, full)
            leave(at - rest * length, first + full, bool(rest))
            leave(at, first + full + bool(rest), there - full - bool(rest))
            placed = full * each + rest
            rank, todo = rank + placed, todo - placed
    return runs


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[regex.Pattern | None, dict[str, int]]:
    """Pattern and ids of the strings that a tokenizer's JSON turns into ids before anything else, the longest first."""
    if not path.endswith(".json"):
        return None, {}
    with open(path, "rb") as f:
        tokens = json.load(f).get("added_tokens") or []
    if odd := [t["content"] for t in tokens if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"added tokens that take in their surroundings: {odd}")
    ids = {t["content"]: t["id"] for t in tokens if t["content"]}
    return regex.compile("|".join(map(regex.escape, sorted(ids, key=len, reverse=True)))) if ids else None, ids


def encode_added(encoding: tiktoken.Encoding, text: str, added: tuple[regex.Pattern | None, dict[str, int]]) -> np.ndarray:
    """Ids of one text as the tokenizer library gives them: added tokens are ids of their own, the parts between are encoded alone."""
    pattern, names = added
    found = list(pattern.finditer(text)) if pattern and any(name in text for name in names) else []
    if not found:
        return encode_text(encoding, text)
    out, at = [], 0
    for m in found:
        out += [encode_text(encoding, text[at : m.start()]), np.array([names[m[0]]], "<u4")]
        at = m.end()
    return np.concatenate([*out, encode_text(encoding, text[at:])])


def cut_rows(rows: Iterator[pa.RecordBatch], path: str, pattern: str, capacity: int, end_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoding, _ = codec(path, pattern)
    added = added_tokens(path)
    for batch in rows:
        out = [[] for _ in schema]
        for key, text in zip(batch.column("key").to_pylist(), texts(batch, "text")):
            ids = np.append(encode_added(encoding, text, added), np.array([end_id], "<u4"))
            first = (len(ids) - 1) % capacity + 1
            starts = [0, *range(first, len(ids), capacity)]
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                for column, value in zip(out, (key, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                    column.append(value)
        yield record(schema, *out)


def place_rows(rows: Iterator[pa.RecordBatch], runs, capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    lengths, ranks, each, first, offset = runs.value
    span = np.int64(1) << 48
    starts = lengths * span + ranks  # ascending
    for batch in rows:
        length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
        at = np.searchsorted(starts, length * span + rank, side="right") - 1
        within = rank - ranks[at]
        yield record(schema, *(batch.column(n) for n in schema.names[:-2]), first[at] + within // each[at], offset[at] + within % each[at] * length)


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row: its ids and one end id, cut only if there are more than ``capacity``.

    Added tokens of a tokenizer's JSON are their own ids, as in the tokenizer library's default. All pieces of a cut row are full
    but its first. A null or empty text is the end id alone; repeated rows repeat.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    schema = pa.schema([("key", _arrow(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    return rows.mapInArrow(partial(cut_rows, path=path, pattern=pattern, capacity=capacity, end_id=end_id, schema=schema), f"key {kind.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", id_column)


def pack(cut: DataFrame, capacity: int = 2048, id_column: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to ``capacity``.

    The pieces are written to the checkpoint folder once, as their lengths are needed before any can be placed. Ranks are
    counted in two steps, inside the partitions that were written and then over them, so that a length that a third of
    all pieces have does not meet in one task, nor do equal rows. Null ids stay null, repeated rows are packed each. An empty
    input gives no rows.
    """
    spark = ready(cut.sparkSession)
    whole = saved(cut)
    counts = {r["length"]: r["n"] for r in whole.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = sorted(plan(counts, capacity)) or [(0, 0, 1, 0, 0)]
    # A run uses up an interval of sequences or ends a length, and leaves three intervals at most: some for each length.
    shared = spark.sparkContext.broadcast(tuple(np.array(column, dtype=np.int64) for column in zip(*runs)))

    bucketed = whole.withColumn("bucket", F.spark_partition_id())  # fixed, as the files are
    sums = bucketed.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "length").orderBy(id_column, "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("inside", F.row_number().over(inside) - 1).join(sums, ["bucket", "length"])
    ranked = ranked.select(F.col(id_column).alias("key"), "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))
    kind = cut.schema[id_column].dataType
    schema = pa.schema([("key", _arrow(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    placed = ranked.mapInArrow(partial(place_rows, runs=shared, capacity=capacity, schema=schema), f"key {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("key", id_column)
