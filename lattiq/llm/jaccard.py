"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same set of word shingles are one text. Texts that agree on a band of MinHash values share a bucket; the
pairs in a bucket compare further values a few at a time, and a pair is dropped once the posterior probability that its
similarity reaches the threshold is below a tolerance. Pairs that come through all are verified on their shingles. Buckets
are cut into blocks, and a task compares two blocks, so that no bucket meets in one task; a block gives counts of links and
its components, never its pairs. A pair that shares several buckets is counted in the first of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.bpe import _arrow
from lattiq.llm.common import BATCH_BYTES, counted, partitions, ready, record, saved, texts

#: So many rows at most are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows of a file with ids and digests; pairs and shingles that are compared at once.
FILE_ROWS, PAIRS, VALUES = 50_000, 250_000, 1 << 20


@dataclass(frozen=True)
class Settings:
    """``bands`` of ``rows`` MinHash values find candidates: at a similarity of exactly 0.8, one pair in 45 000 is missed.

    ``step`` values are compared at a time, ``values`` in all; ``tolerance`` is the posterior probability below which a pair
    is dropped; about ``block`` texts of a bucket, or ``block_bytes`` bytes of shingles, meet as many others in one task."""

    words: int = 5
    threshold: tuple[int, int] = (4, 5)
    bands: int = 27
    rows: int = 5
    step: int = 15
    tolerance: float = 1e-6
    block: int = 2048
    block_bytes: int = 16 << 20

    @property
    def values(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    """64-bit hash by word; cleared when it has grown large, which changes no result."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


def shingles(text: str, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words (lower case, split at white space). A text of fewer words
    is one run; a text without words has none."""
    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(7)
    return random.integers(0, 1 << 32, (count, 1), dtype=np.uint32), random.integers(0, 1 << 31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(values: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values of a set; of long sets, a part at a time."""
    x = (values ^ (values >> np.uint64(29))).astype(np.uint32)
    least = np.full(len(mixers[0]), np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(x), 4096):
        y = (x[lo : lo + 4096] ^ mixers[0]) * mixers[1]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, y.min(axis=1), out=least)
    return least


def band_hashes(signature: np.ndarray, s: Settings) -> np.ndarray:
    out = np.arange(1, s.bands + 1, dtype=np.uint64)
    for column in signature.reshape(s.bands, s.rows).T:
        out = (out ^ column) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def digest_rows(rows: Iterator[pa.RecordBatch], s: Settings, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    words, mixers = WordHashes(), multipliers(s.values)
    for batch in rows:
        keys, counts, bands = [], [], []
        for text in texts(batch, "text"):
            own = shingles(text, s.words, words)
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            counts.append(len(own))
            bands.append(band_hashes(minhash(own, mixers), s) if len(own) else [])
        yield record(schema, batch.column("id"), batch.column("hash"), keys, counts, bands)


def content_rows(rows: Iterator[pa.RecordBatch], s: Settings, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """MinHash values and shingles of the texts asked for; a row whose text is not the one asked for is left out."""
    words, mixers = WordHashes(), multipliers(s.values)
    for batch in rows:
        out, size = [[] for _ in schema], 0
        for key, docs, text in zip(batch.column("key").to_pylist(), batch.column("size").to_pylist(), texts(batch, "text")):
            own = shingles(text, s.words, words)
            if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == key:
                for column, value in zip(out, (key, docs, minhash(own, mixers).tobytes(), own.tobytes())):
                    column.append(value)
                size += own.nbytes
            if size > BATCH_BYTES:
                yield record(schema, *out)
                out, size = [[] for _ in schema], 0
        yield record(schema, *out)


def least_matches(s: Settings) -> list[int]:
    """By compared values n = step, 2 step ...: the fewest matches m with P(J >= t | m of n) >= tolerance, for a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), so that probability is that of at most m successes in n + 1 trials of t."""
    t = s.threshold[0] / s.threshold[1]
    out = []
    for n in range(s.step, s.values + 1, s.step):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= s.tolerance:
                out.append(m)
                break
    return out


@dataclass(frozen=True)
class Members:
    """Texts that meet in one place: their MinHash values, and their shingles one text after another, from ``start`` on."""

    signatures: np.ndarray
    shingles: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, s: Settings) -> Members:
        column = rows.column("shingles").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
        signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(len(column), s.values)
        return cls(signatures, np.frombuffer(column.buffers()[2], np.uint64), ends[:-1], np.diff(ends))

    def set(self, i: int) -> np.ndarray:
        return self.shingles[self.start[i] : self.start[i] + self.size[i]]


def linked(left: np.ndarray, right: np.ndarray, band: int, m: Members, s: Settings, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs among (left, right) of a bucket of ``band`` that reach the threshold and share no earlier bucket."""
    (num, den), size, signatures = s.threshold, m.size, m.signatures
    fits = np.minimum(size[left], size[right]) * den >= np.maximum(size[left], size[right]) * num
    left, right = left[fits], right[fits]
    matches = np.zeros(len(left), np.int32)
    for k, fewest in enumerate(least):
        part = signatures[:, k * s.step : (k + 1) * s.step]
        matches += (part[left] == part[right]).sum(axis=1, dtype=np.int32)
        keep = matches >= fewest
        left, right, matches = left[keep], right[keep], matches[keep]
        if not len(left):
            return left, right
    if band:
        by_band = signatures.reshape(len(signatures), s.bands, s.rows)
        first = np.ones(len(left), bool)
        for lo in range(0, len(left), 10_000):
            a, b = left[lo : lo + 10_000], right[lo : lo + 10_000]
            first[lo : lo + 10_000] = ~(by_band[a, :band] == by_band[b, :band]).all(axis=2).any(axis=1)
        left, right = left[first], right[first]
    common = np.empty(len(left), np.int64)
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    edges = np.flatnonzero(np.diff(left, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(left)]):
        own, at, others = m.set(left[lo]), lo, right[lo:hi]
        ends = np.cumsum(size[others])
        while at < hi:  # a part of the others at a time, of one at least
            upto = max(at + 1, lo + int(np.searchsorted(ends, (ends[at - lo - 1] if at > lo else 0) + VALUES, side="right")))
            some = right[at:upto]
            joined = np.concatenate([m.set(r) for r in some])
            place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            common[at:upto] = np.add.reduceat((own[place] == joined).astype(np.int64), np.cumsum(size[some]) - size[some])
            at = upto
    union = size[left] + size[right] - common
    reach = common * den >= union * num
    return left[reach], right[reach]


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def block_links(parts: list[pa.RecordBatch], s: Settings, least: list[int]) -> list[tuple[bytes, bytes, int, int]]:
    """(key, root, linked texts, their documents) of the members of one pair of blocks that have links."""
    rows = pa.Table.from_batches(parts)
    keys = rows.column("key").to_pylist()
    if len(keys) < 2:
        return []
    low, high, band = (rows.column(n)[0].as_py() for n in ("low", "high", "band"))
    own, docs = rows.column("own").to_numpy(), rows.column("size").to_numpy()
    members = Members.of(rows, s)
    a, b = (np.flatnonzero(own == low), np.flatnonzero(own == high))
    found = []
    per = max(1, PAIRS // max(1, len(b)))
    for lo in range(0, len(a), per):
        left, right = np.repeat(a[lo : lo + per], len(b)), np.tile(b, len(a[lo : lo + per]))
        if low == high:
            left, right = left[left < right], right[left < right]
        found.append(linked(left, right, band, members, s, least))
    left, right = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    if not len(left):
        return []
    both, others = np.concatenate([left, right]), np.concatenate([right, left])
    count = np.bincount(both, minlength=len(keys))
    reached = np.bincount(both, docs[others], minlength=len(keys)).astype(np.int64)
    root = roots(len(keys), left, right)
    return [(keys[i], keys[root[i]], int(count[i]), int(reached[i])) for i in np.flatnonzero(count)]


def block_rows(rows: Iterator[pa.RecordBatch], s: Settings, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks one after another, as the rows come sorted by them; they are cut out of the batches as they are."""
    least, group, last, out = least_matches(s), [], None, []
    for batch in rows:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(n).to_numpy() for n in ("bucket", "low", "high")], axis=1)
        starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1)]
        for lo, hi in zip(starts, [*starts[1:], len(names)]):
            name = tuple(names[lo])
            if name != last:
                out += block_links(group, s, least) if group else []
                group, last = [], name
            group.append(batch.slice(lo, hi - lo))
        if len(out) > 1000:
            yield record(schema, *zip(*out))
            out = []
    out += block_links(group, s, least) if group else []
    if out:
        yield record(schema, *zip(*out))


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of every end of ``edges`` (a, b): the smallest key of its component.

    Labels spread along edges and then along themselves (a label takes its own label's label), so the number of rounds
    grows with the logarithm of a component's diameter. Every round is written to the checkpoint folder."""
    files = in_files(edges.count())
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().coalesce(files))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label"))
    labels = saved(labels.coalesce(files))
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "key"), "key").select("key", F.least("label", "near").alias("spread"), F.col("label").alias("old"))
        jump = spread.join(labels.select(F.col("key").alias("spread"), F.col("label").alias("next")), "spread").select("key", "old", F.least("spread", "next").alias("label"))
        new = saved(jump.coalesce(files))
        if new.where("label <> old").limit(1).count() == 0:
            return new.select("key", "label")
        labels = new.select("key", "label")


def in_files(rows: int) -> int:
    """Files for so many short rows: many small ones cost more than they save."""
    return max(1, -(-rows // FILE_ROWS))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (ids and digests) to be broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_rows(docs: DataFrame, s: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, key, group, class_id, n_links, n_texts) of every row.

    ``key`` names the text (the set of its shingles), ``group`` its class by one of these keys; ``class_id`` is the smallest id of all rows that a chain of links
    reaches, ``n_links`` the number of other rows with a similarity of the threshold or more, copies included, ``n_texts``
    that of other texts. Pairs below the threshold are no links, however near. Nulls and empty texts are copies of one another
    and link to nothing else. Repeated rows repeat. A null id stays null and is no class_id, unless no row of the class has
    another.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("hash"), "text")
    name = f"id {kind.simpleString()}"
    digest = pa.schema([("id", _arrow(kind)), ("hash", pa.int64()), ("key", pa.binary()), ("count", pa.int64()), ("bands", pa.list_(pa.int64()))])
    digests = rows.mapInArrow(partial(digest_rows, s=s, schema=digest), f"{name}, hash long, key binary, count long, bands array<long>")
    digests, total = counted(digests)

    # One row for each text; copies meet in partial sums first. A text is fetched again by the id and hash of its first row.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))
    classes = digests.groupBy("key").agg(first.alias("first"), F.count("*").alias("size"), F.first("count").alias("count"), F.first("bands").alias("bands"))
    classes = saved(classes.select("key", "first.id", "first.hash", "size", "count", "bands").coalesce(in_files(total)))
    found = classes.select("key", "count", F.posexplode("bands").alias("band", "bucket"))
    mark = F.xxhash64("key")
    buckets = found.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("count").alias("all"), F.min("band").alias("band"), F.sum(F.shiftright(mark, 20)).alias("sum"), F.bit_xor(mark).alias("xor")).where("n > 1")
    # Buckets with the same members hold the same pairs: the first of them is enough.
    buckets = buckets.groupBy("n", "all", "sum", "xor").agg(F.min_by("bucket", F.struct("band", "bucket")).alias("bucket"))
    # A bucket is cut into blocks by its texts and by their bytes.
    blocks = F.greatest(F.ceil(F.col("n") / s.block), F.ceil(F.col("all") * 8 / s.block_bytes)).cast("int")
    member = found.join(buckets.select("bucket", blocks.alias("blocks")), "bucket").select("key", "band", "bucket", "blocks")
    member = saved(member.coalesce(in_files(total)))

    asked, n = counted(classes.join(member.select("key").distinct(), "key").select("key", F.col("id").alias("of"), F.col("hash").alias("named"), "size").coalesce(in_files(total)))
    content = pa.schema([("key", pa.binary()), ("size", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])
    contents = rows.join(bounded(asked, n), F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("named"))).select("key", "size", "text")
    contents = contents.mapInArrow(partial(content_rows, s=s, schema=content), "key binary, size long, signature binary, shingles binary")
    contents = contents.groupBy("key").agg(F.first("size").alias("size"), F.first("signature").alias("signature"), F.first("shingles").alias("shingles"))  # repeated rows

    # A text goes to the pairs that its block forms with every block of its bucket.
    placed = member.withColumn("own", F.pmod(F.xxhash64("key", "bucket"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "bucket", "band", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    joined = placed.join(contents, "key").repartition(partitions(spark), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "key")
    out = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64())])
    links = joined.mapInArrow(partial(block_rows, s=s, schema=out), "key binary, root binary, texts long, docs long")
    links = saved(links.repartition(in_files(n), "key"))

    labels = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    named = classes.select("key", "id", "size").join(labels, "key", "left").join(sums, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("id").alias("class_id"))
    named = named.join(least, "label").select("key", F.col("label").alias("group"), "class_id", (F.col("size") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    return digests.select(F.col("id").alias(id_column), "key").join(named, "key").select(id_column, "key", "group", "class_id", "n_links", "n_texts")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` (columns as they are) without those that link to a row with a smaller doc_id through a chain.

    Of rows with the same doc_id and text one stays; so does one of a class without any doc_id."""
    joined, total = counted(join_rows(docs, s).select("doc_id", "key", "group", "class_id"))
    free = lambda name: next(n for i in range(len(docs.columns) + 1) if (n := f"_{name}{i}") not in docs.columns)
    if joined.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        # Ids are not unique: rows are told apart by id and text, which takes a shuffle of the texts.
        key, of, stay = free("key"), free("id"), free("stay")
        schema = pa.schema([(f.name, _arrow(f.dataType)) for f in docs.schema] + [(key, pa.binary())])
        keyed = docs.mapInArrow(partial(keyed_rows, s=s, schema=schema), docs.withColumn(key, F.lit(b"")).schema)
        first = joined.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
        first = first.select(F.col("first.doc_id").alias(of), F.col("first.key").alias(stay))
        kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(stay)), "left_semi")
        return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)
    gone = free("gone")
    dropped, n = counted(joined.where("doc_id <> class_id").select(F.col("doc_id").alias(gone)).coalesce(in_files(total)))
    return docs.join(bounded(dropped, n), F.col("doc_id") == F.col(gone), "left_anti")


def keyed_rows(rows: Iterator[pa.RecordBatch], s: Settings, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in rows:
        keys = [hashlib.blake2b(shingles(t, s.words, words).tobytes(), digest_size=16).digest() for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([*batch.cast(pa.schema(list(schema)[:-1])).columns, pa.array(keys, pa.binary())], schema=schema)
