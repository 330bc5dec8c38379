"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a longer one is cut behind sentences, and those without end behind words, where their hashes say so, so
that an edit moves no cut but its own. Each paragraph's digest is added to one cell in each of three parts of the sketch (a
count, a sum of digests and a sum of their checksums). Subtracting the sketches of two versions cancels what they share; cells
with a single digest left then give it away, and taking it out of its other cells frees more, until nothing is left. If cells
stay, the versions differ in too many paragraphs for the sketch, and it is tried again twice as large.

A fingerprint is the smallest sketch that gives away all of a text's own digests, so that it depends on the text alone and any
two fingerprints tell by themselves what their texts share (``compared_fingerprints``).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.bpe import _arrow
from lattiq.llm.common import partitions, ready, record, texts

#: Cells of the smallest sketch (in three parts), growth on failure, and cells held at once.
CELLS, GROWTH, AT_ONCE = 15, 2, 1 << 18
#: Lines of so many characters are cut; sentences of so many are cut behind words.
LINE, SENTENCE = 128, 400
#: Of sentences and of words, one in so many has a cut behind it.
PER_SENTENCE, PER_WORD = 3, 6
#: Rows and characters that are compared at once, and bytes of texts that a task is given.
ROWS, CHARS, TASK_BYTES = 200, 2 << 20, 32 << 20
#: Ranges at most, and rows of the sample that finds each one's bounds.
RANGES, PER_RANGE = 10_000, 32
#: Rows that Spark's reader holds at once; its arrays of texts double as they grow, and 4096 texts are many.
READ_ROWS = 512
END = re.compile(r"(?<=[.!?\u2026\u3002])\s+")


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grouped(parts: list[str], per: int) -> Iterator[str]:
    """``parts`` put together, with an end behind those whose hash (of a few characters and the length) says so."""
    start = 0
    for i, part in enumerate(parts, 1):
        if (len(part) * 7 + ord(part[0]) * 3 + ord(part[len(part) // 2]) * 5 + ord(part[len(part) // 3])) // 3 % per == 0 or i == len(parts):
            yield " ".join(parts[start:i])
            start = i


def paragraphs_of(text: str) -> Iterator[str]:
    """The paragraphs of one text, without white space around them; empty lines are none."""
    for line in text.split("\n"):
        line = line.strip()
        if len(line) <= LINE:
            if line:
                yield line
            continue
        for part in grouped(END.split(line), PER_SENTENCE):
            if len(part) <= SENTENCE:
                yield part
            else:
                yield from grouped(part.split(), PER_WORD)


def paragraphs(data: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of each text and how many each has. The nth repetition of a paragraph has a digest of its own."""
    each = [np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "replace")) for p in paragraphs_of(t)), np.uint64) for t in data]
    sizes = np.array([len(e) for e in each], np.int64)
    digest = np.concatenate([*each, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(data)), sizes)
    order = np.lexsort((digest, owner))
    digest, owner = digest[order], owner[order]
    first = np.ones(len(digest), bool)
    first[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(digest))
    again = place - np.maximum.accumulate(np.where(first, place, 0))
    return mix(digest + again.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 3), sizes


def places(digest: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each digest, one in each third."""
    third = cells // 3
    return np.stack([(mix(digest, 11 + 7 * k) % np.uint64(third)).astype(np.int64) + k * third for k in range(3)])


class Sketches:
    """Sketches of several texts side by side."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint32)

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: np.ndarray) -> None:
        """``sign`` is 1 or -1."""
        key, check = digest * sign.view(np.uint64), mix(digest, 5).astype(np.uint32) * sign.astype(np.uint32)
        for at in places(digest, self.cells) + owner * self.cells:
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner and digest of all that the sketches gave away, and by sketch whether it is empty after that."""
        got = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
        todo = np.flatnonzero(np.abs(self.count) == 1)
        while len(todo):
            sign = self.count[todo]
            key = self.key[todo] * sign.view(np.uint64)
            pure = (np.abs(sign) == 1) & (mix(key, 5).astype(np.uint32) * sign.astype(np.uint32) == self.check[todo])
            owner, key, sign = todo[pure] // self.cells, key[pure], sign[pure]
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            owner, key, sign = owner[once], key[once], sign[once]
            if not len(key):
                break
            self.add(owner, key, -sign)
            got.append((owner, key))
            todo = np.unique(places(key, self.cells) + owner * self.cells)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return np.concatenate([o for o, _ in got]), np.concatenate([k for _, k in got]), ~left.reshape(self.n, self.cells).any(axis=1)

    def spelt(self, sizes: np.ndarray) -> list[str]:
        """Each sketch as text: its number of paragraphs and its cells."""
        rows = np.concatenate([x.view(np.uint8).reshape(self.n, -1) for x in (self.count.astype("<i4"), self.key.astype("<u8"), self.check.astype("<u4"))], axis=1)
        return [f"{int(size):x}.{base64.b64encode(row.tobytes()).decode()}" for size, row in zip(sizes, rows)]


def rows_of(sizes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where the digests of ``some`` texts stand, one text after another."""
    n = sizes[some]
    return np.repeat((np.cumsum(sizes) - sizes)[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def sketch(digest: np.ndarray, sizes: np.ndarray, some: np.ndarray, cells: int) -> Sketches:
    out = Sketches(len(some), cells)
    out.add(np.repeat(np.arange(len(some)), sizes[some]), digest[rows_of(sizes, some)], np.ones(int(sizes[some].sum()), np.int64))
    return out


def fingerprints(digest: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Of each text the smallest sketch that gives away all of its digests."""
    out, todo, cells = [""] * len(sizes), np.arange(len(sizes)), CELLS
    while len(todo):
        large = sizes[todo] > cells  # no sketch gives away more digests than it has cells
        failed, todo = [todo[large]], todo[~large]
        per = max(1, AT_ONCE // cells)
        for lo in range(0, len(todo), per):
            some = todo[lo : lo + per]
            made = sketch(digest, sizes, some, cells)
            names = made.spelt(sizes[some])
            done = made.peel()[2]
            for i in np.flatnonzero(done):
                out[some[i]] = names[i]
            failed.append(some[~done])
        todo, cells = np.concatenate(failed), cells * GROWTH
    return out


def recovered(fingerprint: str) -> np.ndarray:
    """All digests that a fingerprint holds."""
    data = base64.b64decode(fingerprint.split(".", 1)[1])
    one = Sketches(1, len(data) // 16)
    one.count = np.frombuffer(data, "<i4", one.cells).astype(np.int64)
    one.key = np.frombuffer(data, "<u8", one.cells, 4 * one.cells).astype(np.uint64)
    one.check = np.frombuffer(data, "<u4", one.cells, 12 * one.cells).astype(np.uint32)
    return one.peel()[1]


def differences(digest: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """By pair of texts, the number of paragraphs that only one of them has, found by subtracting and peeling."""
    out = np.full(len(left), -1, np.int64)
    todo, cells = np.arange(len(left)), CELLS
    least = np.abs(sizes[left] - sizes[right])
    while len(todo):
        large = least[todo] > cells
        failed, todo = [todo[large]], todo[~large]
        per = max(1, AT_ONCE // cells)
        for lo in range(0, len(todo), per):
            some = todo[lo : lo + per]
            pair = sketch(digest, sizes, left[some], cells)
            other = sketch(digest, sizes, right[some], cells)
            for name in ("count", "key", "check"):
                setattr(pair, name, getattr(pair, name) - getattr(other, name))
            owner, _, done = pair.peel()
            out[some[done]] = np.bincount(owner, minlength=len(some))[done]
            failed.append(some[~done])
        todo, cells = np.concatenate(failed), cells * GROWTH
    return out


def likeness(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Shared paragraphs by all of them; 1 for two texts without any."""
    total = a + b + apart
    return np.where(total == 0, 1.0, (a + b - apart) / np.maximum(total, 1))


def compared_fingerprints(a: str, b: str) -> float:
    """The likeness of two texts by their fingerprints alone."""
    held = [recovered(a), recovered(b)]
    sizes = np.array([len(h) for h in held])
    return float(likeness(sizes[:1], sizes[1:], differences(np.concatenate(held), sizes, np.array([0]), np.array([1])))[0])


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_rows(rows: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by place; a row's next is the one after it, and a range ends with a copy of the next one's first."""
    waiting: list[tuple] = []
    held = 0
    for batch in rows:
        for row in zip(batch.column("carried").to_pylist(), batch.column("id").to_pylist(), texts(batch, "text")):
            waiting.append(row)
            held += len(row[2])
            if len(waiting) > ROWS or held > CHARS and len(waiting) > 1:
                if out := compared(waiting, schema):
                    yield out
                waiting = waiting[-1:]
                held = len(row[2])
    if len(waiting) > 1 and (out := compared(waiting, schema)):
        yield out


def compared(part: list[tuple], schema: pa.Schema) -> pa.RecordBatch | None:
    """All rows of ``part`` but its last, unless they are carried."""
    own = [i for i in range(len(part) - 1) if not part[i][0]]
    if not own:
        return None
    edited = [edited_text(part[i][2], part[i + 1][2]) for i in own]
    digest, sizes = paragraphs([t for *_, t in part] + edited)
    mine, changed = np.array(own), len(part) + np.arange(len(own))
    apart = differences(digest, sizes, np.concatenate([mine, mine]), np.concatenate([changed, mine + 1]))
    names = fingerprints(digest, sizes)
    near = likeness(sizes[mine], sizes[changed], apart[: len(own)]), likeness(sizes[mine], sizes[mine + 1], apart[len(own) :])
    digests = [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited]
    return record(schema, [part[i][1] for i in own], [len(part[i][2]) for i in own], digests, [names[i] for i in own], [names[i] for i in changed], *near)


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next row is that with the next smaller id (of equal ids, the next by the text's hash; rows without an id come last,
    after the last comes the first, which for a single row is itself). Null texts are empty; repeated rows repeat.

    Rows are cut into ranges of that order, by id and hash, so that rows that share an id are parted too. The first row of each
    range, one for a task, is what the range before it needs besides its own rows, so the texts are shuffled once. It is known
    from the bounds, without an aggregate or a join, whose sorts and tables would hold pages of memory in each task.
    """
    spark = ready(docs.sparkSession)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    kind = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    place = F.struct(F.col("id").isNull(), -F.col("id"), F.col("hash"))
    size, head = rows.agg(F.sum(F.octet_length("text")), F.min_by(F.struct("id", "hash"), place)).first()  # no keys: nothing is sorted
    n = min(RANGES, max(partitions(spark), -(-(size or 0) // TASK_BYTES)))
    # A sample of a bounded number of ids finds the bounds. Each bound is a row, the first of its range.
    sample = rows.select("id", "hash").orderBy(F.xxhash64("id", "hash"), "id").limit(PER_RANGE * n).collect()
    sample = sorted({(r["id"] is None, -r["id"] if r["id"] is not None else 0, r["hash"]) for r in sample})
    cuts = [sample[len(sample) * i // n] for i in range(1, n)] if len(sample) > n else sample[1:]
    heads = [(head["id"], head["hash"])] if head else []
    heads += [(None if none else -negative, hash_) for none, negative, hash_ in cuts]
    rows = rows.withColumn("bucket", ranged(cuts))
    is_head = F.col("id").eqNullSafe(listed([i for i, _ in heads], "bucket").cast(kind)) & (F.col("hash") == listed([h for _, h in heads], "bucket"))
    before = F.pmod(F.col("bucket") - 1, F.lit(len(cuts) + 1))
    spots = F.array_compact(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("carried")), F.when(is_head, F.struct(before.alias("bucket"), F.lit(True).alias("carried")))))
    rows = rows.select("id", "text", "hash", F.explode(spots).alias("spot")).select("spot.*", "id", "text", "hash")
    rows = rows.repartitionById(max(1, len(cuts) + 1), "bucket").sortWithinPartitions("carried", F.col("id").desc_nulls_last(), "hash").select("carried", "id", "text")
    schema = pa.schema([(id_column, _arrow(kind)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return rows.mapInArrow(partial(compare_rows, schema=schema), f"{id_column} {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def in_sql(value: int | float | Decimal | None) -> str:
    """A number in SQL."""
    if value is None:
        return "null"
    return f"{value}L" if isinstance(value, int) else f"{value}BD" if isinstance(value, Decimal) else f"{value!r}D"


def listed(values: list, index: str) -> Column:
    """That of ``values`` at the place that column ``index`` names, from one literal."""
    return F.expr(f"get(array({', '.join(map(in_sql, values))}), {index})")


def ranged(cuts: list[tuple[bool, int, int]]) -> Column:
    """How many of the ascending ``cuts`` (id is null, -id, hash) a row (id, hash) has reached, by bisection. It is parsed at
    once: as a column made of columns, 211 ranges took the driver many seconds."""

    def reached(cut: tuple[bool, int, int]) -> str:
        none, negative, hash_ = cut
        if none:
            return f"id is null and hash >= {in_sql(hash_)}"
        return f"id is null or id < {in_sql(-negative)} or id = {in_sql(-negative)} and hash >= {in_sql(hash_)}"

    def between(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if({reached(cuts[mid])}, {between(mid + 1, hi)}, {between(lo, mid)})"

    return F.expr(between(0, len(cuts)))
