"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic documents. Toxic documents are mostly ordinary text
too, so both hold the same part trained on ordinary documents; behind it, the toxic one has a part trained on the words that
toxic documents use significantly more often than ordinary ones. The ordinary one has as many bytes more of its own class
instead. A text's windows are compressed with either; a window that is shorter under the toxic dictionary holds toxic
material. A logistic fit over how large and how frequent those savings are gives a calibrated probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.bpe import _arrow
from lattiq.llm.common import labelled_sample, ready, record, remainder, texts

WINDOW, STRIDE, LEVEL, MIN_MATCH = 64, 52, 9, 6
#: Bytes of the part that both dictionaries share and of the part that each has of its own class.
SHARED_BYTES, OWN_BYTES = 131072, 2048
#: A word counts as one of a class if it is surely (by so many standard deviations of its count) so many times as frequent there.
RATIO, SURE = 4, 2
#: Length of the strings that the trainer counts, and of the segments that it takes, for whole texts and for words.
COVER, COVER_WORDS = {"d": 8, "k": 64}, {"d": 6, "k": 16}
#: Savings of a window are counted up to this; measures of a text that the probability is fitted on.
SAVED, MEASURES = 13, 10


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    odds: tuple[float, ...]  # by saved bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the intercept


NOT_WORD = re.compile(r"[\W_]+")


def normal(text: str) -> bytes:
    """Lower-case words with one space before each and one behind the last: what stands between words says nothing here."""
    return f" {NOT_WORD.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def different(data: list[bytes]) -> list[int]:
    """Positions of documents of which none is a near copy of an earlier one: those that share the least hash of their
    strings of 24 bytes, for either of two hashes, are taken for copies. This is for the choice of strings only."""
    seen: list[set[int]] = [set(), set()]
    keep = []
    for i, d in enumerate(data):
        b = np.frombuffer(d.ljust(24), np.uint8).astype(np.uint64)
        code = np.zeros(len(b) - 23, np.uint64)
        for k in range(24):
            code = code * np.uint64(0x100000001B3) + b[k : k + len(code)] + np.uint64(1)
        least = [int(((code ^ (code >> np.uint64(29))) * np.uint64(m) >> np.uint64(7)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        if not any(v in s for v, s in zip(least, seen)):
            keep.append(i)
        for v, s in zip(least, seen):
            s.add(v)
    return keep


def words_of(own: list[bytes], others: list[bytes]) -> set[bytes]:
    """Words that are in significantly more of ``own`` documents than in ``others``."""
    here, there = (Counter(w for d in data for w in set(d.split())) for data in (own, others))
    least = RATIO / max(1, len(others))
    return {w for w, n in here.items() if (n - SURE * math.sqrt(n)) / len(own) > least * (there[w] + 1)}


def only(data: bytes, words: set[bytes]) -> bytes:
    """A document without all other words; words that follow one another stay together."""
    return b" " + b" ".join(w for w in data.split() if w in words) + b" "


def trained(samples: list[bytes], size: int, cover: dict[str, int]) -> bytes:
    """The bytes of a dictionary that zstandard trains on the samples; the last of the samples themselves if they are too few."""
    samples = [s for s in samples if len(s) > 2]
    try:
        return zstandard.train_dictionary(size, samples, **cover).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries, of one size; what is likeliest to be of use is last."""
    plain = trained(ordinary, SHARED_BYTES + OWN_BYTES, COVER).rjust(SHARED_BYTES + OWN_BYTES, b"\n")
    words = words_of(toxic, ordinary) if toxic else set()
    own = trained([only(d, words) for d in toxic], OWN_BYTES, COVER_WORDS)
    return (plain[len(own) :] if own else plain) + own, plain


def compressors(toxic: bytes, ordinary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    def one(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content.rjust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(content), min_match=MIN_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
        held.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)

    return one(ordinary), one(toxic)


def savings(data: bytes, plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """How many of a text's windows save 0 (or less), 1, 2 ... bytes under the toxic dictionary; they cover the whole text."""
    a, b = plain.compress, toxic.compress
    saved = [len(a(w)) - len(b(w)) for w in (data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE))]
    return np.bincount(np.clip(saved, 0, SAVED - 1), minlength=SAVED)


def measures(counts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """A row for each row of savings: the largest and the mean of the three largest, the mean, shares and numbers of windows
    saving two and three bytes, the number of windows, and the log odds of all windows together and each."""
    n = np.maximum(1, counts.sum(axis=1))
    bytes_ = np.arange(SAVED)
    # The three largest: of each saving, as many as the larger ones leave of three.
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    most = np.where(above > 0, bytes_, 0).max(axis=1)
    three = (np.minimum(above, np.minimum(3, n)[:, None])[:, 1:]).sum(axis=1) / np.minimum(3, n)
    at2, at3, total = counts[:, 2:].sum(axis=1), counts[:, 3:].sum(axis=1), counts @ odds
    return np.stack([most, three, counts @ bytes_ / n, at2 / n, at3 / n, np.log1p(at2), np.log1p(at3), np.log(n), np.arcsinh(total), total / n], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column's coefficient, the intercept, is free."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def at_best_threshold(w: np.ndarray, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``w`` with its intercept moved so that a score of 0.5 is the threshold with the best F1 measure."""
    margin = z @ w
    order = np.argsort(-margin, kind="stable")
    hits, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (taken + (weight * y).sum())
    last = np.append(margin[order][1:] < margin[order][:-1], True)  # a threshold does not part equal margins
    best = int(np.argmax(np.where(last, f1, -1.0)))
    cut = (margin[order][best] + margin[order][min(best + 1, len(margin) - 1)]) / 2
    out = w.copy()
    out[-1] -= cut
    return out


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """A model from labelled texts; ``share`` is the share of toxic ones among all labelled rows, which the sample need not have.

    The fit of the probabilities uses dictionaries made from the other half of the sample, as those made from the same
    texts would save too much."""
    data = [normal(t) for t, _ in rows]
    y = np.array([m for _, m in rows], dtype=float)
    single = different(data)

    def made(use: list[int]) -> tuple[bytes, bytes]:
        return dictionaries([data[i] for i in use if y[i]], [data[i] for i in use if not y[i]])

    counts = np.zeros((len(rows), SAVED), np.int64)
    for half in (0, 1):
        pair = compressors(*made([i for i in single if i % 2 != half]))
        for i in range(half, len(rows), 2):
            counts[i] = savings(data[i], *pair)
    # Windows of a class by their saving; every document weighs the same.
    share_of = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    shares = [share_of[y == label].sum(axis=0) + 0.1 for label in (0, 1)]
    odds = np.log(shares[1] / shares[1].sum()) - np.log(shares[0] / shares[0].sum())
    x = measures(counts, odds)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(rows) else (np.zeros(MEASURES), np.ones(MEASURES))
    z = np.hstack([(x - mean) / scale, np.ones((len(rows), 1))])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) if len(rows) else y
    toxic, ordinary = made(single)
    weights = at_best_threshold(logistic(z, y, weight), z, y, weight) if 0 < y.sum() < len(y) else np.array([0.0] * MEASURES + [math.log(share / (1 - share))])
    return Model(toxic, ordinary, tuple(odds), tuple(mean), tuple(scale), tuple(weights))


def probability(counts: np.ndarray, model: Model) -> np.ndarray:
    mean, scale, w = (np.array(v) for v in (model.mean, model.scale, model.weights))
    x = measures(counts, np.array(model.odds))
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def score_rows(rows: Iterator[pa.RecordBatch], model: Model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pair = compressors(model.toxic, model.ordinary)
    for batch in rows:
        counts = np.array([savings(normal(t), *pair) for t in texts(batch, "text")]).reshape(-1, SAVED)
        yield record(schema, *(batch.column(n) for n in schema.names[:-1]), probability(counts, model))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, fold: int | None = 5) -> Model:
    """A model from at most ``per_class`` labelled documents (and 16 MiB of text) of each class; with ``fold``, rows whose crc32 of the id modulo
    ``fold`` is 0 are kept out. Without labels of both classes every score is the share of toxic labels, a quarter if
    there is no label."""
    ready(docs.sparkSession)
    marks = labels.where(remainder("doc_id", fold) != 0) if fold else labels
    counts = {r["toxic"]: r["n"] for r in marks.where(F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 2)
    sample = labelled_sample(docs, marks, "toxic", per_class).orderBy(F.xxhash64("doc_id"), "doc_id", "text").toArrow()
    return fit(list(zip(sample.column("text").to_pylist(), sample.column("label").to_pylist())), share)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row: the probability that it is toxic, by its text alone.

    Null and empty texts get the score of a window without any saving; repeated rows repeat; a null id stays null."""
    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    schema = pa.schema([(id_column, _arrow(kind)), ("score", pa.float64())])
    return docs.select(id_column, F.col(text_column).alias("text")).mapInArrow(partial(score_rows, model=model, schema=schema), f"{id_column} {kind.simpleString()}, score double")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (columns as they are) that the model does not hold to be toxic."""
    ready(docs.sparkSession)
    schema = pa.schema([(f.name, _arrow(f.dataType)) for f in docs.schema])

    def kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = pa.schema([("text", pa.string()), ("score", pa.float64())])
        for batch in rows:
            batch = batch.cast(schema)
            for out in score_rows(iter([batch]), model, scored):
                yield batch.filter(pa.array(out.column("score").to_numpy() < threshold))

    return docs.mapInArrow(kept, docs.schema)
