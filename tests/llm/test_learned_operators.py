"""Toxicity and quality: held-out accuracy, what may enter a score, and odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import quality, toxicity
from lattiq.llm.common import labelled_sample, remainder

DOCS = "doc_id long, text string, label int, score double"


def corpus(n=700):
    """Ordinary words; toxic documents also hold words with one of two stems, bad ones are shouted or repeat themselves."""
    r = random.Random(5)
    syllables = ["an", "er", "st", "re", "in", "ou", "tha", "wh", "le", "on"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(30, 200))]
        toxic, bad = i % 4 == 1, i % 5 == 2
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(["zogvik", "mubrax"]) + r.choice(["", "an", "er"])
        if bad:
            words = [w.upper() + "!!" for w in words] if r.random() < 0.5 else [words[0]] * len(words)
        docs.append((i, " ".join(words), 1, 0.5))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def given(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


ODD = [(None, None, None, None), (1, "", 1, 0.0), (1, "", 1, 0.0), (2, None, 1, 0.0), (3, "word " * 60000, 1, 0.0), (4, "\n\t  ", 1, 0.0), (5, "a\0b 𝔘", 1, 0.0)]


@pytest.mark.parametrize(("module", "label", "fold", "out"), [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_held_out_accuracy(given, module, label, fold, out):
    docs, labels = given
    model = module.train(docs, labels)
    rows = module.score(docs, model).join(labels.select(F.col("doc_id"), F.col(label).alias("y")), "doc_id").where(remainder("doc_id", fold) == out).collect()
    assert len(rows) > 80
    assert sum((r.score >= 0.5) == bool(r.y) for r in rows) / len(rows) >= 0.93


@pytest.mark.parametrize(("module", "label", "fold", "out"), [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_labels_of_the_fold_are_not_learned(spark, given, module, label, fold, out):
    docs, labels = given
    wrong = labels.withColumn(label, F.when(remainder("doc_id", fold) == out, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = module.score(docs, module.train(docs, labels)), module.score(docs, module.train(docs, wrong))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, given, module):
    docs, labels = given
    model = module.train(docs, labels)
    odd = spark.createDataFrame(ODD, DOCS)
    rows = module.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert module.score(odd.limit(0), model).count() == 0


def test_without_labels(spark, given):
    docs, labels = given
    none = labels.limit(0)
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.25}
    assert toxicity.keep_ordinary(docs, toxicity.train(docs, none)).count() == docs.count()
    assert quality.keep_good(docs, quality.train(docs.limit(0), none)).count() == docs.count()
    one = labels.where("toxic = 0")
    assert toxicity.keep_ordinary(docs, toxicity.train(docs, one)).count() == docs.count()


def test_filters_keep_all_columns(given):
    docs, labels = given
    extra = docs.withColumn("key", F.array(F.lit("x"))).withColumn("ts", F.lit("2024-01-01").cast("date"))
    for kept, score in ((toxicity.keep_ordinary(extra, toxicity.train(docs, labels)), "toxicity"), (quality.keep_good(extra, quality.train(docs, labels)), "quality")):
        assert kept.columns == extra.columns and kept.schema["key"].dataType == extra.schema["key"].dataType, score
        assert 0 < kept.count() < docs.count()


def test_dictionaries_are_trained_on_their_class(given):
    docs, labels = given
    texts = {r.doc_id: toxicity.normal(r.text) for r in docs.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    data = [[t for i, t in texts.items() if (i in toxic) == side] for side in (True, False)]
    words = toxicity.words_of(*data)
    assert words and all(w.startswith((b"zogvik", b"mubrax")) for w in words)
    own, plain = toxicity.dictionaries(*data)
    assert len(own) == len(plain) and b"zogvik" in own and b"mubrax" in own and b"zogvik" not in plain


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, "a b")] * 50 + [(1, "c")] + [(i, "x" * 100) for i in range(2, 40)] + [(40, "y" * 10000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, toxic int")
    none = labelled_sample(docs, labels, "toxic", 100, bytes_per_class=64).collect()
    assert [r.doc_id for r in none] == [1]
    rows = labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(rows) == 20 and len({r.doc_id for r in rows}) == 20
    few = labelled_sample(docs, labels, "toxic", 100, bytes_per_class=6400).collect()
    assert len(few) == 39 and all(len(r.text) <= 100 for r in few)


def test_texts_beyond_the_sample_are_not_held(spark):
    """The sample is chosen by sizes: no window holds texts, and those left out are not shuffled."""
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(200)] + [(3, "longer " * 9), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", 100, bytes_per_class=64 * 64)
    assert "Window" not in sample._jdf.queryExecution().optimizedPlan().toString()
    rows = sample.collect()
    assert 2 * 80 <= len(rows) <= 2 * 82 and len({r.doc_id for r in rows}) == len(rows)
    assert all(sum(len(r.text) for r in rows if r.label == c) <= 64 * 64 for c in (0, 1))
    assert {r.text for r in rows if r.doc_id == 3} <= {"longer " * 9} and {r.text for r in rows if r.doc_id == 4} <= {""}


def test_memory_of_a_fit_on_long_texts():
    """A batch of many words takes a few numbers for each, not one for each factor."""
    import tracemalloc

    r = np.random.default_rng(1)
    rows = [(r.choice(quality.BUCKETS, 5000, replace=False).astype(np.int32), np.full(5000, 5000**-0.5), [0.0] * quality.STATS, i % 2) for i in range(64)]
    tracemalloc.start()
    quality.fit(rows, 0.5, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 * 64 * 5000


def test_windows_cover_the_text():
    pair = toxicity.compressors(b"zogvik", b"an er st re")
    for n in (1, 63, 64, 65, 115, 116, 117, 1000):
        assert toxicity.savings(b"x" * n, *pair).sum() == len(range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE))
        starts = list(range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE))
        assert starts[-1] + toxicity.WINDOW >= n


def test_measures_of_counts():
    counts = np.array([[5, 0, 2, 1] + [0] * 9, [3] + [0] * 12])
    m = toxicity.measures(counts, np.zeros(toxicity.SAVED))
    assert m[0, 0] == 3 and m[0, 1] == pytest.approx(7 / 3) and m[0, 2] == pytest.approx(7 / 8) and m[0, 3] == pytest.approx(3 / 8)
    assert m[1, 0] == 0 and m[1, 1] == 0


def test_sum_of_squares_identity():
    random_ = np.random.default_rng(1)
    model = quality.Model(0.3, random_.normal(size=quality.BUCKETS + quality.STATS), random_.normal(size=(quality.BUCKETS + quality.STATS, quality.RANK)) * 0.1, np.zeros(quality.STATS), np.ones(quality.STATS))
    where, value, stats = quality.features("some words and some more words!", quality.Buckets())
    stats = np.clip(np.array(stats), -4, 4)
    index, x = np.concatenate([where, np.arange(quality.BUCKETS, quality.BUCKETS + quality.STATS)]), np.concatenate([value, stats])
    margin = 0.3 + model.linear[index] @ x + sum(model.factors[index[i]] @ model.factors[index[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert model.score(where, value, stats) == pytest.approx(1 / (1 + np.exp(-margin)))


def test_remainder(spark):
    rows = spark.createDataFrame([(7,), (None,)], "doc_id long").select("doc_id", remainder("doc_id", 5).alias("r")).collect()
    assert {r.doc_id: r.r for r in rows} == {7: zlib.crc32(b"7") % 5, None: 0}
