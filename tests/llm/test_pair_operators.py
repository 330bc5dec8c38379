"""Near duplicates, fingerprints and nearest neighbours against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import fingerprint, jaccard, neighbours

DOCS = "doc_id long, text string, key string, size int, _gone0 int"


def runs(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def corpus():
    r = random.Random(3)
    word = lambda: "w" + str(r.randrange(400))
    passage = " ".join(word() for _ in range(15))
    texts = [" ".join(word() for _ in range(r.randint(3, 120))) for _ in range(60)]
    texts += [passage + " " + " ".join(word() for _ in range(r.randint(1, 60))) for _ in range(60)]
    base = [word() for _ in range(150)]
    for _ in range(90):  # one large group of near copies, at very different distances from each other
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [texts[0]] * 40 + [texts[1].upper(), "a b c", "A  b\nc", "a b c d", "", None, " \n", "one", "one two three four five", "one two three four five six"]
    return [(i, t, "k", 1, 0) for i, t in enumerate(texts)]


def brute(rows):
    classes = defaultdict(list)
    for i, t, *_ in rows:
        classes[runs(t)].append(i)
    sets = list(classes)
    links = defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for a, s in enumerate(sets):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least = min(i for b in seen for i in classes[sets[b]])
        for i in classes[s]:
            out[i] = (least, len(classes[s]) - 1 + sum(len(classes[sets[b]]) for b in links[a]), len(links[a]))
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_join_is_brute_force(spark, block):
    rows = corpus()
    got = jaccard.join_rows(spark.createDataFrame(rows, DOCS), jaccard.Settings(block=block)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_texts) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, *_ in brute(rows).values()})


def test_repeated_and_missing_ids(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(1, long, "a", 1, 0), (1, long, "b", 1, 0), (1, "other words here", "c", 1, 0), (None, long + " x", "d", 1, 0), (None, "alone", "e", 1, 0), (None, "alone", "f", 1, 0), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    joined = jaccard.join_rows(docs).collect()
    assert len(joined) == len(rows)
    assert sorted((r.class_id is None, r.n_links) for r in joined) == [(False, 0), (False, 0), (False, 2), (False, 2), (False, 2), (True, 1), (True, 1)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(docs).collect())
    assert kept == [(0, "alone"), (1, "other words here"), (1, long), (2, "")]
    assert jaccard.join_rows(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    rows = corpus()
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, *_ in brute(rows).values()})


def test_pruning_table():
    s = jaccard.Settings()
    least = jaccard.least_matches(s)
    assert least == sorted(least) and len(least) == s.values // s.step
    # Dropping at the posterior's tolerance hardly ever drops a pair at the threshold.
    r = np.random.default_rng(0)
    same = r.random((20000, s.values)) < 0.8
    sums = np.cumsum(same, axis=1)[:, s.step - 1 :: s.step]
    assert (sums < np.array(least)).any(axis=1).mean() < 1e-3


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.key: r.label for r in jaccard.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


PIECES = "doc_id long, text string, bucket int, hash string"


def fingerprint_rows(spark, rows):
    return fingerprint.compare_with_next(spark.createDataFrame(rows, PIECES)).collect()


def test_fingerprints(spark):
    r = random.Random(8)
    texts = ["", None, "x", "ab", "one line\nand one\n" * 40, "éß𝔘" * 100, "same", "same", "word " * 20000]
    texts += [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(1, 300))) for _ in range(40)]
    rows = [(i * 7, t, 1, "h") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint_rows(spark, rows)}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda x: -x[0])
    names = defaultdict(set)
    for (i, t, *_), (_, following, *_) in zip(ordered, [*ordered[1:], ordered[0]]):
        t, k = t or "", len(t or "") // 3
        edited = t[: len(t) - k] + (following or "")[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        names[got[i].fingerprint].add(t)
        assert got[i].near_edited == pytest.approx(fingerprint.compared_fingerprints(got[i].fingerprint, got[i].edited_fingerprint))
        if edited == t:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1
    assert all(len(v) == 1 for v in names.values())
    long = [r for r in got.values() if r.n_chars > 400 and r.doc_id > 60]
    assert len(long) > 20 and all(r.near_edited > 0.25 > r.near_next for r in long)
    for (i, *_), (j, *_) in zip(ordered, [*ordered[1:], ordered[0]]):
        assert got[i].near_next == pytest.approx(fingerprint.compared_fingerprints(got[i].fingerprint, got[j].fingerprint))


def test_rows_without_ids_are_parted(spark):
    rows = [(None, f"text number {i}", 1, "h") for i in range(300)] + [(7, f"another {i}", 1, "h") for i in range(300)]
    df = fingerprint.compare_with_next(spark.createDataFrame(rows, PIECES))
    assert df.count() == 600
    assert max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) < 400


def test_ranges_need_no_aggregate_by_range_and_no_join(spark):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, f"text number {i}", 1, "h") for i in range(500)], PIECES).mapInArrow(counting, PIECES)
    df = fingerprint.compare_with_next(rows)
    assert len(df.collect()) == 500
    assert read.value == 3 * 500  # sizes and the first row, the sample, the texts
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Sort [") == 1
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(fingerprint.READ_ROWS)


def test_rows_find_their_range(spark):
    ids = [None, -(2**63) + 1, -5, 0, 7, 7, 2**63 - 1]
    hashes = [-(2**63), -1, 0, 1, 2**63 - 1]
    place = {(i, h): (i is None, -i if i is not None else 0, h) for i in ids for h in hashes}
    cuts = sorted(place.values())[1::2]
    df = spark.createDataFrame(list(place), "id long, hash long").withColumn("bucket", fingerprint.ranged(cuts))
    for r in df.withColumn("at", fingerprint.listed([*range(-1, len(cuts) - 1), None], "bucket")).collect():
        assert r.bucket == sum(c <= place[r.id, r.hash] for c in cuts)
        assert r["at"] == (r.bucket - 1 if r.bucket < len(cuts) else None)


def test_odd_fingerprint_rows(spark):
    rows = [(5, "a b c d e f", 1, "h"), (5, "a b c d e f", 1, "h"), (None, "none", 1, "h"), (9, None, None, None)]
    assert sorted((r.doc_id or 0, r.n_chars) for r in fingerprint_rows(spark, rows)) == [(0, 4), (5, 11), (5, 11), (9, 0)]
    assert [r.near_next for r in fingerprint_rows(spark, [(1, "alone", 1, "h")])] == [1.0]
    assert fingerprint_rows(spark, []) == []


def test_peeling_recovers_the_difference():
    r = random.Random(2)
    data = ["\n".join(str(r.randrange(10**9)) for _ in range(n)) for n in (1, 5, 80, 800, 0)]
    data += [d + "\nmore\nmore\nmore" for d in data]
    digest, sizes = fingerprint.paragraphs(data)
    assert sizes.tolist() == [1, 5, 80, 800, 0, 4, 8, 83, 803, 3]
    starts = np.cumsum(sizes) - sizes
    sets = [set(digest[s : s + n].tolist()) for s, n in zip(starts, sizes)]
    assert [len(s) for s in sets] == sizes.tolist()
    left, right = np.array([0, 1, 2, 3, 4, 2, 3]), np.array([5, 6, 7, 8, 9, 3, 4])
    apart = fingerprint.differences(digest, sizes, left, right)
    assert apart.tolist() == [len(sets[a] ^ sets[b]) for a, b in zip(left, right)]
    names = fingerprint.fingerprints(digest, sizes)
    assert [set(fingerprint.recovered(n).tolist()) for n in names] == sets
    for a, b in zip(left, right):
        assert fingerprint.compared_fingerprints(names[a], names[b]) == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b]))


def test_an_edit_changes_no_other_paragraph():
    r = random.Random(4)
    sentences = [" ".join(f"w{r.randrange(10**6)}" for _ in range(8)) + "." for _ in range(60)]
    text = " ".join(sentences)
    other = text.replace(sentences[30], "Something else stands here.")
    a, b = list(fingerprint.paragraphs_of(text)), list(fingerprint.paragraphs_of(other))
    assert len(a) > 10 and len(set(a) ^ set(b)) <= 4
    assert " ".join(a) == text
    endless = [list(fingerprint.paragraphs_of(" ".join(f"w{i}" for i in range(k, 3000)))) for k in (0, 1)]
    assert len(endless[0]) > 50 and len(set(endless[0]) ^ set(endless[1])) <= 2


def test_digests_do_not_depend_on_the_batch():
    data = ["one\ntwo\nthree", "", "x" * 500, "\u00e9\n" * 3]
    digest, sizes = fingerprint.paragraphs(data)
    alone = [fingerprint.paragraphs([d])[0].tolist() for d in data]
    starts = np.cumsum(sizes) - sizes
    assert [digest[s : s + n].tolist() for s, n in zip(starts, sizes)] == alone


VECTORS = "vec_id long, embedding array<float>, id int, vector string, rank int"


def nearest(rows, k=5):
    fine = [(i, np.array(v, dtype=float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    out = {}
    for i, q in fine:
        if i % 50:
            continue
        near = [(-(x @ q) / (np.linalg.norm(x) * np.linalg.norm(q)), j) for j, x in fine if j != i]
        out[i] = [j for _, j in sorted((round(a, 12), j) for a, j in near)[:k]]
    return out


def search(spark, rows, s=neighbours.Settings()):
    df = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 50 = 0").select("vec_id"), s=s).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return got


def test_neighbours(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=8)], 1, "x", 2) for i in range(600)]
    hot = rows[3][1]
    rows += [(i, hot, 1, "x", 2) for i in range(600, 900)]  # a third of all rows
    rows += [(1000, None, 1, "x", 2), (1050, [], 1, "x", 2), (1100, [0.0] * 8, 1, "x", 2), (1150, [float("nan")] * 8, 1, "x", 2), (1151, [1.0, None] * 4, 1, "x", 2), (1152, [1.0] * 7, 1, "x", 2), (None, hot, 1, "x", 2)]
    got, want = search(spark, rows), nearest(rows)
    assert set(got) == set(want)
    assert all([n for n, *_ in v] == [1, 2, 3, 4, 5] for v in got.values())
    assert all(i not in [j for _, j, _ in v] for i, v in got.items())
    hits = sum(len({j for _, j, _ in got[i]} & set(want[i])) for i in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [j for _, j, _ in got[650]] == want[650] == [3, 600, 601, 602, 603]


def test_few_vectors(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0, 0.0], 1, "x", 1)]) == {}
    got = search(spark, [(0, [1.0, 0.0], 1, "x", 1), (3, [2.0, 0.0], 1, "x", 1), (2, [1.0, 1.0], 1, "x", 1)])
    assert [(j, round(s, 6)) for _, j, s in got[0]] == [(3, 1.0), (2, 0.707107)]


def test_equal_vectors_only(spark):
    got = search(spark, [(i, [1.0, 2.0], 1, "x", 1) for i in range(0, 200)])
    assert [j for _, j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for _, j, _ in got[100]] == [0, 1, 2, 3, 4]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t, *_ in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {c for c, *_ in brute(rows).values()}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_learns_and_filters(spark, tmp_path):
    import corpus_pipeline

    from tests.llm.test_learned_operators import corpus as labelled_corpus

    docs, labels = labelled_corpus()
    rows = [(i, t, "en", "s", len(t)) for i, t, *_ in docs] + [(5000, docs[0][1], "en", "s", 1), (5001, None, None, None, None), (None, docs[3][1] + " more", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    good = {i for i, q, t in labels if q and not t}
    bad = {i for i, q, t in labels if not q or t}
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.05 * len(bad)
    assert 5000 not in kept and None not in kept


def test_pipeline_without_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
