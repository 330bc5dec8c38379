"""Text and binary files: written and read again."""

import struct

from lattiq.sources import files


def content(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_vectors_and_graph(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\n1 2.5 -3\n4\t5  6\n")
    assert sorted(map(tuple, files.read_vectors(spark, str(tmp_path / "v.txt")).collect())) == [(0, [1.0, 2.5, -3.0]), (1, [4.0, 5.0, 6.0])]
    assert files.header(spark, str(tmp_path / "v.txt")) == (2, 3)
    (tmp_path / "g.txt").write_text("3 3\n0 1 1\n1 0 2\n1 2\n\n")
    assert sorted(map(tuple, files.read_graph(spark, str(tmp_path / "g.txt")).collect())) == [(0, 1, 1.0), (1, 0, 2.0), (1, 2, 1.0)]
    assert files.read_graph(spark, str(tmp_path / "g.txt"), dedupe=True).count() == 2
    files.write_graph(files.read_graph(spark, str(tmp_path / "g.txt")), str(tmp_path / "out"))
    assert content(tmp_path / "out") == "3 3\n0 1 1.0\n1 0 2.0\n1 2 1.0\n"


def test_layout(spark, tmp_path):
    layout = spark.createDataFrame([(i, i / 7, -i / 3) for i in range(20)], "id long, x double, y double")
    files.write_layout(layout, str(tmp_path / "l"))
    text = content(tmp_path / "l")
    assert text.splitlines()[:2] == ["20 2", "0.000000 0.000000"] and len(text.splitlines()) == 21
    again = files.read_layout(spark, str(tmp_path / "l")).orderBy("id").collect()
    assert [round(r.x, 5) for r in again] == [round(i / 7, 5) for i in range(20)]
    (tmp_path / "with_id.txt").write_text("2 2\n5 1.5 2.5\n6 3.5 4.5\n")
    assert [tuple(r) for r in files.read_layout(spark, str(tmp_path / "with_id.txt")).orderBy("id").collect()] == [(0, 1.5, 2.5), (1, 3.5, 4.5)]
    assert files.read_layout(spark, str(tmp_path / "with_id.txt"), id_column=False).orderBy("id").first().x == 5.0


def test_large_file_keeps_its_order(spark, tmp_path):
    (tmp_path / "v.txt").write_text("9000 1\n" + "".join(f"{i}\n" for i in range(9000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert files.read_vectors(spark, str(tmp_path / "v.txt")).where("v[0] <> id").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_labels_and_lists(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("3 1\n2\n0 0\n")
    labels = files.read_labels(spark, str(tmp_path / "labels.txt"))
    assert [tuple(r) for r in labels.orderBy("id").collect()] == [(0, 3), (1, 1), (2, 2), (3, 0), (4, 0)]
    assert files.classes(labels).first().classes == 4
    knn = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (1, 0, 1), (2, 0, 1)], "id long, nbr long, rank int")
    files.write_knn(knn, str(tmp_path / "knn"))
    assert content(tmp_path / "knn") == "2 1\n0\n0\n"
    assert sorted(map(tuple, files.read_knn(spark, str(tmp_path / "knn")).collect())) == sorted(map(tuple, knn.collect()))
    files.write_knn_binary(knn, str(tmp_path / "knn.bin"))
    assert sorted(map(tuple, files.read_knn_binary(spark, str(tmp_path / "knn.bin")).collect())) == sorted(map(tuple, knn.collect()))


def test_codes(spark, tmp_path):
    for table in (0, 3):
        (tmp_path / f"codes_{table}").write_bytes(struct.pack("<3i3I", 1, 8, 3, 4, 9 + table, 255))
    got = files.read_codes(spark, f"{tmp_path}/codes_*", shift=1).orderBy("tbl", "id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2), (0, 1, 4), (0, 2, 127), (3, 0, 2), (3, 1, 6), (3, 2, 127)]


def test_long_codes(spark, tmp_path):
    (tmp_path / "codes_1").write_bytes(struct.pack("<3i2Q", 1, 64, 2, 1 << 63, 5))
    assert [r.code for r in files.read_codes(spark, f"{tmp_path}/codes_*", bits=64).orderBy("id").collect()] == [-(1 << 63), 5]


def test_labels_are_numbered_over_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RUN", 3)
    (tmp_path / "labels.txt").write_text("".join(f"{i} {i + 1}\n" for i in range(0, 40, 2)))
    assert all(r.id == r.label for r in files.read_labels(spark, str(tmp_path / "labels.txt")).collect())


def test_groups(spark, tmp_path):
    files.write_groups(spark.createDataFrame([(5, 1), (2, 1), (3, 0)], "id long, community long"), str(tmp_path / "g"))
    assert content(tmp_path / "g") == "3\n2 5\n"


def test_catalogue(tmp_path):
    for name in ("a.txt", "a_vec.txt", "b_vec.txt", "c.txt"):
        (tmp_path / name).write_text("")
    assert files.catalogue(str(tmp_path)) == ["a"]


def test_command_line(spark, tmp_path, capsys):
    from lattiq.__main__ import main

    (tmp_path / "g.txt").write_text("12 11\n" + "".join(f"{i} {i + 1} 1\n" for i in range(11)))
    main(["vis", "-mode", "1", "-input", str(tmp_path / "g.txt"), "-output", str(tmp_path / "out"), "-samples", "20", "-epochs", "10", "-multilevel", "0"], spark)
    assert len(content(tmp_path / "out").splitlines()) == 13
    main(["evaluate", "-type", "2", "-graph", str(tmp_path / "g.txt"), "-layout", str(tmp_path / "out")], spark)
    assert "stress" in capsys.readouterr().out
