"""Matrices: ranges of rows, numbered parts, faults."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible.sources.matrices import read_matrix, write_matrix


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int16])
@pytest.mark.parametrize("order", ["C", "F"])
def test_files_are_read_by_ranges(spark, tmp_path, kind, order):
    m = np.asarray(np.arange(3000).reshape(1000, 3), kind, order)
    np.save(tmp_path / "m.npy", m)
    df = read_matrix(spark, str(tmp_path / "m.npy"), block=300 * 3 * m.itemsize)
    assert df.rdd.getNumPartitions() == (4 if order == "C" else 1)
    rows = df.orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(1000)) and np.array_equal([r.vector for r in rows], m)


def test_other_files_are_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([[{}]], object), allow_pickle=True)
    np.save(tmp_path / "one.npy", np.arange(3.0))
    for name in ("o.npy", "one.npy"):
        with pytest.raises(Exception, match="matrix of numbers"):
            read_matrix(spark, str(tmp_path / name)).count()


def test_round_trip_in_parts(spark, tmp_path):
    """Parts of bounded size from several tasks, in the order of identifiers; writing again replaces all."""
    df = spark.range(5000).select(F.format_string("r%05d", (F.col("id") * 7919) % 5000).alias("name"), F.array(F.col("id").cast("float"), F.rand(1).cast("float")).alias("v")).repartition(5)
    at = str(tmp_path / "out")
    for source in (df.limit(10), df):
        n = write_matrix(source, "name", "v", at, block=8 * 600)
    parts = json.loads((tmp_path / "out" / "matrix.json").read_text())
    assert n == parts["rows"] == 5000 and parts["components"] == 2 and all(p["rows"] <= 600 for p in parts["parts"])
    assert {p["file"] for p in parts["parts"]} == {p.name for p in (tmp_path / "out").glob("part-*.npy")}
    whole = np.concatenate([np.load(tmp_path / "out" / p["file"]) for p in parts["parts"]])
    want = {r.name: r.v for r in df.collect()}
    assert np.array_equal(whole, np.array([want[k] for k in sorted(want)], np.float32))
    ids = {int(r.row_index): r.name for r in spark.read.option("header", True).option("sep", "\t").csv(f"{at}/ids.tsv").collect()}
    assert [ids[i] for i in range(5000)] == sorted(want)
    back = read_matrix(spark, at, block=8 * 250)
    assert back.rdd.getNumPartitions() > 10 and {r.row_index: r.vector for r in back.collect()} == {i: want[ids[i]] for i in range(5000)}


def test_one_file_by_places(spark, tmp_path):
    df = spark.range(3000).select(((F.col("id") * 1237) % 3000).alias("id"), F.array(*(F.rand(i).cast("float") for i in range(3))).alias("v")).repartition(6)
    for source in (df.limit(7), df):
        n = write_matrix(source, "id", "v", str(tmp_path / "m"), single=True, block=12 * 200)
    want = {r.id: r.v for r in df.collect()}
    assert n == 3000 and np.array_equal(np.load(tmp_path / "m" / "vectors.npy", mmap_mode="r"), np.array([want[i] for i in range(3000)], np.float32))
    assert [p.name for p in (tmp_path / "m").iterdir() if p.suffix != ".tsv"] == ["vectors.npy"]
    assert read_matrix(spark, str(tmp_path / "m"), block=12 * 500).rdd.getNumPartitions() == 6
    with pytest.raises(Exception, match="length"):
        write_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<float>"), "id", "v", str(tmp_path / "m"), single=True)
    assert np.load(tmp_path / "m" / "vectors.npy").shape == (3000, 3)


def test_empty_and_faulty_tables(spark, tmp_path):
    kind = "id long, v array<float>"
    assert write_matrix(spark.createDataFrame([], kind), "id", "v", str(tmp_path / "none")) == 0
    assert read_matrix(spark, str(tmp_path / "none")).count() == 0
    for rows, why in (([(1, [1.0]), (2, [1.0, 2.0])], "length"), ([(1, [1.0]), (2, None)], "null"), ([(1, [1.0, None])], "null")):
        with pytest.raises(Exception, match=why):
            write_matrix(spark.createDataFrame(rows, kind), "id", "v", str(tmp_path / "bad"))
        assert not (tmp_path / "bad" / "matrix.json").exists()


def test_identifiers_may_repeat(spark, tmp_path):
    assert write_matrix(spark.createDataFrame([(1, [1.0])] * 3 + [(None, [2.0])], "id long, v array<float>"), "id", "v", str(tmp_path / "m")) == 4
    assert sorted(r.vector[0] for r in read_matrix(spark, str(tmp_path / "m")).collect()) == [1.0, 1.0, 1.0, 2.0]
