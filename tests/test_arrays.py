import numpy as np
import pytest
from pyspark.sql import functions as F

from isopanel.sources import arrays


def rows_of(df):
    return [(r["row"], list(r["v"])) for r in df.orderBy("row").collect()]


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<i2", "|u1"])
@pytest.mark.parametrize("fortran", [False, True])
def test_npy_in_ranges_of_rows(spark, tmp_path, dtype, fortran):
    x = np.arange(60).reshape(20, 3).astype(dtype)
    np.save(tmp_path / "x.npy", np.asfortranarray(x) if fortran else x)
    found = arrays.read_npy(spark, f"{tmp_path}/x.npy", split_bytes=5 * 3 * x.itemsize)
    assert found.rdd.getNumPartitions() == 4
    assert rows_of(found) == [(i, v) for i, v in enumerate(x.astype(float).tolist())]


def test_npy_shapes_and_errors(spark, tmp_path):
    np.save(tmp_path / "flat.npy", np.arange(7))
    assert rows_of(arrays.read_npy(spark, f"file:{tmp_path}/flat.npy", 16)) == [(i, [i]) for i in range(7)]
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    assert arrays.read_npy(spark, f"{tmp_path}/none.npy").count() == 0
    np.save(tmp_path / "words.npy", np.array(["a"]))
    (tmp_path / "short.npy").write_bytes((tmp_path / "flat.npy").read_bytes()[:-8])
    for name in ("words", "short", "missing"):
        with pytest.raises(Exception, match="numbers|ends early|missing"):
            arrays.read_npy(spark, f"{tmp_path}/{name}.npy").collect()


def test_npy_folder(spark, tmp_path):
    rows = spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.array("id", -F.col("id")).alias("v"))
    arrays.write_npy(rows, f"{tmp_path}/v", dtype="<f4", file_bytes=800)
    assert len(list((tmp_path / "v").glob("*.npy"))) > 4
    (tmp_path / "v" / "part-000000-left.npy").write_bytes(b"of a task that failed")
    found = arrays.read_npy(spark, f"{tmp_path}/v", split_bytes=400)
    assert found.rdd.getNumPartitions() >= 4
    assert rows_of(found) == [(i, [float(i), float(-i)]) for i in range(1000)]
    for bad in (spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), spark.createDataFrame([(None,)], "v array<double>")):
        with pytest.raises(Exception, match="one length"):
            arrays.write_npy(bad.coalesce(1), f"{tmp_path}/bad")


def test_csr(spark, tmp_path):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((40, 30)) < 0.2, rng.integers(1, 9, (40, 30)), 0).astype(float)
    dense[5], dense[39] = 1, 0  # a full row, and an empty one at the end
    at = np.nonzero(dense)
    parts = {"indices": at[1].astype(np.int32), "indptr": np.concatenate([[0], np.cumsum((dense != 0).sum(1))]).astype(np.int32), "data": dense[at], "shape": np.array(dense.shape), "format": np.array(b"csr")}
    want = sorted(zip(at[0].tolist(), at[1].tolist(), dense[at].tolist(), strict=True))
    np.savez(tmp_path / "stored.npz", **parts)
    np.savez_compressed(tmp_path / "deflated.npz", **parts)
    for name, partitions in (("stored", 4), ("deflated", 1)):
        found = arrays.read_csr(spark, f"{tmp_path}/{name}.npz", split_bytes=12 * 50)
        assert found.rdd.getNumPartitions() >= partitions and (name == "stored" or found.rdd.getNumPartitions() == 1)
        assert sorted(map(tuple, found.collect())) == want
    entries = spark.createDataFrame(want, "row long, col long, value double").repartition(3)
    arrays.write_csr(entries, f"{tmp_path}/parts", 30, 4, file_bytes=500)
    assert len(list((tmp_path / "parts").glob("*.npz"))) > 4
    found = arrays.read_csr(spark, f"{tmp_path}/parts", split_bytes=200)
    assert sorted(map(tuple, found.collect())) == want
    np.savez(tmp_path / "csc.npz", **parts | {"format": np.array(b"csc")})
    with pytest.raises(Exception, match="csc"):
        arrays.read_csr(spark, f"{tmp_path}/csc.npz").collect()


def test_csr_of_many_entries(spark, tmp_path):
    """Far ends of all three members are read in turn: zipfile's own readers lost their places here."""
    n = 40_000
    entries = spark.range(n).select((F.col("id") / 4).cast("bigint").alias("row"), (F.col("id") % 4 * 10_000 + F.col("id") % 9_973).alias("col"), (F.col("id") + 0.5).alias("value"))
    arrays.write_csr(entries, f"{tmp_path}/many", 50_000, 1)
    found = arrays.read_csr(spark, f"{tmp_path}/many", split_bytes=1 << 14)
    assert found.rdd.getNumPartitions() > 20
    assert found.exceptAll(entries).isEmpty() and found.count() == n


def test_adjacency(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.0), (1, 9, 2.0)], "source long, target long, weight double")
    arrays.write_csr(arrays.adjacency(edges), f"{tmp_path}/a", 10, 2)
    back = arrays.read_csr(spark, f"{tmp_path}/a")
    assert sorted(map(tuple, arrays.edges_of_adjacency(back).collect())) == sorted(map(tuple, edges.collect()))
    with pytest.raises(Exception, match="not symmetric"):
        arrays.edges_of_adjacency(back.where("NOT (row = 1 AND col = 9)")).collect()
    with pytest.raises(Exception, match="order"):
        back.orderBy(F.desc("row")).coalesce(1).select("row", "col", "value").write.format("npz_csr").option("columns", 10).mode("append").save(f"{tmp_path}/bad")
