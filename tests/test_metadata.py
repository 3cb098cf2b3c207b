import pytest
from pyspark.sql import functions as F

from isopanel.functions import scalars
from isopanel.operators import metadata as M
from isopanel.sources import delimited


def test_many_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, x string")
    right = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k long, y string")
    assert sorted(map(tuple, M.many_to_one(left, right, ["k"]).collect())) == [(1, "a", "one"), (1, "b", "one"), (2, "c", "two")]
    with pytest.raises(ValueError):
        M.many_to_one(left, right.unionAll(right), ["k"])
    with pytest.raises(Exception, match="no match"):
        M.many_to_one(left, right.where("k <> 2"), ["k"]).collect()


def test_broken_rows_are_an_error(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\tone\nnone\ttwo\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        delimited.read_delimited(spark, str(tmp_path / "a.tsv"), "x int, y string", sep="\t").collect()
    assert delimited.plain_or_gz(spark, str(tmp_path / "a.tsv")).endswith("a.tsv") and delimited.plain_or_gz(spark, str(tmp_path / "b.tsv")).endswith("b.tsv.gz")


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalars.seed_list(F.lit("0-3, 7"))) == [0, 1, 2, 3, 7] and one(scalars.seed_list(F.lit(""))) == []
    assert one(scalars.virus_name_key(F.lit("Spike|hCoV-19/X Y/12/2021|z"))) == "hCoV-19/XY/12"
    assert one(scalars.graph_family(F.lit("hamming_mst"))) == "MST"
    assert one(scalars.ratio_text(F.lit(1234.5))) == "1,234.50" and one(scalars.ratio_text(F.lit(None).cast("double"))) == "n/a"
    assert one(M.stable_seed(F.lit("a"), F.lit("b"))) == 2523025035
    with pytest.raises(KeyError):
        scalars.header_id(F.lit("x"), "none")


def test_representatives_and_orders(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None)], "k long, c string")
    assert {r["k"]: r["representative"] for r in M.represented(rows, "k", "c").collect()} == {1: 1, 3: 1, 2: 2, 4: 4}
    lists = [spark.createDataFrame(x, "accession string, position long") for x in ([("b", 0), ("a", 1), ("c", 2)], [("a", 0), ("b", 9)])]
    assert sorted((r["position"], r["accession"]) for r in M.in_order(*lists).collect()) == [(0, "b"), (1, "a")]
