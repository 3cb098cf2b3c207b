import random
from collections import Counter

from pyspark.sql import functions as F

from isopanel.functions.scalars import accession
from isopanel.operators import positions
from isopanel.sources import fasta


def test_rows_of_files_in_blocks(spark, tmp_path):
    lines = [f"line {i}" + "x" * (i % 50) for i in range(3000)]
    for n, low in enumerate(range(0, 3000, 1000)):
        (tmp_path / f"{n}.txt").write_text("\n".join(lines[low : low + 1000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = positions.file_rows(spark.read.text(f"{tmp_path}/*.txt").where("value NOT LIKE 'line 7x%'"), F.col("value"))
        spans = spark.read.text(f"{tmp_path}/*.txt").select("_metadata.file_block_start", "_metadata.file_path").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert spans > 12
    assert [tuple(r) for r in found.orderBy("row").collect()] == list(enumerate(x for x in lines if not x.startswith("line 7x")))


def test_numbers_within_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    found = positions.numbered(df, ["g"], ["v", "i"], parts=5).collect()
    for g in ("a", "b", None):
        want = sorted((v, i) for h, v, i in rows if h == g)
        assert [(r["v"], r["i"]) for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["place"])] == want
        assert sorted(r["place"] for r in found if r["g"] == g) == list(range(len(want)))
    assert sorted(r["place"] for r in positions.numbered(df, [], ["i"]).collect()) == list(range(500))
    assert positions.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_filled_by_position(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">EPI_ISL_{i} G>A\nAC\nGT\n" for i in range(6)))
    headers = positions.file_rows(fasta.records(spark, f"{tmp_path}/x.fa"), accession(fasta.header()).alias("accession"))
    ids = spark.createDataFrame([(i, "lost" if i in (1, 4) else f"EPI_ISL_{i}", "n") for i in range(6)] + [], "row long, accession string, note string")
    known = spark.createDataFrame([(f"EPI_ISL_{i}",) for i in (0, 1, 1, 2, 3, 5)] + [(None,)], "accession string")
    rows, agrees = positions.filled_by_position(ids, headers, known)
    assert agrees and [r["accession"] for r in rows.orderBy("row").collect()] == ["EPI_ISL_0", "EPI_ISL_1", "EPI_ISL_2", "EPI_ISL_3", "lost", "EPI_ISL_5"]
    rows, agrees = positions.filled_by_position(ids, headers.where("row < 5"), known)
    assert not agrees and [r["accession"] for r in rows.orderBy("row").collect()].count("lost") == 2


def greedy(costs, budget):
    out, batch, used, some = [], 0, 0, False
    for cost in costs:
        if some and used + cost > budget:
            batch, used = batch + 1, 0
        some = True
        used += cost
        out.append(batch)
    return out


def test_batches_equal_the_greedy(spark):
    rng = random.Random(1)
    for _ in range(3000):
        costs = sorted(rng.choices(range(1, 15), k=rng.randint(0, 40)), reverse=True)
        budget = rng.randint(1, 40)
        sizes = sorted(Counter(costs).items(), reverse=True)
        runs = positions.batch_runs(sizes, budget)
        got = [r.first + (0 if p < r.lead else 1 + (p - r.lead) // r.each) for r, (_, n) in zip(runs, sizes, strict=True) for p in range(n)]
        assert got == greedy(costs, budget)
    lengths = [rng.choice([5, 5, 5, 90, 400, 7]) for _ in range(1200)] + [100_000]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)] + [(5000, None, "x")], "id long, n int, batch_size string")
    found = positions.token_batches(df.repartition(5), "n", "id", 1000).collect()
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    want = dict(zip(order, greedy([lengths[i] + 2 for i in order], 1000), strict=True)) | {5000: None}
    assert {r["id"]: r["batch"] for r in found} == want and len(found) == len(want)
    assert positions.token_batches(df.limit(0), "n", "id", 10).count() == 0
