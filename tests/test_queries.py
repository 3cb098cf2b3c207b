"""Some queries beside their SQL on the smallest tables, where these are at hand, and the stream on tables of its own."""

import os

import duckdb
import pandas as pd
import pytest

from isopanel.plans import registry

FOLDER = "/root/testdata/sf0.001"
SOME = "graph_summary collapsed_graph temporal_roles date_profiles rank_sum_test medoid_update patristic_distances paired_summary set_membership fasta_round_trip exact_allocation usable_records id_list seeds_together header_ids label_codes normalized_curves holm_adjusted fisher_test clock_score random_pruned matrix_slice".split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_streamed_moments(spark, tmp_path):
    rows = pd.DataFrame({"event_id": [1, 2, 3], "ts": pd.to_datetime(["2024-01-03", "2024-01-05", "2024-01-01"]), "user_id": [1, 1, 2], "event_type": ["a", "a", "b"], "value": [1.0, 2.0, 3.0], "props": ["", "", ""]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["graph"]: (r["n"], r["mean"], r["min"], r["max"]) for r in registry.QUERIES["streamed_moments"](spark, str(tmp_path)).collect()}
    assert got == {"a": (2, 3.0, 2, 4), "b": (1, 0.0, 0, 0)}
