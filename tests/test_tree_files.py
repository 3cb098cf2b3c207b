import random

import pytest

from isopanel.sources import fasta, tree_files


def newick(rng, n):
    """A random tree with names in quotes, comments and white space here and there."""
    parts = [f"t{i}" if rng.random() > 0.2 else f"'a, ({i}) b'" for i in range(n)]
    while len(parts) > 1:
        k = rng.randint(1, min(4, len(parts)))
        at = rng.randint(0, len(parts) - k)
        inside = (rng.choice([",", ", ", ",\n"])).join(p + (f":{rng.randint(0, 99) / 10}" if rng.random() > 0.1 else "") + rng.choice(["", "[&x=1,y={2,3}]"]) for p in parts[at : at + k])
        parts[at : at + k] = [f"({inside})" + rng.choice(["", f"n{rng.randint(0, 9)}", "'in, ner'"])]
    return parts[0] + ";"


@pytest.mark.parametrize("n", [1, 2, 12, 150])
def test_large_newick_equals_the_parser(spark, tmp_path, n):
    rng = random.Random(n)
    text = newick(rng, n) + "\n"
    (tmp_path / "t.nwk").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        got = tree_files.read_large_newick(spark, f"{tmp_path}/t.nwk").orderBy("node").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == fasta.parse_newick(text.strip())


def test_nexus(spark, tmp_path):
    text = """#NEXUS
begin trees;
  Translate 1 Alpha, 2 'Beta, b', 3 Gamma;
  tree one = [&R] ((1:1,2:2)x:0.5,3);
  utree * two = (3:1,(1,9));
end;
"""
    (tmp_path / "t.nex").write_text(text)
    got = tree_files.read_nexus(spark, f"{tmp_path}/t.nex").orderBy("tree", "node").collect()
    want = [("one", 0, None, None, ""), ("one", 1, 0, 0.5, "x"), ("one", 2, 1, 1.0, "Alpha"), ("one", 3, 1, 2.0, "Beta, b"), ("one", 4, 0, None, "Gamma")]
    want += [("two", 0, None, None, ""), ("two", 1, 0, 1.0, "Gamma"), ("two", 2, 0, None, ""), ("two", 3, 2, None, "Alpha"), ("two", 4, 2, None, "9")]
    assert [tuple(r)[1:] for r in got] == want
