"""The fourth round's finding: what ids cost in shuffles, tiles, pieces, and missing parts of a name."""

import pytest

from claimloom.operators import entities
from claimloom.plans import language


def written(spark):
    """Rows that all stages so far have written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_shuffles_of_prefixes_grow_with_rows_and_not_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(entities, "BLOCK", 4)
    monkeypatch.setattr(entities, "GRID", 4, raising=False)
    cost = []
    for n in (400, 1600):
        df = spark.createDataFrame([(k, ("acme", "acme ltd")[k % 2]) for k in range(n)], "id long, name string").repartition(1)
        before = written(spark)
        assert len(entities.prefix_matches(df).collect()) == n * n // 4
        cost.append(written(spark) - before)
    assert cost[1] < 5 * cost[0]


@pytest.mark.parametrize("block, grid, piece", [(1, 2, (2, 3)), (3, 2, (1, 1)), (5, 3, (4, 2)), (1000, 1, (16, 256))])
def test_every_pair_is_given_once_by_tiles_and_pieces(spark, monkeypatch, block, grid, piece):
    for name, value in (("BLOCK", block), ("GRID", grid), ("PIECE", piece)):
        monkeypatch.setattr(entities, name, value, raising=False)
    names = ["acme", "acme", "acme ltd", "acme ltd bonn", "acme ltd bonn west", "abc", "abc d", "zinc", "solo one", None]
    rows = [(k if k % 23 else None, names[k * k % len(names)]) for k in range(70)] + [(99, "zinc"), (99, "zinc ore"), (99, "zinc ore")]
    split = [(k, n.split(" ")) for k, n in rows if n is not None]
    plain = [(a, b) for a, v in split for b, w in split if len(v[0]) >= 4 and len(v) < len(w) and w[: len(v)] == v]
    found = entities.prefix_matches(spark.createDataFrame(rows, "id long, name string")).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain))


def test_a_part_without_name_or_type_has_no_long_name(spark, tmp_path):
    rows = [(1, "ring", None), (2, "ring small", None), (3, None, "ring LARGE"), (4, "ring", "PROMO")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(tuple(r) for r in language.prefix_matches(spark, str(tmp_path)).collect()) == [(1, 1_000_004), (4, 1_000_004)]
