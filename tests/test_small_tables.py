"""Queries against their SQL on small tables made for what the given ones do not hold."""

from __future__ import annotations

from oracle import compare, connect
from strandloom.plans import catalog


def _differences(spark, tmp_path, name: str, **tables) -> str:
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}")
        next((tmp_path / t).glob("*.parquet")).rename(tmp_path / f"{t}.parquet")
    return compare(spark, connect(str(tmp_path)), catalog.queries()[name], catalog.oracles()[name], str(tmp_path))


def test_values_on_bounds_of_intervals(spark, tmp_path):
    docs = spark.range(1, 200).selectExpr("id as doc_id", "id * 1000 as n_chars")
    labels = spark.range(1, 200).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 3 = 0 as int) as toxic")
    assert _differences(spark, tmp_path, "lrt_interval", documents=docs, labels=labels) == ""


def test_parts_of_one_group_of_any_quantity(spark, tmp_path):
    """Small lots count as well: they add part 2 and take part 3 away."""
    lines = spark.createDataFrame([(1, 1, 50.0), (1, 1, 3.0), (2, 2, 1.0), (3, 1, 49.0), (3, 2, 10.0), (4, 1, 48.0), (4, 2, 48.0)], "l_partkey long, l_suppkey long, l_quantity double")
    suppliers = spark.createDataFrame([(1, 3), (2, 20)], "s_suppkey long, s_nationkey int")
    assert _differences(spark, tmp_path, "set_complement", lineitem=lines, supplier=suppliers) == ""
    got = catalog.queries()["set_complement"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2)]
