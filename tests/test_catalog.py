"""Registered queries against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from conftest import DATA

from pixelframe.plans import catalog

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(round(float(r[i]), 6) if isinstance(r[i], int | float) else r[i] for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_color_distance_of_a_tall_image(spark, tmp_path):
    ids = [0, 4_639_000, 4_639_199, 5_999_999]  # rows 46,390, whose square with 50 off just fits an INT, and on
    spark.createDataFrame([(i, i % 1500, 7.5) for i in ids], "event_id bigint, user_id bigint, value double").selectExpr("*", "timestamp '2024-01-01 00:00:42' AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["color_distance"](spark, str(tmp_path)).collect()
    want = [("events", i // 100, i % 100, (7 - 10) ** 2 + (42 - 30) ** 2 + (i % 1500 % 256 - 20) ** 2, (i % 100 - 50) ** 2 + (i // 100 - 50) ** 2) for i in ids]
    assert sorted(map(tuple, got)) == sorted(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1000
    assert set(e.oracle_sql()) <= set(e.queries())
