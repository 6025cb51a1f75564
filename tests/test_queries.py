"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tonegrid.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, map(tuple, frame.where(frame.notna(), None).values.tolist())))


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["attack_times", "onset_ioi_cv"])
def test_steps_that_equal_their_quantile_but_for_the_last_bit(spark, tmp_path, name):
    # each event six times in a row, so that many steps of an envelope are alike
    duckdb.sql(f"COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id, event_type, value, props FROM '{SF}/../sf0.01/events.parquet', range(6) AS r(k)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = rows_of(catalog.QUERIES[name](spark, str(tmp_path)).toPandas())
    assert len(got) > 100 and got == rows_of(con.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_kernel_query_has_a_row_per_user(spark, name):
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert catalog.QUERIES[name](spark, SF).count() == users


def test_the_registry_needs_no_corpus_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(catalog.QUERIES) and set(alone.oracle_sql()) == set(catalog.ORACLES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
