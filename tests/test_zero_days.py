"""Dated topic weights of users' days whose values add up to nothing, against SQL on the same rows."""

import datetime as dt

import duckdb
import pytest

from textloom import plans
from tests.test_oracle import plain

DAY = dt.datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    rows = [(u, DAY + dt.timedelta(days=i), u, kind, float(v)) for u in (1, 2, 3_000_000_004) for i in range(9) for kind, v in (("click", u % 7), ("view", i + 1))]
    rows += [(0, DAY + dt.timedelta(days=3), 6, "view", 0.0), (0, DAY + dt.timedelta(days=3), 7, "click", 0.0), (0, DAY + dt.timedelta(days=4), 8, "purchase", 0.0), (0, DAY + dt.timedelta(days=4), 8, "view", 0.0)]
    path = str(tmp_path_factory.mktemp("days"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def half(spark, tmp_path_factory):
    """Shares of a user's day that end in a five at the fifth place."""
    rows = [(0, DAY, 2 * n, kind, v) for n, x in enumerate((0.52865, 0.53775, 0.58815, 0.58715, 0.50005, 0.62345)) for kind, v in (("click", x), ("view", 1 - x))]
    path = str(tmp_path_factory.mktemp("half"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path


def same_as_sql(spark, path, name):
    df = plans.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    rel = con.sql(plans.SQL[name])
    at = [list(rel.columns).index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    return got


def test_outlier_probabilities_of_days_without_value(spark, days):
    assert sum("nan" in r for r in same_as_sql(spark, days, "outlier_probabilities")) == 2


def test_outlier_probabilities_round_as_sql(spark, half):
    same_as_sql(spark, half, "outlier_probabilities")


def test_topic_evolution_of_days_without_value(spark, days):
    assert any("nan" in r for r in same_as_sql(spark, days, "topic_evolution"))


def test_topic_sankey_of_days_without_value(spark, days):
    assert any("nan" in r for r in same_as_sql(spark, days, "topic_sankey"))


def test_topic_sankey_of_slices_without_value(spark, tmp_path):
    rows = [(0, DAY + dt.timedelta(days=i), u, kind, v) for i in range(9) for u, v in ((1, 2.0), (2, -2.0)) for kind in ("click", "view")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, str(tmp_path), "topic_sankey")
