"""The smallest of signals that are equal but for the last bits of their running sums."""

import datetime

import duckdb
import pytest

from helpers import rows_of
from strataflow.plans import registry

LARGER = "/root/testdata/sf0.1"


def test_sums_that_differ_in_last_bits_tie(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [("click", 0.1), ("click", 0.2), ("purchase", 5.0), ("view", 0.3)]  # 0.1 + 0.2 is above 0.3
    rows = [(n, start + datetime.timedelta(minutes=n), 1, kind, value, "{}") for n, (kind, value) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.row_id: r.best for r in registry.QUERIES["cross_signal_stats"](spark, str(tmp_path)).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 1}


@pytest.mark.parametrize("name", ["cross_signal_stats"])
def test_larger_tables_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{LARGER}/events.parquet'")
    assert rows_of(registry.QUERIES[name](spark, LARGER).toPandas()) == rows_of(con.execute(registry.ORACLES[name]).df())
