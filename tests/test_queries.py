"""Every query of the mining part against its SQL in DuckDB."""

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from taskloom.plans import candidates, records  # noqa: F401  (register their queries)
from taskloom.plans.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, str(SF)).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [df[columns].astype(str).sort_values(columns).reset_index(drop=True) for df in (got, want)]
    assert rows[0].equals(rows[1])


def test_before_cutoff_has_every_order(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1 + k % 7, k % 5, k % 3) for k in range(300)]
    orders = [(k, t) for k, t in enumerate(at)] + [(3, at[40]), (900, None), (None, at[5])]
    events = [(k, dt.datetime(2024, 1, 2 + k % 4, k % 6)) for k in range(50)] + [(60, None), (None, at[0]), (61, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    want = Counter()
    for key, t in orders:
        want[key] += sum(i is not None and (ts is None or (t is not None and ts < t)) for i, ts in events)
    assert {r.o_orderkey: r.before for r in QUERIES["before_cutoff"](spark, str(tmp_path)).collect()} == dict(want)
    assert QUERIES["before_cutoff"](spark, str(SF)).count() == spark.read.parquet(str(SF / "orders.parquet")).select("o_orderkey").distinct().count()
