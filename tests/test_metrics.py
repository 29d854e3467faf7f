"""Runs without losses, without a drawdown, without gains or of one day: queries against their SQL."""

import math
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidelane.plans import catalog

#: A run's discounts less its taxes, day by day.
RUNS = {
    "gains": [0.05, 0.02, 0.04, 0.01, 0.03],
    "losses": [-0.02, -0.01, -0.03, -0.01, -0.02],
    "fall first": [-0.02, 0.01, 0.0, 0.005, 0.001],
    "nothing": [0.0, 0.0, 0.0, 0.0],
    "one day": [0.03],
    "mixed": [0.05, -0.02, 0.03, -0.04, 0.06],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    rows = [(run, datetime(1995, 1, 2) + timedelta(days=30 * k), 10_000.0 + 100 * k, max(x, 0.0), max(-x, 0.0)) for run, days in RUNS.items() for k, x in enumerate(days)]
    names = "l_returnflag l_shipdate l_extendedprice l_discount l_tax".split()
    pq.write_table(pa.table({n: pa.array(list(c), pa.timestamp("us") if n == "l_shipdate" else None) for n, c in zip(names, zip(*rows))}), at / "lineitem.parquet")
    return str(at)


def same(a, b) -> bool:
    if not (isinstance(a, float) and isinstance(b, float)):
        return a == b
    return math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-6, abs_tol=1.1e-6)


@pytest.mark.parametrize("name", ["cagr_calmar", "objective_calmar", "run_summary", "profit_factor", "run_reconciled", "objective_composite", "wfo_aggregate"])
def test_nothing_to_divide_by(spark, folder, name):
    df = catalog.queries()[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    r = con.sql(catalog.oracle_sql()[name])
    want = {x["run"]: x for x in (dict(zip(r.columns, row)) for row in r.fetchall())}
    got = {x["run"]: x.asDict() for x in df.collect()}
    assert set(got) == set(want) == set(RUNS)
    assert [(run, c, got[run][c], x) for run in RUNS for c, x in want[run].items() if not same(got[run][c], x)] == []
