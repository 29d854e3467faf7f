"""Blocks of a series against the plain pass over it."""

import random

import pytest
from pyspark.sql import functions as F

from tidelane.functions import kernels
from tidelane.operators import bars as B
from tidelane.operators import blocks
from tidelane.operators import windows as W


@pytest.fixture(scope="module")
def walk(spark):
    """Two series, one of 700 bars and one of 5, with gaps in time."""
    random.seed(7)
    rows, x = [], 100.0
    for series, n in (("long", 700), ("short", 5)):
        ts = 0
        for k in range(n):
            ts += random.choice((1, 1, 1, 50)) * 1000
            o, x = x, x + random.gauss(0, 2)
            rows.append((series, k, ts, o, max(o, x) + random.random(), min(o, x) - random.random(), x, random.randint(1, 9) + 0.0))
    return spark.createDataFrame(rows, "series string, bar_idx long, ts_ms long, o double, h double, l double, c double, v double").cache()


def series(df, *columns):
    out = {}
    for r in sorted(df.select("series", "bar_idx", *columns).collect()):
        out.setdefault(r[0], []).append(r[2] if len(columns) == 1 else tuple(r[2:]))
    return out


def folded(walk, make):
    out = {}
    for s, xs in series(walk, "c").items():
        step = make()
        out[s] = [step(x) for x in xs]
    return out


def same(a, b, by=1e-9):
    assert a.keys() == b.keys()
    for s in a:
        assert a[s] == pytest.approx(b[s], rel=by, abs=by)


@pytest.mark.parametrize(("alpha", "chunk"), [(0.9, 256), (0.5, 5), (2 / 21, 256), (1 / 14, 16), (0.001, 16), (1.0, 256)])
def test_smooth(walk, alpha, chunk):
    same(series(blocks.smooth(walk, "c", alpha, "s", chunk), "s"), folded(walk, lambda: kernels.Smooth(alpha).step))


@pytest.mark.parametrize(("alpha", "rows", "chunk"), [(0.5, 16, 4), (0.07, 16, 8), (0.07, 4096, 256), (0.01, 64, 32)])
def test_trend_line(walk, alpha, rows, chunk):
    same(series(blocks.trend_line(walk, "c", alpha, "t", rows, chunk), "t"), folded(walk, lambda: kernels.Trend(alpha).step))


@pytest.mark.parametrize(("alpha", "rows", "chunk"), [(0.42, 8, 4), (0.07, 64, 16), (0.07, 4096, 256)])
def test_cycle(walk, alpha, rows, chunk):
    def make():
        c = kernels.Cycle()
        return lambda x: c.step(x, alpha)

    same(series(blocks.cycle(walk, "c", alpha, "y", rows, chunk), "y"), folded(walk, make))


CASES = {
    "sma": (lambda d: d.withColumn("y", W.sma("c", 20)), 19, 19),
    "high": (lambda d: d.withColumn("y", W.highest("h", 10)), 9, 0),
    "pivot": (lambda d: W.pivot(d, "h", 5, 5, True, "y"), 10, 0),
    "swing": (lambda d: d.withColumn("y", W.extreme("l", 4, 6, False)), 4, 6),
    "strength": (lambda d: W.strength(d, "c", 30, 60, "y"), 30, 0),
    "bundle": (lambda d: W.gaussian_bundle(d, "c", [10, 15, 30], 3.0, "y").withColumn("y", F.col("y")[2]), 29, 0),
    "range": (lambda d: d.withColumn("y", W.true_range()), 1, 0),
}


@pytest.mark.parametrize("rows", [64])
@pytest.mark.parametrize("case", sorted(CASES))
def test_windows_in_blocks(walk, case, rows):
    f, back, ahead = CASES[case]
    got, want = series(blocks.spread(walk, f, back, ahead, rows), "y"), series(f(walk), "y")
    same({s: [-1e9 if x is None else x for x in xs] for s, xs in got.items()}, {s: [-1e9 if x is None else x for x in xs] for s, xs in want.items()})


@pytest.mark.parametrize("rows", [32, 4096])
def test_latch_over_blocks(walk, rows):
    got, want = blocks.multi_trend(walk, rows, range_length=30), W.multi_trend(walk, range_length=30)
    assert sorted(got.select("series", "bar_idx", "trend").collect()) == sorted(want.select("series", "bar_idx", "trend").collect())
    assert want.select("trend").distinct().count() == 2
    same(series(got, "line"), series(want, "line"))


@pytest.mark.parametrize("rows", [3, 4096])
def test_positions(walk, rows):
    got = blocks.indexed(walk.drop("bar_idx"), rows)
    assert sorted(got.select("series", "ts_ms", "bar_idx").collect()) == sorted(walk.select("series", "ts_ms", "bar_idx").collect())
    assert sorted(B.indexed(walk.drop("bar_idx")).select("series", "bar_idx", "ts_ms").collect()) == sorted(walk.select("series", "bar_idx", "ts_ms").collect())
    assert blocks.indexed(walk.drop("bar_idx").limit(0)).count() == 0


def test_one_series_is_dealt_by_blocks(walk):
    plan = blocks.smooth(walk, "c", 0.1, "s")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(series" in plan and "Python" not in plan and "Pandas" not in plan
    assert all("_k" in x for x in plan.split("hashpartitioning(")[1:])


@pytest.mark.parametrize("span", [7000, 10**9])
def test_last_before_and_intervals(spark, walk, span):
    """Openings are every bar of the series at odd gaps; the fine rows lie anywhere, before the first one as well."""
    from tidelane.operators import htf

    fine = [(s, t, float(t)) for s in ("long", "short", "none") for t in range(0, 200_000, 700)]
    detail = spark.createDataFrame(fine, "series string, ts_ms long, x double")
    opens = {}
    for r in sorted(walk.select("series", "bar_idx", "ts_ms").collect()):
        opens.setdefault(r.series, []).append(r.ts_ms)
    got = {(r.series, r.ts_ms): r.bar_idx for r in htf.detail_in(walk, detail, 2, span).collect()}
    want = {}
    for s, t, _ in fine:
        before = [k for k, o in enumerate(opens.get(s, [])) if o <= t]
        if before and t < (opens[s][before[-1] + 1] if before[-1] + 1 < len(opens[s]) else opens[s][-1] + 2000):
            want[s, t] = before[-1]
    assert got == want
    near = blocks.last_before(detail, walk, ["c"], span).filter("asof_c is null").count()
    assert near == sum(not opens.get(s) or t < opens[s][0] for s, t, _ in fine)


@pytest.mark.parametrize("rows", [32, 4096])
def test_percentile_over_blocks(walk, rows):
    d = walk.withColumn("x", F.round(F.col("c") - F.col("o"), 1))  # ties
    got, want = series(blocks.strength(d, "x", 50, 60, "y", rows), "y"), series(W.strength(d, "x", 50, 60, "y"), "y")
    assert got == want and {True, False} == set(got["long"])
