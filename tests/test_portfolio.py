"""Portfolios ranked by moments against their paths."""

import random
from itertools import combinations, product
from statistics import fmean, pstdev

import pytest

from tidelane.operators import portfolio


@pytest.fixture(scope="module")
def returns(spark):
    """Three series with missing times and one of a single value."""
    random.seed(3)
    rows = [(s, t, random.gauss(0.001 * k, 0.02)) for k, s in enumerate("abc") for t in range(60) if random.random() < 0.8]
    return spark.createDataFrame([*rows, *(("flat", t, 0.01) for t in range(5))], "series string, ts_ms long, r double").cache()


def by_hand(returns, most, steps):
    r = {}
    for x in returns.collect():
        r.setdefault(x.series, {})[x.ts_ms] = x.r
    values = [0.1 + 0.8 * k / (steps - 1) for k in range(steps)]
    out = {}
    for n in range(1, most + 1):
        for m in combinations(sorted(r), n):
            times = sorted(set().union(*(r[s] for s in m)))
            for w in product(values, repeat=n):
                w = [x / sum(w) for x in w]
                p = [sum(r[s].get(t, 0.0) * x for s, x in zip(m, w)) for t in times]
                sd = pstdev(p)
                parts = sum(pstdev(r[s].values()) * x for s, x in zip(m, w))
                out["+".join(m), tuple(round(x, 9) for x in w)] = (fmean(p) * 365**0.5 / sd if sd > 1e-12 else 0.0, parts / sd if sd > 1e-12 else 1.0)
    return out


def test_all_are_ranked_as_their_paths_would(spark, returns):
    from pyspark.sql import functions as F

    grid = portfolio.weight_grid(portfolio.combinations(returns.select(F.col("series").alias("name")).distinct(), 3), 3).withColumn("weights_id", F.xxhash64("weights")).dropDuplicates(["combo", "weights_id"])
    got = portfolio.ranked(returns, grid).join(grid, ["combo", "weights_id"]).collect()
    want = by_hand(returns, 3, 3)
    assert {(r.combo, tuple(round(x, 9) for x in r.weights)) for r in got} == set(want)
    for r in got:
        sharpe, spread = want[r.combo, tuple(round(x, 9) for x in r.weights)]
        if "flat" != r.combo:
            assert (r.sharpe, r.diversification) == pytest.approx((sharpe, spread), rel=1e-6)


def test_the_best_have_their_paths(spark, returns):
    top = portfolio.search(spark, returns.filter("series <> 'flat'"), 2, 3, 5).collect()
    best = sorted((x[0] for x in by_hand(returns.filter("series <> 'flat'"), 2, 3).values()), reverse=True)[:5]
    assert [r.sharpe for r in top] == pytest.approx(best)
    assert all(r.max_drawdown >= 0 for r in top)
