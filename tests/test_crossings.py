"""First crossings and live levels against plain loops."""

import random

import pytest

from tidelane.operators import crossings, structure


@pytest.fixture(scope="module")
def walk(spark):
    random.seed(11)
    rows = []
    for s, n in (("a", 600), ("b", 3), ("c", 70)):
        x = 100.0
        for k in range(n):
            x += random.gauss(0, 1)
            x = round(x, 1)  # ties
            rows.append((s, k, k * 1000, x, x + random.choice((0.0, 0.5)), x - random.choice((0.0, 0.5)), x, 1.0))
    return spark.createDataFrame(rows, "series string, bar_idx long, ts_ms long, o double, h double, l double, c double, v double").cache()


def by_series(bars):
    out = {}
    for r in bars.orderBy("series", "bar_idx").collect():
        out.setdefault(r.series, []).append((r.h, r.l))
    return out


@pytest.mark.parametrize("fan", [4, 64])
def test_first_crossing(spark, walk, fan):
    bars, events = by_series(walk), []
    for s, hl in bars.items():
        for k in range(len(hl) + 2):
            h, l = hl[min(k, len(hl) - 1)]  # noqa: E741
            events += [(s, 2 * k, k, 1, l - random.choice((0, 1, 3, 30))), (s, 2 * k + 1, k, -1, h + random.choice((0, 1, 3, 30)))]
    e = spark.createDataFrame(events, "series string, event long, from_idx long, direction int, level double")
    got = {(r.series, r.event): r.crossed_idx for r in crossings.first_crossing(e, walk, fan).collect()}
    for s, event, start, d, level in events:
        want = next((k for k in range(start, len(bars[s])) if (bars[s][k][1] <= level if d == 1 else bars[s][k][0] >= level)), None)
        assert got[s, event] == want
    assert len(got) == len(events)


@pytest.mark.parametrize("fan", [2, 5, 16])
def test_nearest_live(spark, walk, fan):
    bars, lives = by_series(walk), []
    for s, hl in bars.items():
        for k in range(0, len(hl), 3):
            lives += [(s, random.choice((1, -1)), float(random.randint(50, 150)), k, random.choice((None, k, k + 1, k + random.randint(1, 400)))) for _ in range(2)]
    levels = spark.createDataFrame(lives, "series string, direction int, level double, born long, dead long")
    got = {(r.series, r.bar_idx): (r.above, r.below) for r in crossings.nearest_live(walk, levels, fan).collect()}
    assert len(got) == sum(map(len, bars.values()))
    for (s, k), pair in got.items():
        alive = [(d, x) for t, d, x, a, b in lives if t == s and a <= k and (b is None or k < b)]
        assert pair == (min((x for d, x in alive if d == -1), default=None), max((x for d, x in alive if d == 1), default=None))


def test_liquidity(walk):
    bars = by_series(walk)
    got = {(r.series, r.bar_idx): (r.bsl, r.ssl) for r in structure.liquidity(walk, 2).collect()}
    for s, hl in bars.items():
        above, below = [], []
        for k, (h, l) in enumerate(hl):  # noqa: E741
            if k >= 4:
                near = hl[k - 4 : k + 1]
                if all(near[2][0] > near[j][0] for j in (0, 1, 3, 4)):
                    above.append(near[2][0])
                if all(near[2][1] < near[j][1] for j in (0, 1, 3, 4)):
                    below.append(near[2][1])
            above, below = [x for x in above if h < x], [x for x in below if l > x]
            assert got[s, k] == (min(above, default=None), max(below, default=None))


def test_nothing(spark, walk):
    e = spark.createDataFrame([], "series string, event long, from_idx long, direction int, level double")
    assert crossings.first_crossing(e, walk).count() == 0
    one = spark.createDataFrame([("z", 0, 0, 1, 1.0)], e.schema)
    assert crossings.first_crossing(one, walk.limit(0)).collect()[0].crossed_idx is None
    assert structure.liquidity(walk.limit(0)).count() == 0
