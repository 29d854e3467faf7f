"""Strategies against signals worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidelane.operators import folds, regime, signals, structure

BARS = "series string, bar_idx long, ts_ms long, o double, h double, l double, c double, v double"


def bars(spark, rows):
    """Bars of one series from (h, l, c); they open at the close before."""
    out, before = [], rows[0][2]
    for k, (h, l, c) in enumerate(rows):  # noqa: E741
        out.append(("s", k, k * 3_600_000, float(before), float(h), float(l), float(c), 1.0))
        before = c
    return spark.createDataFrame(out, BARS)


@pytest.mark.parametrize(
    ("kind", "parts", "points"),
    [
        ("generic", "cross trend htf zone volume fisher momentum", 100),
        ("generic", "cross volume", 35),
        ("generic", "cross momentum", 30),
        ("soft_htf", "cross fisher", 35),
        ("soft_htf", "cross volume", 30),
        ("soft_htf", "cross trend htf zone volume fisher momentum", 100),
        ("v7", "cross trend zone volume fisher momentum strength", 100),
        ("no_htf", "cross trend zone volume fisher momentum", 100),
        ("v63", "cross momentum", 25),
        ("itrend", "cross trend volume strength", 100),
    ],
)
def test_points(spark, kind, parts, points):
    held = {x: F.lit(x in parts.split()) for x in signals.WEIGHTS[kind]}
    assert spark.range(1).select(signals.confidence(kind, held)).first()[0] == points


def one(spark, direction, entry, atr):
    return spark.createDataFrame([("s", 1, direction, entry, atr)], "series string, bar_idx long, direction int, entry double, atr double")


@pytest.mark.parametrize(
    ("name", "direction", "stop", "targets", "portions", "be", "trail", "leverage"),
    [
        ("cycle", 1, 95.0, [107.5, 120.0], [0.6, 0.4], 101.5, 1.2, 7.0),
        ("cycle_pine", -1, 103.0, [94.0, 91.0, 85.0], [0.4, 0.3, 0.3], 98.5, 1.0, 12.0),
        ("cycle_pine_htf", 1, 97.0, [106.0, 109.0], [0.6, 0.4], 101.5, 1.0, 8.0),
        ("cycle_htf", 1, 97.0, [106.0, 109.0], [0.6, 0.4], 101.0, 1.0, 20.0),
        ("itrend", -1, 104.0, [92.0, 84.0], [0.6, 0.4], 99.0, 0.8, 10.0),
    ],
)
def test_exits_at_an_entry_of_100_with_an_atr_of_2(spark, name, direction, stop, targets, portions, be, trail, leverage):
    x = signals.with_exits(one(spark, direction, 100.0, 2.0), signals.REGISTRY[name].defaults).first()
    assert x.stop == pytest.approx(stop) and x.targets == pytest.approx(targets) and x.portions == pytest.approx(portions)
    assert (x.be_trigger, x.trail_distance, x.leverage) == pytest.approx((be, trail, leverage))


def test_fixed_exits_have_their_own_targets(spark):
    p = signals.REGISTRY["cycle_htf"].defaults | {"fixed_stop": 2.5, "fixed_targets": (3.0, 4.5), "trailing": False, "be_pct": 0.0}
    x = signals.with_exits(one(spark, -1, 200.0, 2.0), p).first()
    assert x.stop == pytest.approx(205.0) and x.targets == pytest.approx([194.0, 191.0]) and (x.be_trigger, x.trail_distance) == (0.0, 0.0)


def test_higher_time_frame_needs_the_trend(spark, monkeypatch):
    """A cross upward against a falling trend line is no signal, whatever its points; without the filter it is one."""
    row = dict(series="s", bar_idx=20, ts_ms=0, h=101.0, l=99.0, c=100.0, atr=2.0, slope=-1.0, cycle=-2.0, fisher_step=1.0, momentum3=1.0, volume_ratio=2.0, strong=True, bull_cross=True, bear_cross=False)  # noqa: E741
    table = spark.createDataFrame([tuple(row.values())], "series string, bar_idx int, ts_ms long, h double, l double, c double, atr double, slope double, cycle double, fisher_step double, momentum3 double, volume_ratio double, strong boolean, bull_cross boolean, bear_cross boolean")
    monkeypatch.setattr(signals, "cycle_table", lambda *_: table)
    b, s = bars(spark, [(101, 99, 100)] * 3), signals.REGISTRY["cycle_htf"]
    assert s.candidates(b, s.defaults).count() == 0
    got = s.candidates(b, s.defaults | {"use_trend": False}).first()
    assert (got.direction, got.confidence, got.entry) == (1, 100.0, 100.0)


def test_gaps_count_lows_and_highs_from_their_own_bar(spark):
    """Gaps upward: 10 to 12 (bars 0 to 2), which bar 4 trades into, and 15 to 15.5 and 15.5 to 16 (from bars 4 and 5), which none does."""
    b = bars(spark, [(10, 8, 9), (13, 9, 12.5), (14, 12, 13), (14.5, 13, 14), (15, 11, 14), (15.5, 13, 15), (17, 15.5, 16), (18, 16, 17), (18, 16.5, 17)])
    gaps = {r.bar_idx: (r.direction, r.top, r.bottom, r.crossed_idx) for r in structure.mitigated_gaps(b).collect()}
    assert gaps == {1: (1, 12.0, 10.0, 4), 6: (1, 16.0, 15.5, None)} | {k: x for k, x in gaps.items() if k not in (1, 6)}
    inside = lambda *p: sorted(r.bar_idx for r in structure.gap_zones(b, *p).filter("in_bull").collect())
    assert inside(20) == [6, 7]  # lows of 15.5 and 16
    assert inside(20, True) == [2, 4, 6, 7]  # as known then: 12, 11, and the gap of bars 4 to 6 as well
    assert inside(3, True) == [2, 6, 7]


def test_trend_line_turns(spark, monkeypatch):
    """Crosses where the two-bar change gets a sign it had not; a slope of the wrong size and a far close cost points."""
    line = [100.0] * 11 + [101.0, 102.0, 102.0, 101.9, 101.0, 100.0]
    monkeypatch.setattr(folds, "trend_line", lambda b, *_: b.withColumn("itrend", F.element_at(F.array(*map(F.lit, line)), F.col("bar_idx").cast("int") + 1)))
    b = bars(spark, [(105, 95, x) for x in line[:11] + [101.0, 106.0, 102.0, 101.9, 101.0, 100.0]])
    s = signals.REGISTRY["itrend"]
    got = {r.bar_idx: (r.direction, r.confidence) for r in s.candidates(b, s.defaults).collect()}
    # up at 11 (1 %, volume 1.0 of its mean: no points); down at 14 (101.9 under 102.0: 0.098 %)
    assert got == {11: (1, 75.0), 14: (-1, 75.0)}
    got = {r.bar_idx: r.confidence for r in s.candidates(b, s.defaults | {"volume_mult": 1.0, "volume_period": 5, "slope_min": 0.5}).collect()}
    assert got == {11: 100.0, 14: 75.0}
    assert {r.confidence for r in s.candidates(b, s.defaults | {"use_volume": False, "slope_min": 0.0, "extension_max": 0.0}).collect()} == {100.0}


SMC = {  # bar: direction of the break, its kind, the oscillator, nearest level above and below
    31: (1, "CHoCH", 70.0, 130.0, 90.0),
    32: (1, "BOS", 70.0, 104.0, None),
    33: (-1, "BOS", 30.0, None, 80.0),
    34: (-1, "CHoCH", 45.0, None, None),
    35: (1, "CHoCH", 40.0, None, None),
    20: (1, "CHoCH", 99.0, None, None),
}


@pytest.fixture
def smart(spark, monkeypatch):
    rows = [("s", k, *x) for k, x in SMC.items()]
    t = spark.createDataFrame(rows, "series string, bar_idx long, direction int, kind string, osc double, bsl double, ssl double")
    monkeypatch.setattr(structure, "oscillator", lambda *_, **__: t.select("series", "bar_idx", "osc"))
    monkeypatch.setattr(structure, "breaks", lambda *_: t.select("series", "bar_idx", "direction", "kind"))
    monkeypatch.setattr(structure, "liquidity", lambda *_: t.select("series", "bar_idx", "bsl", "ssl"))
    monkeypatch.setattr(structure, "gap_zones", lambda *_, **__: t.select("series", "bar_idx", (F.col("bar_idx") == 31).alias("in_bull"), F.lit(True).alias("in_bear")))
    monkeypatch.setattr(folds, "rma", lambda b, *_: b.withColumn("atr", F.lit(2.0)))
    monkeypatch.setattr(folds, "ema", lambda b, x, n, name: b.withColumn(name, F.when(F.col("bar_idx").isin(33, 34), 101.0).otherwise(99.0)))
    return lambda **p: {r.bar_idx: r for r in signals.REGISTRY["smart_money"].signals(bars(spark, [(101, 99, 100)] * 40), min_bars=0, **p).collect()}


def test_breaks_need_the_oscillator_on_their_side(smart):
    got = smart()
    assert {k: (r.direction, r.confidence) for k, r in got.items()} == {31: (1, 70.0), 32: (1, 59.5), 33: (-1, 59.5)}
    # the stop is 3 away: 103, 106, then the level above where it lies beyond 106, else 110.5
    assert got[31].targets == [103.0, 106.0, 130.0] and got[32].targets == [103.0, 106.0, 110.5] and got[33].targets == [97.0, 94.0, 80.0]
    assert [(r.stop, r.be_trigger, r.trail_distance) for r in (got[31], got[33])] == [(97.0, 103.0, 1.5), (103.0, 97.0, 1.5)]
    assert got[31].portions == [0.40, 0.35, 0.25] and got[31].leverage == 3.0


def test_other_modes(smart):
    assert {k: r.confidence for k, r in smart(mode="L1").items()} == {31: 70.0, 32: 70.0, 33: 70.0, 34: 55.0, 35: 40.0}
    assert set(smart(mode="L3")) == set()
    assert set(smart(mode="L3", level3=55.0)) == {31, 34}
    assert set(smart(mode="L3", level3=40.0)) == {31, 34}
    assert set(smart(mode="L3", level3=40.0, use_gap=False)) == {31, 34, 35}
    assert set(smart(level2=70.0, use_higher=False)) == {31, 32, 33}


def test_clusters_by_their_centres():
    names = regime.named([0.01, -0.01, 0.00005, 0.002, -0.002], [5.0, 4.0, 9.0, 1.0, 2.0])
    assert names == [regime.HIGH_VOL_UP, regime.TREND_DOWN, regime.RANGING, regime.TREND_UP, regime.TREND_DOWN]


def test_gaussian_bands(spark, monkeypatch):
    """A close through the line with a score of 0.8: the range low and 0.3 ATR bound the risk, 60 is near enough to be a rung."""
    from tidelane.operators import windows

    rows = [(101, 99, 100)] * 30
    monkeypatch.setattr(signals, "multi_trend", lambda b, **_: b.withColumn("score", F.lit(0.8)).withColumn("line", F.when(F.col("bar_idx") < 28, 100.5).otherwise(99.5)))
    monkeypatch.setattr(structure, "liquidity", lambda b, _: b.select("series", "bar_idx", F.lit(105.0).alias("bsl"), F.lit(None).cast("double").alias("ssl")))
    monkeypatch.setattr(folds, "rma", lambda b, *_: b.withColumn("atr", F.lit(2.0)))
    got = signals.REGISTRY["gaussian_bands"].signals(bars(spark, rows)).collect()
    assert [(r.bar_idx, r.direction) for r in got] == [(28, 1)] and windows.previous_range
    x = got[0]
    assert x.confidence == pytest.approx(80.0) and x.stop == pytest.approx(98.4)
    # risk 1.6: 105 is the first rung (beyond 0.48), not the second; then 2.4, 3.2, 4.0 and 6.4 on top
    assert x.targets == pytest.approx([105.0, 107.4, 110.6, 114.6, 121.0]) and x.be_trigger == pytest.approx(105.0) and x.trail_distance == pytest.approx(0.8)
    assert x.portions == pytest.approx([0.30, 0.25, 0.20, 0.15, 0.10])
