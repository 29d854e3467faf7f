"""Searches over strategies: trials in one table against trials one by one, windows together against windows alone."""

import pytest
from pyspark.sql import functions as F

from tidelane.operators import signals
from tidelane.operators import validation as V
from tidelane.plans import search
from tidelane.plans.registry import hourly

TRIALS = [{"confidence_min": c, "min_bars": n} for c in (40.0, 55.0) for n in (0, 6, 30)]
TRIALS += [{"confidence_min": 40.0, "min_bars": 6, "max_signals_per_day": 1}, {"confidence_min": 40.0, "manual_alpha": 0.2}, {"confidence_min": 40.0, "atr_mult": 3.0}]


@pytest.fixture(scope="module")
def bars(spark, sf_dir):
    return hourly(spark, sf_dir).cache()


def test_trials_together_are_trials_alone(spark, bars):
    s = signals.REGISTRY["cycle_no_htf"]
    shown = lambda df: sorted(map(str, df.select("series", "bar_idx", "direction", "confidence", F.round("entry", 9), F.round("stop", 9)).collect()))
    together = s.of_trials(bars, TRIALS).cache()
    for k, t in enumerate(TRIALS):
        assert shown(together.filter(F.col("trial") == k)) == shown(s.signals(bars, **t)), t
    assert together.filter("trial = 0").count() > together.filter("trial = 2").count() > 0


def test_scores_together_are_scores_alone(bars):
    got = search.evaluate(bars, "cycle_no_htf", TRIALS[:3], min_trades=1)
    assert got == pytest.approx([search.evaluate(bars, "cycle_no_htf", [t], min_trades=1)[0] for t in TRIALS[:3]])


def test_walk_forward_against_windows_one_by_one(spark, bars):
    trials = TRIALS[:5]
    windows = V.walk_forward_windows(bars.groupBy("series").agg(F.count("*").alias("n_bars"))).filter("window_id < 2").cache()
    got = {r["window_id"]: r for r in search.walk_forward(bars, "cycle_no_htf", trials, windows, min_trades=1).collect()}
    assert sorted(got) == [0, 1]
    for k, r in got.items():
        part = lambda a, b: V.in_windows(bars, windows.filter(F.col("window_id") == k), a, b).drop("window_id")  # noqa: B023, E731
        first = search.evaluate(part("is_start", "is_end"), "cycle_no_htf", trials, min_trades=1)
        later = search.evaluate(part("oos_start", "oos_end"), "cycle_no_htf", trials, min_trades=1)
        best = max(range(len(trials)), key=lambda i: (first[i], -i))
        assert (r["is_score"], r["oos_score"]) == pytest.approx((first[best], later[r["trial"]])) and first[r["trial"]] == pytest.approx(first[best])


def test_estimator_asks_for_new_trials_until_there_are_none():
    space = [search.Param("x", "int", 0, 30, 1), search.Param("y", "float", -2.0, 2.0, 0.25)]
    found = search.tpe(lambda ts: [-abs(t["x"] - 21) - abs(t["y"]) for t in ts], space, 100, start=8)
    assert len(found) == 100 and len({(t["x"], t["y"]) for _, t in found}) >= 99  # the random start may draw one twice
    tiny = search.tpe(lambda ts: [-abs(t["x"] - 1) for t in ts], [search.Param("x", "int", 0, 2, 1)], 40, start=8)
    assert len(tiny) == 40 and tiny[0] == (0, {"x": 1})
