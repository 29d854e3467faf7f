"""Signals bar by bar against the column form, for whole, open and streamed bars."""

import pytest
from pyspark.sql import functions as F

from tidelane.functions import kernels
from tidelane.operators import live, signals
from tidelane.plans.queries_bars import fine
from tidelane.plans.registry import HOUR, hourly

LOOSE = {"confidence_min": 30.0, "min_bars": 3}


def rows(df):
    df = df.select("series", "bar_idx", "ts_ms", "direction", "confidence", F.round("entry", 6), F.round("stop", 6))
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", sorted(live.KINDS))
@pytest.mark.parametrize("method", ["manual", "kalman"])
def test_whole_bars_equal_the_columns(spark, sf_dir, name, method):
    b = hourly(spark, sf_dir).cache()
    want = rows(signals.REGISTRY[name].signals(b, alpha_method=method, **LOOSE))
    assert want and rows(live.incremental(b, name, alpha_method=method, **LOOSE)) == want


@pytest.fixture
def typed_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize(("name", "method"), [("cycle", "manual"), ("cycle_pine", "kalman")])
def test_streamed_bars_equal_the_columns(spark, sf_dir, tmp_path, typed_state, name, method):
    """In two runs over the same checkpoint, so that the second starts from the kept state alone."""
    b = hourly(spark, sf_dir).cache()
    middle = b.approxQuantile("ts_ms", [0.5], 0.0)[0]
    for part in (b.filter(F.col("ts_ms") < middle), b.filter(F.col("ts_ms") >= middle)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.stream(spark.readStream.schema(b.schema).parquet(f"{tmp_path}/in"), name, alpha_method=method, **LOOSE)
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(signals.REGISTRY[name].signals(b, alpha_method=method, **LOOSE))


@pytest.mark.parametrize("method", ["manual", "kalman", "homodyne", "mama", "autocorrelation"])
def test_state_by_name_goes_on_where_it_was(method):
    p = signals.REGISTRY["cycle_pine"].defaults | {"alpha_method": method}
    bars = [(k * 3_600_000, 101.0 + k % 7, 99.0 - k % 5, 100.0 + (k * k) % 3, 5.0 + k % 4) for k in range(120)]
    one, two = live.Readings(p), live.Readings(p)
    for k, bar in enumerate(bars):
        if k % 10 == 0:
            kept, two = dict(kernels.numbers(two)), live.Readings(p)
            kernels.restore(two, kept)
        assert one.step(p, *bar) == two.step(p, *bar)


def test_state_without_a_reading_starts_it_anew():
    p = signals.REGISTRY["cycle_pine"].defaults
    old, new = live.Readings(p), live.Readings(p)
    for k in range(20):
        old.step(p, k * 3_600_000, 2.0 + k, 1.0 + k, 1.5 + k, 3.0)
    kept = {n: v for n, v in kernels.numbers(old) if n not in ("bucket", "held")} | {"gone.away": 1.0}
    kernels.restore(new, kept)
    assert (new.n, new.held) == (20, None)
    new.step(p, 20 * 3_600_000, 22.0, 21.0, 21.5, 3.0)
    assert new.held == old.lines.ago(0)


def test_open_bars_against_prefixes(spark, sf_dir):
    """Each form of a bar is judged as if it were the last bar of the table; the first that signals counts."""
    b = hourly(spark, sf_dir)
    forms = live.open_bars(b, fine(spark, sf_dir), HOUR).orderBy("series", "ts_ms", "whole").collect()
    got = {(r["series"], r["bar_idx"]): (r["ts_ms"], r["direction"], r["confidence"]) for r in live.incremental(live.open_bars(b, fine(spark, sf_dir), HOUR), "cycle", **LOOSE).collect()}
    p = signals.REGISTRY["cycle"].defaults | LOOSE
    want, done, last = {}, {}, {}
    for r in forms:
        key, bar = r["series"], (r["ts_ms"], r["h"], r["l"], r["c"], r["v"])
        n = len(done.setdefault(key, []))
        at = live.Readings(p)  # from the start over all whole bars before, without a kept state
        if n >= 10 and n - last.get(key, -99) >= p["min_bars"] and n < 60:
            for x in done[key]:
                at.step(p, *x)
            side, parts, _ = at.step(p, *bar)
            score = sum(w for name, w in signals.WEIGHTS["v7"].items() if parts.get(name))
            if side and score >= p["confidence_min"]:
                want[key, n], last[key] = (r["ts_ms"], side, float(score)), n
        if r["whole"]:
            done[key].append(bar)
    assert want and {k: v for k, v in got.items() if k[1] < 60} == want


def test_main_bars_without_detail_come_whole(spark):
    bars = spark.createDataFrame([("s", k * 3_600_000, k, 1.0, 2.0, 0.5, 1.0, 3.0) for k in range(3)], "series string, ts_ms long, bar_idx long, o double, h double, l double, c double, v double")
    detail = spark.createDataFrame([("s", 3_600_000 + k * 300_000, 1.0, 1.0 + k, 0.5, 1.0, 1.0) for k in range(2)], "series string, ts_ms long, o double, h double, l double, c double, v double")
    got = sorted((r["bar_idx"], r["h"], r["v"], r["whole"]) for r in live.open_bars(bars, detail, 3600).collect())
    assert got == [(0, 2.0, 3.0, True), (1, 1.0, 1.0, False), (1, 2.0, 2.0, True), (2, 2.0, 3.0, True)]
    assert live.incremental(bars.limit(0), "cycle").count() == 0
