"""Streams of ticks and bars: candles by event time, partial bars, and recursive indicators with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelane.functions import kernels


def candles(ticks: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Bars by tumbling windows; a bar is final when the watermark passes it, ticks later than that are dropped."""
    t = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    key = F.struct("ts", "event_id")
    g = t.groupBy(F.col("event_type").alias("series"), F.window("at", f"{seconds} seconds").alias("w"))
    b = g.agg(F.min_by("value", key).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", key).alias("c"), F.count("*").cast("double").alias("v"))
    return b.select("series", F.unix_millis("w.start").alias("ts_ms"), "o", "h", "l", "c", "v")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of ticks of a series without a gap."""
    t = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    s = t.groupBy(F.col("event_type").alias("series"), F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("series", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n", "total")


def _number(x):
    return None if x is None else float(x)


def smoothed(bars: DataFrame, alpha: float, value: str = "c") -> DataFrame:
    """series, ts_ms, smooth of a stream of bars: the state is the last output, so a restart goes on where it was.

    Bars of a series must come in order across triggers; inside a trigger they are sorted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k = kernels.Smooth(alpha)
        if state.exists:
            (k.out,) = state.get
        x = pd.concat(list(frames)).sort_values("ts_ms")
        out = [k.step(float(v)) for v in x[value]]
        state.update((_number(k.out),))
        yield pd.DataFrame({"series": key[0], "ts_ms": x["ts_ms"], "smooth": out})

    return bars.groupBy("series").applyInPandasWithState(step, "series string, ts_ms long, smooth double", "last double", "append", GroupStateTimeout.NoTimeout)


class CycleState:
    """The oscillator of one series and the number of its bars, as bytes between triggers."""

    def __init__(self, method: str = "manual"):
        self.oscillator, self.n = kernels.Oscillator(method), 0

    def step(self, x: float) -> tuple:
        self.n += 1
        return self.n - 1, *self.oscillator.step(x)


def cycles(bars: DataFrame, method: str = "manual", value: str = "c", final: str | None = None) -> DataFrame:
    """bar_idx, alpha, cycle, trigger, fisher of a stream of bars, by the kernels of the batch fold.

    final: a boolean column; bars that are not final are computed on a copy of the state, which they leave as it was.
    """
    import pickle

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = pickle.loads(state.get[0]) if state.exists else CycleState(method)
        x = pd.concat(list(frames)).sort_values("ts_ms")
        out = []
        for v, done in zip(x[value], x[final] if final else [True] * len(x)):
            at = s if done else pickle.loads(pickle.dumps(s))
            out.append(at.step(float(v)))
        state.update((pickle.dumps(s),))
        columns = list(zip(*out))
        yield pd.DataFrame({"series": key[0], "ts_ms": x["ts_ms"], **dict(zip(("bar_idx", "alpha", "cycle", "trigger", "fisher"), columns))})

    return bars.groupBy("series").applyInPandasWithState(step, "series string, ts_ms long, bar_idx long, alpha double, cycle double, trigger double, fisher double", "state binary", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, as a table in memory: for tests and reports of small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
