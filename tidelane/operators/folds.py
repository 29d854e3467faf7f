"""Keyed folds: recursive indicators over each series, one ordered pass a series.

The table is dealt and sorted by series and bar, and one Python pass over a partition, in Arrow batches, keeps the state of
the series it is in, so a series is never held whole. Linear recurrences of one long series are in `blocks`, over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelane.functions import kernels


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: list[str], make: Callable[[], Callable]) -> DataFrame:
    """df with output columns: make() gives a series' step, called with the inputs of each bar in order.

    The step returns a value, or a tuple for several outputs. Batches are bounded whatever a series' length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = None, None
        for x in batches:
            rows = []
            for key, values in zip(x[keys].itertuples(index=False, name=None), x[inputs].itertuples(index=False, name=None)):
                if key != at:
                    at, step = key, make()
                got = step(*values)
                rows.append(got if isinstance(got, tuple) else (got,))
            yield x.assign(**{name: [r[k] for r in rows] for k, name in enumerate(outputs)})

    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in outputs)])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def series_fold(df: DataFrame, inputs: list[str], outputs: list[str], make: Callable[[], Callable]) -> DataFrame:
    return fold(df, ["series"], ["bar_idx"], inputs, outputs, make)


def smooth_long(df: DataFrame, x: str, alpha: float, name: str) -> DataFrame:
    return series_fold(df, [x], [name], lambda: kernels.Smooth(alpha).step)


def ema(df: DataFrame, x: str, period: int, name: str) -> DataFrame:
    return smooth_long(df, x, 2 / (period + 1), name)


def rma(df: DataFrame, x: str, period: int, name: str) -> DataFrame:
    return smooth_long(df, x, 1 / period, name)


def trend_line(df: DataFrame, x: str = "c", alpha: float = 0.07, name: str = "itrend") -> DataFrame:
    return series_fold(df, [x], [name], lambda: kernels.Trend(alpha).step)


def adaptive_alpha(df: DataFrame, method: str, x: str = "c", name: str = "alpha") -> DataFrame:
    return series_fold(df, [x], [name], lambda: kernels.ALPHAS[method]().step)


def cycle(df: DataFrame, method: str = "manual", x: str = "c", fisher_lookback: int = 10, trigger_ema: int | None = None, manual_alpha: float = 0.07) -> DataFrame:
    """Adds alpha, cycle, trigger (the cycle a bar before, or its moving average of trigger_ema bars) and fisher in one pass."""
    return series_fold(df, [x], ["alpha", "cycle", "trigger", "fisher"], lambda: kernels.Oscillator(method, fisher_lookback, trigger_ema, manual_alpha).step)


def throttle(signals: DataFrame, least_bars: int | Column, per_day: int | Column | None = None, day_ms: int = 86_400_000, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Adds accepted (1.0 or 0.0) to candidate signals: at least least_bars after the last accepted one of the key, at most
    per_day a UTC day (null: any number). Needs the keys, bar_idx, ts_ms; as columns the limits may differ from key to key."""
    least, most = (x if isinstance(x, Column) else F.lit(x) for x in (least_bars, per_day))
    limits = {"_least": least.cast("long"), "_most": F.coalesce(most.cast("long"), F.lit(1 << 62))}

    def make():
        state = {"bar": -(10**9), "day": None, "n": 0}

        def step(bar, ms, least, most):
            day = ms // day_ms
            if day != state["day"]:
                state["day"], state["n"] = day, 0
            if bar - state["bar"] < least or state["n"] >= most:
                return 0.0
            state["bar"], state["n"] = bar, state["n"] + 1
            return 1.0

        return step

    return fold(signals.withColumns(limits), list(keys), ["bar_idx"], ["bar_idx", "ts_ms", *limits], ["accepted"], make).drop(*limits)


def capped_levels(df: DataFrame, pivots: tuple[str, str] = ("pivot_high", "pivot_low"), most: int = 40) -> DataFrame:
    """Adds the nearest unswept pivot above each bar's high (bsl) and below its low (ssl), of the newest `most` unswept."""

    def make():
        above: list[float] = []
        below: list[float] = []

        def step(h, l, up, down):  # noqa: E741
            for pool, x in ((above, up), (below, down)):
                if x is not None and x == x:
                    pool.append(x)
                    del pool[: max(0, len(pool) - most)]
            above[:] = [x for x in above if h < x]
            below[:] = [x for x in below if l > x]
            return min(above, default=None), max(below, default=None)

        return step

    return series_fold(df, ["h", "l", *pivots], ["bsl", "ssl"], make)
