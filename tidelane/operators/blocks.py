"""One long series over many tasks: positions, bounded windows and linear recurrences by blocks of bars.

Bars carry bar_idx, their position from 0 without gaps (`indexed`), and a block is a range of positions, so a series is dealt
by (series, block) and a single one fills a cluster.

* `spread` runs anything that looks a bounded way back and ahead: each block also gets the bars that its edges look at.
* `recurrence` runs s(t) = f(t) + r s(t-1), or the one with a double root r, as a parallel scan of affine maps: each block is
  summed up by itself, which gives its map's vector (the matrix follows from r alone); the ends of blocks then follow the
  same kind of recurrence with ratio r^length, over a table shorter by that length, and so on until the ratio is nothing; and
  each block is replayed from the state before it. All steps are sums over windows of one block and joins on its number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import windows
from .tables import held

ROWS = 4096  # bars of a block
CHUNK = 256  # bars of a recurrence's block, at most
NOTHING = 1e-40  # a ratio under which the blocks before the last do not matter


def indexed(bars: DataFrame, rows: int = ROWS) -> DataFrame:
    """Bars with bar_idx, their position in the series by ts_ms (ties: any order); no task holds a series.

    Time is cut into spans of about `rows` bars; a bar's position is that within its span and the bars of earlier ones.
    """
    n, low, high = bars.agg(F.count("*"), F.min("ts_ms"), F.max("ts_ms")).first()
    span = max(1, ((high or 0) - (low or 0) + 1) * rows // max(1, n))
    b = bars.withColumn("_s", F.floor((F.col("ts_ms") - (low or 0)) / span))
    counts = b.groupBy("series", "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("series").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    counts = counts.select("series", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("series", "_s").orderBy("ts_ms")) - 1
    return b.withColumn("_at", within).join(counts, ["series", "_s"]).withColumn("bar_idx", (F.col("_at") + F.col("_before")).cast("long")).drop("_s", "_at", "_before")


def spread(df: DataFrame, f: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0, rows: int = ROWS) -> DataFrame:
    """f(df), block by block: f's windows over a series may look `back` bars back and `ahead` bars ahead, no further.

    In f a block with the bars that its edges look at stands for a series, so whatever is written for series runs in it.
    f may add columns and keeps the rows.
    """
    at = F.col("bar_idx")
    blocks = F.sequence(F.greatest(F.floor((at - ahead) / rows), F.lit(0)), F.floor((at + back) / rows))
    d = df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == F.floor(at / rows))
    d = f(d.withColumn("series", F.struct("series", "_block")).drop("_block"))
    return d.filter("_own").withColumn("series", F.col("series.series")).drop("_own")


def rolling_percentile(df: DataFrame, x: str, n: int, percent: float, name: str, rows: int = ROWS) -> DataFrame:
    """Adds the percentile (linear between values) of x over a bar and the n - 1 before it, null where there are fewer.

    A block, with the n - 1 bars before it, is a group of bounded size, in which the window's values are kept in order as it
    moves: the cost of a bar grows with the logarithm of n.
    """
    d = df.withColumn("_block", F.explode(F.sequence(F.floor(F.col("bar_idx") / rows), F.floor((F.col("bar_idx") + n - 1) / rows))))
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("bar_idx")
        b[name] = b[x].rolling(n).quantile(percent / 100)
        return b[b["bar_idx"] // rows == key[1]].drop(columns="_block")

    return d.groupBy("series", "_block").applyInPandas(run, schema)


def strength(df: DataFrame, x: str, lookback: int, percent: float, name: str = "strong", rows: int = ROWS) -> DataFrame:
    """windows.strength by blocks, at a cost that hardly grows with the look-back."""
    d = rolling_percentile(df.withColumn("_a", F.abs(x)), "_a", lookback + 1, percent, "_edge", rows)
    return d.withColumn(name, F.col("_edge").isNull() | (F.col("_a") >= F.col("_edge"))).drop("_a", "_edge")


def recurrence(df: DataFrame, forced: dict[str, str], r: float, order: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Adds, for each name and forcing column, s(t) = f(t) + r s(t-1), or with order 2 f(t) + 2 r s(t-1) - r^2 s(t-2).

    s is 0 before the first bar. r lies strictly between -1 and 1.
    """
    if r == 0:
        return df.withColumns({name: F.col(f).cast("double") for name, f in forced.items()})
    # within a block, powers of 1 / r stay far from overflow
    length = max(2, min(chunk, int(250 / -math.log10(abs(r)))))
    ratio = r**length
    d = df.withColumn("_k", F.floor(F.col("bar_idx") / length)).withColumn("_j", F.col("bar_idx") - F.col("_k") * length)
    running = Window.partitionBy("series", "_k").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    j, up = F.col("_j"), F.pow(F.lit(r), F.col("_j"))
    local = {}
    for name, f in forced.items():
        scaled = F.col(f) * F.pow(F.lit(r), -j)
        total = F.sum(scaled).over(running)
        local[f"_l_{name}"] = up * total if order == 1 else up * ((j + 1) * total - F.sum(j * scaled).over(running))
    d = d.withColumns(local)
    last = lambda name, k: F.sum(F.when(j == length - k, F.col(f"_l_{name}")))
    ends = d.filter(j >= length - order).groupBy("series", F.col("_k").alias("bar_idx")).agg(*(last(name, k).alias(f"{name}_{k}") for name in forced for k in range(1, order + 1)))
    if abs(ratio) > NOTHING:  # else only the block before matters
        ends = _after(held(ends), list(forced), r, length, order, chunk)
    carried = ends.select("series", (F.col("bar_idx") + 1).alias("_k"), *(F.col(f"{name}_{k}").alias(f"_c_{name}_{k}") for name in forced for k in range(1, order + 1)))
    d = d.join(carried, ["series", "_k"], "left")
    m = j + 1
    power = F.pow(F.lit(r), m)
    for name in forced:
        before = [F.coalesce(F.col(f"_c_{name}_{k}"), F.lit(0.0)) for k in range(1, order + 1)]
        free = power * before[0] if order == 1 else power * ((m + 1) * before[0] - m * r * before[1])
        d = d.withColumn(name, F.col(f"_l_{name}") + free)
    return d.select(*df.columns, *forced)


def _after(ends: DataFrame, names: list[str], r: float, length: int, order: int, chunk: int) -> DataFrame:
    """The last `order` values after each block, from those that its own forcing gives: a recurrence over blocks.

    With order 2 both values follow the block's matrix M, whose double root is r^length, so each of them follows the scalar
    recurrence of that root under the forcing v(k) + (M - 2 r^length) v(k-1).
    """
    if order == 1:
        forced = {f"_s_{n}_1": f"{n}_1" for n in names}
        d = ends
    else:
        big, small = r**length, r ** (length - 1)
        m = (((length - 1) * big, -length * big * r), (length * small, -(length + 1) * big))
        before = ends.select("series", (F.col("bar_idx") + 1).alias("bar_idx"), *(F.col(f"{n}_{k}").alias(f"_b_{n}_{k}") for n in names for k in (1, 2)))
        d = ends.join(before, ["series", "bar_idx"], "left").fillna(0.0, [f"_b_{n}_{k}" for n in names for k in (1, 2)])
        forced = {f"_s_{n}_{k}": f"_f_{n}_{k}" for n in names for k in (1, 2)}
        d = d.withColumns({f"_f_{n}_{k}": F.col(f"{n}_{k}") + m[k - 1][0] * F.col(f"_b_{n}_1") + m[k - 1][1] * F.col(f"_b_{n}_2") for n in names for k in (1, 2)})
    d = recurrence(d, forced, r**length, order, chunk)
    return d.select("series", "bar_idx", *(F.col(s).alias(s.removeprefix("_s_")) for s in forced))


def smooth(df: DataFrame, x: str, alpha: float, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds alpha * x + (1 - alpha) * the value before, from the first x on."""
    d = df.withColumn("_f", F.when(F.col("bar_idx") == 0, F.col(x)).otherwise(alpha * F.col(x)))
    return recurrence(d, {name: "_f"}, 1 - alpha, 1, chunk).drop("_f")


def ema(df: DataFrame, x: str, period: int, name: str) -> DataFrame:
    return smooth(df, x, 2 / (period + 1), name)


def rma(df: DataFrame, x: str, period: int, name: str) -> DataFrame:
    return smooth(df, x, 1 / period, name)


def _lagged(df: DataFrame, x: str, most: int, rows: int, f: Callable[[list[Column]], Column], name: str) -> DataFrame:
    """Adds name = f of x now and up to `most` bars ago, 0 before the first."""
    w = Window.partitionBy("series").orderBy("bar_idx")
    lags = [F.coalesce(F.lag(x, k).over(w), F.lit(0.0)) if k else F.col(x) for k in range(most + 1)]
    return spread(df, lambda d: d.withColumn(name, f(lags)), most, 0, rows)


def _starting(now: list[Column], then: Column, warm: int, r: float) -> Column:
    """The forcing that makes a double-root recurrence give now[0] (then now[1], now[2] a bar and two ago) for `warm` bars."""
    return F.when(F.col("bar_idx") < warm, now[0] - 2 * r * now[1] + r * r * now[2]).otherwise(then)


def trend_line(df: DataFrame, x: str = "c", alpha: float = 0.07, name: str = "itrend", rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """Adds the instantaneous trend line: x itself for three bars, then of second order."""
    a, r = alpha, 1 - alpha
    force = lambda v: _starting(v, (a - a * a / 4) * v[0] + a * a / 2 * v[1] - (a - 0.75 * a * a) * v[2], 3, r)
    return recurrence(_lagged(df, x, 2, rows, force, "_f"), {name: "_f"}, r, 2, chunk).drop("_f")


def cycle(df: DataFrame, x: str = "c", alpha: float = 0.07, name: str = "cycle", rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """Adds the cyber cycle with one alpha: a quarter of the second difference for seven bars, then a double-root filter
    of the curvature of the four-bar mean."""
    r = 1 - alpha

    def force(v: list[Column]) -> Column:
        quarter = [(v[k] - 2 * v[k + 1] + v[k + 2]) / 4 for k in range(3)]
        mean = [(v[k] + 2 * v[k + 1] + 2 * v[k + 2] + v[k + 3]) / 6 for k in range(3)]
        return _starting(quarter, (1 - alpha / 2) ** 2 * (mean[0] - 2 * mean[1] + mean[2]), 7, r)

    return recurrence(_lagged(df, x, 5, rows, force, "_f"), {name: "_f"}, r, 2, chunk).drop("_f")


def latched(df: DataFrame, event: str, name: str, rows: int = ROWS) -> DataFrame:
    """Adds the last event so far that is not null: within the block, else of the blocks before, of which each is a row."""
    d = df.withColumn("_k", F.floor(F.col("bar_idx") / rows))
    running = Window.partitionBy("series", "_k").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy("series", "_k").agg(F.max_by(event, F.when(F.col(event).isNotNull(), F.col("bar_idx"))).alias("_e"))
    earlier = Window.partitionBy("series").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("series", "_k", F.last("_e", ignorenulls=True).over(earlier).alias("_before"))
    d = d.withColumn("_last", F.last(event, ignorenulls=True).over(running)).join(ends, ["series", "_k"])
    return d.withColumn(name, F.coalesce("_last", "_before")).drop("_k", "_last", "_before")


def multi_trend(df: DataFrame, rows: int = ROWS, **p) -> DataFrame:
    """windows.multi_trend by blocks."""
    look = windows.bands_back(**{k: v for k, v in p.items() if k in ("period", "count", "range_length")})
    d = latched(spread(df, lambda x: windows.trend_bands(x, **p), look, 0, rows), "turn", "trend", rows)
    return d.withColumn("line", F.when(F.col("trend"), F.col("lower")).otherwise(F.col("upper"))).drop("turn")


def last_before(left: DataFrame, right: DataFrame, columns: list[str], span_ms: int, ts: str = "ts_ms") -> DataFrame:
    """left with columns (asof_*) of the last right row at or before it; a long series is dealt by spans of time.

    Both sides are one sequence by time, along which the last right row is carried: within a span, and into it from the
    spans before, of which each is a row. No row meets another by comparison.
    """
    row = F.struct(*columns)
    a = left.withColumns({"_left": F.lit(1), "_r": F.lit(None).cast(right.select(row.alias("x")).schema["x"].dataType)})
    b = right.select("series", ts, F.lit(0).alias("_left"), row.alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_k", F.floor(F.col(ts) / span_ms))
    running = Window.partitionBy("series", "_k").orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    ends = b.groupBy("series", F.floor(F.col(ts) / span_ms).alias("_k")).agg(F.max_by("_r", ts).alias("_e"))
    spans = both.groupBy("series", "_k").agg(F.count("*").alias("_n")).drop("_n").join(ends, ["series", "_k"], "left")
    earlier = Window.partitionBy("series").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("series", "_k", F.last("_e", ignorenulls=True).over(earlier).alias("_before"))
    out = both.withColumn("_last", F.last("_r", ignorenulls=True).over(running)).filter("_left = 1").join(spans, ["series", "_k"])
    out = out.withColumn("_last", F.coalesce("_last", "_before"))
    return out.select(*left.columns, *(F.col(f"_last.{c}").alias(f"asof_{c}") for c in columns))
