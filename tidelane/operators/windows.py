"""Indicators with a bounded look-back, and latches, as column expressions over a series' window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import in_order


def back(n: int):
    """The frame of a bar and the n - 1 before it."""
    return in_order().rowsBetween(-(n - 1), 0)


def nz(x: Column, k: int = 0, default: float = 0.0) -> Column:
    """x k bars ago, `default` where there is none."""
    return F.coalesce(F.lag(x, k).over(in_order()) if k else x, F.lit(default))


def sma(x: str, n: int) -> Column:
    """Mean of the last n bars, of all so far while there are fewer; null where the series is shorter than n."""
    long_enough = F.col("bar_idx") + F.count("*").over(in_order().rowsBetween(0, n - 1)) >= n
    return F.when(long_enough, F.avg(x).over(back(n)))


def highest(x: str, n: int) -> Column:
    return F.max(x).over(back(n))


def lowest(x: str, n: int) -> Column:
    return F.min(x).over(back(n))


def true_range() -> Column:
    """max(h - l, |h - c1|, |l - c1|), h - l on the first bar."""
    c1 = F.lag("c").over(in_order())
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - c1), F.abs(F.col("l") - c1))


def _crossed(df: DataFrame, a: str, b: str, name: str, up: bool) -> DataFrame:
    w = in_order()
    a1, b1 = F.lag(a).over(w), F.lag(b).over(w)
    now, was = (F.col(a) > F.col(b), a1 <= b1) if up else (F.col(a) < F.col(b), a1 >= b1)
    return df.withColumn(name, F.coalesce(now & was, F.lit(False)))


def crossover(df: DataFrame, a: str, b: str, name: str = "crossover") -> DataFrame:
    """Adds whether a rises above b at this bar; false on the first bar."""
    return _crossed(df, a, b, name, True)


def crossunder(df: DataFrame, a: str, b: str, name: str = "crossunder") -> DataFrame:
    return _crossed(df, a, b, name, False)


def extreme(x: str, left: int, right: int, high: bool = True) -> Column:
    """Whether x is strictly beyond all of the `left` bars before and the `right` bars after, all of which exist."""
    w = in_order()
    pick = F.max if high else F.min
    before, after = pick(x).over(w.rowsBetween(-left, -1)), pick(x).over(w.rowsBetween(1, right))
    full = (F.count("*").over(w.rowsBetween(-left, -1)) == left) & (F.count("*").over(w.rowsBetween(1, right)) == right)
    beyond = (F.col(x) > before) & (F.col(x) > after) if high else (F.col(x) < before) & (F.col(x) < after)
    return full & F.coalesce(beyond, F.lit(False))


def pivot(df: DataFrame, x: str, left: int, right: int, high: bool, name: str) -> DataFrame:
    """Adds the pivot's value at the bar that confirms it, `right` bars later."""
    d = df.withColumn("_at", F.when(extreme(x, left, right, high), F.col(x)))
    return d.withColumn(name, F.lag("_at", right).over(in_order())).drop("_at")


def volume_ratio(df: DataFrame, n: int, name: str = "volume_ratio") -> DataFrame:
    d = df.withColumn("_m", sma("v", n))
    return d.withColumn(name, F.when(F.col("_m") > 0, F.col("v") / F.col("_m")).otherwise(0.0)).drop("_m")


def momentum(x: str, k: int = 3) -> Column:
    """x less x k bars ago, 0 where there is none."""
    return F.coalesce(F.col(x) - F.lag(x, k).over(in_order()), F.lit(0.0))


def gaussian_weights(length: int, sigma: float) -> list[float]:
    w = [math.exp(-0.5 * ((j - length / 2) / sigma) ** 2) for j in range(length)]
    return [x / sum(w) for x in w]


def gaussian(x: str, length: int, sigma: float) -> Column:
    """Finite filter with normalised Gaussian weights; before the first bar stands its value."""
    w = in_order()
    first = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = None
    for j, weight in enumerate(gaussian_weights(length, sigma)):
        term = (F.coalesce(F.lag(x, j).over(w), first) if j else F.col(x)) * weight
        total = term if total is None else total + term
    return total


def gaussian_bundle(df: DataFrame, x: str, lengths: list[int], sigma: float, name: str) -> DataFrame:
    """Adds an array of `gaussian` filters of x, one a length: one frame of the last values, then a product for each."""
    most = max(lengths)
    d = df.withColumn("_f", F.reverse(F.collect_list(x).over(back(most))))
    d = d.withColumn("_f", F.concat("_f", F.array_repeat(F.element_at("_f", -1), most - F.size("_f"))))  # the first bar's value before it
    dot = lambda n: F.aggregate(F.zip_with(F.slice("_f", 1, n), F.array(*map(F.lit, gaussian_weights(n, sigma))), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
    return d.withColumn(name, F.array(*map(dot, lengths))).drop("_f")


def trend_bands(df: DataFrame, x: str = "c", period: int = 10, sigma: float = 3.0, count: int = 21, distance: float = 1.0, range_length: int = 100, mode: str = "median") -> DataFrame:
    """Adds score, centre, upper, lower of a bundle of Gaussian filters of rising length, and turn: true at a close above
    the band, false at one below and on the first bar, else null.

    score: 0.05 for each filter above the first; centre: their median, or their mean with mode avg; the band lies
    `distance` mean ranges around it. Looks `bands_back` bars back.
    """
    d = gaussian_bundle(df, x, [period + k for k in range(count)], sigma, "_g")
    d = d.withColumn("score", F.size(F.filter("_g", lambda g: g > F.col("_g")[0])) * 0.05)
    centre = F.aggregate("_g", F.lit(0.0), lambda s, g: s + g) / count if mode == "avg" else F.sort_array("_g")[count // 2]
    d = d.withColumn("centre", centre).withColumn("_r", F.avg(F.col("h") - F.col("l")).over(back(range_length)) * distance)
    d = d.withColumn("upper", F.col("centre") + F.col("_r")).withColumn("lower", F.col("centre") - F.col("_r"))
    turn = F.when(F.col("c") > F.col("upper"), True).when((F.col("c") < F.col("lower")) | (F.col("bar_idx") == 0), False)
    return d.withColumn("turn", turn).drop("_g", "_r")


def bands_back(period: int = 10, count: int = 21, range_length: int = 100) -> int:
    return max(period + count - 1, range_length) - 1


def multi_trend(df: DataFrame, **p) -> DataFrame:
    """`trend_bands` with trend, the last turn, and line, the band's edge that the trend holds to: see blocks.multi_trend
    for a series of many bars."""
    d = trend_bands(df, **p).withColumn("trend", F.last("turn", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("line", F.when(F.col("trend"), F.col("lower")).otherwise(F.col("upper"))).drop("turn")


def strength(df: DataFrame, x: str, lookback: int, percent: float, name: str = "strong") -> DataFrame:
    """Adds whether |x| reaches the percentile of the last lookback + 1 values; true until there are as many."""
    d = df.withColumn("_a", F.abs(x))
    edge = F.percentile("_a", percent / 100).over(in_order().rowsBetween(-lookback, 0))
    return d.withColumn(name, (F.col("bar_idx") < lookback) | (F.col("_a") >= edge)).drop("_a")


def previous_range(n: int) -> list[Column]:
    """Highest high and lowest low of the n + 1 bars before this one."""
    w = in_order().rowsBetween(-(n + 1), -1)
    return [F.max("h").over(w).alias("range_high"), F.min("l").over(w).alias("range_low")]


def excursions(df: DataFrame, window: int) -> DataFrame:
    """Adds the best and worst move in percent over the `window` - 1 next bars, floored at 0, with the bar that first has it."""
    w = in_order().rowsBetween(1, window - 1)
    early = (-F.col("bar_idx")).alias("early")
    up, down = F.max(F.struct(F.col("h").alias("x"), early)).over(w), F.max(F.struct((-F.col("l")).alias("x"), early)).over(w)
    d = df.withColumn("_u", up).withColumn("_d", down)
    best = (F.col("_u.x") - F.col("c")) / F.col("c") * 100
    worst = (F.col("c") + F.col("_d.x")) / F.col("c") * 100
    d = d.withColumn("mfe", F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0))).withColumn("mae", F.greatest(F.coalesce(worst, F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("mfe_bar", F.when(F.col("mfe") > 0, -F.col("_u.early") - F.col("bar_idx")).otherwise(0))
    return d.withColumn("mae_bar", F.when(F.col("mae") > 0, -F.col("_d.early") - F.col("bar_idx")).otherwise(0)).drop("_u", "_d")


def gaps_and_islands(df: DataFrame, x: str) -> DataFrame:
    """Runs of equal x: series, run, label, first, last, n_bars."""
    w = in_order()
    changed = F.coalesce((F.col(x) != F.lag(x).over(w)).cast("int"), F.lit(1))
    d = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("series", "run").agg(F.first(x).alias("label"), F.min("bar_idx").alias("first"), F.max("bar_idx").alias("last"), F.count("*").alias("n_bars"))


def with_floor(alpha: Column, floor: float) -> Column:
    """Alpha, the floor at least where one is set."""
    return F.greatest(alpha, F.lit(float(floor))) if floor > 0 else alpha


def alpha_summary(df: DataFrame, x: str = "alpha", floor: float = 0.1, warm_up: int = 100) -> DataFrame:
    """Per series, from bar `warm_up` on: mean, sd, low, high and percentiles of x, the share that the floor lifts, and
    mean, median and sd with the floor."""
    d = df.filter(F.col("bar_idx") >= warm_up).withColumn("_f", with_floor(F.col(x), floor))
    each = [F.percentile(x, k / 100).alias(f"p{k}") for k in (10, 25, 50, 75, 90)]
    return d.groupBy("series").agg(
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("sd"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        *each,
        (F.avg((F.col(x) < floor).cast("double")) * 100).alias("clipped"),
        F.avg("_f").alias("floor_mean"),
        F.percentile("_f", 0.5).alias("floor_median"),
        F.stddev_pop("_f").alias("floor_sd"),
    )


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int = 19) -> DataFrame:
    """series, bin (from 0), low, high, n: values between low and high by bins of equal width, empty ones as well.

    A bin has its lower edge, the last one its upper edge too.
    """
    width = (high - low) / bins
    inside = df.filter(F.col(x).between(low, high)).withColumn("bin", F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)))
    n = inside.groupBy("series", "bin").agg(F.count("*").alias("n"))
    every = df.select("series").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = every.join(n, ["series", "bin"], "left").fillna(0, ["n"])
    return out.select("series", "bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")
