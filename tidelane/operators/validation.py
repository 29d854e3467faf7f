"""Validation: walk-forward windows, purged folds, deflated Sharpe ratios and Monte Carlo tests.

Repetition (windows, folds, simulations) is a column, so one shuffle serves all of them.
"""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import profit_factor, ratio


def walk_forward_windows(sizes: DataFrame, n_windows: int = 5, oos: float = 0.25, anchored: bool = False) -> DataFrame:
    """sizes (series, n_bars) as windows: window_id, is_start, is_end, oos_start, oos_end."""
    per = F.col("n_bars") / n_windows
    w = sizes.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    w = w.withColumn("o", F.floor(per * oos)).withColumn("i", F.floor(per * (1 - oos)))
    start = F.lit(0).cast("long") if anchored else F.col("window_id") * (F.col("i") + F.col("o"))
    end = F.col("i") + F.col("window_id") * F.col("o") if anchored else start + F.col("i")
    w = w.withColumn("is_start", start.cast("long")).withColumn("is_end", end.cast("long"))
    w = w.withColumn("oos_end", F.least(F.col("is_end") + F.col("o"), F.col("n_bars"))).filter(F.col("is_end") < F.col("n_bars"))
    return w.select("series", F.col("window_id").cast("long").alias("window_id"), "is_start", "is_end", F.col("is_end").alias("oos_start"), "oos_end")


def in_windows(bars: DataFrame, windows: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of each window (window_id), positions from 0; windows of a series are few, so they are joined by series."""
    b = bars.join(windows.select("series", "window_id", start, end), "series").filter((F.col("bar_idx") >= F.col(start)) & (F.col("bar_idx") < F.col(end)))
    return b.withColumn("bar_idx", F.col("bar_idx") - F.col(start)).drop(start, end)


def rolling_windows(spark: SparkSession, start: str, end: str, opt_days: int, test1_days: int, test2_days: int, step_days: int) -> DataFrame:
    """Date windows to optimise, select and verify in, stepping until the last test would pass the end."""
    total = opt_days + test1_days + test2_days
    last = F.date_sub(F.to_date(F.lit(end)), total)
    w = spark.range(1).select(F.to_date(F.lit(start)).alias("s")).filter(last >= F.col("s"))
    w = w.select(F.posexplode(F.sequence("s", last, F.expr(f"interval {step_days} days"))).alias("window_id", "opt_start"))
    at = lambda d: F.date_add("opt_start", d).cast("string")
    return w.select(F.col("window_id").cast("long").alias("window_id"), F.col("opt_start").cast("string").alias("opt_start"), at(opt_days).alias("opt_end"), at(opt_days).alias("test1_start"), at(opt_days + test1_days).alias("test1_end"), at(opt_days + test1_days).alias("test2_start"), at(total).alias("test2_end"))


def efficiency(scores: DataFrame) -> DataFrame:
    """Per series: mean out-of-sample over mean in-sample score of windows whose in-sample score is not 0, and passed."""
    s = scores.filter("is_score != 0").groupBy("series").agg(F.count("*").alias("n_windows"), F.avg("is_score").alias("a"), F.avg("oos_score").alias("b"))
    s = s.withColumn("wfe", F.when(F.col("a") != 0, F.col("b") / F.col("a")).otherwise(0.0))
    return s.select("series", "n_windows", "wfe", (F.col("wfe") >= 0.3).alias("passed"))


def purged_folds(sizes: DataFrame, groups: int = 5, tested: int = 2, purge: int = 10, embargo: float = 0.01) -> DataFrame:
    """Bars of each fold: series, fold_id, bar_idx, role (train or test); purged and embargoed bars are in neither.

    Each choice of `tested` of the groups is a fold. The bars of a series come from a sequence; no bar is compared with
    another.
    """
    spark = sizes.sparkSession
    folds = [(k, list(c)) for k, c in enumerate(combinations(range(groups), tested))]
    chosen = F.broadcast(spark.createDataFrame(folds, "fold_id long, ids array<long>"))
    size = F.floor(F.col("n_bars") / groups)
    b = sizes.withColumn("size", size).withColumn("bar_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bars") - 1))).join(chosen)
    start = lambda g: g * F.col("size")
    end = lambda g: F.when(g == groups - 1, F.col("n_bars")).otherwise((g + 1) * F.col("size"))
    i = F.col("bar_idx")
    b = b.withColumn("test", F.exists("ids", lambda g: (i >= start(g)) & (i < end(g))))
    b = b.withColumn("near", F.exists("ids", lambda g: (i >= start(g) - purge) & (i < end(g) + purge)))
    count = F.aggregate("ids", F.lit(0).cast("long"), lambda a, g: a + end(g) - start(g))
    last = end(F.array_max("ids"))
    b = b.withColumn("held", (i >= last) & (i < last + F.floor(count * embargo)))
    b = b.withColumn("role", F.when(F.col("test"), "test").when(~F.col("near") & ~F.col("held"), "train")).filter("role is not null")
    return b.select("series", "fold_id", "bar_idx", "role")


def moments(returns: DataFrame, r: str = "r") -> DataFrame:
    """Per series: n, mean, sample deviation, population skewness and raw kurtosis."""
    x = F.col(r)
    s = returns.filter(x.isNotNull() & ~F.isnan(x)).groupBy("series")
    m = s.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg(x * x).alias("m2"), F.avg(x * x * x).alias("m3"), F.avg(x * x * x * x).alias("m4"))
    mu = F.col("mean")
    var = F.col("m2") - mu * mu
    third = F.col("m3") - 3 * mu * F.col("m2") + 2 * mu * mu * mu
    fourth = F.col("m4") - 4 * mu * F.col("m3") + 6 * mu * mu * F.col("m2") - 3 * mu * mu * mu * mu
    return m.select("series", "n", "mean", "sd", F.when(var > 0, third / F.pow(var, 1.5)).otherwise(0.0).alias("skew"), F.when(var > 0, fourth / (var * var)).otherwise(3.0).alias("kurt"))


def expected_best(n_trials: int) -> float:
    """Expected largest Sharpe ratio of independent trials without skill."""
    if n_trials <= 1:
        return 0.0
    gamma, q = 0.5772156649, NormalDist().inv_cdf
    return (1 - gamma) * q(1 - 1 / n_trials) + gamma * q(1 - 1 / (n_trials * math.e))


def _normal_cdf(z: Column) -> Column:
    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return x.map(NormalDist().cdf, na_action="ignore")

    return cdf(z)


def deflated_sharpe(returns: DataFrame, n_trials: int, annual: float = 365**0.5, threshold: float = 0.5, r: str = "r") -> DataFrame:
    """Per series: sharpe, expected_max, dsr, psr, passed. Fewer than 10 returns never pass."""
    m = moments(returns, r)
    kurt = F.least("kurt", F.lit(30.0))
    best = expected_best(n_trials) * F.greatest(F.lit(0.5), 1 + (kurt - 3) / (4 * F.greatest("n", F.lit(10))))
    m = m.withColumn("sharpe", F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd") * annual).otherwise(0.0)).withColumn("expected_max", F.greatest(F.lit(0.0), best))
    var = (1 - F.col("skew") * F.col("sharpe") + (kurt - 1) / 4 * F.col("sharpe") * F.col("sharpe")) / (F.col("n") - 1)
    m = m.withColumn("se", F.sqrt(F.greatest(var, F.lit(1e-12))))
    m = m.withColumn("dsr", _normal_cdf((F.col("sharpe") - F.col("expected_max")) / F.col("se"))).withColumn("psr", _normal_cdf(F.col("sharpe") / F.col("se")))
    ok = F.col("n") >= 10
    return m.select("series", "n", "sharpe", "expected_max", F.when(ok, F.col("dsr")).otherwise(0.0).alias("dsr"), F.when(ok, F.col("psr")).otherwise(0.0).alias("psr"), (ok & (F.col("dsr") >= threshold)).alias("passed"))


def _sims(trades: DataFrame, n: int) -> DataFrame:
    return trades.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))))


def _paths(drawn: DataFrame, initial: float) -> DataFrame:
    """Per run and sim of ordered draws (pos, net_pnl): final equity, largest drawdown and Sharpe ratio of equity steps."""
    w = Window.partitionBy("run", "sim").orderBy("pos")
    d = drawn.withColumn("equity", initial + F.sum("net_pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("step", F.col("net_pnl") / F.greatest(F.abs(F.col("equity") - F.col("net_pnl")), F.lit(1e-9)))
    d = d.withColumn("peak", F.greatest(F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(initial)))
    return d.groupBy("run", "sim").agg(F.max_by("equity", "pos").alias("final"), F.max((F.col("peak") - F.col("equity")) / F.col("peak") * 100).alias("drawdown"), ratio(F.avg("step"), F.stddev_pop("step")).alias("sharpe"))


def _verdict(paths: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """sim 0 is the observed order; p: share of the others at least as good; with intervals of the others."""
    seen = paths.filter("sim = 0").select("run", F.col(metric).alias("observed"))
    beats = F.col(metric) >= F.col("observed") if higher_is_better else F.col(metric) <= F.col("observed")
    return paths.filter("sim > 0").join(seen, "run").groupBy("run", "observed").agg(F.count("*").alias("n_sims"), F.avg(beats.cast("double")).alias("p_value"), F.avg(metric).alias("mean"), *(F.percentile_approx(metric, q).alias(f"q{round(q * 100):02d}") for q in (0.01, 0.05, 0.95, 0.99)))


def shuffle_test(trades: DataFrame, n: int = 200, seed: int = 42, initial: float = 1000.0, metric: str = "sharpe", block: int = 1) -> DataFrame:
    """Permutes each run's trades (run, id, net_pnl), or blocks of them; at least five trades.

    A simulation's order is that of hashes, so it needs no random stream. mean and deviation of plain pnl would not see
    the order; the Sharpe ratio of equity steps and the drawdown do.
    """
    t = trades.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("id")) - 1)
    enough = t.groupBy("run").count().filter("count >= 5").select("run")
    s = _sims(t.join(enough, "run", "left_semi"), n).withColumn("part", F.floor(F.col("k") / block))
    order = F.when(F.col("sim") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("run", "sim", "part", F.lit(seed)))
    s = s.withColumn("pos", F.row_number().over(Window.partitionBy("run", "sim").orderBy(order, "k")))
    return _verdict(_paths(s, initial), metric, metric != "drawdown")


def bootstrap(trades: DataFrame, n: int = 200, seed: int = 42, initial: float = 1000.0) -> DataFrame:
    """Draws each run's trades with replacement: the interval of the final equity."""
    t = trades.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("id")) - 1).withColumn("m", F.count("*").over(Window.partitionBy("run")))
    s = _sims(t, n).withColumn("pos", F.col("k"))
    pick = F.when(F.col("sim") == 0, F.col("k")).otherwise(F.pmod(F.xxhash64("run", "sim", "k", F.lit(seed)), F.col("m")))
    drawn = s.select("run", "sim", "pos", pick.alias("k")).join(t.select("run", "k", "net_pnl"), ["run", "k"])
    return _verdict(_paths(drawn, initial), "final", True)


def robustness(r: DataFrame) -> DataFrame:
    """Score of rows with wfe, degradation, dsr, p_value: 30, 25, 25 and 20 points; all_passed at the usual bounds."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = 30 * clip(F.col("wfe")) + 25 * clip(1 - F.col("degradation")) + 25 * clip(F.col("dsr")) + 20 * clip(1 - F.col("p_value") / 0.10)
    passed = (F.col("wfe") >= 0.3) & (F.col("degradation") <= 0.4) & (F.col("dsr") >= 0.4) & (F.col("p_value") <= 0.10)
    return r.withColumn("score", score).withColumn("all_passed", passed)


def layers(bars: DataFrame, trades: DataFrame, equity: DataFrame, n_trials: int, sims: int = 200, n_windows: int = 5) -> DataFrame:
    """Per series with five trades: wfe, degradation, dsr, p_value, score, all_passed of one set of parameters.

    Windows score in- and out-of-sample bars by the Sharpe ratio of equity steps; degradation is the mean relative loss of
    the folds' test bars against their train bars.
    """
    e = equity.withColumn("r", F.col("equity") / F.lag("equity").over(Window.partitionBy("series").orderBy("bar_idx")) - 1)
    sharpe = ratio(F.avg("r"), F.stddev_pop("r"))
    sizes = bars.groupBy("series").agg(F.count("*").alias("n_bars"))
    w = walk_forward_windows(sizes, n_windows)
    part = lambda a, z, name: in_windows(e, w, a, z).groupBy("series", "window_id").agg(sharpe.alias(name))
    wfe = efficiency(part("is_start", "is_end", "is_score").join(part("oos_start", "oos_end", "oos_score"), ["series", "window_id"])).select("series", "wfe")
    folds = e.join(purged_folds(sizes), ["series", "bar_idx"]).groupBy("series", "fold_id", "role").agg(sharpe.alias("s"))
    folds = folds.groupBy("series", "fold_id").agg(F.max(F.when(F.col("role") == "train", F.col("s"))).alias("a"), F.max(F.when(F.col("role") == "test", F.col("s"))).alias("b"))
    lost = folds.groupBy("series").agg(F.coalesce(F.avg(F.when(F.col("a") > 0, 1 - F.col("b") / F.col("a"))), F.lit(1.0)).alias("degradation"))
    dsr = deflated_sharpe(e, n_trials).select("series", "dsr")
    p = shuffle_test(trades.withColumnRenamed("series", "run"), sims).select(F.col("run").alias("series"), "p_value")
    return robustness(wfe.join(lost, "series").join(dsr, "series").join(p, "series"))


def window_aggregate(windows: DataFrame, initial: float = 1000.0, plain: bool = False) -> DataFrame:
    """Over window results (run, window_id, ret in percent, days, degradation): mean, median, deviation, compounded
    equity and return, drawdown, win rate, profit factor, mean degradation of windows where it is not nearly 0.

    The profit factor is 999 where no window lost, or the plain quotient."""
    w = Window.partitionBy("run").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    e = windows.withColumn("equity", initial * F.exp(F.sum(F.log(F.greatest(1 + F.col("ret") / 100, F.lit(1e-9)))).over(w)))
    e = e.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(initial)))
    a = e.groupBy("run").agg(
        F.count("*").alias("n_windows"),
        F.avg("ret").alias("mean_ret"),
        F.percentile("ret", 0.5).alias("median_ret"),
        F.stddev_pop("ret").alias("sd_ret"),
        F.max_by("equity", "window_id").alias("final"),
        F.max((F.col("peak") - F.col("equity")) / F.col("peak") * 100).alias("drawdown"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        profit_factor(F.sum(F.greatest("ret", F.lit(0.0))), F.sum(F.greatest(-F.col("ret"), F.lit(0.0))), plain).alias("profit_factor"),
        F.avg(F.when(F.abs("degradation") > 0.001, F.col("degradation"))).alias("degradation"),
        F.sum("days").alias("days"),
    )
    return a.withColumn("annual_ret", (F.pow(F.col("final") / initial, 365.0 / F.col("days")) - 1) * 100).drop("days")


def stability(params: DataFrame) -> DataFrame:
    """Mean cosine similarity of the parameter vectors (run, window_id, p) of consecutive windows."""
    w = Window.partitionBy("run").orderBy("window_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    p = params.withColumn("q", F.lag("p").over(w)).filter("q is not null")
    return p.withColumn("cos", dot("p", "q") / F.sqrt(dot("p", "p") * dot("q", "q"))).groupBy("run").agg(F.avg("cos").alias("stability"))


