"""Market regimes: by volatility and trend, by clusters of rolling features, with segments and statistics."""

from __future__ import annotations

from statistics import median

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from .bars import in_order
from .windows import back, gaps_and_islands, true_range

#: Labels.
TREND_UP, TREND_DOWN, RANGING, HIGH_VOL_UP, HIGH_VOL_DOWN = 1, 2, 3, 4, 5
#: Mean returns up to this size are neither up nor down.
FLAT = 0.0001
FEATURES = ("ret_mean", "ret_sd", "volume_share", "range_share", "slope_share")


def volatility_trend(bars: DataFrame, alpha: float = 0.07, period: int = 20, lookback: int = 100, percent: float = 70.0) -> DataFrame:
    """Bars with regime, direction and norm_vol.

    direction: the trend line's two-bar change by the close, smoothed over 5 bars; it counts beyond the 30th percentile of
    its size after the warm-up. Volatility is high over the percentile of the last lookback + 1 bars; the first bars take
    the first full window's percentile.
    """
    w = in_order()
    b = folds.trend_line(bars, "c", alpha).withColumn("tr", true_range())
    b = b.withColumn("d", F.coalesce((F.col("itrend") - F.lag("itrend", 2).over(w)) / F.col("c"), F.lit(0.0)))
    b = folds.rma(folds.ema(b, "d", 5, "direction"), "tr", period, "atr").withColumn("norm_vol", F.when(F.col("c") > 0, F.col("atr") / F.col("c")).otherwise(0.0))
    edge = F.percentile("norm_vol", percent / 100).over(w.rowsBetween(-lookback, 0))
    b = b.withColumn("_e", F.when(F.col("bar_idx") >= lookback, edge))
    b = b.withColumn("vol_edge", F.coalesce("_e", F.first("_e", ignorenulls=True).over(Window.partitionBy("series").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    late = F.col("bar_idx") >= max(lookback, 50)
    size = b.groupBy("series").agg(F.coalesce(F.percentile(F.when(late, F.abs("direction")), 0.3), F.percentile(F.abs("direction"), 0.3)).alias("_p"))
    b = b.join(size, "series").withColumn("_t", F.greatest(F.lit(1e-6), F.col("_p")))
    high, up, down = F.col("norm_vol") > F.col("vol_edge"), F.col("direction") > F.col("_t"), F.col("direction") < -F.col("_t")
    label = F.when(F.col("bar_idx") < 2, RANGING).when(high & up, HIGH_VOL_UP).when(high & down, HIGH_VOL_DOWN).when(up, TREND_UP).when(down, TREND_DOWN).otherwise(RANGING)
    return b.withColumn("regime", label).drop("d", "tr", "_e", "_p", "_t")


def features(bars: DataFrame, n: int = 20) -> DataFrame:
    """Bars with FEATURES over the last n bars; null until there are as many."""
    w, f = in_order(), back(n)
    b = bars.withColumn("r", F.log(F.col("c") / F.lag("c").over(w)))
    b = b.withColumns(
        {
            "ret_mean": F.avg("r").over(f),
            "ret_sd": F.stddev_pop("r").over(f),
            "volume_share": F.col("v") / F.avg("v").over(f),
            "range_share": (F.max("h").over(f) - F.min("l").over(f)) / F.avg("c").over(f),
            "slope_share": F.abs(F.regr_slope("c", F.col("bar_idx").cast("double")).over(f)) / F.avg("c").over(f),
        }
    )
    return b.withColumns({c: F.when(F.col("bar_idx") >= n, F.col(c)) for c in FEATURES}).drop("r")


def named(returns: list[float], volatility: list[float]) -> list[int]:
    """The regime of each centre by its mean return and its volatility."""
    middle = median(volatility)
    calm = lambda r: RANGING if abs(r) <= FLAT else TREND_UP if r > 0 else TREND_DOWN
    wild = lambda r: RANGING if abs(r) <= FLAT else HIGH_VOL_UP if r > 0 else HIGH_VOL_DOWN
    return [wild(r) if v > middle else calm(r) for r, v in zip(returns, volatility)]


def clusters(bars: DataFrame, n: int = 20, k: int = 4, seed: int = 42) -> DataFrame:
    """Bars that have features, with regime: k-means of the standardised features, named by the clusters' centres.

    A centre ranges where its mean return is within FLAT of 0; the sign gives the side of the others, which are
    high-volatility ones where ret_sd is above the centres' median and trends where it is not.
    """
    b = VectorAssembler(inputCols=list(FEATURES), outputCol="_raw", handleInvalid="skip").transform(features(bars, n).dropna(subset=list(FEATURES)))
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(b)
    b = scaler.transform(b)
    model = KMeans(featuresCol="_x", predictionCol="cluster", k=k, seed=seed, maxIter=50).fit(b)
    scaled = [list(map(float, c)) for c in model.clusterCenters()]
    centres = [[c[j] * scaler.std[j] + scaler.mean[j] for j in range(2)] for c in scaled]  # as they were measured
    names = {i: name for i, name in enumerate(named([c[0] for c in centres], [c[1] for c in centres]))}
    label = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("cluster")]
    return model.transform(b).withColumn("regime", label).drop("_raw", "_x")


def segments(labels: DataFrame) -> DataFrame:
    """Runs of one regime: series, run, regime, first, last, n_bars, ret in percent between its first and last close."""
    s = gaps_and_islands(labels, "regime").withColumnRenamed("label", "regime")
    c = labels.select("series", "bar_idx", "c")
    s = s.join(c.withColumnRenamed("bar_idx", "first").withColumnRenamed("c", "a"), ["series", "first"]).join(c.withColumnRenamed("bar_idx", "last").withColumnRenamed("c", "b"), ["series", "last"])
    return s.select("series", "run", "regime", "first", "last", "n_bars", ((F.col("b") / F.col("a") - 1) * 100).alias("ret"))


def statistics(labels: DataFrame) -> DataFrame:
    """Per series and regime: count, pct, mean and deviation of returns between successive bars of the regime."""
    before = F.lag("c").over(Window.partitionBy("series", "regime").orderBy("bar_idx"))
    r = labels.withColumn("r", F.col("c") / before - 1)
    s = r.groupBy("series", "regime").agg(F.count("*").alias("n_bars"), F.avg("r").alias("mean_ret"), F.stddev_pop("r").alias("sd_ret"))
    return s.withColumn("pct", F.col("n_bars") / F.sum("n_bars").over(Window.partitionBy("series")) * 100)


def trades_by_regime(trades: DataFrame, labels: DataFrame) -> DataFrame:
    """Per series and regime at entry: n_trades, pnl, win_rate, sharpe (mean by deviation, times the root of n)."""
    t = trades.join(labels.select("series", F.col("bar_idx").alias("entry_idx"), "regime"), ["series", "entry_idx"])
    a = t.groupBy("series", "regime").agg(F.count("*").alias("n_trades"), F.sum("net_pnl").alias("pnl"), (F.avg((F.col("net_pnl") > 0).cast("double")) * 100).alias("win_rate"), F.avg("net_pnl").alias("m"), F.stddev_pop("net_pnl").alias("sd"))
    return a.select("series", "regime", "n_trades", "pnl", "win_rate", F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * F.sqrt("n_trades")).otherwise(0.0).alias("sharpe"))
