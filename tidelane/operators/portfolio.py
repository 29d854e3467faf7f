"""Portfolios of return series: correlation, combinations, weights and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import ratio


def correlations(returns: DataFrame) -> DataFrame:
    """a, b, corr of every two series (a < b) over the times both have; joined on time, so only series multiply."""
    x = returns.select("ts_ms", F.col("series").alias("a"), F.col("r").alias("ra"))
    y = returns.select("ts_ms", F.col("series").alias("b"), F.col("r").alias("rb"))
    return x.join(y, "ts_ms").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("corr"))


def combinations(names: DataFrame, most: int = 3) -> DataFrame:
    """members: sorted arrays of 1 to `most` names; each size extends the one before by later names, of which each row has
    the list."""
    every = names.groupBy().agg(F.sort_array(F.collect_set("name")).alias("all"))  # one row: the names of a portfolio's choice
    out = last = every.select(F.explode("all").alias("n"), "all").select(F.array("n").alias("members"), "all")
    for _ in range(most - 1):
        later = F.filter("all", lambda n: n > F.element_at("members", -1))
        last = last.withColumn("n", F.explode(later)).select(F.array_append("members", F.col("n")).alias("members"), "all")
        out = out.union(last)
    return out.select(F.size("members").cast("long").alias("size"), F.array_join("members", "+").alias("combo"), "members")


def weight_grid(combos: DataFrame, steps: int = 5) -> DataFrame:
    """combos with weights: every choice of `steps` values from 0.1 to 0.9 for each member, scaled to sum to 1."""
    values = F.array(*(F.lit(0.1 + 0.8 * k / (steps - 1)) for k in range(steps)))
    c = combos.withColumn("w", F.array().cast("array<double>"))
    done = None
    for k in range(1, 4):
        c = c.withColumn("x", F.explode(values)).withColumn("w", F.array_append("w", F.col("x"))).drop("x")
        part = c.filter(F.col("size") == k)
        done = part if done is None else done.union(part)
        c = c.filter(F.col("size") > k)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return done.withColumn("weights", F.transform("w", lambda x: x / total)).drop("w")


def metrics(returns: DataFrame, weighted: DataFrame, annual: float = 365.0) -> DataFrame:
    """Per combo and weights: total, sharpe, sortino, max_drawdown, diversification.

    weighted: combo, weights_id, name, weight. Missing returns of a member count as 0. diversification: weighted mean of
    the members' deviations by the deviation of the whole.
    """
    r = returns.select("ts_ms", F.col("series").alias("name"), "r").join(weighted, "name")
    keys = ["combo", "weights_id"]
    p = r.groupBy(*keys, "ts_ms").agg(F.sum(F.col("r") * F.col("weight")).alias("p"))
    w = Window.partitionBy(*keys).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("equity", F.exp(F.sum(F.log1p(F.greatest("p", F.lit(-0.999999)))).over(w)))
    p = p.withColumn("fall", 1 - F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)))
    m = p.groupBy(*keys).agg(
        (F.max_by("equity", "ts_ms") - 1).alias("total"),
        ratio(F.avg("p") * annual**0.5, F.stddev_pop("p")).alias("sharpe"),
        ratio(F.avg("p") * annual**0.5, F.coalesce(F.stddev_pop(F.when(F.col("p") < 0, F.col("p"))), F.lit(0.0))).alias("sortino"),
        F.max("fall").alias("max_drawdown"),
        F.stddev_pop("p").alias("sd"),
    )
    own = r.groupBy(*keys, "name").agg(F.stddev_pop("r").alias("s"), F.first("weight").alias("w")).groupBy(*keys).agg(F.sum(F.col("s") * F.col("w")).alias("parts"))
    return m.join(own, keys).withColumn("diversification", ratio(F.col("parts"), F.col("sd"), 1.0)).drop("sd", "parts")


def moments(returns: DataFrame) -> DataFrame:
    """a, b (a <= b) and sums over all times of both: n, sa, sb, sab; one pass, of partial sums that merge."""
    x = returns.select("ts_ms", F.col("series").alias("a"), F.col("r").alias("ra"))
    y = returns.select("ts_ms", F.col("series").alias("b"), F.col("r").alias("rb"))
    return x.join(y, "ts_ms").filter("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("ra").alias("sa"), F.sum("rb").alias("sb"), F.sum(F.col("ra") * F.col("rb")).alias("sab"))


def ranked(returns: DataFrame, grid: DataFrame, annual: float = 365.0) -> DataFrame:
    """combo, weights_id, sharpe and diversification of each row of the grid (combo, weights_id, members, weights).

    A portfolio's mean and variance are forms in its weights over the series' sums and sums of products, so the returns are
    read once for all weights; only the times that any member has are counted for each combination. Missing returns of a
    member count as 0.
    """
    m = moments(returns)
    times = grid.select("combo", "members").distinct().select("combo", F.explode("members").alias("series")).join(returns.select("series", "ts_ms"), "series")
    times = times.groupBy("combo", "ts_ms").agg(F.count("*").alias("k")).groupBy("combo").agg(F.count("*").alias("n_times"))
    own = F.arrays_zip(F.col("members").alias("name"), F.col("weights").alias("w"))
    pairs = grid.select("combo", "weights_id", F.explode(own).alias("x"), own.alias("all")).select("combo", "weights_id", F.col("x.name").alias("a"), F.col("x.w").alias("wa"), F.explode("all").alias("y"))
    pairs = pairs.select("combo", "weights_id", "a", "wa", F.col("y.name").alias("b"), F.col("y.w").alias("wb")).filter("a <= b")
    same = F.col("a") == F.col("b")
    sd = F.sqrt(F.greatest(F.col("sab") / F.col("n") - F.pow(F.col("sa") / F.col("n"), 2), F.lit(0.0)))
    x = pairs.join(m, ["a", "b"]).groupBy("combo", "weights_id").agg(
        F.sum(F.when(same, F.col("wa") * F.col("sa"))).alias("total"),
        F.sum(F.col("wa") * F.col("wb") * F.col("sab") * F.when(same, 1).otherwise(2)).alias("squares"),
        F.sum(F.when(same, F.col("wa") * sd)).alias("parts"),
    )
    x = x.join(times, "combo").withColumn("mean", F.col("total") / F.col("n_times"))
    x = x.withColumn("sd", F.sqrt(F.greatest(F.col("squares") / F.col("n_times") - F.pow("mean", F.lit(2)), F.lit(0.0))))
    return x.select("combo", "weights_id", ratio(F.col("mean") * annual**0.5, F.col("sd")).alias("sharpe"), ratio(F.col("parts"), F.col("sd"), 1.0).alias("diversification"))


def search(spark: SparkSession, returns: DataFrame, most: int = 3, steps: int = 5, top: int = 20) -> DataFrame:
    """The best portfolios by Sharpe ratio among all combinations and weights: all are ranked by moments, and the paths of
    the best alone are walked."""
    names = returns.select(F.col("series").alias("name")).distinct()
    grid = weight_grid(combinations(names, most), steps).withColumn("weights_id", F.xxhash64(F.transform("weights", lambda w: F.round(w, 12)))).dropDuplicates(["combo", "weights_id"])
    best = ranked(returns, grid).orderBy(F.round("sharpe", 9).desc(), "combo", "weights_id").limit(top).select("combo", "weights_id")
    each = grid.join(F.broadcast(best), ["combo", "weights_id"])  # `top` rows
    each = each.select("combo", "weights_id", F.explode(F.arrays_zip(F.col("members").alias("name"), F.col("weights").alias("weight"))).alias("x")).select("combo", "weights_id", "x.*")
    return metrics(returns, each).orderBy(F.desc("sharpe"), "combo", "weights_id")
