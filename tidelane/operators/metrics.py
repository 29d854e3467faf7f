"""Performance of equity curves and trades, calendar statistics, objectives and losses; all as grouped aggregates.

Equity tables have run, bar_idx, ts_ms, equity; trade tables run, exit_ms, net_pnl, size and what a function names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_S = 365.25 * 86400
REJECTED = -999.0


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b where b is above 0."""
    return F.when(b > 0, a / b).otherwise(otherwise)


def quotient(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it: infinite over 0, or no number where a is 0 too."""
    over_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b != 0, a / b).when(a.isNotNull() & b.isNotNull(), over_zero)


def drawdowns(equity: DataFrame) -> DataFrame:
    """equity with peak and drawdown in percent of it."""
    w = Window.partitionBy("run").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    e = equity.withColumn("peak", F.max("equity").over(w))
    return e.withColumn("drawdown", F.when(F.col("peak") == 0, 0.0).otherwise((F.col("peak") - F.col("equity")) / F.col("peak") * 100))


def equity_summary(equity: DataFrame, initial: float, bar_seconds: int, plain: bool = False) -> DataFrame:
    """Per run: total_return, sharpe, sortino, max_drawdown, annual_return, calmar. Deviations are population ones.

    annual_return is 0 for short spans and total losses, calmar without a drawdown; plain: both are plain quotients and powers.
    """
    w = Window.partitionBy("run").orderBy("bar_idx")
    e = drawdowns(equity).withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    down = F.when(F.col("r") < -1e-12, F.col("r"))  # steps of nothing are no losses
    scale = (YEAR_S / bar_seconds) ** 0.5
    s = e.groupBy("run").agg(
        F.max_by("equity", "bar_idx").alias("last"),
        F.avg("r").alias("mean"),
        F.stddev_pop("r").alias("sd"),
        F.stddev_pop(down).alias("down_sd"),
        F.max("drawdown").alias("max_drawdown"),
        ((F.max("ts_ms") - F.min("ts_ms")) / 1000 / YEAR_S).alias("years"),
    )
    s = s.withColumn("total_return", (F.col("last") - initial) / initial * 100)
    s = s.withColumn("sharpe", ratio(F.col("mean") * scale, F.coalesce("sd", F.lit(0.0)))).withColumn("sortino", ratio(F.col("mean") * scale, F.coalesce("down_sd", F.lit(0.0))))
    grown = (F.pow(1 + F.col("total_return") / 100, quotient(F.lit(1.0), F.col("years"))) - 1) * 100
    s = s.withColumn("annual_return", grown if plain else F.when((F.col("years") > 0.01) & (F.col("total_return") > -100), grown).otherwise(0.0))
    s = s.withColumn("calmar", (quotient if plain else ratio)(F.col("annual_return"), F.col("max_drawdown")))
    return s.select("run", "total_return", "sharpe", "sortino", "max_drawdown", "annual_return", "calmar")


def trade_summary(trades: DataFrame, plain: bool = False) -> DataFrame:
    """Per run: n_trades, win_rate, profit_factor (999 without losses), avg_win, avg_loss as percent of size, 0 where there are none.

    plain: profit_factor is the plain quotient, and averages of nothing are null.
    """
    win = F.col("net_pnl") > 0
    pct = F.col("net_pnl") / F.col("size") * 100
    mean = F.avg if plain else lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    t = trades.groupBy("run").agg(
        F.count("*").alias("n_trades"),
        (F.sum(win.cast("int")) / F.count("*") * 100).alias("win_rate"),
        F.sum(F.when(win, F.col("net_pnl")).otherwise(0.0)).alias("profit"),
        F.abs(F.sum(F.when(~win, F.col("net_pnl")).otherwise(0.0))).alias("loss"),
        mean(F.when(win, pct)).alias("avg_win"),
        mean(F.when(~win, F.abs(pct))).alias("avg_loss"),
    )
    return t.select("run", "n_trades", "win_rate", profit_factor(F.col("profit"), F.col("loss"), plain).alias("profit_factor"), "avg_win", "avg_loss")


def profit_factor(gain: Column, loss: Column, plain: bool) -> Column:
    return quotient(gain, loss) if plain else ratio(gain, loss, 999.0)


def reconciled(trades: DataFrame, equity: DataFrame, initial: float, plain: bool = False) -> DataFrame:
    """trade_summary (which explains plain), but from equity steps where the trades' sum drifts from the change of equity."""
    w = Window.partitionBy("run").orderBy("bar_idx")
    e = equity.withColumn("d", F.col("equity") - F.lag("equity").over(w)).groupBy("run").agg(
        (F.max_by("equity", "bar_idx") - initial).alias("change"),
        F.sum(F.greatest("d", F.lit(0.0))).alias("gain"),
        F.sum(F.greatest(-F.col("d"), F.lit(0.0))).alias("fall"),
    )
    t = trade_summary(trades, plain).join(trades.groupBy("run").agg(F.sum("net_pnl").alias("total")), "run").join(e, "run")
    drift = F.abs(F.col("total") - F.col("change")) > F.greatest(F.lit(1.0), F.abs("change") * 0.01)
    factor = F.when(F.col("total") != 0, F.abs(F.col("change") / F.col("total"))).otherwise(1.0)
    for c in ("avg_win", "avg_loss"):
        t = t.withColumn(c, F.when(drift, F.col(c) * factor).otherwise(F.col(c)))
    return t.withColumn("profit_factor", F.when(drift, profit_factor(F.col("gain"), F.col("fall"), plain)).otherwise(F.col("profit_factor"))).drop("total", "change", "gain", "fall")


def _month(ms: str) -> Column:
    return F.date_format(F.timestamp_millis(F.col(ms)), "yyyy-MM")


def monthly_trades(trades: DataFrame, initial: float = 1000.0) -> DataFrame:
    """Per run and month of exit: pnl, pnl_pct of the capital at its start, n_trades, win_rate.

    Capital never falls below 1 % of the initial one, which makes its running sum a fold over the months' trades; that fold
    is a running sum less its running least value, so it stays a window.
    """
    floor = initial * 0.01
    order = Window.partitionBy("run").orderBy("exit_ms", "id")
    t = trades.withColumn("month", _month("exit_ms")).withColumn("sum", F.sum("net_pnl").over(order.rowsBetween(Window.unboundedPreceding, 0)) + initial)
    least = F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("capital", F.col("sum") + F.greatest(F.lit(0.0), floor - least))
    t = t.withColumn("before", F.coalesce(F.lag("capital").over(order), F.lit(initial)))
    m = t.groupBy("run", "month").agg(
        F.sum("net_pnl").alias("pnl"),
        F.count("*").alias("n_trades"),
        (F.sum((F.col("net_pnl") > 0).cast("int")) / F.count("*") * 100).alias("win_rate"),
        F.min_by("before", F.struct("exit_ms", "id")).alias("start"),
    )
    return m.withColumn("pnl_pct", F.greatest(F.lit(-200.0), F.least(F.lit(200.0), F.col("pnl") / F.col("start") * 100))).drop("start")


def monthly_equity(equity: DataFrame) -> DataFrame:
    """Per run and month: end equity and pnl_pct against the end of the month before (the first equity at first).

    Months without a point between the first and the last one keep the equity and return nothing.
    """
    m = equity.withColumn("month", _month("ts_ms")).groupBy("run", "month").agg(F.max_by("equity", "ts_ms").alias("end"), F.min_by("equity", "ts_ms").alias("begin"))
    day = lambda agg: F.to_date(F.concat(agg("month"), F.lit("-01")))
    grid = m.groupBy("run").agg(F.sequence(day(F.min), day(F.max), F.expr("interval 1 month")).alias("all"))
    grid = grid.select("run", F.explode("all").alias("day")).select("run", F.date_format("day", "yyyy-MM").alias("month"))
    w = Window.partitionBy("run").orderBy("month")
    m = grid.join(m, ["run", "month"], "left").withColumn("end", F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.coalesce(F.lag("end").over(w), F.col("begin"))
    return m.select("run", "month", "end", ((F.col("end") / start - 1) * 100).alias("pnl_pct"))


def weekly_trades(trades: DataFrame) -> DataFrame:
    """Per run and ISO week of exit: pnl, pnl_pct of the mean size, n_trades, win_rate."""
    day = F.timestamp_millis(F.col("exit_ms"))
    t = trades.withColumn("iso_year", F.extract(F.lit("yearofweek"), day).cast("long")).withColumn("iso_week", F.weekofyear(day).cast("long"))
    return t.groupBy("run", "iso_year", "iso_week").agg(
        F.sum("net_pnl").alias("pnl"),
        (F.sum("net_pnl") / F.avg(F.abs("size")) * 100).alias("pnl_pct"),
        F.count("*").alias("n_trades"),
        (F.sum((F.col("net_pnl") > 0).cast("int")) / F.count("*") * 100).alias("win_rate"),
    )


def period_stats(periods: DataFrame) -> DataFrame:
    """Of monthly or weekly rows: n_periods, pct_positive, worst, best, avg_return, period_sharpe per run."""
    s = periods.groupBy("run").agg(
        F.count("*").alias("n_periods"),
        (F.sum((F.col("pnl_pct") > 0).cast("int")) / F.count("*") * 100).alias("pct_positive"),
        F.min("pnl_pct").alias("worst"),
        F.max("pnl_pct").alias("best"),
        F.avg("pnl_pct").alias("avg_return"),
        F.stddev_pop("pnl_pct").alias("sd"),
    )
    sd = F.when(F.col("n_periods") > 1, F.col("sd")).otherwise(1.0)
    return s.withColumn("period_sharpe", ratio(F.col("avg_return"), sd)).drop("sd")


def spans(trades: DataFrame) -> DataFrame:
    """Calendar months and weeks between the first and the last exit per run."""
    first, last = F.timestamp_millis(F.min("exit_ms")), F.timestamp_millis(F.max("exit_ms"))
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
    return trades.groupBy("run").agg(months.cast("double").alias("cal_months"), ((F.max("exit_ms") - F.min("exit_ms")) / (7 * 86_400_000.0)).alias("cal_weeks"))


def composite(r: DataFrame) -> Column:
    pos = lambda c, most: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col(c)))
    return 0.4 * F.greatest(F.lit(0.0), F.col("sharpe")) + 0.2 * pos("profit_factor", 5) / 5 + 0.2 * pos("calmar", 5) / 5 + 0.2 * F.col("win_rate") / 100


def consistency(calendar: str, robust: bool = False, leverage: float = 1.0) -> Column:
    """Objective over rows with period_stats, win_rate, profit_factor, max_drawdown, n_trades, cal_periods.

    calendar: monthly or weekly, which sets the least number of periods, the trades a period and the weight of the worst.
    """
    monthly = calendar == "monthly"
    least_periods, worst_unit = (2, 100.0) if monthly else (4, 50.0 if not robust or not monthly else 100.0)
    least_trades = ((1.0, 3.5) if monthly else (0.2, 0.8))[robust]
    if monthly:
        worst_unit = 100.0
    cal = F.greatest(F.col("cal_periods"), F.col("n_periods").cast("double"))
    wr = F.col("win_rate") / 100
    score = F.col("period_sharpe") * F.col("pct_positive") / 100 * F.greatest(F.lit(0.1), 1 + F.least(F.lit(0.0), F.col("worst")) / worst_unit)
    score = score * F.sqrt(F.least(F.lit(1.0), F.col("n_periods") / cal))
    bad = (F.col("n_periods") < least_periods) | (F.col("n_trades") / cal < least_trades)
    if not robust:
        return F.when(bad, REJECTED).otherwise(score * (0.5 + 0.5 * wr))
    dd = F.abs("max_drawdown")
    factors = (0.5 + 0.5 * F.least(F.lit(1.0), (wr - 0.4) / 0.6)) * (1.0 if leverage <= 15 else max(0.3, 1 - (leverage - 15) / 30))
    factors = factors * F.when(dd <= 15, 1.0).otherwise(F.greatest(F.lit(0.2), 1 - (dd - 15) / 35)) * F.least(F.lit(1.5), F.col("profit_factor") / 2)
    return F.when(bad | (F.col("win_rate") < 40) | (F.col("profit_factor") < 1), REJECTED).otherwise(score * factors)


def liquidation_gate(trades: DataFrame, runs: DataFrame, most: int = 2, bypass: float = 10.0) -> DataFrame:
    """Runs (total_return, max_drawdown) with worst_month, the most liquidations of a month, and safe."""
    m = trades.filter("exit_reason = 'liquidation'").groupBy("run", _month("exit_ms").alias("month")).count()
    worst = m.groupBy("run").agg(F.max("count").alias("worst_month"))
    r = runs.join(worst, "run", "left").fillna(0, ["worst_month"])
    return r.withColumn("safe", (F.col("worst_month") <= most) | (ratio(F.col("total_return"), F.abs("max_drawdown")) >= bypass))


def rejection(rules: list[tuple[Column, str]]) -> Column:
    """The text of the first rule that holds, null if none does."""
    out = None
    for cond, text in rules:
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def buckets(trades: DataFrame, period: str) -> DataFrame:
    """Trades by day, week (ISO) or month of entry: n_trades, win_rate, pnl, ret, drawdown of the running pnl, sharpe."""
    ts = F.timestamp_millis(F.col("entry_ms"))
    label = {"daily": F.date_format(ts, "yyyy-MM-dd"), "weekly": F.concat_ws("-", F.extract(F.lit("yearofweek"), ts), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")), "monthly": F.date_format(ts, "yyyy-MM")}[period]
    w = Window.partitionBy("run", "bucket").orderBy("entry_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("bucket", label).withColumn("sum", F.sum("net_pnl").over(w))
    t = t.withColumn("fall", F.max("sum").over(w) - F.col("sum")).withColumn("pct", F.col("net_pnl") / F.col("size") * 100)
    b = t.groupBy("run", "bucket").agg(
        F.count("*").alias("n_trades"),
        (F.sum((F.col("net_pnl") > 0).cast("int")) / F.count("*") * 100).alias("win_rate"),
        F.sum("net_pnl").alias("pnl"),
        F.sum("pct").alias("ret"),
        F.max("fall").alias("drawdown"),
        F.avg("pct").alias("mean"),
        F.stddev_samp("pct").alias("sd"),
    )
    return b.withColumn("sharpe", ratio(F.col("mean"), F.coalesce("sd", F.lit(0.0)))).drop("mean", "sd")


def parse_target(spec: str) -> tuple[str, str, float, float]:
    """metric:period:threshold:consistency."""
    metric, period, threshold, share = spec.split(":")
    return metric, period, float(threshold), float(share)


def evaluate_targets(trades: DataFrame, specs: list[str]) -> DataFrame:
    """Per run and spec: share of the period's buckets that meet the threshold, and passed. A drawdown must stay below it."""
    spark = trades.sparkSession
    parsed = [(s, *parse_target(s)) for s in specs]
    out = None
    for period in sorted({p[2] for p in parsed}):
        own = spark.createDataFrame([p for p in parsed if p[2] == period], "spec string, metric string, period string, threshold double, need double")
        metrics = F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in ("win_rate", "pnl", "return", "drawdown", "sharpe", "trades"))), F.array("win_rate", "pnl", "ret", "drawdown", "sharpe", F.col("n_trades").cast("double"))))
        rows = buckets(trades, period).select("run", metrics.alias("metric", "value")).join(F.broadcast(own), "metric")
        met = F.when(F.col("metric") == "drawdown", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
        e = rows.groupBy("run", "spec", "need").agg(F.count("*").alias("n_buckets"), F.avg(met.cast("double")).alias("share"), F.avg("value").alias("mean"), F.min("value").alias("worst"))
        out = e if out is None else out.unionByName(e)
    return out.withColumn("passed", F.col("share") >= F.col("need")).drop("need")


LOSS_LEAST_TRADES, LOSS_TOO_FEW = 10, 1000.0


def losses(trades: DataFrame, balance: float = 1000.0) -> DataFrame:
    """Three losses to minimise per run, of trades in order: quality over quantity, conservative calmar, regime aware.

    Months are the whole days between first and last exit by 30, one at least. Runs of fewer than LOSS_LEAST_TRADES trades
    lose LOSS_TOO_FEW. Depths are in shares of the starting balance: `low` below the start, `fall` below the peak.
    """
    w = Window.partitionBy("run").orderBy("exit_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("ratio", F.col("net_pnl") / F.col("size")).withColumn("sum", F.sum("net_pnl").over(w))
    t = t.withColumn("fall", F.max("sum").over(w) - F.col("sum"))
    days = F.floor((F.max("exit_ms") - F.min("exit_ms")) / 86_400_000)
    s = t.groupBy("run").agg(
        F.count("*").alias("n"),
        F.greatest(days / 30, F.lit(1.0)).alias("months"),
        F.sum("ratio").alias("total"),
        *_sides("net_pnl"),
        *_sides("ratio"),
        (F.greatest(-F.min("sum"), F.lit(0.0)) / balance).alias("low"),
        (F.max("fall") / balance).alias("fall"),
        F.stddev_samp("ratio").alias("sd"),
    )
    n, per_month, zero = F.col("n"), F.col("n") / F.col("months"), F.lit(0.0)
    over = lambda x, limit: F.greatest(x - limit, zero)
    win, pf = F.col("net_pnl_wins") / n, F.col("net_pnl_gain") / F.col("net_pnl_lost")
    share = n / (10 * F.col("months"))  # of ten trades a month
    mean = F.col("total") * 100 / n
    quality = (
        -F.col("total") * 100
        + F.when(share > 1.5, F.pow(share - 1.5, 2) * 50).when(share < 0.3, 20.0).otherwise(zero)
        + F.when(F.col("low") > 0.15, (F.col("low") - 0.15) * 200).otherwise(F.col("low") * 10)
        + over(F.lit(1.5), pf) * 30
        + over(win, 0.7) * 100
        + over(F.lit(0.35), win) * 50
        + over(F.coalesce("sd", zero), 0.05) * 100
        - F.least(over(pf, 1.0), F.lit(3.0)) * 5
        - F.when(mean > 1, F.least(mean, F.lit(5.0)) * 2).otherwise(zero)
    )
    crowded = F.when(per_month > 15, 0.5).when(per_month > 10, 0.75).otherwise(1.0)
    calmar = -F.when(F.col("fall") > 0, F.col("total") / F.pow("fall", F.lit(1.5))).otherwise(F.col("total") * 10) * crowded
    win, pf = F.col("ratio_wins") / n, F.col("ratio_gain") / F.col("ratio_lost")
    regime = -F.col("total") * 100 + over(F.col("low"), 0.15) * 500 + over(F.lit(1.5), pf) * 50 + over(win, 0.7) * 200 + over(F.lit(0.4), win) * 100 + over(per_month, 12) * 5
    few = lambda x: F.when(n < LOSS_LEAST_TRADES, LOSS_TOO_FEW).otherwise(x)
    return s.select("run", few(quality).alias("quality"), few(calmar).alias("calmar"), few(regime).alias("regime"))


def _sides(x: str) -> list:
    """Number and sum of a column's gains, and the sum of its losses, 0.001 where there are none."""
    lost = F.sum(F.when(F.col(x) < 0, -F.col(x)))
    return [F.count_if(F.col(x) > 0).alias(f"{x}_wins"), F.sum(F.greatest(F.col(x), F.lit(0.0))).alias(f"{x}_gain"), F.coalesce(lost, F.lit(0.001)).alias(f"{x}_lost")]


def monthly(trades: DataFrame, equity: DataFrame | None = None) -> DataFrame:
    """run, month, pnl_pct: from the equity curve where there is one, else from the trades."""
    return (monthly_trades(trades) if equity is None else monthly_equity(equity)).select("run", "month", "pnl_pct")
