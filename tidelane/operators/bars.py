"""Candles: building, checking, repairing and merging OHLCV bars.

A bar table has the columns series, ts_ms (bar open, UTC), o, h, l, c, v; `indexed` adds bar_idx, the position in the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("series", "ts_ms")
#: Seconds of each time frame code.
TIME_FRAMES = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800}


def candles(ticks: DataFrame, seconds: int, series: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Ticks as bars of `seconds`; equal times are ordered by `tie`. One shuffle, combined before it."""
    step = seconds * 1000
    ms = F.unix_micros(F.col(ts).cast("timestamp")) / 1000
    t = ticks.select(F.col(series).alias("series"), (F.floor(ms / step) * step).cast("long").alias("ts_ms"), F.struct(ts, tie).alias("at"), F.col(value).cast("double").alias("x"))
    return t.groupBy("series", "ts_ms").agg(F.min_by("x", "at").alias("o"), F.max("x").alias("h"), F.min("x").alias("l"), F.max_by("x", "at").alias("c"), F.count("*").cast("double").alias("v"))


def indexed(bars: DataFrame) -> DataFrame:
    """Bars with their position in the series."""
    w = Window.partitionBy("series").orderBy("ts_ms")
    return bars.withColumn("bar_idx", (F.row_number().over(w) - 1).cast("long"))


def in_order():
    """The window of a bar's series up to it; frames are set on top of it."""
    return Window.partitionBy("series").orderBy("bar_idx")


def with_prices(bars: DataFrame) -> DataFrame:
    return bars.withColumn("hl2", (F.col("h") + F.col("l")) / 2).withColumn("hlc3", (F.col("h") + F.col("l") + F.col("c")) / 3)


def row_range(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Positions start to end, end left out, numbered anew."""
    return bars.filter((F.col("bar_idx") >= start) & (F.col("bar_idx") < end)).withColumn("bar_idx", F.col("bar_idx") - start)


def row_set(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """The bars at the positions of a table (series, bar_idx), numbered anew."""
    picked = bars.join(positions, ["series", "bar_idx"], "left_semi")
    return picked.withColumn("bar_idx", (F.row_number().over(in_order()) - 1).cast("long"))


def train_validation(bars: DataFrame, share: float = 0.7) -> DataFrame:
    """Bars with `part`: the first int(n * share) of a series are train."""
    n = F.count("*").over(Window.partitionBy("series"))
    return bars.withColumn("part", F.when(F.col("bar_idx") < F.floor(n * share), "train").otherwise("validation"))


def validate(bars: DataFrame, seconds: int, slack: float = 1e-10) -> DataFrame:
    """Counts of each fault per series; a series is valid without nulls and duplicates."""
    step = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("series").orderBy("ts_ms"))
    b = bars.withColumn("step", step)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    nulls = F.col("o").isNull() | F.col("h").isNull() | F.col("l").isNull() | F.col("c").isNull() | F.col("v").isNull()
    out = b.groupBy("series").agg(
        F.count("*").alias("n_bars"),
        count(nulls).alias("n_null"),
        count(F.col("h") < F.greatest("o", "c") - slack).alias("bad_high"),
        count(F.col("l") > F.least("o", "c") + slack).alias("bad_low"),
        count(F.col("step") == 0).alias("n_duplicate"),
        count(F.col("step") > 2 * seconds * 1000).alias("n_gap"),
    )
    return out.withColumn("valid", (F.col("n_null") == 0) & (F.col("n_duplicate") == 0) & (F.col("n_bars") > 0))


def info(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars, span, duplicates and gaps of more than 1.5 bars per series."""
    step = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("series").orderBy("ts_ms"))
    b = bars.withColumn("step", step)
    return b.groupBy("series").agg(
        F.count("*").alias("n_bars"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.sum(F.when(F.col("step") == 0, 1).otherwise(0)).cast("long").alias("n_duplicate"),
        F.sum(F.when(F.col("step") > 1.5 * seconds * 1000, 1).otherwise(0)).cast("long").alias("n_gap"),
    )


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """Each run of missing bars: after_ms, before_ms, missing."""
    before = F.lead("ts_ms").over(Window.partitionBy("series").orderBy("ts_ms"))
    g = bars.select("series", F.col("ts_ms").alias("after_ms"), before.alias("before_ms"))
    return g.withColumn("missing", F.floor((F.col("before_ms") - F.col("after_ms")) / (seconds * 1000)) - 1).filter("missing > 0")


def fill_gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars on the whole grid: missing ones repeat the last close with no volume; `filled` marks them."""
    step = seconds * 1000
    before = F.lead("ts_ms").over(Window.partitionBy("series").orderBy("ts_ms"))
    b = bars.withColumn("next_ms", F.coalesce(before, F.col("ts_ms") + step))
    # each bar makes the bars up to the next one: nothing is joined
    grid = b.withColumn("at", F.explode(F.sequence(F.col("ts_ms"), F.greatest(F.col("next_ms") - step, F.col("ts_ms")), F.lit(step).cast("long"))))
    own = F.col("at") == F.col("ts_ms")
    pick = lambda x: F.when(own, F.col(x)).otherwise(F.col("c")).alias(x)
    return grid.select("series", F.col("at").alias("ts_ms"), pick("o"), pick("h"), pick("l"), "c", F.when(own, F.col("v")).otherwise(0.0).alias("v"), (~own).alias("filled"))


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' bars, the existing one where both have it; repeats within a side keep the least row."""
    both = existing.withColumn("rank", F.lit(0)).unionByName(new.withColumn("rank", F.lit(1)))
    rest = [c for c in existing.columns if c not in KEYS]
    best = both.groupBy(*KEYS).agg(F.min(F.struct("rank", *rest)).alias("x"))
    return best.select(*KEYS, *(F.col(f"x.{c}").alias(c) for c in rest))


def missing_ranges(held: DataFrame, wanted: DataFrame, seconds: int, warm_up: int = 300) -> DataFrame:
    """What to download per series: the head before and the tail after what is held; wanted: series, start_ms, end_ms."""
    step = seconds * 1000
    span = held.groupBy("series").agg(F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    w = wanted.withColumn("start_ms", F.col("start_ms") - warm_up * step).join(span, "series", "left")
    whole = F.when(F.col("low").isNull(), F.array(F.struct(F.lit("all").alias("side"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))))
    head = F.when(F.col("start_ms") < F.col("low"), F.struct(F.lit("head").alias("side"), F.col("start_ms").alias("from_ms"), (F.col("low") - step).alias("to_ms")))
    tail = F.when(F.col("end_ms") > F.col("high"), F.struct(F.lit("tail").alias("side"), (F.col("high") + step).alias("from_ms"), F.col("end_ms").alias("to_ms")))
    parts = F.coalesce(whole, F.filter(F.array(head, tail), lambda x: x.isNotNull()))
    return w.select("series", F.explode(parts).alias("x")).select("series", "x.*")
