"""Higher time frames: buckets of bars, aligned back without looking ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .bars import in_order


def buckets(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars of a higher time frame: series, bucket, o, h, l, c, v, n_bars."""
    b = bars.withColumn("bucket", F.floor(F.col("ts_ms") / (seconds * 1000)))
    return b.groupBy("series", "bucket").agg(F.min_by("o", "ts_ms").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts_ms").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n_bars"))


def resample(bars: DataFrame, seconds: int, x: str = "c", name: str = "htf") -> DataFrame:
    """Adds x of the last bar before the current bucket; x of the first bar while there is no earlier bucket."""
    w = in_order()
    b = bars.withColumn("_b", F.floor(F.col("ts_ms") / (seconds * 1000)))
    b = b.withColumn("_e", F.when(F.col("bar_idx") == 0, F.col(x)).when(F.col("_b") != F.lag("_b").over(w), F.lag(x).over(w)))
    return b.withColumn(name, F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b", "_e")


def last_completed(bars: DataFrame, higher: DataFrame, seconds: int, columns: list[str]) -> DataFrame:
    """Adds columns of the last bucket before each bar's own (htf_*), null in the first one."""
    w = Window.partitionBy("series").orderBy("bucket")
    done = higher.select("series", "bucket", *(F.lag(c).over(w).alias(f"htf_{c}") for c in columns))
    b = bars.withColumn("bucket", F.floor(F.col("ts_ms") / (seconds * 1000)))
    return b.join(done, ["series", "bucket"], "left").drop("bucket")


def detail_index(bars: DataFrame, detail: DataFrame, seconds: int) -> DataFrame:
    """Fine bars with the bar_idx they lie in: bars are regular, so the interval join is one on the bucket."""
    step = seconds * 1000
    d = detail.withColumn("_open", F.floor(F.col("ts_ms") / step) * step)
    m = bars.select("series", F.col("ts_ms").alias("_open"), "bar_idx")
    return d.join(m, ["series", "_open"]).drop("_open")


def detail_in(bars: DataFrame, detail: DataFrame, seconds: int, span_ms: int = 4096 * 3_600_000) -> DataFrame:
    """Fine bars with the bar_idx they lie in, however irregular the bars' openings are.

    A bar lasts until the next one of its series opens, the last one `seconds`. The last opening is carried along the
    merged times of both tables, so no fine bar is compared with openings.
    """
    until = F.lead("ts_ms").over(in_order())
    m = bars.select("series", "ts_ms", "bar_idx", F.coalesce(until, F.col("ts_ms") + seconds * 1000).alias("until"))
    d = blocks.last_before(detail, m, ["bar_idx", "until"], span_ms)
    return d.filter(F.col("ts_ms") < F.col("asof_until")).withColumnRenamed("asof_bar_idx", "bar_idx").drop("asof_until")


def as_of(left: DataFrame, right: DataFrame, columns: list[str], key: str = "series", ts: str = "ts_ms") -> DataFrame:
    """left with columns of the last right row at or before it; one shuffle, no range join."""
    names = [f"asof_{c}" for c in columns]
    a = left.withColumn("_left", F.lit(1)).withColumns({n: F.lit(None) for n in names})
    b = right.select(key, ts, F.lit(0).alias("_left"), *(F.col(c).alias(n) for c, n in zip(columns, names)))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names}).filter("_left = 1").drop("_left")


def partial_bars(detail: DataFrame) -> DataFrame:
    """Running open, high, low, close and volume inside each main bar; detail needs series, bar_idx, ts_ms and o..v."""
    w = Window.partitionBy("series", "bar_idx").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    return detail.select("series", "bar_idx", "ts_ms", F.first("o").over(w).alias("po"), F.max("h").over(w).alias("ph"), F.min("l").over(w).alias("pl"), F.col("c").alias("pc"), F.sum("v").over(w).alias("pv"))
