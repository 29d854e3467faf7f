"""Market structure: swings, breaks, fair value gaps, order blocks, liquidity, and the later bars that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import in_order
from .crossings import first_crossing, nearest_live
from .windows import extreme, pivot

def swings(bars: DataFrame, n: int) -> DataFrame:
    """Swing highs and lows, dated at the extreme: series, bar_idx, is_high, price."""
    b = bars.withColumn("_up", extreme("h", n, n)).withColumn("_down", extreme("l", n, n, False))
    both = F.array_compact(F.array(F.when(F.col("_up"), F.struct(F.lit(True).alias("is_high"), F.col("h").alias("price"))), F.when(F.col("_down"), F.struct(F.lit(False).alias("is_high"), F.col("l").alias("price")))))
    return b.select("series", "bar_idx", F.explode(both).alias("x")).select("series", "bar_idx", "x.*")


def breaks(bars: DataFrame, n: int) -> DataFrame:
    """Closes at a swing beyond the running extreme of the swings before: series, bar_idx, direction, kind, price.

    kind: CHoCH where the direction differs from the break before, else BOS. Needs a swing high and a swing low.
    """
    s = swings(bars, n).join(bars.select("series", "bar_idx", "c"), ["series", "bar_idx"])
    both = s.groupBy("series").agg(F.countDistinct("is_high").alias("kinds")).filter("kinds = 2").select("series")
    w = Window.partitionBy("series", "is_high").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.join(both, "series", "left_semi").withColumn("top", F.max("price").over(w)).withColumn("bottom", F.min("price").over(w))
    up, down = F.col("is_high") & (F.col("c") > F.col("top")), ~F.col("is_high") & (F.col("c") < F.col("bottom"))
    b = s.withColumn("direction", F.when(up, 1).when(down, -1)).filter("direction is not null")
    before = F.lag("direction").over(Window.partitionBy("series").orderBy("bar_idx", F.col("is_high").desc()))
    kind = F.when(before == -F.col("direction"), "CHoCH").otherwise("BOS")
    return b.select("series", "bar_idx", "direction", kind.alias("kind"), F.col("c").alias("price"))


def trend(bars: DataFrame, events: DataFrame) -> DataFrame:
    """bars with trend, the direction of the last break at or before each, 0 before the first."""
    last = events.groupBy("series", "bar_idx").agg(F.last("direction").alias("_d"))
    w = in_order().rowsBetween(Window.unboundedPreceding, 0)
    b = bars.join(last, ["series", "bar_idx"], "left")
    return b.withColumn("trend", F.coalesce(F.last("_d", ignorenulls=True).over(w), F.lit(0))).drop("_d")


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Three-bar gaps, dated at the middle bar: series, bar_idx, direction, top, bottom."""
    w = in_order()
    h2, l2 = F.lag("h", 2).over(w), F.lag("l", 2).over(w)
    b = bars.withColumn("direction", F.when(F.col("l") > h2, 1).when(F.col("h") < l2, -1))
    b = b.withColumn("top", F.when(F.col("direction") == 1, F.col("l")).otherwise(l2)).withColumn("bottom", F.when(F.col("direction") == 1, h2).otherwise(F.col("h")))
    return b.filter("direction is not null").select("series", (F.col("bar_idx") - 1).alias("bar_idx"), "direction", "top", "bottom")


def mitigated_gaps(bars: DataFrame) -> DataFrame:
    """Gaps with the bar that first trades back into them, from the second bar after the gap on."""
    g = fair_value_gaps(bars)
    e = g.withColumn("event", F.col("bar_idx")).withColumn("from_idx", F.col("bar_idx") + 2).withColumn("level", F.when(F.col("direction") == 1, F.col("top")).otherwise(F.col("bottom")))
    return first_crossing(e, bars).select("series", "bar_idx", "direction", "top", "bottom", "crossed_idx")


def gap_zones(bars: DataFrame, lookback: int = 20, point_in_time: bool = False) -> DataFrame:
    """Bars that enter a gap of the last `lookback` bars: series, bar_idx, in_bull (a low within it), in_bear (a high).

    A gap counts from its own bar on, unless any bar trades back into it; with point_in_time it counts from the bar that
    shows it up to the one that first trades back.
    """
    g = mitigated_gaps(bars)
    first = F.col("bar_idx") + (1 if point_in_time else 0)
    reach = (g if point_in_time else g.filter("crossed_idx is null")).withColumn("at", F.explode(F.sequence(first, F.col("bar_idx") + lookback - 1)))
    if point_in_time:
        reach = reach.filter(F.col("crossed_idx").isNull() | (F.col("at") <= F.col("crossed_idx")))
    entered = F.when(F.col("direction") == 1, F.col("l")).otherwise(F.col("h")).between(F.col("bottom"), F.col("top"))
    hit = bars.select("series", F.col("bar_idx").alias("at"), "h", "l").join(reach.drop("bar_idx"), ["series", "at"]).filter(entered)
    flags = hit.groupBy("series", "at").agg(F.max(F.col("direction") == 1).alias("in_bull"), F.max(F.col("direction") == -1).alias("in_bear"))
    out = bars.select("series", "bar_idx").join(flags.withColumnRenamed("at", "bar_idx"), ["series", "bar_idx"], "left")
    return out.fillna(False, ["in_bull", "in_bear"])


def order_blocks(bars: DataFrame, length: int = 10) -> DataFrame:
    """The last opposite candle before a strong close: series, made_idx, bar_idx, direction, top, bottom, strength.

    Strong: beyond the last bar's extreme and that of the `length` bars before. strength: volume over its mean of 21 bars.
    """
    w = in_order()
    before = w.rowsBetween(-length, -1)
    b = bars.withColumn("_s", F.coalesce(F.col("v") / F.avg("v").over(w.rowsBetween(-20, 0)), F.lit(1.0)))
    body = F.struct(F.col("bar_idx").alias("bar_idx"), F.greatest("o", "c").alias("top"), F.least("o", "c").alias("bottom"), F.col("_s").alias("strength"))
    b = b.withColumn("_red", F.when(F.col("c") < F.col("o"), body)).withColumn("_green", F.when(F.col("c") > F.col("o"), body))
    up = (F.col("c") > F.lag("h").over(w)) & (F.col("c") > F.max("h").over(before))
    down = (F.col("c") < F.lag("l").over(w)) & (F.col("c") < F.min("l").over(before))
    # of the frame's candles those after bar 0 count, as far back as `length`
    last = lambda x: F.last(x, ignorenulls=True).over(w.rowsBetween(-length, -1))
    b = b.withColumn("_up", F.when(up & (F.col("bar_idx") > length), last("_red"))).withColumn("_down", F.when(down & (F.col("bar_idx") > length), last("_green")))
    each = F.array_compact(F.array(F.when(F.col("_up").isNotNull(), F.struct(F.lit(1).alias("direction"), F.col("_up").alias("b"))), F.when(F.col("_down").isNotNull(), F.struct(F.lit(-1).alias("direction"), F.col("_down").alias("b")))))
    return b.select("series", F.col("bar_idx").alias("made_idx"), F.explode(each).alias("x")).select("series", "made_idx", "x.direction", "x.b.*")


def mitigated_blocks(bars: DataFrame, length: int = 10) -> DataFrame:
    """Order blocks with the first later bar that trades through their far edge."""
    e = order_blocks(bars, length).withColumn("event", F.col("made_idx") * 2 + (F.col("direction") == 1).cast("int"))
    e = e.withColumn("from_idx", F.col("bar_idx") + 1).withColumn("level", F.when(F.col("direction") == 1, F.col("bottom")).otherwise(F.col("top")))
    return first_crossing(e, bars).drop("event", "from_idx", "level")


def block_proximity(bars: DataFrame, length: int = 10, reach: float = 0.02) -> DataFrame:
    """Distance of each close to the middle of the nearest block known and unmitigated at the bar, as a share of the close.

    Only distances up to `reach` count; a block counts from the bar that made it to the one that mitigates it. Bars are met
    by the bands of price a block can reach, so no block meets all bars.
    """
    w = F.log(F.lit(1 + reach))
    blocks = mitigated_blocks(bars, length).withColumn("middle", (F.col("top") + F.col("bottom")) / 2)
    band = F.floor(F.log("middle") / w)
    blocks = blocks.withColumn("band", F.explode(F.array(band - 1, band, band + 1, band + 2)))
    b = bars.withColumn("band", F.floor(F.log("c") / w))
    near = b.join(blocks.select("series", "band", "made_idx", "crossed_idx", "middle"), ["series", "band"])
    near = near.filter((F.col("made_idx") <= F.col("bar_idx")) & (F.col("crossed_idx").isNull() | (F.col("crossed_idx") > F.col("bar_idx"))))
    near = near.withColumn("distance", F.abs(F.col("c") - F.col("middle")) / F.col("c")).filter(F.col("distance") <= reach)
    best = near.groupBy("series", "bar_idx").agg(F.min("distance").alias("distance"))
    return bars.select("series", "bar_idx").join(best, ["series", "bar_idx"], "left")


def oscillator(bars: DataFrame, n: int = 5, length: int = 10, reach: float = 0.02, point_in_time: bool = False) -> DataFrame:
    """series, bar_idx, osc in 0..100: 0.6 of the close's place in the range of 4 n bars, with 0.2 for the structure's trend,
    and 0.4 of the nearness of unmitigated blocks: bullish ones below less bearish ones above, none beyond `reach`.

    Blocks that are mitigated at any time do not count; with point_in_time they count until they are, from when they are
    made. Bars and blocks meet by bands of price.
    """
    w = in_order().rowsBetween(-4 * n, 0)
    b = trend(bars, breaks(bars, n)).withColumn("_hi", F.max("h").over(w)).withColumn("_lo", F.min("l").over(w))
    place = F.when((F.col("bar_idx") >= 4 * n) & (F.col("_hi") > F.col("_lo")), ((F.col("c") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) - 0.5) * 2).otherwise(0.0)
    bonus = F.when(F.col("bar_idx") >= 4 * n, F.col("trend") * 0.2).otherwise(0.0)
    b = b.withColumn("_place", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), place + bonus)))
    step = F.log(F.lit(1 + 2 * reach))
    e = mitigated_blocks(bars, length).withColumn("edge", F.when(F.col("direction") == 1, F.col("top")).otherwise(F.col("bottom")))
    e = e.withColumnRenamed("bar_idx", "from_idx")
    if not point_in_time:
        e = e.filter("crossed_idx is null")
    at = F.floor(F.log("edge") / step)
    e = e.withColumn("band", F.explode(F.array(at - 1, at, at + 1))).select("series", "band", "direction", "edge", "from_idx", "made_idx", "crossed_idx")
    met = b.withColumn("band", F.floor(F.log("c") / step)).join(e, ["series", "band"])
    live = (F.col("made_idx") <= F.col("bar_idx")) & (F.col("crossed_idx").isNull() | (F.col("crossed_idx") > F.col("bar_idx"))) if point_in_time else F.col("from_idx") <= F.col("bar_idx")
    far = F.col("direction") * (F.col("c") - F.col("edge")) / F.col("c")
    met = met.filter(live).withColumn("far", far).filter((F.col("far") > 0) & (F.col("far") < reach))
    score = 1 - F.col("far") / reach
    near = met.groupBy("series", "bar_idx").agg(F.max(F.when(F.col("direction") == 1, score)).alias("bull"), F.max(F.when(F.col("direction") == -1, score)).alias("bear"))
    o = b.select("series", "bar_idx", "_place").join(near, ["series", "bar_idx"], "left").fillna(0.0, ["bull", "bear"])
    osc = (0.6 * F.col("_place") + 0.4 * (F.col("bull") - F.col("bear")) + 1) * 50
    return o.select("series", "bar_idx", F.greatest(F.lit(0.0), F.least(F.lit(100.0), osc)).alias("osc"))


def liquidity(bars: DataFrame, n: int = 5) -> DataFrame:
    """Nearest unswept pivot above the high (bsl) and below the low (ssl) of each bar, without a cap on the pivots kept.

    A pivot lives from its confirming bar until a bar reaches it; see folds.capped_levels for a pool with a cap.
    """
    born = swings(bars, n).select("series", F.when(F.col("is_high"), -1).otherwise(1).alias("direction"), F.col("price").alias("level"), (F.col("bar_idx") + n).alias("from_idx"))
    born = born.withColumn("event", F.col("from_idx") * 2 + (F.col("direction") == 1).cast("int"))
    lives = first_crossing(born, bars).select("series", "direction", "level", F.col("from_idx").alias("born"), F.col("crossed_idx").alias("dead"))
    near = nearest_live(bars, lives)
    return near.select("series", "bar_idx", F.col("above").alias("bsl"), F.col("below").alias("ssl"))


def barriers(bars: DataFrame, take: float, stop: float, most: int) -> DataFrame:
    """First touch after each bar's close: outcome TP, SL or none within `most` bars, with the bar; SL first on a tie.

    take and stop are shares of the close.
    """
    b = bars.select("series", F.col("bar_idx").alias("entry_idx"), F.col("c").alias("entry"))
    # the look-ahead is bounded, so the later bars come by position
    ahead = b.withColumn("bar_idx", F.explode(F.sequence(F.col("entry_idx") + 1, F.col("entry_idx") + most)))
    later = ahead.join(bars.select("series", "bar_idx", "h", "l"), ["series", "bar_idx"])
    sl = F.min(F.when(F.col("l") <= F.col("entry") * (1 - stop), F.col("bar_idx"))).alias("sl_idx")
    tp = F.min(F.when(F.col("h") >= F.col("entry") * (1 + take), F.col("bar_idx"))).alias("tp_idx")
    t = b.join(later.groupBy("series", "entry_idx").agg(sl, tp), ["series", "entry_idx"], "left")
    is_sl = F.col("sl_idx").isNotNull() & (F.col("tp_idx").isNull() | (F.col("sl_idx") <= F.col("tp_idx")))
    outcome = F.when(is_sl, "SL").when(F.col("tp_idx").isNotNull(), "TP").otherwise("none")
    return t.select("series", F.col("entry_idx").alias("bar_idx"), outcome.alias("outcome"), F.least("sl_idx", "tp_idx").alias("touch_idx"))
