"""Which later bar first crosses a level, and which levels live at a bar, by a tree over the bars of each series.

A node of level 0 is a bar; a node of level l + 1 covers FAN nodes of level l. A group holds the extremes of the nodes under
one parent in two arrays. An event looks into one group a level on its way up, until one has a node that crosses, and into
one a level on its way down, so it meets as many rows as the tree is high, twice. Groups above the bars' own are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import held

FAN = 64
BROADCAST_BYTES = 16 << 20  # of a level's groups, by their number


def _levels(bars: DataFrame, fan: int) -> list[DataFrame]:
    """Groups of each level, from the bars' own to the one of a single group: series, parent, lows, highs."""
    n, last = bars.agg(F.count("*"), F.max("bar_idx")).first()
    out, nodes, size = [], bars.select("series", F.col("bar_idx").alias("at"), F.col("l").alias("low"), F.col("h").alias("high")), (last or 0) + 1
    while True:
        g = nodes.groupBy("series", F.floor(F.col("at") / fan).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("x"))
        g = held(g.select("series", "parent", F.col("x.low").alias("lows"), F.col("x.high").alias("highs")))
        out.append(F.broadcast(g) if n // fan ** len(out) * 16 <= BROADCAST_BYTES and out else g)
        if size <= fan:
            return out
        size = -(-size // fan)
        nodes = g.select("series", F.col("parent").alias("at"), F.array_min("lows").alias("low"), F.array_max("highs").alias("high"))


def _first(start: Column) -> Column:
    """The first place in the joined group, `start` or later, that crosses the event's level; null if there is none."""
    places = F.when(start < F.size("lows"), F.sequence(start, F.size("lows") - 1)).otherwise(F.array().cast("array<int>"))
    crossed = F.when(F.col("direction") == 1, F.filter(places, lambda k: F.get("lows", k) <= F.col("level"))).otherwise(F.filter(places, lambda k: F.get("highs", k) >= F.col("level")))
    return F.get(crossed, F.lit(0))


def first_crossing(events: DataFrame, bars: DataFrame, fan: int = FAN) -> DataFrame:
    """events (series, event, from_idx, direction, level) with crossed_idx, the first bar from from_idx on that crosses.

    direction 1: a low at or below the level, -1: a high at or above it. Bars have positions from 0 without gaps.
    """
    levels = _levels(bars, fan)
    aside = -1 - F.pmod(F.xxhash64("series", "event"), F.lit(1 << 40))  # a key that no group has, one for each event
    e = events.withColumns({"_at": F.col("from_idx").cast("long"), "_hit": F.lit(None).cast("long"), "_high": F.lit(None).cast("int")})

    def look(e: DataFrame, level: int, searching: Column, parent: Column, start: Column) -> DataFrame:
        """e with _found, the first node of the level that crosses in the group of this parent, for the events searching."""
        e = e.withColumn("parent", F.when(searching, parent).otherwise(aside)).join(levels[level], ["series", "parent"], "left")
        return e.withColumn("_found", F.col("parent") * fan + _first(start)).drop("lows", "highs", "parent")

    for level in range(len(levels)):
        open_ = F.col("_hit").isNull()
        e = look(e, level, open_, F.floor(F.col("_at") / fan), (F.col("_at") % fan).cast("int"))
        e = e.withColumns({"_hit": F.coalesce("_hit", "_found"), "_high": F.coalesce("_high", F.when(F.col("_found").isNotNull(), level)), "_at": F.floor(F.col("_at") / fan) + 1})
    for level in range(len(levels) - 1, 0, -1):
        there = F.coalesce(F.col("_high") == level, F.lit(False))
        e = look(e, level - 1, there, F.col("_hit"), F.lit(0))
        e = e.withColumns({"_hit": F.when(there, F.col("_found")).otherwise(F.col("_hit")), "_high": F.when(there, level - 1).otherwise(F.col("_high"))})
    return e.select(*events.columns, F.col("_hit").alias("crossed_idx"))


def _pieces(start: Column, end: Column, height: int, fan: int) -> Column:
    """(tier, node) of the tree's nodes that together cover positions start up to end, which is left out.

    At each tier stand the nodes from the first whole one to the first whole parent, and from the last whole parent on; at
    the top, all whole ones.
    """
    out = []
    for tier in range(height):
        first, last = F.ceil(start / fan**tier).cast("long"), F.floor(end / fan**tier).cast("long")
        up, down = F.ceil(start / fan ** (tier + 1)).cast("long") * fan, F.floor(end / fan ** (tier + 1)).cast("long") * fan
        if tier == height - 1:
            runs = [(first, last)]
        else:
            whole = up < down
            runs = [(first, F.when(whole, up).otherwise(last)), (F.when(whole, down).otherwise(last), last)]
        for low, high in runs:
            some = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
            out.append(F.transform(some, lambda k: F.struct(F.lit(tier).alias("tier"), k.alias("node"))))
    return F.concat(*out)


def nearest_live(bars: DataFrame, levels: DataFrame, fan: int = 16) -> DataFrame:
    """series, bar_idx, above (the least live level with direction -1) and below (the greatest with direction 1).

    levels: series, direction, level, born, dead (the first bar at which it lives no more; null: never). Each life is cut
    into nodes of the tree, whose extremes go down to the bars a level at a time: no bar meets the levels themselves.
    """
    last = bars.agg(F.max("bar_idx")).first()[0]
    height, size = 1, (last or 0) + 1
    while size > fan:
        height, size = height + 1, -(-size // fan)
    end = F.coalesce(F.least("dead", F.lit((last or 0) + 1)), F.lit((last or 0) + 1))
    p = levels.select("series", "direction", "level", F.explode(_pieces(F.col("born"), end, height, fan)).alias("x"))
    best = [F.min(F.when(F.col("direction") == -1, F.col("level"))).alias("above"), F.max(F.when(F.col("direction") == 1, F.col("level"))).alias("below")]
    nodes = held(p.groupBy("series", "x.tier", "x.node").agg(*best))
    each = [bars.select("series", F.col("bar_idx").alias("node"))]
    for tier in range(1, height):
        parents = each[-1].select("series", F.floor(F.col("node") / fan).alias("node")).distinct()
        each.append(held(parents) if tier == 1 else parents)
    down = None
    for tier in range(height - 1, -1, -1):
        own = each[tier].join(nodes.filter(F.col("tier") == tier).drop("tier"), ["series", "node"], "left")
        if down is not None:
            over = down.select("series", F.col("node").alias("_p"), F.col("above").alias("_a"), F.col("below").alias("_b"))
            own = own.withColumn("_p", F.floor(F.col("node") / fan)).join(over, ["series", "_p"], "left")
            own = own.select("series", "node", F.least("above", "_a").alias("above"), F.greatest("below", "_b").alias("below"))
        down = own
    return down.withColumnRenamed("node", "bar_idx")
