"""Parameter studies as tables: the searches of all windows go on together, and a round of all of them is a fixed number of jobs.

A study is a row of a table of windows; its trials are rows with the window's columns, `trial_id`, a column a parameter and
`score`. Scores come from any function of a table of trials. Chance is a hash of seed, window, trial and parameter, so a lost
task draws the same again. What a study has seen is start + rounds * batch trials at most, whatever the windows' data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators import blocks
from tidelane.operators.bars import in_order
from tidelane.operators.tables import held

from .search import Param

Score = Callable[[DataFrame], DataFrame]
DISCRETE = ("bool", "categorical")


def _chance(seed: int, keys: list[str], *tags: str) -> Column:
    """A number in [0, 1) for each window, trial and tag."""
    h = F.xxhash64(F.lit(seed), *keys, "trial_id", *(F.lit(t) for t in tags))
    return F.shiftrightunsigned(h, 11) / float(2**53)


def _fit(p: Param, x: Column) -> Column:
    """x in the parameter's range and on its step."""
    x = F.greatest(F.lit(p.low), F.least(F.lit(p.high), x))
    if p.step:
        x = F.least(F.lit(p.high), F.lit(p.low) + F.round((x - p.low) / p.step) * p.step)
    return F.round(x).cast("long") if p.kind == "int" else x.cast("double")


def _draw(p: Param, u: Column) -> Column:
    """The parameter's value at place u of [0, 1)."""
    if p.kind in DISCRETE:
        options = p.values()
        return F.element_at(F.array(*(F.lit(v) for v in options)), F.floor(u * len(options)).cast("int") + 1)
    return _fit(p, u * (p.high - p.low) + p.low)


def _density(p: Param, among: Column) -> Column:
    """How dense the parameter's column lies among trials: shares of options, or Gaussian bumps with a floor of one."""
    n, x = F.size(among), F.col(p.name)
    if p.kind in DISCRETE:
        return (1 + F.size(F.filter(among, lambda t: t[p.name] == x))) / (len(p.values()) + n)
    width = F.greatest(F.lit(1e-9), (p.high - p.low) / F.greatest(F.lit(4.0), 2 * F.sqrt(n.cast("double"))))
    bumps = F.aggregate(among, F.lit(0.0), lambda s, t: s + F.exp(-0.5 * F.pow((x - t[p.name]) / width, 2)))
    return (1 + bumps) / (1 + n)


def grid(windows: DataFrame, params: list[Param]) -> DataFrame:
    """All combinations of all parameters for each window, numbered by trial_id."""
    t, number = windows, F.lit(0)
    for p in params:
        values = p.values()
        t = t.select("*", F.posexplode(F.array(*(F.lit(v) for v in values))).alias(f"_{p.name}", p.name))
        number = number * len(values) + F.col(f"_{p.name}")
    return t.withColumn("trial_id", number.cast("long")).drop(*(f"_{p.name}" for p in params))


def best(trials: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """The n best trials of each study, ties to the smaller trial_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "trial_id")
    return trials.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


def tpe(windows: DataFrame, keys: list[str], params: list[Param], score: Score, rounds: int = 6, batch: int = 8, start: int = 24, share: float = 0.25, draws: int = 24, seed: int = 42) -> DataFrame:
    """Tree-structured Parzen estimator over all windows: every trial made, with its score.

    keys name a window. Up to `start` random trials, then in each round the `batch` of draws * batch candidates near good
    trials whose density among the best share of trials is largest against that among the rest. A trial is made once: a study
    whose candidates are all known makes none. Parameters' `needs` are not looked at. No windows give no trials.
    """
    names, columns = [p.name for p in params], windows.columns
    first = windows.withColumn("trial_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(start - 1).cast("long"))))
    first = first.withColumns({p.name: _draw(p, _chance(seed, keys, p.name)) for p in params})
    known = held(score(first.groupBy(*columns, *names).agg(F.min("trial_id").alias("trial_id"))))
    study = Window.partitionBy(*keys)
    for r in range(rounds):
        ranked = known.withColumn("_place", F.row_number().over(study.orderBy(F.desc("score"), "trial_id")))
        seen = ranked.groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct("_place", *names))).alias("_seen"))
        at = F.greatest(F.lit(3), F.round(F.size("_seen") * share)).cast("int")
        seen = seen.withColumn("_good", F.slice("_seen", F.lit(1), at)).withColumn("_rest", F.filter("_seen", lambda t: t["_place"] > F.size("_good")))
        low = start + r * draws * batch
        c = seen.withColumn("trial_id", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(low + draws * batch - 1).cast("long"))))
        near = {}
        for p in params:
            v = F.get("_good", F.floor(_chance(seed, keys, p.name, "of") * F.size("_good")).cast("int"))[p.name]
            if p.kind in DISCRETE:
                near[p.name] = F.when(_chance(seed, keys, p.name, "stay") < 0.8, v).otherwise(_draw(p, _chance(seed, keys, p.name)))
            else:
                normal = F.sqrt(-2 * F.log(1 - _chance(seed, keys, p.name, "size"))) * F.cos(2 * math.pi * _chance(seed, keys, p.name, "turn"))
                near[p.name] = _fit(p, v + normal * ((p.high - p.low) / 6))
        c = c.withColumns(near).filter(~F.exists("_seen", lambda t: reduce(lambda a, b: a & b, (t[n].eqNullSafe(F.col(n)) for n in names))))
        worth = reduce(lambda a, b: a + b, (F.log(_density(p, F.col("_good")) / _density(p, F.col("_rest"))) for p in params))
        c = c.select(*columns, "trial_id", *names, worth.alias("_worth"))
        same = Window.partitionBy(*keys, *names).orderBy("trial_id")
        c = c.withColumn("_same", F.row_number().over(same)).filter("_same = 1")
        c = c.withColumn("_place", F.row_number().over(study.orderBy(F.desc("_worth"), "trial_id"))).filter(F.col("_place") <= batch)
        known = known.unionByName(held(score(c.drop("_worth", "_same", "_place"))))
    return known


def tested(trials: DataFrame, keys: list[str], score: Score, spans: list[tuple[str, str, str]], top: int = 1, gate: Column | None = None) -> DataFrame:
    """The best `top` trials of each study on later spans (name, column of its start, of its end), one after another.

    After each span the best that passes the gate goes on alone. A row a study: its columns, the chosen trial's parameters and
    `score` (of the search), and name_score a span; nulls from the span on that none passed, whose trial is then null too.
    """
    chosen = best(trials, keys, top).withColumnRenamed("score", "_found")
    searched = best(trials, keys).select(*keys, "score")
    for name, lo, hi in spans:
        chosen = score(chosen.withColumns({"lo": F.col(lo), "hi": F.col(hi)}))
        if gate is not None and name != spans[-1][0]:
            chosen = chosen.filter(gate)
        chosen = held(best(chosen, keys).withColumnRenamed("score", f"{name}_score"))
    return searched.join(chosen.drop("_found"), keys, "left")


def crossovers(bars: DataFrame, longest: int, rows: int = 512) -> Score:
    """Scores of trials (series, lo, hi, fast, slow): what being long above and short below the slower mean earns.

    The score is the mean over the deviation of the next bar's change in price, signed by the faster mean against the slower
    one, over bars lo to hi - 2; 0 without a deviation. Means look back at most `longest` bars, across lo as well; before
    there are so many bars the position is flat. Sums for all look-backs are made once, whatever the trials.
    """

    def sums(df: DataFrame) -> DataFrame:
        w = in_order()
        df = df.withColumn("_sum", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        before = F.collect_list(F.col("_sum") - F.col("c")).over(w.rowsBetween(1 - longest, 0))
        return df.withColumns({"_before": before, "_step": F.lead("c").over(w) - F.col("c")})

    b = blocks.spread(bars.select("series", "bar_idx", "c"), sums, back=longest, ahead=1)
    b = held(b.withColumn("_block", F.floor(F.col("bar_idx") / rows)).drop("c"))

    def mean(n: str) -> Column:
        return (F.col("_sum") - F.get("_before", (F.size("_before") - F.col(n)).cast("int"))) / F.col(n)

    def score(trials: DataFrame) -> DataFrame:
        point = ["series", "lo", "hi", "fast", "slow"]
        t = trials.select(*point).distinct().withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / rows), F.floor((F.col("hi") - 1) / rows))))
        x = t.join(b, ["series", "_block"]).filter((F.col("bar_idx") >= F.col("lo")) & (F.col("bar_idx") < F.col("hi") - 1))
        x = x.withColumn("_gain", F.coalesce(F.signum(mean("fast") - mean("slow")), F.lit(0.0)) * F.col("_step"))
        s = x.groupBy(*point).agg(F.avg("_gain").alias("_m"), F.stddev_pop("_gain").alias("_d"))
        s = s.select(*point, F.when(F.col("_d") > 0, F.round(F.col("_m") / F.col("_d"), 9)).otherwise(0.0).alias("score"))
        return trials.join(s, point, "left").fillna(0.0, ["score"])

    return score
