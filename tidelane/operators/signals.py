"""Signals: scores, gates, price levels and the strategies that combine them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds, htf, structure
from .bars import in_order
from .windows import crossover, crossunder, momentum, multi_trend, strength, true_range, volume_ratio

PARTS = ("cross", "trend", "htf", "zone", "volume", "fisher", "momentum", "strength")
#: Points of each part by kind of score; a kind without a part does not look at it.
WEIGHTS = {
    "generic": {"cross": 20, "trend": 15, "htf": 15, "zone": 15, "volume": 15, "fisher": 10, "momentum": 10},
    "v7": {"cross": 20, "trend": 20, "zone": 15, "volume": 15, "fisher": 10, "momentum": 10, "strength": 10},
    "no_htf": {"cross": 25, "trend": 20, "zone": 20, "volume": 15, "fisher": 10, "momentum": 10},
    "itrend": {"cross": 30, "trend": 25, "volume": 25, "strength": 20},
    "soft_htf": {"cross": 20, "trend": 25, "htf": 15, "zone": 15, "volume": 10, "fisher": 15, "momentum": 10},
    "v63": {"cross": 20, "trend": 25, "zone": 20, "volume": 20, "fisher": 10, "momentum": 5},
}


def confidence(kind: str, parts: dict[str, Column], cap: float | None = 100.0) -> Column:
    """Sum of the weights whose part holds."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS[kind].items():
        if name in parts:
            total = total + F.when(parts[name], float(weight)).otherwise(0.0)
    return F.least(total, F.lit(cap)) if cap else total


@dataclass(frozen=True)
class Strategy:
    """A table of candidate signals from bars: direction, confidence, entry, stop, targets, by parameters."""

    name: str
    defaults: dict
    candidates: Callable[[DataFrame, dict], DataFrame] = field(repr=False)

    def signals(self, bars: DataFrame, **params) -> DataFrame:
        """Accepted signals: candidates over the least confidence, throttled in order."""
        p = self.defaults | params
        c = self.candidates(bars, p).filter(F.col("confidence") >= p["confidence_min"])
        a = folds.throttle(c, p["min_bars"], p.get("max_signals_per_day") or None)
        return with_exits(a.filter("accepted = 1").drop("accepted"), p)


    def of_trials(self, bars: DataFrame, trials: list[dict]) -> DataFrame:
        """Signals of all trials in one table with `trial`, the place in the list.

        Trials that differ in nothing but GATES share one table of candidates, so a search of gates is one branch of the plan
        however many trials it has.
        """
        alike: dict[str, list[int]] = {}
        for k, t in enumerate(trials):
            alike.setdefault(repr(sorted((n, v) for n, v in t.items() if n not in GATES)), []).append(k)
        found = None
        for places in alike.values():
            p = self.defaults | trials[places[0]]
            gates = [F.struct(F.lit(k).alias("trial"), *(F.lit((self.defaults | trials[k]).get(n) or None).cast(t).alias(f"_{n}") for n, t in GATES.items())) for k in places]
            c = self.candidates(bars, p).select("*", F.inline(F.array(*gates))).filter("confidence >= coalesce(_confidence_min, 0)")
            a = folds.throttle(c, F.coalesce("_min_bars", F.lit(0)), F.col("_max_signals_per_day"), keys=("series", "trial"))
            s = with_exits(a.filter("accepted = 1").drop("accepted", *(f"_{n}" for n in GATES)), p)
            found = s if found is None else found.unionByName(s)
        return found


#: Parameters that accept or reject candidates and change nothing else, with their types.
GATES = {"confidence_min": "double", "min_bars": "long", "max_signals_per_day": "long"}
REGISTRY: dict[str, Strategy] = {}


def strategy(name: str, **defaults):
    """Registers a function from bars and parameters to candidates; all strategies share the exits' parameters."""

    def add(f):
        REGISTRY[name] = Strategy(name, EXITS | defaults, f)
        return f

    return add


EXITS = {
    "min_bars": 12, "confidence_min": 75.0, "leverage": 20.0, "atr_mult": 1.5, "reward": (2.0, 3.0), "portions": (0.6, 0.4), "fixed_stop": 0.0, "fixed_targets": (),
    "be_pct": 1.5, "trailing": True, "trail_activate_pct": 2.5, "trail_pullback_pct": 1.0,
    "alpha_method": "manual", "manual_alpha": 0.42, "trigger_ema": 9, "overbought": 1.5, "oversold": -1.5, "trend_alpha": 0.09, "atr_period": 14, "volume_period": 20, "volume_mult": 1.5, "use_trend": True, "use_volume": True, "strength_lookback": 50, "strength_percent": 50.0, "htf_seconds": 14400,
}


def with_exits(s: DataFrame, p: dict) -> DataFrame:
    """Adds stop, targets, portions, be_trigger, trail_distance, leverage; what the candidates bring themselves stays.

    The stop lies atr_mult ATRs away, or fixed_stop percent if that is set; targets are multiples of its distance, or
    fixed_targets percent away. The break-even trigger is the nearer of the break-even price and the trailing stop's
    activation.
    """
    d, e, own = F.col("direction"), F.col("entry"), set(s.columns)
    away = e * p["fixed_stop"] / 100 if p["fixed_stop"] else F.col("atr") * p["atr_mult"]
    pcts = [x for x in (p["be_pct"], p["trail_activate_pct"] if p["trailing"] else 0) if x > 0]
    stop = F.coalesce(F.col("stop"), e - d * away) if "stop" in own else e - d * away
    s = s.withColumn("stop", stop).withColumn("_r", F.abs(e - F.col("stop")))
    plain = {
        "targets": F.array(*(e + d * e * x / 100 for x in p["fixed_targets"])) if p["fixed_targets"] else F.array(*(e + d * F.col("_r") * r for r in p["reward"])),
        "be_trigger": e + d * e * min(pcts) / 100 if pcts else F.lit(0.0),
        "trail_distance": e * p["trail_pullback_pct"] / 100 if p["trailing"] else F.lit(0.0),
    }
    shared = {"portions": F.array(*(F.lit(float(x)) for x in p["portions"])), "leverage": F.lit(float(p["leverage"]))}
    return s.withColumns({k: c for k, c in plain.items() if k not in own} | shared).drop("_r")


#: Rungs of the ladder: the level that may set it, and its distance in risks from the one before.
RUNGS = (("near", 0.8), ("near", 1.5), ("mid", 2.0), ("far", 2.5), (None, 4.0))


def ladder(s: DataFrame) -> DataFrame:
    """Adds targets of five rungs from entry, stop, direction, atr and levels near, mid, far (missing columns: none).

    Risk is the stop's distance, half an ATR at least. A level sets its rung when it lies more than 0.3 risks beyond the
    rung before.
    """
    d = F.col("direction")
    risk = F.greatest(F.abs(F.col("entry") - F.col("stop")), F.col("atr") * 0.5)
    s, at, rungs = s.withColumn("_risk", risk), "entry", []
    for k, (level, step) in enumerate(RUNGS):
        plain = F.col(at) + d * F.col("_risk") * step
        if level in s.columns:
            plain = F.when(d * (F.col(level) - F.col(at)) > 0.3 * F.col("_risk"), F.col(level)).otherwise(plain)
        at = f"_t{k}"
        s = s.withColumn(at, plain)
        rungs.append(at)
    return s.withColumn("targets", F.array(*rungs)).drop("_risk", *rungs)


def cycle_table(bars: DataFrame, p: dict) -> DataFrame:
    """Bars with the cycle of their middle, its trigger (a moving average of the cycle), and what its score reads."""
    w = in_order()
    middle = bars.withColumn("hl2", (F.col("h") + F.col("l")) / 2)
    b = folds.cycle(middle, p["alpha_method"], "hl2", trigger_ema=p["trigger_ema"], manual_alpha=p["manual_alpha"])
    b = folds.trend_line(b, "c", p["trend_alpha"])
    b = folds.rma(b.withColumn("tr", true_range()), "tr", p["atr_period"], "atr")
    b = crossunder(crossover(b, "cycle", "trigger", "bull_cross"), "cycle", "trigger", "bear_cross")
    b = strength(volume_ratio(b, p["volume_period"]), "cycle", p["strength_lookback"], p["strength_percent"])
    slope = F.col("itrend") - F.lag("itrend", 2).over(w)
    return b.withColumns({"slope": slope, "fisher_step": F.col("fisher") - F.lag("fisher").over(w), "momentum3": momentum("cycle")})


def _cycle(kind: str, bars: DataFrame, p: dict, hard_trend: bool = False, higher: str | None = None, at_middle: bool = False) -> DataFrame:
    """Candidates at crosses of cycle and trigger from the tenth bar on, entered at the close or at_middle of the bar."""
    b = cycle_table(bars, p)
    if higher == "real":
        top = htf.buckets(bars, p["htf_seconds"]).withColumn("m", (F.col("h") + F.col("l")) / 2)
        top = folds.ema(top.withColumn("bar_idx", F.col("bucket")), "c", 10, "e").select("series", "bucket", "m", "e")
        b = htf.last_completed(b, top, p["htf_seconds"], ["m", "e"]).withColumn("htf_step", F.coalesce(F.col("htf_m") - F.col("htf_e"), F.lit(0.0)))
    elif higher:
        b = htf.resample(b, p["htf_seconds"], "itrend").withColumn("htf_step", F.col("c") - F.col("htf"))
    else:
        b = b.withColumn("htf_step", F.lit(0.0))
    b = b.filter((F.col("bar_idx") >= 10) & (F.col("bull_cross") | F.col("bear_cross"))).withColumn("direction", F.when(F.col("bull_cross"), 1).otherwise(-1))
    d = F.col("direction")
    parts = {
        "cross": F.lit(True),
        "trend": d * F.col("slope") > 0 if p["use_trend"] else F.lit(True),
        "htf": d * F.col("htf_step") >= 0,
        "zone": F.when(d == 1, F.col("cycle") < p["oversold"]).otherwise(F.col("cycle") > p["overbought"]),
        "volume": F.col("volume_ratio") >= p["volume_mult"] if p["use_volume"] else F.lit(True),
        "fisher": d * F.col("fisher_step") > 0,
        "momentum": d * F.col("momentum3") > 0,
        "strength": F.col("strong"),
    }
    if hard_trend:
        b = b.filter(parts["trend"])
    if higher and kind == "generic":
        b = b.filter(parts["htf"])
    entry = (F.col("h") + F.col("l")) / 2 if at_middle else F.col("c")
    return b.select("series", "bar_idx", "ts_ms", "direction", confidence(kind, parts).alias("confidence"), entry.alias("entry"), "atr")


#: What the flat scores' strategies have of their own, and the one with the softer gate.
FLAT = {"trigger_ema": 14, "trend_alpha": 0.07, "manual_alpha": 0.35, "min_bars": 24, "leverage": 7.0, "atr_mult": 2.5, "reward": (1.5, 4.0), "trail_pullback_pct": 1.2}


@strategy("cycle", **FLAT)
def _(bars, p):
    return _cycle("v7", bars, p)


@strategy("cycle_v63", **FLAT)
def _(bars, p):
    return _cycle("v63", bars, p, hard_trend=p["use_trend"])


@strategy("cycle_pine", leverage=12.0, reward=(2.0, 3.0, 5.0), portions=(0.4, 0.3, 0.3))
def _(bars, p):
    return _cycle("generic", bars, p, hard_trend=True, higher="held", at_middle=True)


@strategy("cycle_pine_htf", leverage=8.0)
def _(bars, p):
    return _cycle("generic", bars, p, hard_trend=True, higher="real", at_middle=True)


@strategy("cycle_htf", min_bars=16, be_pct=1.0)
def _(bars, p):
    return _cycle("generic", bars, p, hard_trend=True, higher="real")


@strategy("cycle_soft_htf", min_bars=16)
def _(bars, p):
    return _cycle("soft_htf", bars, p, higher="held")


@strategy("cycle_no_htf")
def _(bars, p):
    return _cycle("no_htf", bars, p, hard_trend=True)


@strategy("itrend", trend_alpha=0.07, min_bars=10, confidence_min=55.0, slope_min=0.05, extension_max=2.0, volume_mult=1.2, leverage=10.0, atr_mult=2.0, reward=(2.0, 4.0), be_pct=1.0, trail_activate_pct=1.5, trail_pullback_pct=0.8)
def _(bars, p):
    """Candidates where the trend line begins to rise or to fall over two bars, from the tenth bar on.

    slope_min and extension_max are percentages; 0 lets everything pass.
    """
    w = in_order()
    b = folds.rma(folds.trend_line(bars, "c", p["trend_alpha"]).withColumn("tr", true_range()), "tr", p["atr_period"], "atr")
    b = volume_ratio(b, p["volume_period"]).withColumn("_t2", F.lag("itrend", 2).over(w))
    b = b.withColumn("slope", (F.col("itrend") - F.col("_t2")) / F.abs("_t2") * 100).withColumn("_s", F.signum(F.col("itrend") - F.col("_t2")))
    turn = F.when((F.col("_s") != 0) & (F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(0.0))), F.col("_s").cast("int"))
    b = b.withColumn("direction", turn).filter((F.col("bar_idx") >= 10) & F.col("direction").isNotNull())
    parts = {
        "cross": F.lit(True),
        "trend": F.col("direction") * F.col("slope") >= p["slope_min"] if p["slope_min"] > 0 else F.lit(True),
        "volume": F.col("volume_ratio") >= p["volume_mult"] if p["use_volume"] else F.lit(True),
        "strength": F.abs(F.col("c") - F.col("itrend")) / F.abs("itrend") * 100 <= p["extension_max"] if p["extension_max"] > 0 else F.lit(True),
    }
    return b.select("series", "bar_idx", "ts_ms", "direction", confidence("itrend", parts).alias("confidence"), F.col("c").alias("entry"), "atr")


@strategy("gaussian_bands", min_bars=0, confidence_min=0.0, length=20, sigma=10.0, mode="avg", distance=1.0, range_bars=10, pivot_bars=5, portions=(0.30, 0.25, 0.20, 0.15, 0.10), buffer=0.3, leverage=3.0)
def _(bars, p):
    """Closes that cross the trend line of the Gaussian bundle, scored by it; the stop lies beyond the range before, the
    targets are a ladder that the nearest liquidity may set. The first target breaks even, half the risk trails."""
    from .windows import previous_range

    bundle = multi_trend(bars, period=p["length"], sigma=p["sigma"], distance=p["distance"], mode=p["mode"])
    b = folds.rma(bundle.withColumn("tr", true_range()), "tr", p["atr_period"], "atr").select("*", *previous_range(p["range_bars"]))
    b = crossunder(crossover(b, "c", "line", "up"), "c", "line", "down").filter((F.col("bar_idx") >= 25) & (F.col("up") | F.col("down")))
    b = b.withColumn("direction", F.when(F.col("up"), 1).otherwise(-1))
    stop = F.when(F.col("up"), F.col("range_low") - F.col("atr") * p["buffer"]).otherwise(F.col("range_high") + F.col("atr") * p["buffer"])
    b = b.withColumn("stop", stop).withColumn("stop", F.when(F.col("direction") * (F.col("c") - F.col("stop")) > 0, F.col("stop")).otherwise(F.col("c") - F.col("direction") * F.col("atr") * 1.5))
    b = b.join(structure.liquidity(bars, p["pivot_bars"]), ["series", "bar_idx"], "left").withColumn("near", F.when(F.col("up"), F.col("bsl")).otherwise(F.col("ssl"))).withColumn("entry", F.col("c"))
    risk = F.greatest(F.abs(F.col("entry") - F.col("stop")), F.col("atr") * 0.5)
    return ladder(b).select("series", "bar_idx", "ts_ms", "direction", (F.col("score") * 100).alias("confidence"), "entry", "atr", "stop", "targets", F.col("targets")[0].alias("be_trigger"), (risk * 0.5).alias("trail_distance"))


@strategy("smart_money", mode="L2", level2=60.0, level3=80.0, use_higher=True, higher_bars=50, use_gap=True, min_bars=10, confidence_min=0.0, swing=5, reward=(1.0, 2.0, 3.5), portions=(0.40, 0.35, 0.25), gap_lookback=20, pivot_bars=5, leverage=3.0)
def _(bars, p):
    """Breaks of structure that the oscillator bears out, on the close's side of its moving average.

    mode L1: any break, whatever the oscillator; L2: with the oscillator at level2 or beyond, a continuing break at 0.85 of
    its score; L3: a change of character at level3 in an open gap. A break upward goes before one downward. The nearest
    liquidity sets the last target where it lies beyond the one before. Blocks and gaps count as known at the bar.
    """
    b = folds.ema(folds.rma(bars.withColumn("tr", true_range()), "tr", p["atr_period"], "atr"), "c", p["higher_bars"], "mean")
    b = b.join(structure.oscillator(bars, p["swing"], point_in_time=True), ["series", "bar_idx"])
    b = b.join(structure.breaks(bars, p["swing"]).select("series", "bar_idx", "direction", "kind"), ["series", "bar_idx"]).filter("bar_idx >= 30")
    d, turned = F.col("direction"), F.col("kind") == "CHoCH"
    b = b.withColumn("level", F.when(d == 1, F.col("osc")).otherwise(100 - F.col("osc")))
    if p["use_higher"]:
        b = b.filter(d * (F.col("c") - F.col("mean")) > 0)
    if p["mode"] == "L1":
        b = b.withColumn("confidence", F.col("level"))
    elif p["mode"] == "L2":
        b = b.filter(F.col("level") >= p["level2"]).withColumn("confidence", F.when(turned, F.col("level")).otherwise(F.col("level") * 0.85))
    else:
        b = b.filter(turned & (F.col("level") >= p["level3"])).withColumn("confidence", F.col("level"))
        if p["use_gap"]:
            zones = structure.gap_zones(bars, p["gap_lookback"], point_in_time=True)
            b = b.join(zones, ["series", "bar_idx"]).filter(F.when(d == 1, F.col("in_bull")).otherwise(F.col("in_bear")))
    b = b.groupBy("series", "bar_idx").agg(F.max_by(F.struct(*b.columns), "direction").alias("x")).select("x.*")
    b = b.join(structure.liquidity(bars, p["pivot_bars"]), ["series", "bar_idx"], "left").withColumn("entry", F.col("c"))
    risk = F.col("atr") * p["atr_mult"]
    second, near = F.col("entry") + d * risk * p["reward"][1], F.when(d == 1, F.col("bsl")).otherwise(F.col("ssl"))
    last = F.when(d * (near - second) > 0, near).otherwise(F.col("entry") + d * risk * p["reward"][2])
    first = F.col("entry") + d * risk * p["reward"][0]
    return b.select("series", "bar_idx", "ts_ms", "direction", "confidence", "entry", "atr", F.array(first, second, last).alias("targets"), first.alias("be_trigger"), (risk * 0.5).alias("trail_distance"))


def vote(signals: DataFrame, least: float = 0.5) -> DataFrame:
    """Members' signals (series, bar_idx, member, weight, direction, confidence) as one: the side of the larger sum of
    weight and confidence, if it has at least `least` of both sides' sum. Ties give none."""
    s = signals.groupBy("series", "bar_idx").agg(
        F.sum(F.when(F.col("direction") == 1, F.col("weight") * F.col("confidence")).otherwise(0.0)).alias("long"),
        F.sum(F.when(F.col("direction") == -1, F.col("weight") * F.col("confidence")).otherwise(0.0)).alias("short"),
        F.count("*").alias("members"),
        F.sort_array(F.collect_set(F.when(F.col("direction") == 1, F.col("member")))).alias("for_long"),  # members are few
        F.sort_array(F.collect_set(F.when(F.col("direction") == -1, F.col("member")))).alias("for_short"),
    )
    best = F.greatest("long", "short")
    s = s.filter((F.col("long") != F.col("short")) & (best >= least * (F.col("long") + F.col("short"))))
    return s.select("series", "bar_idx", F.when(F.col("long") > F.col("short"), 1).otherwise(-1).alias("direction"), (best / (F.col("long") + F.col("short")) * 100).alias("confidence"), "members", F.when(F.col("long") > F.col("short"), F.col("for_long")).otherwise(F.col("for_short")).alias("contributors"))


def contributions(signals: DataFrame) -> DataFrame:
    """How often each member stands behind an ensemble's signals (contributors: array)."""
    return signals.select("series", F.explode("contributors").alias("member")).groupBy("series", "member").agg(F.count("*").alias("n"))


def by_regime(signals: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """The vote with each member's weight in the regime of the bar; weights: regime, member, weight."""
    s = signals.drop("weight").join(labels.select("series", "bar_idx", "regime"), ["series", "bar_idx"]).join(weights, ["regime", "member"])
    return vote(s)
