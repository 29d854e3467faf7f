"""Parameter search: a round of trials is one Spark job over bars of all trials; only scores come back to the driver."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.operators import metrics, signals, simulation
from tidelane.operators.tables import held
from tidelane.operators.validation import in_windows


@dataclass(frozen=True)
class Param:
    """A dimension: float, int, bool or categorical; needs: another parameter's value without which it is inactive."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 1.0
    step: float = 0.0
    options: tuple = ()
    needs: tuple[str, object] | None = None

    def values(self) -> list:
        if self.kind == "bool":
            return [False, True]
        if self.kind == "categorical":
            return list(self.options)
        n = round((self.high - self.low) / self.step)
        xs = [self.low + k * self.step for k in range(n + 1)]
        return [int(round(x)) for x in xs] if self.kind == "int" else xs

    def draw(self, rng: random.Random):
        if self.kind in ("bool", "categorical"):
            return rng.choice(self.values())
        return self.fit(rng.uniform(self.low, self.high))

    def fit(self, x: float):
        """x in range and on the step."""
        x = min(self.high, max(self.low, x))
        if self.step:
            x = self.low + round((x - self.low) / self.step) * self.step
        return int(round(x)) if self.kind == "int" else min(self.high, x)


def active(params: list[Param], trial: dict) -> dict:
    """The trial without what its other values make inactive: trials that differ in nothing else are the same."""
    return {p.name: trial[p.name] for p in params if p.name in trial and (p.needs is None or trial.get(p.needs[0]) == p.needs[1])}


def grid(spark: SparkSession, params: list[Param]) -> DataFrame:
    """All combinations, a column for each parameter; sizes multiply, so the arrays are exploded by the executors."""
    df = spark.range(1).select()
    for p in params:
        df = df.withColumn(p.name, F.explode(F.array(*(F.lit(v) for v in p.values()))))
    return df


def effective_trials(params: list[Param]) -> int:
    """Number of grid points that differ in active values."""
    heads = [p for p in params if p.needs is None]
    switches = {p.needs[0] for p in params if p.needs}
    total = math.prod(len(p.values()) for p in heads if p.name not in switches)
    for s in switches:
        head = next(p for p in heads if p.name == s)
        total *= sum(math.prod(len(p.values()) for p in params if p.needs == (s, v)) for v in head.values())
    return total


def scores(bars: DataFrame, strategy: str, trials: list[dict], objective: str = "sharpe", min_trades: int = 10, bar_seconds: int = 3600, settings: simulation.Settings | None = None, window: str | None = None) -> DataFrame:
    """A row a trial (its place in the list), and a window if bars have one: score, the mean of the series' objective, -999
    with few trades over all series.

    All trials' signals are one table keyed by trial, so simulation and metrics are one job. Bars of several windows start
    from position 0 in each.
    """
    if window:
        bars = bars.withColumn("series", F.concat_ws("/", "series", window))
    found = signals.REGISTRY[strategy].of_trials(bars, trials)
    every = bars.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(trials) - 1))))
    keys = ("series", "trial")
    tagged = simulation.simulate(every, found, settings, keys)
    run = F.concat_ws("/", *keys)
    e = metrics.equity_summary(simulation.equity(tagged, keys).withColumn("run", run), (settings or simulation.Settings()).initial, bar_seconds)
    t = metrics.trade_summary(simulation.trades(tagged, keys).withColumn("run", run))
    part = lambda k: F.element_at(F.split("run", "/"), k).cast("long")
    r = e.join(t, "run", "left").withColumns({"trial": part(-1)} | ({window: part(-2)} if window else {})).fillna(0)
    value = metrics.composite(r) if objective == "composite" else F.col({"sharpe": "sharpe", "return": "total_return", "calmar": "calmar"}[objective])
    r = r.groupBy("trial", *([window] if window else [])).agg(F.avg(value).alias("score"), F.sum("n_trades").alias("n_trades"))
    return r.withColumn("score", F.when(F.col("n_trades") >= min_trades, F.col("score")).otherwise(metrics.REJECTED))


def evaluate(bars: DataFrame, strategy: str, trials: list[dict], **how) -> list[float]:
    """`scores` of trials as a list, each over all series together."""
    score = {x["trial"]: x["score"] for x in scores(bars, strategy, trials, **how).collect()}  # a row a trial
    return [score.get(k, metrics.REJECTED) for k in range(len(trials))]


Ask = Callable[[list[dict]], list[float]]


def _known(score: Ask, params: list[Param], seen: dict) -> Ask:
    """score for trials whose active values are new; others come from `seen`."""

    def ask(trials: list[dict]) -> list[float]:
        keys = [tuple(sorted(active(params, t).items())) for t in trials]
        new = {k: t for k, t in zip(keys, trials) if k not in seen}
        seen.update(zip(new, score(list(new.values())) if new else []))
        return [seen[k] for k in keys]

    return ask


def tpe(score: Ask, params: list[Param], n_trials: int = 60, batch: int = 8, start: int = 20, seed: int = 42, share: float = 0.25) -> list[tuple[float, dict]]:
    """Tree-structured Parzen estimator: after random trials each batch takes the candidates whose density among the best
    share of trials is largest against the density among the rest, new ones if any was drawn. Best first."""
    rng, done, seen = random.Random(seed), [], {}
    ask = _known(score, params, seen)

    def density(p: Param, x, among: list) -> float:
        if not among:
            return 1.0
        if p.kind in ("bool", "categorical"):
            return (1 + sum(v == x for v in among)) / (len(p.values()) + len(among))
        width = max((p.high - p.low) / max(4.0, len(among) ** 0.5 * 2), 1e-9)
        return (1 + sum(math.exp(-0.5 * ((x - v) / width) ** 2) for v in among)) / (1 + len(among))

    while len(done) < n_trials:
        n = min(batch, n_trials - len(done))
        if len(done) < start:
            trials = [{p.name: p.draw(rng) for p in params} for _ in range(n)]
        else:
            order = sorted(done, key=lambda d: -d[0])
            cut = max(3, round(share * len(order)))
            good, rest = [t for _, t in order[:cut]], [t for _, t in order[cut:]]

            def near(p: Param):
                v = rng.choice(good)[p.name]
                return v if p.kind in ("bool", "categorical") and rng.random() < 0.8 else p.draw(rng) if p.kind in ("bool", "categorical") else p.fit(rng.gauss(v, (p.high - p.low) / 6))

            drawn = [{p.name: near(p) for p in params} for _ in range(24 * n)]
            worth = lambda t: sum(math.log(density(p, t[p.name], [g[p.name] for g in good]) / density(p, t[p.name], [r[p.name] for r in rest])) for p in params)
            new = {k: t for t in drawn if (k := tuple(sorted(active(params, t).items()))) not in seen}
            trials = sorted(new.values() or drawn, key=worth, reverse=True)[:n]
        done += list(zip(ask(trials), trials))
    return sorted(done, key=lambda d: -d[0])


def genetic(score: Ask, params: list[Param], population: int = 20, generations: int = 15, seed: int = 42, elite: int = 2, patience: int = 8, blend: float = 0.3) -> list[tuple[float, dict]]:
    """Tournaments of three, blended crossover, Gaussian mutation that narrows, elitism; stops without progress. Best first."""
    rng = random.Random(seed)
    ask = _known(score, params, {})
    now = [{p.name: p.draw(rng) for p in params} for _ in range(population)]
    best, since, every = -math.inf, 0, []
    for g in range(generations):
        ranked = sorted(zip(ask(now), now), key=lambda d: -d[0])
        every += ranked
        best, since = (ranked[0][0], 0) if ranked[0][0] > best else (best, since + 1)
        if since >= patience:
            break
        pick = lambda: max(rng.sample(ranked, min(3, len(ranked))), key=lambda d: d[0])[1]  # noqa: E731, B023
        now = [t for _, t in ranked[:elite]]
        while len(now) < population:
            a, b, child = pick(), pick(), {}
            for p in params:
                if p.kind in ("bool", "categorical"):
                    child[p.name] = p.draw(rng) if rng.random() < 0.1 else rng.choice((a, b))[p.name]
                    continue
                lo, hi = sorted((a[p.name], b[p.name]))
                x = rng.uniform(lo - blend * (hi - lo), hi + blend * (hi - lo))
                if rng.random() < 0.2:
                    x += rng.gauss(0, (p.high - p.low) * 0.2 * (1 - g / generations))
                child[p.name] = p.fit(x)
            now.append(child)
    unique = {tuple(sorted(t.items())): (s, t) for s, t in every}
    return sorted(unique.values(), key=lambda d: -d[0])


def walk_forward(bars: DataFrame, strategy: str, trials: list[dict], windows: DataFrame, **how) -> DataFrame:
    """For each window the trial (its place in the list; ties: the first) with the best in-sample score over all series, that
    score, and the trial's score afterwards: window_id, trial, is_score, oos_score.

    windows: series, window_id, is_start, is_end, oos_start, oos_end. All windows are one job a span; only the trials that
    are some window's best run on the later spans.
    """
    w = Window.partitionBy("window_id").orderBy(F.desc("score"), "trial")
    first = scores(in_windows(bars, windows, "is_start", "is_end"), strategy, trials, window="window_id", **how)
    best = held(first.withColumn("_place", F.row_number().over(w)).filter("_place = 1").select("window_id", "trial", F.col("score").alias("is_score")))
    chosen = sorted(r["trial"] for r in best.select("trial").distinct().collect())  # some of the caller's trials
    if not chosen:
        return best.withColumn("oos_score", F.lit(None).cast("double"))
    later = scores(in_windows(bars, windows, "oos_start", "oos_end"), strategy, [trials[k] for k in chosen], window="window_id", **how)
    later = later.select("window_id", F.element_at(F.array(*map(F.lit, chosen)), F.col("trial").cast("int") + 1).cast("long").alias("trial"), F.col("score").alias("oos_score"))
    return best.join(later, ["window_id", "trial"], "left").fillna(metrics.REJECTED, ["oos_score"])
