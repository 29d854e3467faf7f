"""Signals bar by bar: one state a series, for streams of bars and for bars that are still open.

Fed with whole bars it gives what the column form of the strategy gives. An open bar is judged on a copy of the state of the
bars before it, so only a bar's last, whole form moves the state; a bar gives one signal at most.

Streams keep the state as named numbers (`kernels.numbers`), not as objects: a version that adds a reading goes on from an
older one's checkpoint, and the new reading starts there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidelane.functions import kernels

from . import htf
from .signals import REGISTRY, WEIGHTS, with_exits

#: Strategies that can go bar by bar: kind of score, and the parts that must hold. Those with a part `htf` hold the trend
#: line of the last bar before the current bar of the higher time frame and enter at the middle of the bar where MIDDLE says.
KINDS = {"cycle": ("v7", ()), "cycle_v63": ("v63", ("trend",)), "cycle_pine": ("generic", ("trend", "htf")), "cycle_soft_htf": ("soft_htf", ()), "cycle_no_htf": ("no_htf", ("trend",))}
MIDDLE = {"cycle_pine"}
FOUND = "bar_idx long, ts_ms long, direction int, confidence double, entry double, atr double"


class Readings:
    """What the score of a series reads, after each bar."""

    def __init__(self, p: dict):
        self.oscillator = kernels.Oscillator(p["alpha_method"], trigger_ema=p["trigger_ema"], manual_alpha=p["manual_alpha"])
        self.trend, self.atr = kernels.Trend(p["trend_alpha"]), kernels.Smooth(1 / p["atr_period"])
        self.lines, self.cycles, self.volumes = kernels.Ring(3), kernels.Ring(p["strength_lookback"] + 1), kernels.Ring(p["volume_period"])
        self.n, self.close, self.trigger, self.fisher = 0, None, 0.0, 0.0
        self.bucket, self.held = None, None  # bar of the higher time frame, and the line before it

    def step(self, p: dict, ts_ms: int, high: float, low: float, close: float, volume: float) -> tuple[int, dict, float]:
        """The side of a cross (0: none), the parts of its score, and the mean true range."""
        before, trigger, fisher = self.cycles.ago(0), self.trigger, self.fisher
        _, cycle, self.trigger, self.fisher = self.oscillator.step((high + low) / 2)
        line = self.trend.step(close)
        bucket = ts_ms // (p["htf_seconds"] * 1000)
        if bucket != self.bucket:
            self.held = self.lines.ago(0) if self.n else line
        self.bucket = bucket
        tr = high - low if self.close is None else max(high - low, abs(high - self.close), abs(low - self.close))
        atr, self.close = self.atr.step(tr), close
        self.lines.push(line)
        self.cycles.push(cycle)
        self.volumes.push(volume)
        n, self.n = self.n, self.n + 1
        if n < 10:
            return 0, {}, atr
        side = (cycle > self.trigger and before <= trigger) - (cycle < self.trigger and before >= trigger)
        if not side:
            return 0, {}, atr
        mean = sum(self.volumes.items) / len(self.volumes.items)
        parts = {
            "cross": True,
            "trend": side * (line - self.lines.ago(2)) > 0 or not p["use_trend"],
            "htf": side * (close - self.held) >= 0,
            "zone": cycle < p["oversold"] if side == 1 else cycle > p["overbought"],
            "volume": mean > 0 and volume / mean >= p["volume_mult"] or not p["use_volume"],
            "fisher": side * (self.fisher - fisher) > 0,
            "momentum": side * (cycle - self.cycles.ago(3)) > 0,
            "strength": n < p["strength_lookback"] or abs(cycle) >= self.edge(p["strength_percent"] / 100),
        }
        return side, parts, atr

    def edge(self, share: float) -> float:
        """The quantile of the last cycles' sizes, between neighbours."""
        sizes = sorted(map(abs, self.cycles.items))
        at = share * (len(sizes) - 1)
        k = min(int(at), len(sizes) - 2) if len(sizes) > 1 else 0
        return sizes[k] + (at - k) * (sizes[min(k + 1, len(sizes) - 1)] - sizes[k])


class Live:
    """Readings and throttle of one series."""

    def __init__(self, strategy: str, p: dict):
        (self.kind, self.needs), self.p = KINDS[strategy], p
        self.at_middle = strategy in MIDDLE
        self.readings, self.last, self.day, self.n = Readings(p), -(10**9), None, 0
        self.kept: bytes | None = None  # the readings before an open bar

    def step(self, ts_ms: int, high: float, low: float, close: float, volume: float, whole: bool = True) -> tuple | None:
        """Takes a bar as it stands; its signal as a row of FOUND, if there is one."""
        if whole:
            self.kept, at = None, self.readings
        else:
            self.kept = self.kept or pickle.dumps(self.readings)
            at = pickle.loads(self.kept)
        bar = at.n
        side, parts, atr = at.step(self.p, ts_ms, high, low, close, volume)
        score = min(100.0, float(sum(w for name, w in WEIGHTS[self.kind].items() if parts.get(name))))
        if not side or score < self.p["confidence_min"] or not all(parts[name] for name in self.needs) or bar - self.last < self.p["min_bars"] or bar == self.last:
            return None
        most, day = self.p.get("max_signals_per_day"), ts_ms // 86_400_000
        if day != self.day:
            self.day, self.n = day, 0
        if most and self.n >= most:
            return None
        self.last, self.n = bar, self.n + 1
        return bar, ts_ms, side, score, (high + low) / 2 if self.at_middle else close, atr


def _parameters(strategy: str, params: dict) -> dict:
    return REGISTRY[strategy].defaults | params


def incremental(bars: DataFrame, strategy: str = "cycle", **params) -> DataFrame:
    """Signals of a table of bars (series, ts_ms, h, l, c, v; whole: false for forms of a bar that is still open).

    One ordered pass over partitions sorted by series and time; a task holds one series' state, never its rows. bar_idx is
    the number of whole bars before. Signals have the exits' columns.
    """
    p = _parameters(strategy, params)
    source = bars if "whole" in bars.columns else bars.withColumn("whole", F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = live = None
        for x in batches:
            out = []
            for series, *bar in x.itertuples(index=False, name=None):
                if series != key:
                    key, live = series, Live(strategy, p)
                if found := live.step(*bar):
                    out.append((series, *found))
            yield pd.DataFrame(out, columns=["series", *(f.split()[0] for f in FOUND.split(", "))])

    rows = source.select("series", "ts_ms", "h", "l", "c", "v", "whole").repartition("series").sortWithinPartitions("series", "ts_ms", "whole")
    return with_exits(rows.mapInPandas(run, f"series string, {FOUND}"), p)


def open_bars(bars: DataFrame, detail: DataFrame, seconds: int) -> DataFrame:
    """The forms each main bar goes through, one a detail bar, for `incremental`: the last one is whole.

    A main bar without detail bars comes whole as it is.
    """
    from pyspark.sql import Window

    forms = htf.partial_bars(htf.detail_index(bars, detail, seconds))
    later = F.lead("ts_ms").over(Window.partitionBy("series", "bar_idx").orderBy("ts_ms"))
    forms = forms.select("series", "ts_ms", "bar_idx", F.col("ph").alias("h"), F.col("pl").alias("l"), F.col("pc").alias("c"), F.col("pv").alias("v"), later.isNull().alias("whole"))
    bare = bars.join(forms.select("series", "bar_idx").distinct(), ["series", "bar_idx"], "left_anti")
    return forms.unionByName(bare.select("series", "ts_ms", "bar_idx", "h", "l", "c", "v", F.lit(True).alias("whole")))


class _Kept(StatefulProcessor):
    """Live signals of a series between triggers: counters as a value, single readings and rings as maps by name.

    Readings of an open bar are not kept: the next form of the bar starts from the whole bars before, which are.
    """

    def __init__(self, strategy: str, p: dict):
        self.strategy, self.p = strategy, p

    def init(self, handle) -> None:
        self.counters = handle.getValueState("counters", "last long, day long, n long")
        self.single = handle.getMapState("single", "name string", "value double")
        self.rings = handle.getMapState("rings", "name string", "items array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live = Live(self.strategy, self.p)
        if self.counters.exists():
            live.last, live.day, live.n = self.counters.get()
            kept = {name: value for (name,), (value,) in self.single.iterator()}
            kernels.restore(live.readings, kept | {name: list(items) for (name,), (items,) in self.rings.iterator()})
        x = pd.concat(list(rows)).sort_values(["ts_ms", "whole"])
        found = [live.step(*bar) for bar in x[["ts_ms", "h", "l", "c", "v", "whole"]].itertuples(index=False, name=None)]
        self.counters.update((live.last, live.day, live.n))
        for name, value in kernels.numbers(live.readings):
            if isinstance(value, list):
                self.rings.updateValue((name,), (value,))
            else:
                self.single.updateValue((name,), (None if value is None else float(value),))
        yield pd.DataFrame([(key[0], *f) for f in found if f], columns=["series", *(f.split()[0] for f in FOUND.split(", "))])

    def close(self) -> None:
        pass


def stream(bars: DataFrame, strategy: str = "cycle", **params) -> DataFrame:
    """`incremental` over a stream of bars, whose state is kept between triggers.

    Bars of a series must come in order across triggers; inside one they are sorted, so a trigger's size bounds memory.
    Typed states need the session's spark.sql.streaming.stateStore.providerClass to be RocksDBStateStoreProvider.
    """
    p = _parameters(strategy, params)
    source = bars if "whole" in bars.columns else bars.withColumn("whole", F.lit(True))
    source = source.select("series", "ts_ms", "h", "l", "c", "v", "whole")
    got = source.groupBy("series").transformWithStateInPandas(_Kept(strategy, p), f"series string, {FOUND}", "Append", "None")
    return with_exits(got, p)
