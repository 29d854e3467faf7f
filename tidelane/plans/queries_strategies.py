"""The strategies' signals, each against SQL that is put together from the indicators' recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.operators import live, signals, simulation

from .queries_indicators import FILLED, FISHER, FVG, LIQUIDITY, OPEN_THEN, P, SWING, TR, TREND, cycle_cte, gauss_cte, oscillator_sql, recursion, trend_cte, zone_sql
from .queries_bars import fine
from .registry import HOUR, hourly, query, rounded

#: tr with tm, and its running mean ra.
ATR = f"{TR}, tm AS MATERIALIZED (SELECT * FROM tr), {recursion('ra', 'tr', 1 / 14, 'tm')}"
RATIO = f"v / avg(v) OVER ({P} ROWS 19 PRECEDING)"


def crosses(alpha: float, trigger: int, trend: float) -> str:
    """Everything a cycle strategy reads, at crosses only, as cx: the cycle of the middle of each bar, its moving average of
    `trigger` bars, the trend line of the close."""
    return f"""{ATR}, {trend_cte(trend)}, {cycle_cte("((h + l) / 2)", alpha)}, {FISHER}, rm AS MATERIALIZED (SELECT * FROM r), {recursion("rg", "c1", 2 / (trigger + 1), "rm")},
 al AS MATERIALIZED (SELECT b.*, ra.e AS atr, rt.t1 AS line, r.c1 AS cy, fi.fisher AS fi, rg.e AS tg FROM bars b JOIN ra USING (series, bar_idx) JOIN rt USING (series, bar_idx) JOIN r USING (series, bar_idx) JOIN fi USING (series, bar_idx) JOIN rg USING (series, bar_idx)),
 hs AS (SELECT *, CASE WHEN bar_idx = 0 THEN line WHEN ts_ms // 14400000 <> lag(ts_ms // 14400000) OVER ({P}) THEN lag(line) OVER ({P}) END AS he FROM al),
 ky AS (SELECT *, line - lag(line, 2) OVER ({P}) AS slope, fi - lag(fi) OVER ({P}) AS fstep, cy - lag(cy, 3) OVER ({P}) AS mom, {RATIO} AS vr, bar_idx < 50 OR abs(cy) >= quantile_cont(abs(cy), 0.5) OVER ({P} ROWS 50 PRECEDING) AS strong,
 sign(cy - tg) AS side, cy > tg AND lag(cy) OVER ({P}) <= lag(tg) OVER ({P}) AS up, cy < tg AND lag(cy) OVER ({P}) >= lag(tg) OVER ({P}) AS dn, c - last_value(he IGNORE NULLS) OVER ({P}) AS held FROM hs),
 cx AS MATERIALIZED (SELECT * FROM ky WHERE bar_idx >= 10 AND (up OR dn))"""


#: The step of the last whole higher bar over its mean, as hx.
HIGHER = f"""hb AS MATERIALIZED (SELECT series, ts_ms // 14400000 AS bucket, row_number() OVER (PARTITION BY series ORDER BY ts_ms // 14400000) - 1 AS bar_idx, (max(h) + min(l)) / 2 AS m, arg_max(c, ts_ms) AS c FROM bars GROUP BY series, ts_ms // 14400000),
 {recursion("rh", "c", 2 / 11, "hb")}, hx AS (SELECT series, bucket, lag(m - e) OVER (PARTITION BY series ORDER BY bucket) AS s FROM hb JOIN rh USING (series, bar_idx))"""


#: Columns of a strategy's query beside the bar and the side.
LEVELS = 5


def accepted(candidates: str, atr: float = 1.5, reward: tuple = (2.0, 3.0), portions: tuple = (0.6, 0.4), be: float = 1.5, pullback: float = 1.0, stop: str | None = None, targets: list[str] | None = None, be_trigger: str | None = None, trail: str | None = None) -> str:
    """Signals of candidates cd with 40 points at least, five bars apart, with all their targets and portions."""
    stop = stop or f"entry - direction * {atr} * atr"
    targets = targets or [f"entry + direction * abs(entry - st) * {r}" for r in reward]
    levels = ", ".join(f"{f'round({targets[k]}, 6)' if k < len(targets) else 'NULL::DOUBLE'} AS target{k + 1}" for k in range(LEVELS))
    shares = ", ".join(f"{portions[k] if k < len(portions) else 'NULL'}::DOUBLE AS portion{k + 1}" for k in range(LEVELS))
    return f"""{candidates}, sg AS MATERIALIZED (SELECT *, {stop} AS st FROM cd WHERE confidence >= 40), RECURSIVE rs AS (SELECT series, min(bar_idx) AS bar_idx FROM sg GROUP BY series
    UNION ALL SELECT rs.series, min(sg.bar_idx) FROM rs JOIN sg ON sg.series = rs.series AND sg.bar_idx >= rs.bar_idx + 5 GROUP BY rs.series)
    SELECT series, bar_idx, direction, round(confidence::DOUBLE, 6) AS confidence, round(entry, 6) AS entry, round(st, 6) AS stop, {levels}, {shares},
    round({be_trigger or f"entry * (1 + {be / 100!r} * direction)"}, 6) AS be_trigger, round({trail or f"entry * {pullback / 100!r}"}, 6) AS trail_distance FROM rs JOIN sg USING (series, bar_idx)"""


def cycle_sql(trend: int, higher: int, zone: int, volume: int, fisher: int, mom: int, strong: int, cross: int = 20, step: str | None = None, gate: str = "true", entry: str = "c", alpha: float = 0.42, trigger: int = 9, line: float = 0.09, **exits) -> str:
    """Points of the parts, which higher time frame step there is, and what must hold."""
    real = f", {HIGHER}" if step == "real" else ""
    value = {"real": "coalesce(hx.s, 0)", "held": "held", None: "0"}[step]
    join = "LEFT JOIN hx ON hx.series = cx.series AND hx.bucket = cx.ts_ms // 14400000" if real else ""
    return accepted(
        f"""WITH bars, {crosses(alpha, trigger, line)}{real}, sd AS (SELECT cx.*, side::INT AS direction, side * {value} AS hstep FROM cx {join}),
    cd AS (SELECT series, bar_idx, direction, {entry} AS entry, atr, least(100, {cross} + CASE WHEN direction * slope > 0 THEN {trend} ELSE 0 END + CASE WHEN hstep >= 0 THEN {higher} ELSE 0 END
    + CASE WHEN direction * cy < -1.5 THEN {zone} ELSE 0 END + CASE WHEN vr >= 1.5 THEN {volume} ELSE 0 END + CASE WHEN direction * fstep > 0 THEN {fisher} ELSE 0 END + CASE WHEN direction * mom > 0 THEN {mom} ELSE 0 END
    + CASE WHEN strong THEN {strong} ELSE 0 END) AS confidence FROM sd WHERE {gate})""",
        **exits,
    )


WITH_TREND, WITH_BOTH = "direction * slope > 0", "direction * slope > 0 AND hstep >= 0"
MIDDLE = "(h + l) / 2"
V7 = {"alpha": 0.35, "trigger": 14, "line": 0.07, "atr": 2.5, "reward": (1.5, 4.0), "pullback": 1.2}
#: Points in the order trend, higher time frame, zone, volume, fisher, momentum, strength.
SQL = {
    "cycle": cycle_sql(20, 0, 15, 15, 10, 10, 10, **V7),
    "cycle_v63": cycle_sql(25, 0, 20, 20, 10, 5, 0, gate=WITH_TREND, **V7),
    "cycle_pine": cycle_sql(15, 15, 15, 15, 10, 10, 0, step="held", gate=WITH_BOTH, entry=MIDDLE, reward=(2.0, 3.0, 5.0), portions=(0.4, 0.3, 0.3)),
    "cycle_pine_htf": cycle_sql(15, 15, 15, 15, 10, 10, 0, step="real", gate=WITH_BOTH, entry=MIDDLE),
    "cycle_htf": cycle_sql(15, 15, 15, 15, 10, 10, 0, step="real", gate=WITH_BOTH, be=1.0),
    "cycle_soft_htf": cycle_sql(25, 15, 15, 10, 15, 10, 0, step="held"),
    "cycle_no_htf": cycle_sql(20, 0, 20, 15, 10, 10, 0, cross=25, gate=WITH_TREND),
    "itrend": accepted(
        f"""WITH bars, {ATR}, {TREND}, al AS (SELECT b.*, ra.e AS atr, t1 AS line FROM bars b JOIN ra USING (series, bar_idx) JOIN rt USING (series, bar_idx)),
        ky AS (SELECT *, (line - lag(line, 2) OVER ({P})) / abs(lag(line, 2) OVER ({P})) * 100 AS slope, {RATIO} AS vr, coalesce(line > lag(line, 2) OVER ({P}), false) AS bull, coalesce(line < lag(line, 2) OVER ({P}), false) AS bear FROM al),
        kz AS (SELECT *, bull AND NOT lag(bull) OVER ({P}) AS up, bear AND NOT lag(bear) OVER ({P}) AS dn FROM ky),
        cd AS (SELECT series, bar_idx, CASE WHEN up THEN 1 ELSE -1 END AS direction, c AS entry, atr, 30 + CASE WHEN CASE WHEN up THEN slope ELSE -slope END >= 0.05 THEN 25 ELSE 0 END + CASE WHEN vr >= 1.2 THEN 25 ELSE 0 END + CASE WHEN abs(c - line) / abs(line) * 100 <= 2 THEN 20 ELSE 0 END AS confidence
        FROM kz WHERE bar_idx >= 10 AND (up OR dn))""",
        atr=2.0, reward=(2.0, 4.0), be=1.0, pullback=0.8,
    ),
    "gaussian_bands": accepted(
        f"""WITH bars, {ATR}, {gauss_cte(20, 10.0, "list_avg(g)")}, {LIQUIDITY}, al AS (SELECT k.series, k.bar_idx, k.c, k.score, ra.e AS atr, bsl, ssl, max(h) OVER p AS top, min(l) OVER p AS low, lag(k.c) OVER n AS c1, k.line, lag(k.line) OVER n AS line1
        FROM k JOIN ra USING (series, bar_idx) JOIN lq USING (series, bar_idx) WINDOW n AS (PARTITION BY k.series ORDER BY k.bar_idx), p AS (PARTITION BY k.series ORDER BY k.bar_idx ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)),
        cc AS (SELECT series, bar_idx, c AS entry, atr, score * 100 AS confidence, 1 AS direction, low - atr * 0.3 AS beyond, bsl AS near FROM al WHERE bar_idx >= 25 AND c > line AND c1 <= line1
        UNION ALL SELECT series, bar_idx, c, atr, score * 100, -1, top + atr * 0.3, ssl FROM al WHERE bar_idx >= 25 AND c < line AND c1 >= line1),
        cs AS (SELECT *, CASE WHEN direction * (entry - beyond) > 0 THEN beyond ELSE entry - direction * 1.5 * atr END AS st0 FROM cc), cr AS (SELECT *, greatest(abs(entry - st0), atr / 2) AS risk FROM cs),
        c1 AS (SELECT *, CASE WHEN direction * (near - entry) > 0.3 * risk THEN near ELSE entry + 0.8 * direction * risk END AS t1 FROM cr),
        cd AS (SELECT *, CASE WHEN direction * (near - t1) > 0.3 * risk THEN near ELSE t1 + 1.5 * direction * risk END AS t2 FROM c1)""",
        portions=(0.30, 0.25, 0.20, 0.15, 0.10), stop="st0", targets=["t1", "t2", "t2 + 2 * direction * risk", "t2 + 4.5 * direction * risk", "t2 + 8.5 * direction * risk"], be_trigger="t1", trail="risk / 2",
    ),
}


def smart_sql(confidence: str, where: str) -> str:
    """Breaks of structure with the oscillator's level on their side."""
    return accepted(
        f"""WITH bars, {ATR}, {recursion("rq", "c", 2 / 51, "bars")}, {oscillator_sql("o.made_idx <= b.bar_idx AND (o.crossed_idx IS NULL OR o.crossed_idx > b.bar_idx)")}, {FVG}, {FILLED}, {zone_sql(20, OPEN_THEN)}, {LIQUIDITY.removeprefix(SWING + ", ")},
        jn AS (SELECT series, bar_idx, br.direction, kind, b.c AS entry, ra.e AS atr, CASE WHEN br.direction = 1 THEN osc ELSE 100 - osc END AS level, CASE WHEN br.direction = 1 THEN in_bull ELSE in_bear END AS in_gap, rq.e AS mean, CASE WHEN br.direction = 1 THEN bsl ELSE ssl END AS near
        FROM br JOIN bars b USING (series, bar_idx) JOIN gz USING (series, bar_idx) JOIN ra USING (series, bar_idx) JOIN rq USING (series, bar_idx) JOIN os USING (series, bar_idx) JOIN lq USING (series, bar_idx) WHERE bar_idx >= 30),
        cd AS (SELECT *, {confidence} AS confidence FROM jn WHERE direction * (entry - mean) > 0 AND {where} QUALIFY row_number() OVER (PARTITION BY series, bar_idx ORDER BY direction DESC) = 1)""",
        portions=(0.40, 0.35, 0.25), targets=["entry + direction * 1.5 * atr", "entry + direction * 3 * atr", "CASE WHEN direction * (near - entry - direction * 3 * atr) > 0 THEN near ELSE entry + direction * 5.25 * atr END"],
        be_trigger="entry + direction * 1.5 * atr", trail="atr * 0.75",
    )


SQL["smart_money"] = smart_sql("CASE kind WHEN 'BOS' THEN level * 0.85 ELSE level END", "level >= 60")
#: The strategy's other modes; the third with a lower level, which these bars reach.
MODES = {"smart_money_any": ({"mode": "L1"}, smart_sql("level", "true")), "smart_money_turns": ({"mode": "L3", "level3": 50.0}, smart_sql("level", "kind = 'CHoCH' AND level >= 50 AND in_gap"))}


def shown(s):
    each = [F.get(x, F.lit(k)).alias(f"{name}{k + 1}") for name, x in (("target", "targets"), ("portion", "portions")) for k in range(LEVELS)]
    return rounded(s.select("series", "bar_idx", "direction", "confidence", "entry", "stop", *each, "be_trigger", "trail_distance"))


for _name in signals.REGISTRY:

    @query(f"strategy_{_name}", SQL.get(_name))
    def _(spark, d, name=_name):
        return shown(signals.REGISTRY[name].signals(hourly(spark, d), confidence_min=40.0, min_bars=5))


for _name, (_params, _sql) in MODES.items():

    @query(f"strategy_{_name}", _sql)
    def _(spark, d, params=_params):
        return shown(signals.REGISTRY["smart_money"].signals(hourly(spark, d), confidence_min=40.0, min_bars=5, **params))


for _name in live.KINDS:

    @query(f"incremental_{_name}", SQL[_name])
    def _(spark, d, name=_name):
        """The strategy bar by bar, which must give what its columns give."""
        return shown(live.incremental(hourly(spark, d), name, confidence_min=40.0, min_bars=5))


def intrabar(spark, d):
    """Signals of hourly bars as they form from bars of five minutes."""
    b = hourly(spark, d)
    return live.incremental(live.open_bars(b, fine(spark, d), HOUR), "cycle", confidence_min=40.0, min_bars=5)


@query("intrabar_signals")
def _(spark, d):
    return shown(intrabar(spark, d))


@query("simulate_partial_bars")
def _(spark, d):
    """Positions opened at the five-minute close that first gives the hour's signal, and checked on each later one."""
    from tidelane.operators import bars as B

    f = B.indexed(fine(spark, d))
    s = intrabar(spark, d).drop("bar_idx").join(f.select("series", "ts_ms", "bar_idx"), ["series", "ts_ms"])
    return rounded(simulation.trades(simulation.simulate(f, s, simulation.Settings(funding_bars=8 * 12))))
