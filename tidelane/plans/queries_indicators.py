"""Indicator, structure, fold and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.operators import bars as B
from tidelane.operators import blocks, folds, regime, signals, structure
from tidelane.operators import windows as W

from .registry import hourly, query, rounded

P = "PARTITION BY series ORDER BY bar_idx"
ROWS = 256  # bars of a block, so that series of the given tables have several


def one(name: str, sql: str, column):
    """A query of series, bar_idx and one column."""

    @query(name, sql)
    def _(spark, d, column=column, name=name):
        b = column(hourly(spark, d))
        return rounded(b.select("series", "bar_idx", *[c for c in b.columns if c in OUT[name]]))

    return _


OUT: dict[str, list[str]] = {}


def column(name: str, outputs: list[str], sql: str):
    """Registers a query whose function adds `outputs` to the hourly bars."""
    OUT[name] = outputs

    def add(f):
        one(name, sql, f)
        return f

    return add


@column("sma", ["sma"], f"WITH bars SELECT series, bar_idx, round(avg(c) OVER ({P} ROWS 19 PRECEDING), 6) AS sma FROM bars")
def _(b):
    return blocks.spread(b, lambda d: d.withColumn("sma", W.sma("c", 20)), 19, 19, ROWS)


@column("highest_lowest", ["hi", "lo"], f"WITH bars SELECT series, bar_idx, max(h) OVER w AS hi, min(l) OVER w AS lo FROM bars WINDOW w AS ({P} ROWS 9 PRECEDING)")
def _(b):
    return blocks.spread(b, lambda d: d.withColumn("hi", W.highest("h", 10)).withColumn("lo", W.lowest("l", 10)), 9, 0, ROWS)


TR = f"tr AS (SELECT *, greatest(h - l, abs(h - coalesce(lag(c) OVER ({P}), h)), abs(l - coalesce(lag(c) OVER ({P}), l))) AS tr FROM bars)"


@column("true_range", ["tr"], f"WITH bars, {TR} SELECT series, bar_idx, round(tr, 6) AS tr FROM tr")
def _(b):
    return b.withColumn("tr", W.true_range())


MA = f"m AS (SELECT *, avg(c) OVER ({P} ROWS 9 PRECEDING) AS s FROM bars)"


@column("crossover", ["up"], f"WITH bars, {MA} SELECT series, bar_idx, coalesce(c > s AND lag(c) OVER ({P}) <= lag(s) OVER ({P}), false) AS up FROM m")
def _(b):
    return W.crossover(b.withColumn("s", W.sma("c", 10)), "c", "s", "up")


@column("crossunder", ["down"], f"WITH bars, {MA} SELECT series, bar_idx, coalesce(c < s AND lag(c) OVER ({P}) >= lag(s) OVER ({P}), false) AS down FROM m")
def _(b):
    return W.crossunder(b.withColumn("s", W.sma("c", 10)), "c", "s", "down")


def pivot_sql(x: str, agg: str, sign: str, name: str) -> str:
    return f"""WITH bars, p AS (SELECT series, bar_idx, CASE WHEN {x} {sign} {agg}({x}) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND {x} {sign} {agg}({x}) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)
    AND count(*) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 AND count(*) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN {x} END AS p FROM bars)
    SELECT series, bar_idx, lag(p, 5) OVER ({P}) AS {name} FROM p"""


@column("pivot_high", ["ph"], pivot_sql("h", "max", ">", "ph"))
def _(b):
    return blocks.spread(b, lambda d: W.pivot(d, "h", 5, 5, True, "ph"), 10, 0, ROWS)


@column("pivot_low", ["pl"], pivot_sql("l", "min", "<", "pl"))
def _(b):
    return blocks.spread(b, lambda d: W.pivot(d, "l", 5, 5, False, "pl"), 10, 0, ROWS)


@column("volume_ratio", ["volume_ratio"], f"WITH bars SELECT series, bar_idx, round(v / avg(v) OVER ({P} ROWS 19 PRECEDING), 6) AS volume_ratio FROM bars")
def _(b):
    return blocks.spread(b, lambda d: W.volume_ratio(d, 20), 19, 19, ROWS)


@column("momentum3", ["mom"], f"WITH bars SELECT series, bar_idx, round(coalesce(c - lag(c, 3) OVER ({P}), 0.0), 6) AS mom FROM bars")
def _(b):
    return b.withColumn("mom", W.momentum("c"))


def gauss_sql(x: str, n: int, sigma: float) -> str:
    return " + ".join(f"coalesce(lag({x}, {j}) OVER w, first_value({x}) OVER w) * {g!r}" for j, g in enumerate(W.gaussian_weights(n, sigma)))


@column("gaussian_filter", ["g"], f"WITH bars SELECT series, bar_idx, round({gauss_sql('c', 12, 3.0)}, 6) AS g FROM bars WINDOW w AS ({P})")
def _(b):
    return blocks.spread(b, lambda d: d.withColumn("g", W.gaussian("c", 12, 3.0)), 11, 0, ROWS)


def gauss_cte(period: int = 10, sigma: float = 3.0, centre: str = "list_sort(g)[11]") -> str:
    """The bundle's score, centre, trend and line as k."""
    return f"""g AS (SELECT *, [{", ".join(gauss_sql("c", period + k, sigma) for k in range(21))}] AS g, avg(h - l) OVER ({P} ROWS 99 PRECEDING) AS r FROM bars WINDOW w AS ({P})),
 t AS (SELECT *, len(list_filter(g, lambda x: x > g[1])) * 0.05::DOUBLE AS score, {centre} AS centre FROM g),
 u AS (SELECT *, centre + r AS upper, centre - r AS lower FROM t),
 e AS (SELECT *, last_value(CASE WHEN c > upper THEN true WHEN c < lower OR bar_idx = 0 THEN false END IGNORE NULLS) OVER ({P}) AS trend FROM u),
 k AS (SELECT *, CASE WHEN trend THEN lower ELSE upper END AS line FROM e)"""


GAUSS = gauss_cte()


@column("multi_trend_score", ["score", "centre"], f"WITH bars, {GAUSS} SELECT series, bar_idx, round(score, 6) AS score, round(centre, 6) AS centre FROM k")
def _(b):
    return blocks.spread(b, W.trend_bands, W.bands_back(), 0, ROWS)


@column("gauss_trend_latch", ["trend", "line"], f"WITH bars, {GAUSS} SELECT series, bar_idx, trend, round(line, 6) AS line FROM k")
def _(b):
    return blocks.multi_trend(b, ROWS)


@column("gauss_signals", ["up", "down"], f"""WITH bars, {GAUSS} SELECT series, bar_idx, coalesce(c > line AND lag(c) OVER ({P}) <= lag(line) OVER ({P}), false) AS up,
 coalesce(c < line AND lag(c) OVER ({P}) >= lag(line) OVER ({P}), false) AS down FROM k""")
def _(b):
    return blocks.spread(blocks.multi_trend(b, ROWS), lambda d: W.crossunder(W.crossover(d, "c", "line", "up"), "c", "line", "down"), 1, 0, ROWS)


@column("cycle_strength", ["strong"], f"WITH bars, d AS (SELECT *, abs(c - o) AS a FROM bars) SELECT series, bar_idx, bar_idx < 100 OR a >= quantile_cont(a, 0.6) OVER ({P} ROWS 100 PRECEDING) AS strong FROM d")
def _(b):
    return blocks.strength(b.withColumn("x", F.col("c") - F.col("o")), "x", 100, 60, rows=ROWS)


@column("ob_range", ["range_high", "range_low"], f"WITH bars SELECT series, bar_idx, max(h) OVER w AS range_high, min(l) OVER w AS range_low FROM bars WINDOW w AS ({P} ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)")
def _(b):
    return blocks.spread(b, lambda d: d.select("*", *W.previous_range(10)), 11, 0, ROWS)


EXC = f"""WITH bars, j AS (SELECT a.series, a.bar_idx, a.c, b.bar_idx - a.bar_idx AS k, (b.h - a.c) / a.c * 100 AS up, (a.c - b.l) / a.c * 100 AS down
 FROM bars a LEFT JOIN bars b ON a.series = b.series AND b.bar_idx > a.bar_idx AND b.bar_idx < a.bar_idx + {{n}})
 SELECT series, bar_idx, round(greatest(coalesce(max(up), 0), 0), 6)::DOUBLE AS mfe, round(greatest(coalesce(max(down), 0), 0), 6)::DOUBLE AS mae,
 CASE WHEN max(up) > 0 THEN arg_max(k, (up, -k)) ELSE 0 END AS mfe_bar, CASE WHEN max(down) > 0 THEN arg_max(k, (down, -k)) ELSE 0 END AS mae_bar FROM j GROUP BY series, bar_idx"""


EXC_EARLY = f"""WITH bars SELECT a.series, a.bar_idx, round(greatest(coalesce(max((a.c - b.l) / a.c * 100), 0), 0), 6)::DOUBLE AS mae
 FROM bars a LEFT JOIN bars b ON a.series = b.series AND b.bar_idx > a.bar_idx AND b.bar_idx < a.bar_idx + 6 GROUP BY a.series, a.bar_idx"""


@column("mfe_mae", ["mfe", "mae", "mfe_bar", "mae_bar"], EXC.format(n=24))
def _(b):
    return blocks.spread(b, lambda d: W.excursions(d, 24), 0, 23, ROWS)


@column("early_mae", ["mae"], EXC_EARLY)
def _(b):
    return blocks.spread(b, lambda d: W.excursions(d, 6), 0, 5, ROWS)


# --- folds ---


def recursion(r: str, x: str, a: float, frm: str) -> str:
    """Exponential smoothing of x in frm as a recursive CTE r (its name begins with r)."""
    return f"""RECURSIVE {r}(series, bar_idx, e) AS (SELECT series, bar_idx, {x} FROM {frm} WHERE bar_idx = 0
    UNION ALL SELECT b.series, b.bar_idx, {a!r} * b.{x} + {1 - a!r} * {r}.e FROM {r} JOIN {frm} b ON b.series = {r}.series AND b.bar_idx = {r}.bar_idx + 1)"""


def smooth_sql(x: str, a: float, name: str, frm: str = "bars", pre: str = "") -> str:
    return f"WITH bars{pre}, {recursion('r', x, a, frm)} SELECT series, bar_idx, round(e, 6) AS {name} FROM r"


@column("ema", ["ema"], smooth_sql("c", 2 / 21, "ema"))
def _(b):
    return blocks.ema(b, "c", 20, "ema")


@column("ema_alpha", ["s"], smooth_sql("c", 0.15, "s"))
def _(b):
    return blocks.smooth(b, "c", 0.15, "s")


@column("rma", ["rma"], smooth_sql("c", 1 / 14, "rma"))
def _(b):
    return blocks.rma(b, "c", 14, "rma")


@column("atr", ["atr"], smooth_sql("tr", 1 / 14, "atr", "tm", f", {TR}, tm AS MATERIALIZED (SELECT * FROM tr)"))
def _(b):
    return blocks.rma(blocks.spread(b, lambda d: d.withColumn("tr", W.true_range()), 1, 0, ROWS), "tr", 14, "atr")


A = 0.07


def trend_cte(a: float = A) -> str:
    """The trend line of the close, t1 of rt."""
    return f"""RECURSIVE rt(series, bar_idx, c1, c2, t1, t2) AS (SELECT series, bar_idx, c, 0.0::DOUBLE, c, 0.0::DOUBLE FROM bars WHERE bar_idx = 0
 UNION ALL SELECT b.series, b.bar_idx, b.c, rt.c1, CASE WHEN b.bar_idx < 3 THEN b.c ELSE {a - a * a / 4!r} * b.c + {a * a / 2!r} * rt.c1 - {a - 0.75 * a * a!r} * rt.c2 + {2 * (1 - a)!r} * rt.t1 - {(1 - a) ** 2!r} * rt.t2 END, rt.t1
 FROM rt JOIN bars b ON b.series = rt.series AND b.bar_idx = rt.bar_idx + 1)"""


TREND = trend_cte()


@column("itrend", ["itrend"], f"WITH bars, {TREND} SELECT series, bar_idx, round(t1, 6) AS itrend FROM rt")
def _(b):
    return blocks.trend_line(b)


def cycle_cte(x: str = "c", a: float = A) -> str:
    """The cycle of x with a constant alpha, c1 of r."""
    return f"""s AS MATERIALIZED (SELECT series, bar_idx, (coalesce({x}, 0) + 2 * coalesce(lag({x}) OVER w, 0) + 2 * coalesce(lag({x}, 2) OVER w, 0) + coalesce(lag({x}, 3) OVER w, 0)) / 6 AS s,
 ({x} - 2 * coalesce(lag({x}) OVER w, 0) + coalesce(lag({x}, 2) OVER w, 0)) / 4 AS q FROM bars WINDOW w AS ({P})),
 d AS MATERIALIZED (SELECT *, s - 2 * coalesce(lag(s) OVER ({P}), 0) + coalesce(lag(s, 2) OVER ({P}), 0) AS curve FROM s),
 RECURSIVE r(series, bar_idx, c1, c2) AS (SELECT series, bar_idx, q, 0.0::DOUBLE FROM d WHERE bar_idx = 0
 UNION ALL SELECT d.series, d.bar_idx, CASE WHEN d.bar_idx < 7 THEN d.q ELSE {(1 - a / 2) ** 2!r} * d.curve + {2 * (1 - a)!r} * r.c1 - {(1 - a) ** 2!r} * r.c2 END, r.c1
 FROM r JOIN d ON d.series = r.series AND d.bar_idx = r.bar_idx + 1)"""


CYCLE = cycle_cte()


@column("cybercycle", ["cycle", "trigger"], f"WITH bars, {CYCLE} SELECT series, bar_idx, round(c1, 6) AS cycle, round(coalesce(lag(c1) OVER ({P}), 0), 6) AS trigger FROM r")
def _(b):
    return blocks.spread(blocks.cycle(b), lambda d: d.withColumn("trigger", W.nz(F.col("cycle"), 1)), 1, 0, ROWS)


# smoothing by halves forgets: 54 bars back the weight is below 1e-16, so a finite filter gives the same
FISHER = f"""x AS (SELECT series, bar_idx, c1, min(c1) OVER w AS lo, max(c1) OVER w AS hi FROM r WINDOW w AS ({P} ROWS 9 PRECEDING)),
 f AS MATERIALIZED (SELECT *, CASE WHEN hi <> lo THEN greatest(-0.999, least(0.999, 2 * ((c1 - lo) / (hi - lo) - 0.5))) ELSE 0 END AS v FROM x),
 y AS MATERIALIZED (SELECT series, bar_idx, 0.25 * ln((1 + v) / (1 - v)) AS y FROM f),
 fi AS MATERIALIZED (SELECT a.series, a.bar_idx, sum(b.y * 0.5 ** (a.bar_idx - b.bar_idx)) AS fisher FROM y a JOIN y b ON a.series = b.series AND b.bar_idx <= a.bar_idx AND b.bar_idx > a.bar_idx - 54 GROUP BY a.series, a.bar_idx)"""


@column("fisher", ["fisher"], f"WITH bars, {CYCLE}, {FISHER} SELECT series, bar_idx, round(fisher, 6) AS fisher FROM fi")
def _(b):
    return folds.cycle(b)


KALMAN = f"""WITH bars, RECURSIVE r(series, bar_idx, x, p, m, e) AS (SELECT series, bar_idx, c, (1 - 1.01 / 1.51) * 1.01, 0.00095::DOUBLE, 0.0::DOUBLE FROM bars WHERE bar_idx = 0
 UNION ALL SELECT b.series, b.bar_idx, r.x + (r.p + 0.01) / (r.p + 0.51) * (b.c - r.x), (1 - (r.p + 0.01) / (r.p + 0.51)) * (r.p + 0.01), 0.05 * abs(b.c - r.x) + 0.95 * r.m, abs(b.c - r.x)
 FROM r JOIN bars b ON b.series = r.series AND b.bar_idx = r.bar_idx + 1)
 SELECT series, bar_idx, round(greatest(0.05, least(0.5, 0.05 + 0.45 / (1 + exp(-(CASE WHEN m > 1e-12 THEN e / m ELSE 1 END - 1) * 2)))), 6) AS alpha FROM r"""


@column("kalman_alpha", ["alpha"], KALMAN)
def _(b):
    return folds.adaptive_alpha(b, "kalman")


KALMAN_ALPHA = KALMAN.replace(" SELECT series, bar_idx, round(greatest", ", al AS (SELECT series, bar_idx, greatest").replace(", 6) AS alpha FROM r", " AS alpha FROM r)")


@query(
    "alpha_summary",
    f"""{KALMAN_ALPHA}, f AS (SELECT *, greatest(alpha, 0.1) AS fl FROM al WHERE bar_idx >= 100)
    SELECT series, round(avg(alpha), 6) AS mean, round(stddev_pop(alpha), 6) AS sd, round(min(alpha), 6) AS low, round(max(alpha), 6) AS high, {", ".join(f"round(quantile_cont(alpha, {k / 100}), 6) AS p{k}" for k in (10, 25, 50, 75, 90))},
    round(avg((alpha < 0.1)::INT) * 100, 6) AS clipped, round(avg(fl), 6) AS floor_mean, round(quantile_cont(fl, 0.5), 6) AS floor_median, round(stddev_pop(fl), 6) AS floor_sd FROM f GROUP BY series""",
)
def _(spark, d):
    return rounded(W.alpha_summary(folds.adaptive_alpha(hourly(spark, d), "kalman")))


@query(
    "alpha_histogram",
    f"""{KALMAN_ALPHA}, f AS (SELECT * FROM al WHERE bar_idx >= 100), b AS (SELECT series, unnest(range(19)) AS bin FROM (SELECT DISTINCT series FROM f)), n AS (SELECT series, least(floor((alpha - 0.05) / (0.45 / 19)), 18)::BIGINT AS bin, count(*) AS n FROM f GROUP BY ALL)
    SELECT b.series, b.bin, round(0.05 + b.bin * 0.45 / 19, 6)::DOUBLE AS low, round(0.05 + (b.bin + 1) * 0.45 / 19, 6)::DOUBLE AS high, coalesce(n.n, 0) AS n FROM b LEFT JOIN n ON n.series = b.series AND n.bin = b.bin""",
)
def _(spark, d):
    return rounded(W.histogram(folds.adaptive_alpha(hourly(spark, d), "kalman").filter("bar_idx >= 100"), "alpha", 0.05, 0.5))


for _name in ("homodyne", "mama", "autocorrelation"):

    @query(f"{_name}_alpha")
    def _(spark, d, method=_name):
        return rounded(folds.adaptive_alpha(hourly(spark, d), method).select("series", "bar_idx", "alpha"))


@query("alpha_percentiles")
def _(spark, d):
    a = folds.adaptive_alpha(hourly(spark, d), "homodyne")
    return rounded(a.groupBy("series").agg(F.min("alpha").alias("low"), F.max("alpha").alias("high"), F.percentile("alpha", 0.5).alias("mid")))


# --- structure ---

SWING = f"""sw AS (SELECT *, h > max(h) OVER a AND h > max(h) OVER b AND count(*) OVER a = 5 AND count(*) OVER b = 5 AS up, l < min(l) OVER a AND l < min(l) OVER b AND count(*) OVER a = 5 AND count(*) OVER b = 5 AS down
 FROM bars WINDOW a AS ({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS ({P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
 swings AS (SELECT series, bar_idx, c, true AS is_high, h AS price FROM sw WHERE up UNION ALL SELECT series, bar_idx, c, false, l FROM sw WHERE down)"""


@query("swing_points", f"WITH bars, {SWING} SELECT series, bar_idx, is_high, price FROM swings")
def _(spark, d):
    return structure.swings(hourly(spark, d), 5)


BREAKS = f"""{SWING}, ex AS (SELECT *, max(price) OVER x AS top, min(price) OVER x AS bottom FROM swings WINDOW x AS (PARTITION BY series, is_high ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 bd AS (SELECT *, CASE WHEN is_high AND c > top THEN 1 WHEN NOT is_high AND c < bottom THEN -1 END AS direction FROM ex),
 br AS (SELECT series, bar_idx, direction, CASE WHEN lag(direction) OVER (PARTITION BY series ORDER BY bar_idx, is_high DESC) = -direction THEN 'CHoCH' ELSE 'BOS' END AS kind, c AS price FROM bd WHERE direction IS NOT NULL)"""


@query("bos_choch", f"WITH bars, {BREAKS} SELECT * FROM br")
def _(spark, d):
    return structure.breaks(hourly(spark, d), 5)


@query("smc_signals", f"WITH bars, {BREAKS} SELECT b.series, b.bar_idx, coalesce(last_value(br.direction IGNORE NULLS) OVER (PARTITION BY b.series ORDER BY b.bar_idx), 0) AS trend FROM bars b LEFT JOIN br USING (series, bar_idx)")
def _(spark, d):
    b = hourly(spark, d)
    return structure.trend(b, structure.breaks(b, 5)).select("series", "bar_idx", "trend")


FVG = f"""k AS (SELECT *, lag(h, 2) OVER ({P}) AS h2, lag(l, 2) OVER ({P}) AS l2 FROM bars), fvg AS (SELECT series, bar_idx - 1 AS bar_idx, CASE WHEN l > h2 THEN 1 ELSE -1 END AS direction,
 CASE WHEN l > h2 THEN l ELSE l2 END AS top, CASE WHEN l > h2 THEN h2 ELSE h END AS bottom FROM k WHERE l > h2 OR h < l2)"""


@query("fvg", f"WITH bars, {FVG} SELECT * FROM fvg")
def _(spark, d):
    return structure.fair_value_gaps(hourly(spark, d))


@query("fvg_mitigation", f"WITH bars, {FVG} SELECT f.*, min(b.bar_idx) AS crossed_idx FROM fvg f LEFT JOIN bars b ON b.series = f.series AND b.bar_idx >= f.bar_idx + 2 AND CASE WHEN direction = 1 THEN b.l <= top ELSE b.h >= bottom END GROUP BY ALL")
def _(spark, d):
    return structure.mitigated_gaps(hourly(spark, d))


FILLED = """fm AS (SELECT f.*, min(b.bar_idx) AS crossed_idx FROM fvg f LEFT JOIN bars b ON b.series = f.series AND b.bar_idx >= f.bar_idx + 2 AND CASE WHEN direction = 1 THEN b.l <= top ELSE b.h >= bottom END GROUP BY ALL)"""


def zone_sql(lookback: int, live: str) -> str:
    """Bars in gaps fm, as gz; live: which gaps count at bar b."""
    return f"""gz AS (SELECT b.series, b.bar_idx, coalesce(bool_or(f.direction = 1), false) AS in_bull, coalesce(bool_or(f.direction = -1), false) AS in_bear FROM bars b
    LEFT JOIN fm f ON f.series = b.series AND b.bar_idx < f.bar_idx + {lookback} AND {live} AND CASE WHEN f.direction = 1 THEN b.l ELSE b.h END BETWEEN f.bottom AND f.top GROUP BY b.series, b.bar_idx)"""


NEVER_FILLED, OPEN_THEN = "b.bar_idx >= f.bar_idx AND f.crossed_idx IS NULL", "b.bar_idx > f.bar_idx AND (f.crossed_idx IS NULL OR b.bar_idx <= f.crossed_idx)"

for _name, _now, _live in (("fvg_zone", False, NEVER_FILLED), ("fvg_zone_in_time", True, OPEN_THEN)):

    @query(_name, f"WITH bars, {FVG}, {FILLED}, {zone_sql(20, _live)} SELECT * FROM gz")
    def _(spark, d, now=_now):
        return structure.gap_zones(hourly(spark, d), 20, now)


OB = f"""ob0 AS (SELECT *, v / avg(v) OVER ({P} ROWS 20 PRECEDING) AS s, lag(h) OVER ({P}) AS h1, lag(l) OVER ({P}) AS l1, max(h) OVER t AS hh, min(l) OVER t AS ll FROM bars WINDOW t AS ({P} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
 mk AS (SELECT series, bar_idx AS made_idx, 1 AS direction FROM ob0 WHERE bar_idx > 10 AND c > h1 AND c > hh UNION ALL SELECT series, bar_idx, -1 FROM ob0 WHERE bar_idx > 10 AND c < l1 AND c < ll),
 ob AS (SELECT m.series, m.made_idx, m.direction, max(b.bar_idx) AS bar_idx, arg_max(greatest(b.o, b.c), b.bar_idx) AS top, arg_max(least(b.o, b.c), b.bar_idx) AS bottom, arg_max(b.s, b.bar_idx) AS strength
 FROM mk m JOIN ob0 b ON b.series = m.series AND b.bar_idx BETWEEN m.made_idx - 10 AND m.made_idx - 1 AND CASE WHEN m.direction = 1 THEN b.c < b.o ELSE b.c > b.o END GROUP BY ALL),
 obm AS (SELECT o.*, min(b.bar_idx) AS crossed_idx FROM ob o LEFT JOIN bars b ON b.series = o.series AND b.bar_idx > o.bar_idx AND CASE WHEN direction = 1 THEN b.l <= bottom ELSE b.h >= top END GROUP BY ALL)"""


@query("order_blocks", f"WITH bars, {OB} SELECT series, made_idx, direction, bar_idx, top, bottom, round(strength, 6) AS strength FROM ob")
def _(spark, d):
    return rounded(structure.order_blocks(hourly(spark, d)))


@query("ob_mitigation", f"WITH bars, {OB} SELECT series, made_idx, direction, bar_idx, crossed_idx FROM obm")
def _(spark, d):
    return structure.mitigated_blocks(hourly(spark, d)).select("series", "made_idx", "direction", "bar_idx", "crossed_idx")


@query(
    "ob_proximity",
    f"""WITH bars, {OB}, n AS (SELECT b.series, b.bar_idx, min(abs(b.c - (o.top + o.bottom) / 2) / b.c) AS distance FROM bars b JOIN obm o ON o.series = b.series AND o.made_idx <= b.bar_idx AND (o.crossed_idx IS NULL OR o.crossed_idx > b.bar_idx)
    AND abs(b.c - (o.top + o.bottom) / 2) / b.c <= 0.02 GROUP BY ALL) SELECT b.series, b.bar_idx, round(n.distance, 6) AS distance FROM bars b LEFT JOIN n USING (series, bar_idx)""",
)
def _(spark, d):
    return rounded(structure.block_proximity(hourly(spark, d)))


LIQUIDITY = f"""{SWING}, pv AS (SELECT series, bar_idx + 5 AS born, is_high, price FROM swings),
 pd AS (SELECT p.*, min(b.bar_idx) AS dead FROM pv p LEFT JOIN bars b ON b.series = p.series AND b.bar_idx >= p.born AND CASE WHEN is_high THEN b.h >= price ELSE b.l <= price END GROUP BY ALL),
 lq AS (SELECT b.series, b.bar_idx, min(CASE WHEN is_high THEN price END) AS bsl, max(CASE WHEN NOT is_high THEN price END) AS ssl FROM bars b
 LEFT JOIN pd ON pd.series = b.series AND pd.born <= b.bar_idx AND (pd.dead IS NULL OR pd.dead > b.bar_idx) GROUP BY b.series, b.bar_idx)"""


@query("liquidity_nearest", f"WITH bars, {LIQUIDITY} SELECT * FROM lq")
def _(spark, d):
    return structure.liquidity(hourly(spark, d))


@query("liquidity_capped")
def _(spark, d):
    b = W.pivot(W.pivot(hourly(spark, d), "h", 5, 5, True, "pivot_high"), "l", 5, 5, False, "pivot_low")
    return folds.capped_levels(b).select("series", "bar_idx", "bsl", "ssl")


@query(
    "first_touch_barriers",
    """WITH bars, j AS (SELECT a.series, a.bar_idx, min(CASE WHEN b.l <= a.c * 0.98 THEN b.bar_idx END) AS sl, min(CASE WHEN b.h >= a.c * 1.03 THEN b.bar_idx END) AS tp
    FROM bars a LEFT JOIN bars b ON a.series = b.series AND b.bar_idx > a.bar_idx AND b.bar_idx <= a.bar_idx + 48 GROUP BY a.series, a.bar_idx)
    SELECT series, bar_idx, CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN 'SL' WHEN tp IS NOT NULL THEN 'TP' ELSE 'none' END AS outcome, least(sl, tp) AS touch_idx FROM j""",
)
def _(spark, d):
    return structure.barriers(hourly(spark, d), 0.03, 0.02, 48)


# --- regime ---


@query("regime_vt")
def _(spark, d):
    return rounded(regime.volatility_trend(hourly(spark, d)).select("series", "bar_idx", "regime", "direction", "norm_vol"))


@query("regime_cluster")
def _(spark, d):
    return regime.clusters(hourly(spark, d)).select("series", "bar_idx", "regime")


@query(
    "regime_features",
    f"""WITH bars, k AS (SELECT *, ln(c / lag(c) OVER ({P})) AS r FROM bars)
    SELECT series, bar_idx, round(avg(r) OVER f, 6) AS ret_mean, round(stddev_pop(r) OVER f, 6) AS ret_sd, round(v / avg(v) OVER f, 6) AS volume_share, round((max(h) OVER f - min(l) OVER f) / avg(c) OVER f, 6) AS range_share,
    round(abs(regr_slope(c, bar_idx) OVER f) / avg(c) OVER f, 6) AS slope_share FROM k WINDOW f AS ({P} ROWS 19 PRECEDING) QUALIFY bar_idx >= 20""",
)
def _(spark, d):
    b = regime.features(hourly(spark, d))
    return rounded(b.filter("bar_idx >= 20").select("series", "bar_idx", *regime.FEATURES))


LABEL = "lb AS (SELECT *, CASE WHEN c > 60 THEN 1 WHEN c < 30 THEN 2 ELSE 3 END AS regime FROM bars)"


def labelled(b):
    return b.withColumn("regime", F.when(F.col("c") > 60, 1).when(F.col("c") < 30, 2).otherwise(3))


SEG = f"ch AS (SELECT *, coalesce((regime <> lag(regime) OVER ({P}))::INT, 1) AS n FROM lb), rn AS (SELECT *, sum(n) OVER ({P}) AS run FROM ch)"


@query("regime_segments", f"WITH bars, {LABEL}, {SEG} SELECT series, run::BIGINT AS run, any_value(regime) AS regime, min(bar_idx) AS first, max(bar_idx) AS last, count(*) AS n_bars, round((arg_max(c, bar_idx) / arg_min(c, bar_idx) - 1) * 100, 6) AS ret FROM rn GROUP BY series, run")
def _(spark, d):
    return rounded(regime.segments(labelled(hourly(spark, d))))


@query(
    "regime_stats",
    f"""WITH bars, {LABEL}, q AS (SELECT *, c / lag(c) OVER (PARTITION BY series, regime ORDER BY bar_idx) - 1 AS r FROM lb),
    z AS (SELECT series, regime, count(*) AS n_bars, round(avg(r), 6) AS mean_ret, round(stddev_pop(r), 6) AS sd_ret FROM q GROUP BY ALL) SELECT *, round(n_bars / sum(n_bars) OVER (PARTITION BY series) * 100, 6) AS pct FROM z""",
)
def _(spark, d):
    return rounded(regime.statistics(labelled(hourly(spark, d))))


@query(
    "trades_by_regime",
    f"""WITH bars, {LABEL}, t AS (SELECT series, bar_idx, lead(c, 5) OVER ({P}) - c AS pnl, regime FROM lb), u AS (SELECT * FROM t WHERE pnl IS NOT NULL)
    SELECT series, regime, count(*) AS n_trades, round(sum(pnl), 6) AS pnl, round(avg((pnl > 0)::INT) * 100, 6) AS win_rate, round(CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(count(*)) ELSE 0 END, 6) AS sharpe FROM u GROUP BY ALL""",
)
def _(spark, d):
    b = labelled(hourly(spark, d))
    t = b.withColumn("net_pnl", F.lead("c", 5).over(B.in_order()) - F.col("c")).filter("net_pnl is not null").select("series", F.col("bar_idx").alias("entry_idx"), "net_pnl")
    return rounded(regime.trades_by_regime(t, b))


# --- signals ---


@query(
    "confidence_score",
    f"""WITH bars, k AS (SELECT *, c - lag(c, 2) OVER ({P}) AS slope, avg(v) OVER ({P} ROWS 19 PRECEDING) AS m, c - lag(c, 3) OVER ({P}) AS mom FROM bars)
    SELECT series, bar_idx, least(100, 20 + CASE WHEN slope > 0 THEN 20 ELSE 0 END + CASE WHEN c < 30 THEN 15 ELSE 0 END + CASE WHEN v > m THEN 15 ELSE 0 END + CASE WHEN c > o THEN 10 ELSE 0 END + CASE WHEN mom > 0 THEN 10 ELSE 0 END + CASE WHEN h - l > 50 THEN 10 ELSE 0 END)::DOUBLE AS confidence FROM k""",
)
def _(spark, d):
    w = B.in_order()
    b = hourly(spark, d).withColumn("m", W.sma("v", 20)).withColumn("slope", F.col("c") - F.lag("c", 2).over(w)).withColumn("mom", F.col("c") - F.lag("c", 3).over(w))
    parts = {"cross": F.lit(True), "trend": F.col("slope") > 0, "zone": F.col("c") < 30, "volume": F.col("v") > F.col("m"), "fisher": F.col("c") > F.col("o"), "momentum": F.col("mom") > 0, "strength": F.col("h") - F.col("l") > 50}
    return b.select("series", "bar_idx", signals.confidence("v7", parts).alias("confidence"))


@query("daily_signal_cap", f"WITH bars, k AS (SELECT series, bar_idx, ts_ms FROM bars WHERE c > o) SELECT series, bar_idx FROM k QUALIFY row_number() OVER (PARTITION BY series, ts_ms // 86400000 ORDER BY bar_idx) <= 3")
def _(spark, d):
    k = hourly(spark, d).filter("c > o").select("series", "bar_idx", "ts_ms")
    return folds.throttle(k, 0, 3).filter("accepted = 1").select("series", "bar_idx")


@query(
    "min_bars_throttle",
    """WITH bars, s AS (SELECT series, bar_idx FROM bars WHERE c > o), RECURSIVE r AS (SELECT series, min(bar_idx) AS bar_idx FROM s GROUP BY series
    UNION ALL SELECT r.series, min(s.bar_idx) FROM r JOIN s ON s.series = r.series AND s.bar_idx >= r.bar_idx + 24 GROUP BY r.series) SELECT series, bar_idx FROM r""",
)
def _(spark, d):
    return folds.throttle(hourly(spark, d).filter("c > o").select("series", "bar_idx", "ts_ms"), 24).filter("accepted = 1").select("series", "bar_idx")


@query(
    "ensemble_vote",
    f"""WITH bars, s AS (SELECT series, bar_idx, 1.0 AS w, CASE WHEN c > o THEN 1 ELSE -1 END AS d, 60.0 AS conf FROM bars UNION ALL SELECT series, bar_idx, 0.7, CASE WHEN c > 50 THEN 1 ELSE -1 END, 80.0 FROM bars
    UNION ALL SELECT series, bar_idx, 1.2, CASE WHEN v > 3 THEN 1 ELSE -1 END, 70.0 FROM bars),
    g AS (SELECT series, bar_idx, sum(CASE WHEN d = 1 THEN w * conf ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN d = -1 THEN w * conf ELSE 0 END)::DOUBLE AS b, count(*) AS members FROM s GROUP BY ALL)
    SELECT series, bar_idx, CASE WHEN a > b THEN 1 ELSE -1 END AS direction, round(greatest(a, b) / (a + b) * 100, 6) AS confidence, members FROM g WHERE round(a - b, 9) <> 0 AND greatest(a, b) >= 0.6 * (a + b)""",
)
def _(spark, d):
    b = hourly(spark, d)
    member = lambda n, w, cond, conf: b.select("series", "bar_idx", F.lit(n).alias("member"), F.lit(w).alias("weight"), F.when(cond, 1).otherwise(-1).alias("direction"), F.lit(conf).alias("confidence"))
    s = member("a", 1.0, F.col("c") > F.col("o"), 60.0).union(member("b", 0.7, F.col("c") > 50, 80.0)).union(member("c", 1.2, F.col("v") > 3, 70.0))
    return rounded(signals.vote(s, 0.6).drop("contributors"))


@query(
    "ensemble_contributions",
    """WITH bars, s AS (SELECT series, bar_idx, 'a' AS m, CASE WHEN c > o THEN 1 ELSE -1 END AS d FROM bars UNION ALL SELECT series, bar_idx, 'b', CASE WHEN c > 50 THEN 1 ELSE -1 END FROM bars UNION ALL SELECT series, bar_idx, 'c', CASE WHEN v > 3 THEN 1 ELSE -1 END FROM bars),
    g AS (SELECT series, bar_idx, sign(sum(d)) AS side FROM s GROUP BY ALL) SELECT series, m AS member, count(*) AS n FROM s JOIN g USING (series, bar_idx) WHERE d = side GROUP BY ALL""",
)
def _(spark, d):
    b = hourly(spark, d)
    member = lambda n, cond: b.select("series", "bar_idx", F.lit(n).alias("member"), F.lit(1.0).alias("weight"), F.when(cond, 1).otherwise(-1).alias("direction"), F.lit(50.0).alias("confidence"))
    return signals.contributions(signals.vote(member("a", F.col("c") > F.col("o")).union(member("b", F.col("c") > 50)).union(member("c", F.col("v") > 3))))


@query(
    "ensemble_by_regime",
    """WITH bars, s AS (SELECT series, bar_idx, v > 3 AS busy, 'a' AS m, CASE WHEN c > o THEN 1 ELSE -1 END AS d, 60.0 AS conf FROM bars UNION ALL SELECT series, bar_idx, v > 3, 'b', CASE WHEN c > 50 THEN 1 ELSE -1 END, 80.0 FROM bars
    UNION ALL SELECT series, bar_idx, v > 3, 'c', CASE WHEN h > 70 THEN 1 ELSE -1 END, 70.0 FROM bars),
    x AS (SELECT *, CASE m WHEN 'a' THEN if(busy, 1.0, 0.3) WHEN 'b' THEN if(busy, 0.5, 1.1) ELSE if(busy, 0.8, 0.6) END * conf AS p FROM s),
    g AS (SELECT series, bar_idx, sum(CASE WHEN d = 1 THEN p ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN d = -1 THEN p ELSE 0 END)::DOUBLE AS b, count(*) AS members FROM x GROUP BY ALL)
    SELECT series, bar_idx, CASE WHEN a > b THEN 1 ELSE -1 END AS direction, round(greatest(a, b) / (a + b) * 100, 6) AS confidence, members FROM g WHERE greatest(a, b) >= 0.5 * (a + b)""",
)
def _(spark, d):
    """Three members whose weights follow the regime, busy or quiet bars."""
    b = hourly(spark, d)
    member = lambda n, cond, conf: b.select("series", "bar_idx", F.lit(n).alias("member"), F.lit(1.0).alias("weight"), F.when(cond, 1).otherwise(-1).alias("direction"), F.lit(conf).alias("confidence"))
    s = member("a", F.col("c") > F.col("o"), 60.0).union(member("b", F.col("c") > 50, 80.0)).union(member("c", F.col("h") > 70, 70.0))
    labels = b.select("series", "bar_idx", F.when(F.col("v") > 3, "busy").otherwise("quiet").alias("regime"))
    weights = spark.createDataFrame([("busy", "a", 1.0), ("busy", "b", 0.5), ("busy", "c", 0.8), ("quiet", "a", 0.3), ("quiet", "b", 1.1), ("quiet", "c", 0.6)], "regime string, member string, weight double")
    return rounded(signals.by_regime(s, labels, weights).drop("contributors"))


def oscillator_sql(live: str) -> str:
    """The oscillator as CTE os; live: which of the blocks obm count at bar b."""
    return f"""{BREAKS}, {OB}, td AS (SELECT b.series, b.bar_idx, coalesce(last_value(br.direction IGNORE NULLS) OVER (PARTITION BY b.series ORDER BY b.bar_idx), 0) AS trend FROM bars b LEFT JOIN br USING (series, bar_idx)),
    pl AS (SELECT *, max(h) OVER w AS hi, min(l) OVER w AS lo FROM bars WINDOW w AS ({P} ROWS 20 PRECEDING)),
    ps AS (SELECT p.series, p.bar_idx, CASE WHEN bar_idx < 20 THEN 0 ELSE greatest(-1, least(1, ((c - lo) / (hi - lo) - 0.5) * 2 + trend * 0.2)) END AS place FROM pl p JOIN td USING (series, bar_idx)),
    nr AS (SELECT b.series, b.bar_idx, max(CASE WHEN direction = 1 AND b.c > top AND (b.c - top) / b.c < 0.02 THEN 1 - (b.c - top) / b.c / 0.02 END) AS bull, max(CASE WHEN direction = -1 AND b.c < bottom AND (bottom - b.c) / b.c < 0.02 THEN 1 - (bottom - b.c) / b.c / 0.02 END) AS bear
    FROM bars b JOIN obm o ON o.series = b.series AND {live} GROUP BY ALL),
    os AS MATERIALIZED (SELECT series, bar_idx, greatest(0, least(100, (0.6 * place + 0.4 * (coalesce(bull, 0) - coalesce(bear, 0)) + 1) * 50))::DOUBLE AS osc FROM ps LEFT JOIN nr USING (series, bar_idx))"""


for _name, _now, _live in (("smc_oscillator", False, "o.bar_idx <= b.bar_idx AND o.crossed_idx IS NULL"), ("smc_oscillator_in_time", True, "o.made_idx <= b.bar_idx AND (o.crossed_idx IS NULL OR o.crossed_idx > b.bar_idx)")):

    @query(_name, f"WITH bars, {oscillator_sql(_live)} SELECT series, bar_idx, round(osc, 6) AS osc FROM os")
    def _(spark, d, now=_now):
        return rounded(structure.oscillator(hourly(spark, d), point_in_time=now))


@query(
    "target_ladder",
    f"""WITH bars, k AS (SELECT *, CASE WHEN c >= o THEN 1 ELSE -1 END AS d, lag(h) OVER ({P}) AS near0, lag(l) OVER ({P}) AS near1 FROM bars), r AS (SELECT series, bar_idx, d, c, greatest(abs(c - o), (h - l) * 0.5) AS r, CASE WHEN d = 1 THEN near0 ELSE near1 END AS near FROM k),
    a AS (SELECT *, CASE WHEN d * (near - c) > 0.3 * r THEN near ELSE c + d * r * 0.8 END AS t0 FROM r), b AS (SELECT *, CASE WHEN d * (near - t0) > 0.3 * r THEN near ELSE t0 + d * r * 1.5 END AS t1 FROM a)
    SELECT series, bar_idx, round(t0, 6) AS t0, round(t1, 6) AS t1, round(t1 + d * r * 8.5, 6) AS t4 FROM b""",
)
def _(spark, d):
    w = B.in_order()
    b = hourly(spark, d).withColumn("direction", F.when(F.col("c") >= F.col("o"), 1).otherwise(-1))
    b = b.withColumn("near", F.when(F.col("direction") == 1, F.lag("h").over(w)).otherwise(F.lag("l").over(w))).withColumn("atr", F.col("h") - F.col("l"))
    x = signals.ladder(b.withColumn("entry", F.col("c")).withColumn("stop", F.col("o")))
    return rounded(x.select("series", "bar_idx", *(F.col("targets")[k].alias(f"t{k}") for k in (0, 1, 4))))
