"""Candle queries: building, checking, repairing, merging, aligning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.operators import bars as B
from tidelane.operators import htf
from tidelane.operators import windows as W

from .registry import HOUR, hourly, query, read, rounded

H4 = 4 * HOUR


@query(
    "candle_crossover_summary",
    """WITH bars, m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY series) >= 20 THEN avg(c) OVER (PARTITION BY series ORDER BY bar_idx ROWS 19 PRECEDING) END AS s FROM bars),
    x AS (SELECT *, coalesce(c > s AND lag(c) OVER w <= lag(s) OVER w, false) AS up, lead(c) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY series ORDER BY bar_idx))
    SELECT series, count(*) AS n_bars, sum(up::INT)::BIGINT AS n_cross, round(sum(CASE WHEN up THEN nxt - c ELSE 0 END), 6) AS next_move FROM x GROUP BY series""",
)
def _(spark, d):
    b = W.crossover(hourly(spark, d).withColumn("s", W.sma("c", 20)), "c", "s", "up").withColumn("nxt", F.lead("c").over(B.in_order()))
    return rounded(b.groupBy("series").agg(F.count("*").alias("n_bars"), F.sum(F.col("up").cast("int")).alias("n_cross"), F.sum(F.when(F.col("up"), F.col("nxt") - F.col("c")).otherwise(0.0)).alias("next_move")))


@query("candle_build", "WITH bars SELECT * FROM bars")
def _(spark, d):
    return hourly(spark, d).select("series", "bar_idx", "ts_ms", "o", "h", "l", "c", "v")


@query("derived_prices", "WITH bars SELECT series, bar_idx, round((h + l) / 2, 6) AS hl2, round((h + l + c) / 3, 6) AS hlc3 FROM bars")
def _(spark, d):
    return rounded(B.with_prices(hourly(spark, d)).select("series", "bar_idx", "hl2", "hlc3"))


@query("row_range_slice", "WITH bars SELECT series, bar_idx - 100 AS bar_idx, c FROM bars WHERE bar_idx >= 100 AND bar_idx < 200")
def _(spark, d):
    return B.row_range(hourly(spark, d), 100, 200).select("series", "bar_idx", "c")


@query("row_set_slice", "WITH bars SELECT series, (row_number() OVER (PARTITION BY series ORDER BY bar_idx) - 1)::BIGINT AS bar_idx, c FROM bars WHERE c > o")
def _(spark, d):
    """The rising bars, numbered anew."""
    b = hourly(spark, d)
    return B.row_set(b, b.filter("c > o").select("series", "bar_idx")).select("series", "bar_idx", "c")


@query("train_validation_split", "WITH bars SELECT series, bar_idx, CASE WHEN bar_idx < floor(count(*) OVER (PARTITION BY series) * 0.7::DOUBLE) THEN 'train' ELSE 'validation' END AS part FROM bars")
def _(spark, d):
    return B.train_validation(hourly(spark, d)).select("series", "bar_idx", "part")


def validate_sql(frm: str) -> str:
    """Counts of each fault in bars of frm."""
    return f"""s AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY series ORDER BY ts_ms) AS step FROM {frm}),
    q AS (SELECT series, count(*) AS n_bars, sum((o IS NULL OR h IS NULL OR l IS NULL OR c IS NULL OR v IS NULL)::INT)::BIGINT AS n_null, sum(coalesce(h < greatest(o, c) - 1e-10, false)::INT)::BIGINT AS bad_high, sum(coalesce(l > least(o, c) + 1e-10, false)::INT)::BIGINT AS bad_low,
    sum(coalesce(step = 0, false)::INT)::BIGINT AS n_duplicate, sum(coalesce(step > 7200000, false)::INT)::BIGINT AS n_gap FROM s GROUP BY series) SELECT *, n_null = 0 AND n_duplicate = 0 AND n_bars > 0 AS valid FROM q"""


@query("candle_validate", f"WITH bars, {validate_sql('bars')}")
def _(spark, d):
    return B.validate(hourly(spark, d), HOUR)


@query(
    "candle_faults",
    f"""WITH bars, bad AS (SELECT series, ts_ms, o, CASE WHEN bar_idx % 7 = 3 THEN o - 1 ELSE h END AS h, CASE WHEN bar_idx % 5 = 2 THEN c + 1 ELSE l END AS l, c, CASE WHEN bar_idx % 11 = 4 AND series <> 'view' THEN NULL ELSE v END AS v FROM bars
    UNION ALL SELECT series, ts_ms, o, h, l, c, v FROM bars WHERE bar_idx % 13 = 6 AND series <> 'click'), {validate_sql('bad')}""",
)
def _(spark, d):
    """Bars with faults put in by their position: high and low on the wrong side, no volume, bars twice."""
    b, at = hourly(spark, d), F.col("bar_idx")
    twice = b.filter((at % 13 == 6) & (F.col("series") != "click"))
    bad = b.withColumns({"h": F.when(at % 7 == 3, F.col("o") - 1).otherwise(F.col("h")), "l": F.when(at % 5 == 2, F.col("c") + 1).otherwise(F.col("l")), "v": F.when((at % 11 == 4) & (F.col("series") != "view"), None).otherwise(F.col("v"))})
    return B.validate(bad.unionByName(twice).drop("bar_idx"), HOUR)


@query(
    "candle_info",
    """WITH bars, s AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY series ORDER BY ts_ms) AS step FROM bars)
    SELECT series, count(*) AS n_bars, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, 0::BIGINT AS n_duplicate, sum(coalesce(step > 5400000, false)::INT)::BIGINT AS n_gap FROM s GROUP BY series""",
)
def _(spark, d):
    return B.info(hourly(spark, d), HOUR)


GAPS = "g AS (SELECT series, ts_ms AS after_ms, lead(ts_ms) OVER (PARTITION BY series ORDER BY ts_ms) AS before_ms FROM bars)"


@query("gap_report", f"WITH bars, {GAPS} SELECT *, (before_ms - after_ms) // 3600000 - 1 AS missing FROM g WHERE before_ms - after_ms > 3600000")
def _(spark, d):
    return B.gaps(hourly(spark, d), HOUR)


@query(
    "gap_top",
    f"WITH bars, {GAPS}, m AS (SELECT series, after_ms, (before_ms - after_ms) // 3600000 - 1 AS missing FROM g) SELECT * FROM m WHERE missing > 0 ORDER BY missing DESC, series, after_ms LIMIT 10",
)
def _(spark, d):
    return B.gaps(hourly(spark, d), HOUR).select("series", "after_ms", "missing").orderBy(F.desc("missing"), "series", "after_ms").limit(10)


@query(
    "gap_fill",
    """WITH bars, r AS (SELECT series, unnest(range(min(ts_ms), max(ts_ms) + 1, 3600000)) AS ts_ms FROM bars GROUP BY series),
    j AS (SELECT r.series, r.ts_ms, b.o, b.h, b.l, b.c, b.v, last_value(b.c IGNORE NULLS) OVER (PARTITION BY r.series ORDER BY r.ts_ms) AS k FROM r LEFT JOIN bars b USING (series, ts_ms))
    SELECT series, ts_ms, coalesce(o, k) AS o, coalesce(h, k) AS h, coalesce(l, k) AS l, k AS c, coalesce(v, 0.0)::DOUBLE AS v, c IS NULL AS filled FROM j""",
)
def _(spark, d):
    return B.fill_gaps(hourly(spark, d), HOUR)


@query(
    "merge_dedupe",
    """WITH bars, a AS (SELECT series, ts_ms, c, 0 AS k FROM bars UNION ALL SELECT series, ts_ms + 86400000, c + 1, 1 FROM bars)
    SELECT series, ts_ms, arg_min(c, k) AS c FROM a GROUP BY series, ts_ms""",
)
def _(spark, d):
    """All bars, and the same a day later as the new side: most hours are held by both."""
    b = hourly(spark, d)
    return B.merge(b.select("series", "ts_ms", "c"), b.select("series", (F.col("ts_ms") + 86400000).alias("ts_ms"), (F.col("c") + 1).alias("c")))


@query(
    "missing_ranges",
    """WITH bars, h AS (SELECT series, min(ts_ms) AS low, max(ts_ms) AS high FROM bars GROUP BY series), w AS (SELECT event_type AS series, min(epoch_ms(date_trunc('day', ts))) - 300 * 3600000 AS s, max(epoch_ms(date_trunc('day', ts))) + 86400000 AS e FROM events GROUP BY event_type)
    SELECT series, 'head' AS side, s AS from_ms, low - 3600000 AS to_ms FROM w JOIN h USING (series) WHERE s < low
    UNION ALL SELECT series, 'tail', high + 3600000, e FROM w JOIN h USING (series) WHERE e > high""",
)
def _(spark, d):
    """What whole days of each series need beyond the hours that are held."""
    day = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
    wanted = read(spark, d, "events").groupBy(F.col("event_type").alias("series")).agg(F.min(day).alias("start_ms"), (F.max(day) + 86400000).alias("end_ms"))
    return B.missing_ranges(hourly(spark, d), wanted, HOUR)


@query(
    "market_fee_join",
    """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'stock' ELSE 'crypto' END AS market, CASE WHEN p_partkey % 10 = 0 THEN 25 ELSE 125 END::BIGINT AS max_leverage, 0.0006::DOUBLE AS fee FROM part""",
)
def _(spark, d):
    from tidelane.sources.rest import MARKETS, market

    m = spark.createDataFrame(MARKETS, "market string, funding_hours long, maker double, fee double, max_leverage long")
    p = read(spark, d, "part").select("p_partkey", market(F.when(F.col("p_partkey") % 10 == 0, "tslausdt").otherwise("BTCUSDT")).alias("market"))
    return p.join(F.broadcast(m), "market").select("p_partkey", "market", "max_leverage", "fee")


@query("symbol_normalise", "SELECT DISTINCT CASE WHEN o_orderstatus = 'O' THEN 'BTC-USDT' WHEN o_orderstatus = 'F' THEN 'ETH-BTC' ELSE 'SOL-USDT' END AS symbol, o_orderstatus FROM orders")
def _(spark, d):
    from tidelane.sources.rest import hyphenated

    raw = F.when(F.col("o_orderstatus") == "O", "btcusdt").when(F.col("o_orderstatus") == "F", "ETH/BTC").otherwise("SOL_USDT")
    return read(spark, d, "orders").select(hyphenated(raw).alias("symbol"), "o_orderstatus").distinct()


@query("htf_bars", "WITH bars SELECT series, ts_ms // 14400000 AS bucket, arg_min(o, ts_ms) AS o, max(h) AS h, min(l) AS l, arg_max(c, ts_ms) AS c, sum(v) AS v, count(*) AS n_bars FROM bars GROUP BY ALL")
def _(spark, d):
    return htf.buckets(hourly(spark, d), H4)


@query(
    "htf_resample",
    """WITH bars, e AS (SELECT *, CASE WHEN bar_idx = 0 THEN c WHEN ts_ms // 14400000 <> lag(ts_ms // 14400000) OVER w THEN lag(c) OVER w END AS e FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_idx))
    SELECT series, bar_idx, last_value(e IGNORE NULLS) OVER (PARTITION BY series ORDER BY bar_idx) AS htf FROM e""",
)
def _(spark, d):
    return htf.resample(hourly(spark, d), H4).select("series", "bar_idx", "htf")


@query(
    "htf_last_completed",
    """WITH bars, k AS (SELECT series, ts_ms // 14400000 AS bucket, max(h) AS h, arg_max(c, ts_ms) AS c FROM bars GROUP BY ALL),
    p AS (SELECT series, bucket, lag(h) OVER w AS htf_h, lag(c) OVER w AS htf_c FROM k WINDOW w AS (PARTITION BY series ORDER BY bucket))
    SELECT b.series, b.bar_idx, p.htf_h, p.htf_c FROM bars b JOIN p ON p.series = b.series AND p.bucket = b.ts_ms // 14400000""",
)
def _(spark, d):
    b = hourly(spark, d)
    return htf.last_completed(b, htf.buckets(b, H4), H4, ["h", "c"]).select("series", "bar_idx", "htf_h", "htf_c")


FINE = """f AS (SELECT event_type AS series, epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS ts_ms, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c, count(*)::DOUBLE AS v
 FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts))"""


def fine(spark, d):
    return B.candles(read(spark, d, "events"), 300)


@query("detail_bar_map", f"WITH bars, {FINE} SELECT f.series, f.ts_ms, b.bar_idx, f.c FROM f JOIN bars b ON b.series = f.series AND f.ts_ms >= b.ts_ms AND f.ts_ms < b.ts_ms + 3600000")
def _(spark, d):
    return htf.detail_index(hourly(spark, d), fine(spark, d), HOUR).select("series", "ts_ms", "bar_idx", "c")


IRREGULAR = "ir AS (SELECT series, ts_ms, (row_number() OVER (PARTITION BY series ORDER BY ts_ms) - 1)::BIGINT AS bar_idx FROM bars WHERE c > o OR bar_idx = 0)"


@query(
    "detail_interval",
    f"""WITH bars, {FINE}, {IRREGULAR}, nx AS (SELECT *, coalesce(lead(ts_ms) OVER (PARTITION BY series ORDER BY ts_ms), ts_ms + 3600000) AS until FROM ir)
    SELECT f.series, f.ts_ms, b.bar_idx, f.c FROM f JOIN nx b ON b.series = f.series AND f.ts_ms >= b.ts_ms AND f.ts_ms < b.until""",
)
def _(spark, d):
    """Five-minute bars in bars that open at rising hours only, so that they last from one to many hours."""
    rising = B.indexed(hourly(spark, d).filter("c > o or bar_idx = 0").drop("bar_idx"))
    return htf.detail_in(rising, fine(spark, d), HOUR, 48 * HOUR * 1000).select("series", "ts_ms", "bar_idx", "c")


@query(
    "partial_bar_ohlc",
    f"""WITH bars, {FINE}, j AS (SELECT f.*, b.bar_idx FROM f JOIN bars b ON b.series = f.series AND b.ts_ms = f.ts_ms // 3600000 * 3600000)
    SELECT series, bar_idx, ts_ms, first_value(o) OVER w AS po, max(h) OVER w AS ph, min(l) OVER w AS pl, c AS pc, sum(v) OVER w AS pv FROM j WINDOW w AS (PARTITION BY series, bar_idx ORDER BY ts_ms)""",
)
def _(spark, d):
    return htf.partial_bars(htf.detail_index(hourly(spark, d), fine(spark, d), HOUR))


@query(
    "as_of_join",
    "WITH bars, e AS (SELECT event_id, event_type AS series, epoch_ms(ts) AS ms FROM events) SELECT e.event_id, b.c AS asof_c FROM e ASOF LEFT JOIN bars b ON e.series = b.series AND e.ms >= b.ts_ms",
)
def _(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("series"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return htf.as_of(e, hourly(spark, d).select("series", "ts_ms", "c"), ["c"]).select("event_id", "asof_c")


@query("stream_candles", "WITH bars SELECT series, ts_ms, o, h, l, c, v FROM bars")
def _(spark, d):
    """The stream's definition over a bounded table; tests run it as a stream."""
    from tidelane.streaming.candles import candles

    return candles(read(spark, d, "events"), HOUR)


@query(
    "stream_sessions",
    """WITH e AS (SELECT *, event_type AS series, coalesce((ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 1) AS new FROM events),
    k AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY ts, event_id) AS s FROM e)
    SELECT series, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 30 MINUTE) // 1000 AS end_ms, count(*) AS n, round(sum(value), 6) AS total FROM k GROUP BY series, s""",
)
def _(spark, d):
    from tidelane.streaming.candles import sessions

    return rounded(sessions(read(spark, d, "events")))
