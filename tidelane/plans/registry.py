"""The catalogue's registry: a query is a function of (spark, sf_dir), with the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; sql reads the tables as views, and `bars` (see BARS) where it says WITH bars."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace("WITH bars", f"WITH RECURSIVE {BARS}" if "RECURSIVE" in sql else f"WITH {BARS}").replace(" RECURSIVE r", " r")
        return f

    return add


#: Hourly bars of the events, by type.
BARS = """bars AS MATERIALIZED (SELECT event_type AS series, (row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) - 1)::BIGINT AS bar_idx,
 epoch_ms(date_trunc('hour', ts)) AS ts_ms, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c, count(*)::DOUBLE AS v
 FROM events GROUP BY event_type, date_trunc('hour', ts))"""
HOUR = 3600


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark, sf_dir: str):
    """Hourly bars of the events, indexed."""
    from tidelane.operators import bars

    return bars.indexed(bars.candles(read(spark, sf_dir, "events"), HOUR))


def rounded(df, *columns: str):
    """df with its double columns rounded to six places."""
    from pyspark.sql import functions as F

    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
