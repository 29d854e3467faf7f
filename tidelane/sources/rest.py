"""Candles over HTTP as a Spark data source: one input partition for each series and time slice.

spark.dataSource.register(CandleSource); spark.read.format("candles").options(exchange=..., symbols="BTCUSDT,ETHUSDT",
tf="1h", start_ms=..., end_ms=..., base=...).load(). `transport` names a function "module:function" that takes a URL and
returns its JSON; the default one uses urllib with retries.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelane.operators.bars import TIME_FRAMES

SCHEMA = "series string, tf string, ts_ms long, o double, h double, l double, c double, v double"

#: Pages and fields of each kind of endpoint.
EXCHANGES = {
    "a": {"path": "/api/v2/mix/market/history-candles", "page": 200, "symbol": "symbol", "tf": "granularity", "end": "endTime", "limit": "limit", "fields": (0, 1, 2, 3, 4, 5), "data": "data", "ok": ("code", "00000")},
    "b": {"path": "/openApi/swap/v3/quote/klines", "page": 1440, "symbol": "symbol", "tf": "interval", "start": "startTime", "end": "endTime", "limit": "limit", "fields": ("time", "open", "high", "low", "close", "volume"), "data": "data", "ok": ("code", 0)},
    "c": {"path": "/fapi/v1/klines", "page": 1000, "symbol": "symbol", "tf": "interval", "start": "startTime", "end": "endTime", "limit": "limit", "fields": (0, 1, 2, 3, 4, 5), "data": None, "ok": None},
}
QUOTES = ("USDT", "BUSD", "BTC", "ETH", "BNB")
#: Perpetuals on stocks; every other symbol is a crypto one.
STOCKS = ("TSLAUSDT", "NVDAUSDT", "AAPLUSDT", "AMZNUSDT", "GOOGLUSDT", "METAUSDT", "MSFTUSDT", "CRCLUSDT", "BAAUSDT", "JPMAUSDT")
#: name, funding hours, maker fee, taker fee, largest leverage.
MARKETS = [("crypto", 8, 0.0002, 0.0006, 125), ("stock", 4, 0.0002, 0.0006, 25)]


def hyphenated(symbol: Column) -> Column:
    """BTCUSDT, btc/usdt or BTC_USDT as BTC-USDT."""
    s = F.translate(F.upper(symbol), "/_", "--")
    return F.when(s.contains("-"), s).otherwise(F.regexp_replace(s, f"^(.+?)({'|'.join(QUOTES)})$", "$1-$2"))


def market(symbol: Column) -> Column:
    return F.when(F.upper(symbol).isin(*STOCKS), "stock").otherwise("crypto")


def fetch(url: str, tries: int = 3) -> object:
    """JSON of a URL; waits longer each time after 429 and errors of the network."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code != 429 or k == tries - 1:
                raise
        except urllib.error.URLError:
            if k == tries - 1:
                raise
        time.sleep(2.0**k)
    return None


def rows(page: object, exchange: str) -> list[tuple]:
    """(ts_ms, o, h, l, c, v) of a page; rows that are no numbers are left out, a page with an error code is empty."""
    how = EXCHANGES[exchange]
    if how["ok"]:
        key, good = how["ok"]
        page = page.get(how["data"]) if isinstance(page, dict) and page.get(key) == good else []
    out = []
    for item in page or []:
        try:
            ts, *prices = (item[f] for f in how["fields"])
            out.append((int(ts), *map(float, prices)))
        except (KeyError, IndexError, TypeError, ValueError):
            continue
    return out


@dataclass
class Slice(InputPartition):
    symbol: str
    start: int
    end: int


class CandleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Slice]:
        step = TIME_FRAMES[self.o["tf"]] * 1000
        span = step * EXCHANGES[self.o["exchange"]]["page"] * int(self.o.get("pages", 50))
        if "ranges" in self.o:  # JSON: symbol, first and last but one time of each
            ranges = json.loads(self.o["ranges"])
        else:
            ranges = [(s.strip(), int(self.o["start_ms"]), int(self.o["end_ms"])) for s in self.o["symbols"].split(",")]
        return [Slice(s, a, min(a + span, end)) for s, start, end in ranges for a in range(start, end, span)]

    def read(self, part: Slice) -> Iterator[tuple]:
        """Pages backward from the slice's end to its start, through gaps of any length.

        With the options rate (requests a second in all) and parallel (tasks that run at once, 8), a task waits between
        its requests for its share of the rate.
        """
        pause, asked_at = int(self.o.get("parallel", 8)) / float(self.o["rate"]) if "rate" in self.o else 0.0, None
        how = EXCHANGES[self.o["exchange"]]
        name, _, function = self.o.get("transport", f"{__name__}:fetch").partition(":")
        get = getattr(importlib.import_module(name), function)
        at, seen = part.end, set()
        while at > part.start:
            if asked_at is not None:
                time.sleep(max(0.0, asked_at + pause - time.monotonic()))
            asked_at = time.monotonic()
            asked = {how["symbol"]: part.symbol, how["tf"]: self.o["tf"], how["end"]: at, how["limit"]: how["page"]}
            if "start" in how:
                asked[how["start"]] = max(part.start, at - TIME_FRAMES[self.o["tf"]] * 1000 * how["page"])
            page = rows(get(f"{self.o.get('base', '')}{how['path']}?{urllib.parse.urlencode(asked)}"), self.o["exchange"])
            fresh = [r for r in page if part.start <= r[0] < part.end and r[0] not in seen]
            seen.update(r[0] for r in fresh)
            for ts, *prices in fresh:
                yield part.symbol, self.o["tf"], ts, *prices
            before = min((r[0] for r in page), default=at)
            at = before if before < at else at - TIME_FRAMES[self.o["tf"]] * 1000 * how["page"]


class CandleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CandleReader:
        return CandleReader(self.options)
