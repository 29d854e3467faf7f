"""The HTTP source with a transport of its own, the store and the search."""

import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tidelane.operators import bars as B
from tidelane.plans import search
from tidelane.sources import rest, store

STEP = 3_600_000


def pages(url):
    """A server of candles at every hour from 0 to 3000 but for 1000 to 1019."""
    q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items()}
    end, n = int(q["endTime"]), int(q["limit"])
    hours = [h for h in range(3000) if h * STEP < end and not 1000 <= h < 1020 and h * STEP >= int(q.get("startTime", 0))][-n:]
    if "history" in url:
        return {"code": "00000", "data": [[str(h * STEP), "1", "3", "0.5", "2", str(h), "0"] for h in hours] + [["x"]]}
    if "swap" in url:
        return {"code": 0, "data": [{"time": h * STEP, "open": "1", "high": "3", "low": "0.5", "close": "2", "volume": str(h)} for h in hours]}
    return [[h * STEP, "1", "3", "0.5", "2", str(h), 0, 0, 0, 0, 0, 0] for h in hours]


@pytest.mark.parametrize("exchange", ["a", "b", "c"])
def test_pages_are_whole(exchange):
    o = {"exchange": exchange, "symbols": "X,Y", "tf": "1h", "start_ms": str(500 * STEP), "end_ms": str(2500 * STEP), "transport": f"{__name__}:pages", "pages": "3"}
    reader = rest.CandleReader(o)
    import sys

    sys.modules.setdefault(__name__, sys.modules[pages.__module__])
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    want = [(s, h) for s in "XY" for h in range(500, 2500) if not 1000 <= h < 1020]
    assert sorted((r[0], r[2] // STEP) for r in rows) == want and all(r[3:7] == (1.0, 3.0, 0.5, 2.0) for r in rows)


def test_errors_are_empty_pages():
    assert rest.rows({"code": "40001", "data": [[1, 2, 3, 4, 5, 6]]}, "a") == [] and rest.rows({"code": 5}, "b") == []


def test_source_is_registered(spark):
    spark.dataSource.register(rest.CandleSource)
    df = spark.read.format("candles").options(exchange="a", symbols="X", tf="1h", start_ms="0", end_ms="1").load()
    assert df.columns[:3] == ["series", "tf", "ts_ms"]


def test_store_keeps_what_it_has(spark, tmp_path):
    def bars(hours, c):
        return spark.createDataFrame([("a", "S", "1h", h * STEP, c, c, c, c, 1.0) for h in hours], f"exchange string, series string, tf string, {store.BAR}")

    path = f"{tmp_path}/store"
    store.save(bars(range(10), 1.0), path)
    store.save(bars(range(5, 15), 2.0), path)
    got = {r["ts_ms"] // STEP: r["c"] for r in store.load(spark, path, "a", "S", "1h").collect()}
    assert got == {h: 1.0 if h < 10 else 2.0 for h in range(15)}
    assert store.load(spark, path, start_ms=3 * STEP, end_ms=6 * STEP).count() == 4
    assert store.listing(spark, path).first()["n_bars"] == 15


def test_synthetic_bars_are_valid(spark):
    b = store.synthetic(spark, 3, 200)
    v = B.validate(b, 14400).collect()
    assert len(v) == 3 and all(r["valid"] and r["bad_high"] == r["bad_low"] == r["n_gap"] == 0 for r in v)
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, store.synthetic(spark, 3, 200).repartition(5).collect()))


def test_params_json(spark):
    t = spark.createDataFrame([("s", float(k), {"a": str(k)}, {"sharpe": float(k)}) for k in range(20)], "strategy string, score double, params map<string,string>, metrics map<string,double>")
    out = json.loads(store.params_json(t).first()["value"])
    assert out["best_params"] == {"a": "19"} and [x["rank"] for x in out["top_trials"]] == list(range(1, 11))


PARAMS = [search.Param("x", "float", -4, 4, 0.5), search.Param("m", "categorical", options=("a", "b")), search.Param("y", "int", 0, 6, 1, needs=("m", "a"))]


def bowl(trials):
    return [-((t["x"] - 1) ** 2) - (t["y"] - 3) ** 2 * (t["m"] == "a") - 2 * (t["m"] == "b") for t in trials]


@pytest.mark.parametrize("method", [lambda f: search.tpe(f, PARAMS, 80), lambda f: search.genetic(f, PARAMS)])
def test_searches_find_the_top(method):
    asked = []

    def score(trials):
        asked.extend(tuple(sorted(search.active(PARAMS, t).items())) for t in trials)
        return bowl(trials)

    best = method(score)[0]
    assert best[0] >= -0.5 and len(asked) == len(set(asked))


def test_effective_trials():
    assert search.effective_trials(PARAMS) == 17 * (7 + 1)


def test_trials_are_one_job(spark, sf_dir):
    from tidelane.plans.registry import hourly

    b = hourly(spark, sf_dir).filter(F.col("series").isin("click", "view"))
    scores = search.evaluate(b, "cycle_no_htf", [{"confidence_min": 20.0, "min_bars": 3}, {"confidence_min": 101.0}], min_trades=1)
    assert scores[0] != search.metrics.REJECTED and scores[1] == search.metrics.REJECTED


def stored(spark, hours, c, series="S"):
    return spark.createDataFrame([("a", series, "1h", h * STEP, c, c, c, c, 1.0) for h in hours], f"exchange string, series string, tf string, {store.BAR}")


def test_versions_stay_readable(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert store.load(spark, path).count() == 0
    assert store.save(stored(spark, range(3), 1.0), path) == 1
    assert store.save(stored(spark, range(3), 1.0, "T"), path) == 2
    assert store.delete(spark, path, series="S") == 3
    assert [r["series"] for r in store.listing(spark, path).collect()] == ["T"]
    assert store.load(spark, path, version=2).count() == 6
    assert store.delete(spark, path) == 4 and store.load(spark, path).count() == 0
    store.save(stored(spark, range(2), 5.0), path)
    store.clean(spark, path, 1)
    assert store.versions(spark, path) == [5] and store.load(spark, path).count() == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Six writers of overlapping hours of one partition, and of one of their own each."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_path}/store"
    jobs = [stored(spark, range(10 * k, 10 * k + 15), float(k)).union(stored(spark, [k], 1.0, f"own{k}")) for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda d: store.save(d, path), jobs))
    assert sorted(numbers) == list(range(1, 7))
    got = {r["ts_ms"] // STEP: r["c"] for r in store.load(spark, path, series="S").collect()}
    assert sorted(got) == list(range(65))
    assert all(got[h] in {float(k) for k in range(6) if 10 * k <= h < 10 * k + 15} for h in got)
    assert store.listing(spark, path).count() == 7


def test_a_claim_without_a_version_stops_writers(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    store.save(stored(spark, range(2), 1.0), path)
    open(f"{path}/versions/v2.claim", "w").close()
    monkeypatch.setattr(store, "WAIT_S", 0.2)
    with pytest.raises(TimeoutError):
        store.save(stored(spark, range(3), 2.0), path)
    assert store.load(spark, path).count() == 2


def test_get_downloads_what_is_missing(spark, tmp_path, monkeypatch):
    """The server has hours 0 to 2999 without 1000 to 1019; the store has 500 to 599 of X."""
    path = f"{tmp_path}/store"
    store.save(stored(spark, range(500, 600), 9.0, "X"), path)
    module = tmp_path / "paged.py"
    module.write_text(f"import urllib.parse\nSTEP = {STEP}\n\n\ndef asked(url):\n    q = {{k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items()}}\n    end, n = int(q['endTime']), int(q['limit'])\n    hours = [h for h in range(3000) if h * STEP < end and not 1000 <= h < 1020][-n:]\n    return {{'code': '00000', 'data': [[str(h * STEP), '1', '3', '0.5', '2', str(h), '0'] for h in hours]}}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(module))
    got = store.get(spark, path, "a", ["X", "Y"], "1h", 450 * STEP, 1100 * STEP, warm_up=50, transport="paged:asked", rate="1000")
    hours = {s: sorted(r["ts_ms"] // STEP for r in got.filter(F.col("series") == s).collect()) for s in "XY"}
    want = [h for h in range(400, 1101) if not 1000 <= h < 1020]
    assert hours == {"X": want, "Y": want}
    kept = {r["c"] for r in got.filter((F.col("series") == "X") & F.col("ts_ms").between(500 * STEP, 599 * STEP)).collect()}
    assert kept == {9.0} and store.versions(spark, path) == [1, 2]
    store.get(spark, path, "a", ["X"], "1h", 450 * STEP, 1100 * STEP, warm_up=50, transport="nowhere:at_all")
    assert store.versions(spark, path) == [1, 2]


def test_rate_is_kept():
    import time

    o = {"exchange": "a", "symbols": "X", "tf": "1h", "start_ms": "0", "end_ms": str(1000 * STEP), "transport": f"{__name__}:pages", "rate": "40", "parallel": "2"}
    import sys

    sys.modules.setdefault(__name__, sys.modules[pages.__module__])
    reader = rest.CandleReader(o)
    began = time.monotonic()
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 1000
    n = -(-1000 // rest.EXCHANGES["a"]["page"])
    assert time.monotonic() - began >= (n - 1) * 0.05
