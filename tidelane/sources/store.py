"""The candle store: Parquet by exchange, symbol and time frame under a manifest of versions, and the sinks of results.

A version is a file that names, for each exchange, symbol and time frame, the folder with its bars; folders are never
written again. A writer merges what it has with the newest version's bars into new folders, claims the next version's
number, which one writer alone can, and puts its file there under that name at once. Where another was quicker, it goes on
from the other's version: partitions that both wrote are merged anew. Readers see whole versions, old ones as well.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import bars as B

PARTITIONS = ("exchange", "series", "tf")
BAR = "ts_ms long, o double, h double, l double, c double, v double"
COLUMNS = [*PARTITIONS, *(c.split()[0] for c in BAR.split(", "))]
SCHEMA = f"exchange string, series string, tf string, {BAR}"
SPAN_MS = 90 * 86_400_000  # bars of a partition that one file holds
WAIT_S = 60.0  # for the file of a version that another writer has claimed


class _Files:
    """The few calls to the store's file system, whichever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark._jvm
        self.fs = self._of("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._of(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._of(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes beside and renames, so that the name has all of the text or is not there."""
        beside = self._of(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(beside, self._of(name)):
            raise OSError(f"{name}: could not be put in place")

    def claim(self, name: str) -> bool:
        """Creates an empty file that is not there; false if it is."""
        at = self._of(name)
        self.fs.mkdirs(at.getParent())
        if self.fs.getUri().getScheme() == "file":  # Hadoop's own check is not atomic there
            try:
                os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        from py4j.protocol import Py4JJavaError

        with contextlib.suppress(Py4JJavaError):
            self.fs.create(at, False).close()
            return True
        if self.fs.exists(at):
            return False
        raise OSError(f"{name}: can not be created")

    def delete(self, name: str) -> None:
        self.fs.delete(self._of(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole, oldest first."""
    return sorted(int(n[1:-5]) for n in _Files(spark, path).names("versions") if n.startswith("v") and n.endswith(".json"))


def _manifest(files: _Files, version: int | None) -> dict[str, dict]:
    return json.loads(files.text(f"versions/v{version}.json")) if version else {}


def _key(*parts: str) -> str:
    return hashlib.sha1("\x01".join(parts).encode()).hexdigest()


def load(spark: SparkSession, path: str, exchange: str | None = None, series: str | None = None, tf: str | None = None, start_ms: int | None = None, end_ms: int | None = None, version: int | None = None) -> DataFrame:
    """Stored bars of the newest version, or of another; the names choose folders and the times (both ends included) reach
    the files."""
    there = versions(spark, path)
    return _bars(spark, path, _manifest(_Files(spark, path), version or max(there, default=None)), (exchange, series, tf), start_ms, end_ms)


def _bars(spark: SparkSession, path: str, manifest: dict, chosen: tuple = (None, None, None), start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    folders = [f"{path.rstrip('/')}/{x['at']}" for x in manifest.values() if all(v is None or x[c] == v for c, v in zip(PARTITIONS, chosen))]
    df = spark.read.schema(SCHEMA).parquet(*sorted(folders)) if folders else spark.createDataFrame([], SCHEMA)
    if start_ms is not None:
        df = df.filter(F.col("ts_ms") >= start_ms)
    return df if end_ms is None else df.filter(F.col("ts_ms") <= end_ms)


def _commit(spark: SparkSession, path: str, change) -> int:
    """The number of the version that change(manifest before, its number) makes; change runs again after another writer's."""
    files = _Files(spark, path)
    while True:
        last = max(versions(spark, path), default=None)
        new = change(_manifest(files, last), last)
        number = (last or 0) + 1
        if files.claim(f"versions/v{number}.claim"):
            files.put(f"versions/v{number}.json", json.dumps(new, sort_keys=True))
            return number
        until = time.monotonic() + WAIT_S
        while number not in versions(spark, path):
            if time.monotonic() > until:
                raise TimeoutError(f"{path}: version {number} is claimed by a writer that has not written it; if that one is gone, delete versions/v{number}.claim")
            time.sleep(0.05)


def save(new: DataFrame, path: str) -> int:
    """Merges bars (with PARTITIONS) into the store, stored bars win, and returns the version's number.

    Only the partitions that new has are written, each in files of SPAN_MS of time, whoever else writes meanwhile.
    """
    spark = new.sparkSession
    new = new.select(*COLUMNS)
    touched = {_key(*r): dict(zip(PARTITIONS, r)) for r in new.select(*PARTITIONS).distinct().collect()}
    seen: dict[str, dict] = {}  # what stood under the touched keys when they were merged, and what came of it
    key = F.concat_ws("\x01", *PARTITIONS)

    def change(before: dict, _) -> dict:
        stale = {k for k in touched if k not in seen or seen[k]["before"] != before.get(k)}
        if stale:
            at = f"bars/{uuid.uuid4().hex}"
            mine = new.withColumn("p", F.sha1(key)).filter(F.col("p").isin(sorted(stale)))
            old = _bars(spark, path, {k: before[k] for k in stale if k in before}).withColumn("p", F.sha1(key))
            tag = lambda d: d.withColumn("name", F.col("series")).withColumn("series", F.col("p"))
            merged = B.merge(tag(old), tag(mine)).withColumn("series", F.col("name")).drop("name")
            merged = merged.repartition("p", F.floor(F.col("ts_ms") / SPAN_MS)).sortWithinPartitions("p", "ts_ms")
            merged.write.partitionBy("p").parquet(f"{path.rstrip('/')}/{at}")
            seen.update({k: {"before": before.get(k), "now": {**touched[k], "at": f"{at}/p={k}"}} for k in stale})
        return before | {k: seen[k]["now"] for k in touched}

    return _commit(spark, path, change)


def delete(spark: SparkSession, path: str, exchange: str | None = None, series: str | None = None, tf: str | None = None) -> int:
    """A version without the partitions named; without names, without all. Older versions keep them."""
    gone = lambda x: all(v is None or x[c] == v for c, v in zip(PARTITIONS, (exchange, series, tf)))
    return _commit(spark, path, lambda before, _: {k: x for k, x in before.items() if not gone(x)})


def clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes versions before the newest `keep`, and folders that none of those names. No writer may be at work."""
    files, there = _Files(spark, path), versions(spark, path)
    named = {x["at"].split("/")[1] for v in there[-keep:] for x in _manifest(files, v).values()}
    for v in there[:-keep]:
        files.delete(f"versions/v{v}.json")
    for folder in files.names("bars"):
        if folder not in named:
            files.delete(f"bars/{folder}")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Stored series with bars and span."""
    return load(spark, path).groupBy(*PARTITIONS).agg(F.count("*").alias("n_bars"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def get(spark: SparkSession, path: str, exchange: str, symbols: list[str], tf: str, start_ms: int, end_ms: int, warm_up: int = 300, **options) -> DataFrame:
    """Stored bars of the symbols from `warm_up` bars before start_ms to end_ms; what the store lacks before its first and
    after its last bar is downloaded and merged in first. options: those of the candle source (transport, rate, ...)."""
    from .rest import CandleSource

    seconds = B.TIME_FRAMES[tf]
    wanted = spark.createDataFrame([(s, start_ms, end_ms) for s in symbols], "series string, start_ms long, end_ms long")
    held = load(spark, path, exchange, None, tf)
    missing = B.missing_ranges(held, wanted, seconds, warm_up).filter("from_ms <= to_ms").collect()  # two a symbol at most
    if missing:
        spark.dataSource.register(CandleSource)
        ranges = json.dumps([(m.series, m.from_ms, m.to_ms + 1) for m in missing])
        fresh = spark.read.format("candles").options(exchange=exchange, tf=tf, ranges=ranges, **options).load()
        fresh = fresh.select(F.lit(exchange).alias("exchange"), "series", "tf", *COLUMNS[3:])
        if not (fresh := _kept(fresh)).isEmpty():
            save(fresh, path)
    return load(spark, path, exchange, None, tf, start_ms - warm_up * seconds * 1000, end_ms).filter(F.col("series").isin(symbols))


def _kept(df: DataFrame) -> DataFrame:
    """df computed once: a download is not asked for again by the steps that follow."""
    from tidelane.operators.tables import held

    return held(df)


def synthetic(spark: SparkSession, series: int, n: int, seconds: int = 14400, start: float = 50000.0, volatility: float = 0.02, seed: int = 42) -> DataFrame:
    """Random bars: geometric steps with a drift that changes its sign, open at the last close, rare volume spikes.

    Every number is a hash of series and position, so a lost partition comes back the same.
    """
    from pyspark.sql import Window

    u = lambda tag: (F.pmod(F.xxhash64("series", "bar_idx", F.lit(seed), F.lit(tag)), F.lit(2**40)) + 0.5) / 2.0**40
    normal = lambda tag: F.sqrt(-2 * F.log(u(f"{tag}a"))) * F.cos(2 * 3.141592653589793 * u(f"{tag}b"))
    b = spark.range(series * n).select(F.concat(F.lit("s"), F.floor(F.col("id") / n)).alias("series"), (F.col("id") % n).alias("bar_idx"))
    drift = F.when(F.floor(F.col("bar_idx") / 125) % 2 == 0, 0.001).otherwise(-0.001)
    w = Window.partitionBy("series").orderBy("bar_idx")
    b = b.withColumn("ts_ms", F.lit(1_672_531_200_000) + F.col("bar_idx") * seconds * 1000).withColumn("r", normal("r") * volatility + drift)
    b = b.withColumn("c", start * F.exp(F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("o", F.coalesce(F.lag("c").over(w), F.lit(start)))
    b = b.withColumn("h", F.greatest("o", "c") * (1 + F.abs(normal("h")) * volatility * 0.3)).withColumn("l", F.least("o", "c") * (1 - F.abs(normal("l")) * volatility * 0.3))
    volume = (1000 - 500 * F.log(u("v"))) * F.when(u("s") < 0.05, 3 + 5 * u("x")).otherwise(1.0)
    return b.withColumn("v", volume).withColumn("turnover", F.col("v") * F.col("c")).drop("r")


def params_json(trials: DataFrame, top: int = 10) -> DataFrame:
    """One JSON row a strategy (strategy, score, params map, metrics map): the best parameters and the top trials."""
    from pyspark.sql import Window

    t = trials.withColumn("rank", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("score")))).filter(F.col("rank") <= top)
    # maps have no order, their entries have
    each = F.struct("rank", F.map_entries("params").alias("p"), F.map_entries("metrics").alias("m"))
    back = lambda x: F.struct(x["rank"].alias("rank"), F.map_from_entries(x["p"]).alias("params"), F.map_from_entries(x["m"]).alias("metrics"))
    g = t.groupBy("strategy").agg(F.min_by("params", "rank").alias("best_params"), F.min_by("metrics", "rank").alias("metrics"), F.transform(F.sort_array(F.collect_list(each)), back).alias("top_trials"))  # `top` rows a strategy
    return g.select("strategy", F.to_json(F.struct("strategy", "best_params", "metrics", "top_trials")).alias("value"))


def write_report(trades: DataFrame, equity: DataFrame, path: str) -> None:
    """Trades and equity as CSV folders."""
    trades.write.mode("overwrite").option("header", True).csv(f"{path}/trades")
    equity.write.mode("overwrite").option("header", True).csv(f"{path}/equity")
