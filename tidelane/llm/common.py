"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


#: Arrow batches to Python hold at most so many rows and bytes: a worker keeps one batch of texts at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH; smaller settings stay."""
    for key, most in BATCH.items():
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return spark


def _bytes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    digits = text.lower().rstrip("b") or "0"
    return int(digits[:-1]) * units[digits[-1]] if digits[-1] in units else int(digits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder."""
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset on one machine.

    On a cluster it must be set: executors would write to their own disks, so that raises an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        at = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidelane-"))
    return at.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read back: later stages start there, whichever executor is lost."""
    spark = bounded(df.sparkSession)
    at = f"{shared_dir(spark)}/tidelane/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def released(*caches: dict) -> None:
    """At the end of a task: empties caches and gives free memory of this worker back, for it lives on through later stages."""
    for c in caches:
        c.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc keeps what is freed
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    for _ in range(2 if jvm is not None else 0):  # the first finds what Python has let go, the second what that held
        time.sleep(0.3)
        jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Deletes the tables that cut() wrote for df, which no later stage reads."""
    spark = df.sparkSession
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{shared_dir(spark).split(':')[-1].lstrip('/')}/tidelane/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores after it while df has such a column (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(id_col, m: int):
    """crc32 of the id as text, modulo m; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % m


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(sizes, most: int):
    """Runs (start, end) of consecutive items whose sizes sum to at most `most`, or one larger item alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: Steps of `least_of_top` for each doubling of a count.
STEPS = 16


def least_of_top(counts: DataFrame, column: str, most: int) -> int:
    """A count that at most `most` rows reach, the least by steps of a sixteenth of a doubling.

    The rows of each step are counted, so some thousand rows come to the driver and no task gathers the top rows.
    """
    step = F.floor(F.log2(F.col(column)) * STEPS).cast("int")
    sizes = dict(counts.groupBy(step.alias("step")).count().collect())
    total, least = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    n = max(0, int(2 ** (least / STEPS)) - 2)
    while np.floor(np.log2(max(n, 1)) * STEPS) < least:
        n += 1
    return n
