"""Quality scores from compression: a zstandard dictionary of good text against one of bad text.

A text that compresses better with the good dictionary is likelier good. The difference of both compressed sizes, divided
by the larger, goes through a logistic curve fitted on labelled rows that neither dictionary has seen.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod

ROWS = 1500  # labelled rows a label gives to its dictionary at most, and as many to the curve
PART_BYTES = 1000  # of a row, for the dictionary
DICT_BYTES = 16 * 1024
LEVEL = 1


class Model:
    """Both dictionaries and the curve; without rows of both labels, the share of label 1 is every score."""

    def __init__(self, parts: dict[int, list[str]], share: float):
        """Dictionaries of the parts of each label; none when a label has fewer than ten."""
        self.share = share
        self.dicts: dict[int, bytes] | None = None
        if min(len(parts[q]) for q in (0, 1)) >= 10:
            self.dicts = {q: self._dictionary([t.encode("utf-8", "surrogatepass")[:PART_BYTES] for t in x]) for q, x in parts.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, totals: dict[int, int]) -> None:
        """The curve through differences x of rows with labels y, a label weighing as its count in totals."""
        weight = np.array([totals[q] / max(1, (y == q).sum()) for q in (0, 1)])[y.astype(int)]
        weight = weight * len(y) / weight.sum()
        self.centre, self.scale = np.average(x, weights=weight), x.std() or 1.0
        x = (x - self.centre) / self.scale
        w = np.zeros(2)
        design = np.stack([np.ones_like(x), x], 1)
        for _ in range(30):  # Newton steps on the penalised likelihood
            p = 1 / (1 + np.exp(-design @ w))
            grad = design.T @ (weight * (y - p)) - 1e-3 * w
            hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            w = w + np.linalg.solve(hess, grad)
        self.weights = w

    @staticmethod
    def _dictionary(parts: list[bytes]) -> bytes:
        import zstandard

        try:
            return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, parts)) // 4 + 256), parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself
            return b"\n".join(parts)[-DICT_BYTES:]

    def differences(self, texts: list[bytes]) -> list[float]:
        """(bytes with the bad dictionary - bytes with the good one) / the larger, of each text."""
        import zstandard

        tools = []
        for q in (0, 1):
            d = zstandard.ZstdCompressionDict(self.dicts[q])
            d.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        out = []
        for t in texts:
            bad, good = (len(c.compress(t)) for c in tools)
            out.append((bad - good) / max(bad, good))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.dicts is None:
            return np.full(len(texts), self.share)
        x = np.array(self.differences([t.encode("utf-8", "surrogatepass") for t in texts]))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * (x - self.centre) / self.scale, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of at most 2 * ROWS rows a label, those with the least hashes of all labelled rows.

    Every other one is for the dictionary, the rest for the curve, whose texts are compressed whole where they lie. Each
    label weighs in the curve as in all labelled rows, which are counted.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    totals = {0: 0, 1: 0} | {r["quality"]: r["count"] for r in texts.select("doc_id").join(one, "doc_id").groupBy("quality").count().collect()}
    picked = None
    for q in (0, 1):
        part = one.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * ROWS)
        picked = part if picked is None else picked.union(part)
    near = texts.join(F.broadcast(picked), "doc_id")  # 4 * ROWS rows at most
    rows = near.select("doc_id", F.substring("text", 1, PART_BYTES).alias("text"), "quality").collect()
    rows = sorted(((r["doc_id"], r["text"], r["quality"]) for r in rows), key=lambda r: (hash_of(r[0]), r[0]))
    parts: dict[int, list[str]] = {0: [], 1: []}
    held = []
    for q in (0, 1):
        ids = list(dict.fromkeys(i for i, _, label in rows if label == q))
        first = set(ids[::2])
        parts[q] = [t for i, t, label in rows if label == q and i in first]
        held += [(i, q) for i in ids[1::2]]
    model = Model(parts, totals[1] / sum(totals.values()) if sum(totals.values()) else 0.5)
    if model.dicts is None or {q for _, q in held} != {0, 1}:
        model.dicts = None
        return model
    curve = docs.sparkSession.createDataFrame(held, "doc_id long, quality int").select(F.col("doc_id").cast(one.schema["doc_id"].dataType), "quality")
    got = texts.join(F.broadcast(curve), "doc_id").select("quality", differing(F.col("text"), model).alias("x")).collect()
    model.fit(np.array([r["x"] for r in got]), np.array([r["quality"] for r in got], float), totals)
    return model


def differing(text: Column, model: Model) -> Column:
    """The difference of both compressed sizes of a text column."""
    held = SparkSession.active().sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    @F.pandas_udf("double")
    def found(s: pd.Series) -> pd.Series:
        return pd.Series(held.value.differences([t.encode("utf-8", "surrogatepass") for t in s]), dtype="float64")

    return found(text)


def hash_of(x: int) -> int:
    return (x * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def quality(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1."""
    held = SparkSession.active().sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(held.value.scores(s.fillna("").tolist()), dtype="float64")

    return scored(text)


def score(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Learned only from labelled rows whose crc32(doc_id) mod 5 is not 0; rows with contradicting labels are not used. Null
    and empty texts get a score like any other text. Whole texts are compressed; other columns are ignored. Repeated rows
    get the same score each, and a repeated labelled row counts as often as it stands. An empty table gives no rows.
    """
    rest = crc_mod(F.col("doc_id"), 5)
    model = learn(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))
    out = docs.select("doc_id", (rest == 0).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
