"""Language-model scores of whole documents: a gated recurrent network with a class-factored softmax, beside unigrams.

Words are counted over all documents that are learned from. The most frequent are symbols of the network; any other word is
in a class by its last two bytes, which the network predicts, and its share of the class is that of its count. So every
count of the corpus has its part in a score, and unknown words have one too.

Training is by rounds over all those documents, each document in one round: tasks start from the same weights, each passes
over its documents, and the mean of their weights, by the symbols that they read, starts the next round. Rounds grow, so
that tasks part from each other little while the network still changes much.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, crc_mod, cut, least_of_top
from .recurrent import F32, WORDS, Network, score, train

FREQUENT = 512  # words that are symbols
OTHER = 16  # classes of other words
KNOWN = 150_000  # words whose counts each task knows; those of others come by a join
KNOWN_BYTES = 64  # of longer words none is among them
ROUNDS = (1, 2, 4, 9)  # sixteenths of the documents
PENDING = 300_000  # words that a task counts before it hands them on
BLOCK_CHARS = 4_000_000
BLOCK_SYMBOLS = 4_000_000
PARTS = 16  # of the weights, each averaged by itself
END = b""


def words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary; END once a text), n over all rows of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(words(text))
                seen[END] += 1
                if len(seen) > PENDING:
                    yield counted(seen)
                    seen.clear()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What tasks know of the counts: the KNOWN most frequent words, and sizes of classes of other words."""

    known: bytes  # the words, by falling count, with a blank after each
    counts: np.ndarray
    frequent: int
    endings: tuple[bytes, ...]  # of classes; all other words are in a last one
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, known: int = KNOWN) -> Vocabulary:
        """At most `known` words and 65,793 endings come to the driver, whatever the corpus."""
        tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        short = counts.filter(F.length("word") <= KNOWN_BYTES)
        top = sorted(short.filter(F.col("n") >= least_of_top(short, "n", known)).collect(), key=lambda r: (-r.n, bytes(r.word)))
        frequent = min(FREQUENT, len(top) // WORDS * WORDS)
        size = {bytes(e): [n, v] for e, n, v in counts.groupBy(F.substring("word", -2, 2).alias("e")).agg(F.sum("n"), F.count("*")).collect()}
        for w, n in top[:frequent]:
            size[bytes(w)[-2:]][0] -= n
            size[bytes(w)[-2:]][1] -= 1
        endings = sorted(size, key=lambda e: (-size[e][0], e))[: OTHER - 1]
        rest = [size[e] for e in size if e not in set(endings)]
        sizes = [size[e] for e in endings] + [[0, 0]] * (OTHER - 1 - len(endings)) + [[sum(x[0] for x in rest), sum(x[1] for x in rest)]]
        return cls(b"".join(bytes(w) + b" " for w, _ in top), np.array([n for _, n in top], np.int64), frequent, tuple(endings), tokens, distinct, *np.array(sizes, np.int64).T)

    def network(self) -> Network:
        return Network.fresh(np.concatenate([self.counts[: self.frequent], self.class_tokens]), OTHER)

    @property
    def class_log(self) -> np.ndarray:
        """log10 of the tokens of each class of other words, one more for each of its words and for those never seen."""
        return np.log10(self.class_tokens + self.class_words + 1)


@cache
def _index(known: bytes) -> dict[bytes, int]:
    return {w: k for k, w in enumerate(known.split(b" ")[:-1])}


def symbols(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, held_out, turn (0 to 15, by the text) and of each text: n_tokens; symbols (16-bit); seen (tokens of known
    words), base (log10 of their counts and one), rest (log10 shares of known words in their classes, and sizes of the
    classes of all others); far and times: the words that tasks do not know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ends = _index(v.known), {e: k for k, e in enumerate(v.endings)}
        log_count = np.append(np.log10(v.counts + 1), 0.0)
        kind = np.array([ends.get(w[-2:], OTHER - 1) for w in index], np.int64)  # class of each known word
        symbol = np.append(np.where(np.arange(len(kind)) < v.frequent, np.arange(len(kind)), v.frequent + kind), 0)
        share = np.append(np.where(np.arange(len(kind)) < v.frequent, 0.0, log_count[:-1] - v.class_log[kind]), 0.0)
        get, ending = index.get, ends.get
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in blocks([len(x or "") for x in texts], BLOCK_CHARS):
                each = [words(x) for x in texts[start:end]]
                for w in each:
                    w.append(END)
                sizes = np.array([len(w) for w in each], np.int64)
                flat = [w for own in each for w in own]
                at = np.array([get(w, -1) for w in flat], np.int64)
                syms, rest = symbol[at], share[at]
                far = np.flatnonzero(at < 0)
                classes = np.array([ending(flat[i][-2:], OTHER - 1) for i in far.tolist()], np.int64)
                syms[far], rest[far] = v.frequent + classes, -v.class_log[classes]
                owner = np.repeat(np.arange(len(each)), sizes)
                lost: list[Counter] = [Counter() for _ in each]
                for d, i in zip(owner[far].tolist(), far.tolist()):
                    lost[d][flat[i]] += 1
                cuts = np.cumsum([0, *map(len, lost)], dtype=np.int32)
                total = lambda x: pa.array(np.bincount(owner, x, len(each)))  # noqa: E731, B023
                raw, ends_at = syms.astype("<i2").tobytes(), np.cumsum(sizes).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c)[start:end] for c in ("doc_id", "held_out", "turn")),
                        pa.array(sizes),
                        pa.array([raw[2 * (b - n) : 2 * b] for b, n in zip(ends_at, sizes.tolist())], pa.binary()),
                        pa.array(np.bincount(owner, at >= 0, len(each)).astype(np.int64)),
                        total(log_count[at]),
                        total(rest),
                        pa.ListArray.from_arrays(cuts, pa.array([w for c in lost for w in c], pa.binary())),
                        pa.ListArray.from_arrays(cuts, pa.array([n for c in lost for n in c.values()], pa.int64())),
                    ],
                    ["doc_id", "held_out", "turn", "n_tokens", "symbols", "seen", "base", "rest", "far", "times"],
                )

    schema = "doc_id long, held_out boolean, turn int, n_tokens long, symbols binary, seen long, base double, rest double, far array<binary>, times array<long>"
    text = F.col("text").cast("string")
    turn = F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(16)).cast("int").alias("turn")
    return docs.select("doc_id", "held_out", turn, text.alias("text")).mapInArrow(run, schema)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows and their symbols, some BLOCK_SYMBOLS at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column("symbols").nbytes // 2
        if n >= BLOCK_SYMBOLS:
            yield _block(held)
            held, n = [], 0
    if held:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[np.ndarray]]:
    table = pa.Table.from_batches(held)
    return table.drop_columns("symbols"), [np.frombuffer(x.as_py(), "<i2") for x in table.column("symbols")]


def trained(rows: DataFrame, v: Vocabulary) -> Network:
    """The network after all rounds over the rows (symbols, turn)"""
    net, squares, first = v.network(), None, 0
    squares = np.full(len(net.flat), 1e-4, F32)
    for share in ROUNDS:
        start, last = (net.flat.copy(), squares.copy()), first + share

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, squares, n = Network(v.frequent, OTHER, start[0].copy()), start[1].copy(), 0
            for _, documents in _in_blocks(batches):
                n += train(own, squares, documents)
            if n:
                both = zip(np.array_split(own.flat, PARTS), np.array_split(squares, PARTS))
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([float(n)] * PARTS), pa.array([(np.concatenate(x).astype(float) * n).tobytes() for x in both], pa.binary())], ["part", "n", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of a task's parts; rows pass one by one."""
            sums: dict[int, list] = {}
            for batch in batches:
                for part, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                    at = sums.setdefault(part, [0.0, 0.0])
                    at[0], at[1] = at[0] + n, at[1] + np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.float64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], ["part", "n", "sums"])

        schema = "part int, n double, sums binary"
        mine = rows.filter((F.col("turn") >= first) & (F.col("turn") < last)).select("symbols").mapInArrow(run, schema)
        means = sorted(mine.repartition(PARTS, "part").mapInArrow(added, schema).collect())  # PARTS rows
        if means:
            halves = [np.split(np.frombuffer(x.sums) / x.n, 2) for x in means]
            net.flat[:] = np.concatenate([a for a, _ in halves])
            squares = np.concatenate([b for _, b in halves]).astype(F32)
        first = last
    return net


def scored(rows: DataFrame, net: Network) -> DataFrame:
    """rows without symbols, with net: the natural log probability of the symbols."""
    flat, frequent = net.flat.copy(), net.frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(frequent, OTHER, flat)
        for table, documents in _in_blocks(batches):
            yield from table.append_column("net", pa.array(score(own, documents))).to_batches()

    kept = [c for c in rows.columns if c != "symbols"]
    schema = rows.select(*kept, F.lit(0.0).alias("net")).schema
    return rows.select(*kept, "symbols").mapInArrow(run, schema)


def language_model(docs: DataFrame, held_out: Column, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row, learned from rows not held out.

    A null or empty text is its end alone. Rows that repeat a doc_id stand for themselves and are learned from each. Other
    columns are ignored. Where nothing is learned from, every token has the same class-wise chance and base_score is 0. An
    empty table gives no rows.
    """
    bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    counts = cut(word_counts(docs.filter(~F.col("held_out"))), "word-counts")
    v = Vocabulary.of(counts, known)
    rows = cut(symbols(docs, v).withColumn("row", F.monotonically_increasing_id()), "symbols")
    net = trained(rows.filter(~F.col("held_out")), v)
    far = rows.select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("word"), F.col("x.times").alias("times"))
    sums = far.join(counts, "word").groupBy("row").agg(F.sum("times").alias("far_seen"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("far_log"))
    out = scored(rows.drop("far", "times", "turn"), net).join(sums, "row", "left").fillna(0, ["far_seen", "far_log"])
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + F.col("far_seen")).alias("n_known"),
        F.lit(int(v.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("far_log") - F.col("n_tokens") * float(np.log10(v.tokens + v.distinct + 1))).alias("base_score"),
        (F.col("net") / float(np.log(10)) + F.col("rest") + F.col("far_log")).alias("score"),
    )


def in_seventh(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 modulo 7."""
    return crc_mod(doc_id, 7) == 2
