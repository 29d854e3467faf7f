"""Harmonic packing of tokenized documents into sequences.

A document's tokens are cut into whole sequences and a rest. The rest is cut at reciprocal sizes capacity/j until what is
left wastes little in its class; class j holds pieces of at most capacity/j tokens, j of them to a sequence. Cutting needs
no other document. The pieces of a class are numbered from counts per shard, so every shard fills its sequences by itself
and sequences are complete but for one of each class; the pieces of those few, fewer than the classes' sum, are packed
together.
"""

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, released
from .token_count import BLOCK_CHARS, _loaded, pretokens, split_special

#: Classes: the documents a sequence takes. Above 32 pieces are so small that coarser steps waste little.
CLASSES = (*range(1, 33), 40, 48, 64, 96, 128, 256, 512, 1024, 2048)
SLACK = 12
SHARD_PIECES = 200_000  # pieces of a class that one task numbers
BROADCAST_SHARDS = 10_000
MEMO = 500_000


@cache
def _tokenizer(path: str):
    """The library's tokenizer, its special strings, a quick encoder of pretokens or None, and the pretokens met before.

    Where the merges stand in the order of their ids, a pretoken's ids are those of rank-ordered merging with the same
    vocabulary, which is quicker; other files go through the library whole.
    """
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    specials = tuple(x.content for x in t.get_added_tokens_decoder().values())
    try:
        merger, _ = _loaded.__wrapped__(path)  # not kept
    except ValueError:
        return t, specials, None, {}
    in_order = all(merger.ids[a + b] == 256 + k for (a, b), k in merger.rank.items())
    quick = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=merger.ids, special_tokens={}) if in_order else None
    if quick and len(specials) == 1:
        ids = {s: t.token_to_id(s) for s in specials}
        return ids, specials, quick, {}
    return t, specials, None, {}


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit, as the library gives them."""
    t, specials, quick, memo = _tokenizer(path)
    if quick is None:
        return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    joint = b"".join(np.array([t[s]], "<u4").tobytes() for s in specials)
    out = []
    for a, b in blocks([len(x) for x in texts], BLOCK_CHARS):
        split = [split_special(x, specials)[0] for x in texts[a:b]]
        words = pretokens([p for parts in split for p in parts])
        if len(memo) > MEMO:  # short pretokens are the frequent ones
            for w in [w for w in memo if len(w) > 6]:
                del memo[w]
        for w in set().union(*map(set, words)).difference(memo) if words else ():
            ids = quick.encode_ordinary(w)
            memo[w] = struct.pack(f"<{len(ids)}I", *ids)
        words = iter(words)
        out += [joint.join([b"".join(map(memo.__getitem__, next(words))) for _ in parts]) for parts in split]
    return out


def pieces(n: int, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of n tokens."""
    out, start = [], 0
    sizes = [(j, capacity // j) for j in CLASSES if j <= capacity]
    while start < n:
        left = min(n - start, capacity)
        k = max(i for i, (_, size) in enumerate(sizes) if size >= left)
        if sizes[k][1] - left > max(SLACK, left // 64):  # the next class' size fits into what is left
            k += 1
            left = sizes[k][1]
        out.append((start, left, sizes[k][0]))
        start += left
    return out


def cut_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, class of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in blocks([len(x) for x in texts], BLOCK_CHARS):
                for doc, got in zip(ids[a:b], token_ids(texts[a:b], path)):
                    got += end
                    n = len(got) // 4
                    rows += [(doc, s, k, zlib.crc32(got[4 * s : 4 * (s + k)]), n, j) for s, k, j in pieces(n, capacity)]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])
        released(_tokenizer(path)[3])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows with the same doc_id are documents of their own. An empty table gives
    no rows. Other columns are ignored.
    """
    p = cut_documents(docs, path, capacity, end_id)
    p = cut(p.withColumn("dealt", F.xxhash64("doc_id", "start", "ids_crc32")), "pieces")
    # as many shards as the largest class needs, 64 at least: tasks grow with the pieces
    most = p.groupBy("class").count().agg(F.max("count")).first()[0] or 0
    shards = max(64, -(-most // SHARD_PIECES))
    p = p.withColumn("shard", F.pmod("dealt", F.lit(shards))).drop("dealt")
    counts = p.groupBy("class", "shard").count()  # at most classes x shards rows
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"), F.sum("count").over(Window.partitionBy("class")).alias("all"))
    inside = Window.partitionBy("class", "shard").orderBy("doc_id", "start", "length", "ids_crc32")
    p = p.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(counts) if shards <= BROADCAST_SHARDS else counts, ["class", "shard"])
    p = p.withColumn("at", F.col("at") + F.col("base"))
    full = F.col("at") < F.col("all") - F.col("all") % F.col("class")
    whole = p.filter(full).withColumn("sequence_id", F.floor(F.col("at") / F.col("class")) * 4096 + F.col("class"))
    # fewer rows than the sum of all classes, whatever the input
    rest = p.filter(~full).groupBy().applyInPandas(lambda x: _fit_rest(x, capacity), p.withColumn("sequence_id", F.lit(0).cast("long")).schema)
    slot = Window.partitionBy("sequence_id").orderBy("at", "class").rowsBetween(Window.unboundedPreceding, -1)
    done = whole.unionByName(rest).withColumn("offset", F.coalesce(F.sum("length").over(slot), F.lit(0)))
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _fit_rest(x: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """First fit by falling length for the pieces of incomplete sequences; ids end in 0 classes, which no other has."""
    room: list[int] = []
    out = []
    x = x.sort_values(["length", "doc_id", "start", "at"], ascending=[False, True, True, True])
    for n in x["length"]:
        k = next((i for i, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= n
        out.append(k * 4096)
    x["sequence_id"] = out
    x["at"] = range(len(x))
    return x
