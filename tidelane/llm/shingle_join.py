"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

1. A document becomes the sorted array of its shingle hashes. Documents with equal sets share one representative.
2. Within octaves of set size the hash space is cut into parts; parts that two sets share entirely are candidate keys.
   Two sets with a Jaccard index of at least the threshold differ in few elements, so each of their KEYS parts is equal
   with a chance of at least about 0.27 at 0.85 and 0.19 at 0.8: at the threshold itself a pair is missed with a chance of
   about 2e-8 and 4e-6, above it far less. Small sets use the exact prefix filter. Sets near the upper end of an octave take part in the next one as well.
3. Key-sharing sets form clusters (connected by a star at each key's least member, never by pairs). Clusters are dealt
   into blocks by size band; tiles are pairs of blocks whose sizes allow a link.
4. In a tile the bits that one signature has and the other lacks bound the overlap from above; what passes is intersected
   exactly. Sets that a tile has connected already are not compared again. Only connecting links leave a tile.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, forget, mix, released
from .graph import components

KEYS = 64
LEAST_PART = 4  # elements of a part that may be a key
SMALL = 32  # sets below this use the prefix filter
BLOCK_ROWS, BLOCK_SHINGLES = 400, 400_000
MEMO = 300_000  # word hashes kept in a worker
_MEMO: dict[bytes, int] = {}
_U = np.uint64


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: A-Z lowered, words between ASCII blanks."""
    import xxhash

    if len(_MEMO) > MEMO:
        _MEMO.clear()
    out = []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            out.append(np.zeros(0, _U))
            continue
        try:
            got = [_MEMO[w] for w in words]
        except KeyError:
            for w in set(words).difference(_MEMO):
                _MEMO[w] = xxhash.xxh3_64_intdigest(w)
            got = [_MEMO[w] for w in words]
        h = np.array(got, _U)
        k = min(width, len(h))
        n = len(h) - k + 1
        run = np.full(n, k, _U)
        for i in range(k):
            run = run * _U(0x9E3779B97F4A7C15) + h[i : i + n]
        out.append(np.unique(mix(run)))
    return out


def candidate_keys(s: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of a set; see the module's text."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    keys = []
    if n < SMALL:
        keys.append(mix(s[: n - math.ceil(threshold * n - 1e-9) + 1] + _U(1)))
    octaves = [n.bit_length() - 1]
    if n >= math.floor(threshold * (2 << octaves[0])):
        octaves.append(octaves[0] + 1)
    for j in octaves:
        if (1 << j) < SMALL:
            continue
        bits = j - 2
        for family in range(max(1, KEYS >> bits)):
            h = s if not family else np.sort(mix(s + _U(family * 0x51ED270B)))
            part = (h >> _U(64 - bits)).astype(np.int64)
            part = part[: np.searchsorted(part, KEYS)]
            if not len(part):
                continue
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            size = np.diff(np.r_[first, len(part)])
            total = np.add.reduceat(mix(h[: len(part)] ^ _U(0xA5A5A5A5)), first)
            key = mix(total + part[first].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(j * 1000 + family))
            keys.append(key[size >= LEAST_PART])
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.zeros(0, np.int64)


def describe(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, set_id (null if empty), keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in blocks([len(t or "") for t in texts], 4_000_000):
                sets = shingle_sets(texts[a:b], width)
                names = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                columns = [ids[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array([candidate_keys(s, threshold) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "keys"])
        released(_MEMO)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id long, keys array<long>")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of all sets, of a width that suits the largest: bit h mod width for each element."""
    bits = 1 << min(15, max(9, int(2 * max(map(len, sets))).bit_length()))
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for k, s in enumerate(sets):
        at = (s & _U(bits - 1)).astype(np.int64)
        row = np.zeros(bits, bool)
        row[at] = True
        out[k] = np.packbits(row)
    return out.view(_U)


def tile_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a tile: 100 * |A and B| >= percent * |A or B|.

    side: which block a set is from; 0 and 1 are compared with each other, 2 (both) also within.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets, side = ids[order], [sets[i] for i in order], side[order]
    size = np.array([len(s) for s in sets])
    maps = signatures(sets)
    parent = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        # |B| <= |A| * 100 / percent is the last size that can link
        end = np.searchsorted(size, size[i] * 100 // percent, side="right")
        if end <= i + 1:
            continue
        near = slice(i + 1, end)
        open_ = (parent[near] != parent[i]) & ((side[near] != side[i]) | (side[i] == 2))
        at = np.flatnonzero(open_) + i + 1
        if not len(at):
            continue
        lacking = np.bitwise_count(maps[i] & ~maps[at]).sum(1, dtype=np.int64)
        most = size[i] - lacking  # of common elements
        at = at[(100 + percent) * most >= percent * (size[i] + size[at])]
        for k in at:
            if parent[k] == parent[i]:
                continue
            where = np.searchsorted(sets[k], sets[i])
            where[where == len(sets[k])] = 0
            common = int((sets[k][where] == sets[i]).sum())
            if (100 + percent) * common >= percent * (size[i] + size[k]):
                out.append((int(ids[i]), int(ids[k])))
                parent[parent == parent[k]] = parent[i]
    return out


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """members (set_id, n_shingles, cluster) dealt to tiles: tile (a struct as string) and side are added."""
    step = math.log(100 / min(percent, 80)) + 1e-9  # sets that link lie in one band or in neighbours
    m = members.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(step)))
    per_band = m.groupBy("cluster", "band").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("size"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("long")
    per_band = per_band.withColumn("parts", parts)
    whole = per_band.groupBy("cluster").agg((F.sum("rows") <= BLOCK_ROWS).alias("a"), (F.sum("size") <= BLOCK_SHINGLES).alias("b"), F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("of"))
    m = m.join(whole, "cluster")
    own = F.coalesce(F.col("of")[F.col("band")], F.lit(1))
    mine = F.pmod(F.xxhash64("set_id"), own)
    up = F.coalesce(F.col("of")[F.col("band") + 1], F.lit(0))
    down = F.coalesce(F.col("of")[F.col("band") - 1], F.lit(0))

    def tile(band, low, high, side):
        return F.struct(F.concat_ws(":", band, low, high).alias("tile"), side.cast("int").alias("side"))

    def each(n, f):
        return F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")), f)

    inside = each(own, lambda k: tile(F.concat(F.lit("i"), F.col("band")), F.least(k, mine), F.greatest(k, mine), F.when(k == mine, 2).when(k > mine, 0).otherwise(1)))
    above = each(up, lambda k: tile(F.concat(F.lit("u"), F.col("band")), mine, k, F.lit(0)))
    below = each(down, lambda k: tile(F.concat(F.lit("u"), F.col("band") - 1), k, mine, F.lit(1)))
    single = F.array(tile(F.lit("all"), F.lit(0), F.lit(0), F.lit(2)))
    every = F.when(F.col("a") & F.col("b"), single).otherwise(F.concat(inside, above, below))
    return m.select("set_id", "cluster", F.explode(every).alias("x")).select("set_id", "cluster", "x.*")


def links(docs: DataFrame, described: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links between different sets that connect every component (set ids)."""
    reps = described.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    rows = reps.select("set_id", F.explode("keys").alias("key"))
    ends = rows.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).filter("low < high").select("key", "low")
    stars = rows.join(ends, "key").filter("set_id != low").select("set_id", "low").distinct()
    cluster = components(stars, "set_id", "low")
    members = reps.select("set_id", "rep", "n_shingles").join(cluster.select(F.col("node").alias("set_id"), F.col("component").alias("cluster")), "set_id")
    members = cut(members, "members")
    forget(docs.sparkSession)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            want, texts = batch.column("set_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in blocks([len(t or "") for t in texts], 4_000_000):
                sets = shingle_sets(texts[a:b], width)
                names = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                # rows that repeat a doc_id with another text are not the representative
                good = [i for i, name in enumerate(names) if name is not None and want[a + i] in (None, name)]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in good], pa.int64()), pa.array([sets[i].tobytes() for i in good], pa.binary())], ["set_id", "shingles"])
        released(_MEMO)

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("rep", "set_id").hint("merge"), "rep")
    # sets that only rows without a doc_id hold have no representative: those rows name their sets themselves
    nameless = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("set_id"), "text")
    sets = texts.select("set_id", "text").unionByName(nameless).mapInArrow(load, "set_id long, shingles binary").dropDuplicates(["set_id"])
    dealt = sets.join(_tiles(members.select("set_id", "n_shingles", "cluster"), percent), "set_id")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        found = tile_links(x["set_id"].to_numpy(), [np.frombuffer(s, _U) for s in x["shingles"]], x["side"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cluster", "tile").applyInPandas(compare, "a long, b long")


def join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id of each row.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of width-word shingles. A text with
    fewer words is one shingle; without words (null, empty, blank) the set is empty and links with nothing.
    component_id is the least doc_id reachable, through rows without one as well. Repeated rows are copies of each other;
    other columns are ignored.
    """
    described = cut(describe(docs, width, percent / 100), "described")
    found = links(docs, described, width, percent)
    named = components(found, "a", "b").select(F.col("node").alias("set_id"), "component")
    sets = described.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    sets = sets.join(named, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    first = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = sets.join(first, "component").select("set_id", "component_id")
    out = described.select("doc_id", "n_shingles", "set_id").join(by_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_id")
