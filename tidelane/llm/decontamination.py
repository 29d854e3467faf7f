"""Benchmark decontamination: MinHash containment search, in DataFrame operations only.

Items are partitioned by set size (octaves of their shingle count). In a partition each item keeps a bottom sketch: its m
least shingle hashes. An item that a document contains to the threshold lacks at most `missed` of its n shingles, which of
them is up to the hash; m is the least number for which the chance that a document lacks all of the sketch is at most
MISS, so m stays near 17 however large the items, and small items cannot hide at all. Documents are searched whole, however
long: all their shingles are looked up among the sketches, a document with a hit of an item is a candidate, and candidates
are verified by exact containment of the item's shingle set.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality_rules import BLANKS

WIDTH = 5
PERCENT = 80
MISS = 1e-12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, A-Z lowered, words between ASCII blanks."""
    trimmed = F.btrim(F.translate(text, UPPER, LOWER), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def with_shingles(df: DataFrame, width: int) -> DataFrame:
    """df (with text) plus `set`, its distinct shingle hashes; fewer words than width make one shingle, none an empty set."""
    d = df.withColumn("h", word_hashes(F.coalesce(F.col("text"), F.lit("")))).drop("text")
    n = F.size("h")
    runs = F.transform(F.slice("h", 1, F.greatest(n - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, width))))
    whole = F.array(F.aggregate("h", F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)))
    shingles = F.when(n >= width, F.array_distinct(runs)).when(n > 0, whole).otherwise(F.array().cast("array<long>"))
    return d.withColumn("set", shingles).drop("h")


def sketch_size(octave: int, percent: int) -> int:
    """m for items of less than 2^octave shingles: the chance that all m are among the missed ones is at most MISS."""
    n = (1 << octave) - 1
    missed, chance, m = n * (100 - percent) // 100, 1.0, 0
    while chance > MISS:
        chance *= max(missed - m, 0) / (n - m)
        m += 1
    return m


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """item, set, n, sketch of each item; without a word both are empty."""
    d = items.withColumn("set", F.sort_array("set")).withColumn("n", F.size("set").cast("long"))
    sizes = F.array(*(F.lit(sketch_size(k, percent)) for k in range(1, 32)))
    return d.withColumn("sketch", F.slice("set", 1, F.least(F.col("n").cast("int"), F.element_at(sizes, F.length(F.bin("n"))))))


def search(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item, n_common: documents that hold at least percent of an item's shingles.

    Rows are distinct, so repeated rows show once. Null or empty texts hold nothing and items without a word are not
    searched. A row of null doc_id is not reported. Other columns are ignored. An empty table on either side gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    wanted = cut(sketches(with_shingles(wanted, width), percent), "items")
    small = wanted.agg(F.sum("n")).first()[0] or 0
    # the sketches go to every task while they are few, else they are joined on the hash
    marks = wanted.select("item_id", F.explode_outer("sketch").alias("hash"))
    marks = F.broadcast(marks) if small <= BROADCAST_ROWS else marks
    # explode_outer: explode would filter on the size of the set, and pushed below the projections that filter would hash
    # all words again for each shingle; null hashes join nothing
    asked = with_shingles(own, width).select("doc_id", F.explode_outer("set").alias("hash")).join(marks, "hash")
    candidates = cut(asked.select("doc_id", "item_id").distinct(), "candidates")
    ids = candidates.select("doc_id").distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    near = with_shingles(own.join(F.broadcast(ids) if few else ids, "doc_id"), width)
    sets = wanted.select("item_id", F.col("n").alias("n_item"), F.col("set").alias("item_set"))
    exact = near.join(candidates, "doc_id").join(F.broadcast(sets) if small <= BROADCAST_ROWS else sets, "item_id")
    common = F.size(F.array_intersect("set", "item_set")).cast("long")
    found = exact.select("doc_id", "item_id", "n_item", common.alias("n_common")).filter(100 * F.col("n_common") >= percent * F.col("n_item"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_common").alias("n_common"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, whose doc_id holds no item."""
    ids = cut(search(docs, items, width, percent).select("doc_id").distinct(), "leaks")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")
