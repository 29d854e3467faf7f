"""Filter interaction audit: what each order of five text filters keeps, takes and loses.

A CUBE over the five failure flags and the part counts the documents of every combination at once. Its grouping set of
some filters, in the row where all of those flags are false, counts the documents that these filters let through: the
survivors of a subset, 32 subsets to a part. A step of an order goes from the subset before it to the one with its letter
as well, so each step is a pair of subsets, and all its counts are differences of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Letters of the filters, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"


def text_flags(text: Column) -> dict[str, Column]:
    """Failure flags A to D of a text that is not null: few words, few different ones, many capitals, a symbol."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, A to E and n for each kind of row: n equal rows that have a doc_id, a part and a text in common.

    E holds where a smaller doc_id has the same text, by its SHA-256. Equal rows are counted before anything is shuffled
    by document; the least doc_id of a text comes back by text and doc_id, which no large group of copies shares.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    d = d.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *(c.alias(k) for k, c in text_flags(F.col("t")).items()))
    d = cut(d.groupBy(d.columns).agg(F.count("*").alias("n")), "failures")
    first = d.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    known = d.filter("doc_id is not null").join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("first").isNull())
    unknown = d.filter("doc_id is null").withColumn("E", F.lit(False))  # no id is smaller than none
    columns = ["doc_id", "part", *FILTERS, "n"]
    return known.select(columns).unionByName(unknown.select(columns))


def survivors(failed: DataFrame) -> DataFrame:
    """part, subset (bits of FILTERS) and what all filters of the subset let through: n, good, toxic.

    failed: part, A to E, n, good, toxic. Subsets that let nothing through have no row; the empty subset always has one.
    """
    sums = [F.sum(x).alias(x) for x in ("n", "good", "toxic")]
    flags = failed.groupBy("part", *FILTERS).agg(*sums)  # 32 rows a part before the cube makes 64 sets of each
    cube = flags.cube("part", *FILTERS).agg(*sums, F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"any_{f}") for f in FILTERS))
    passed = None
    for f in FILTERS:
        ok = (F.col(f"any_{f}") == 1) | ~F.col(f)
        passed = ok if passed is None else passed & ok
    subset = sum(((1 - F.col(f"any_{f}")) * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0)).cast("int")
    return cube.filter((F.col("all_parts") == 0) & passed).select("part", subset.alias("subset"), "n", "good", "toxic")


def steps(parts: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, before and after for each part: every order of the filters, five steps each."""
    letters = F.array(*map(F.lit, FILTERS))
    s = parts.select("part", F.array().cast("array<string>").alias("chosen"))
    for _ in FILTERS:
        s = s.select("part", "chosen", F.explode(F.array_except(letters, "chosen")).alias("f")).select("part", F.array_append("chosen", F.col("f")).alias("chosen"))
    bit = lambda f: F.pow(F.lit(2), F.array_position(letters, f) - 1).cast("int")
    s = s.select("part", F.array_join("chosen", "").alias("filter_order"), F.col("chosen"), F.posexplode("chosen").alias("at", "filter"))
    before = F.aggregate(F.slice("chosen", F.lit(1), F.col("at")), F.lit(0), lambda a, f: a + bit(f))
    return s.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter", before.alias("before"), (before + bit(F.col("filter"))).alias("after"), bit(F.col("filter")).alias("own"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty; a null source is the part ''. A document without a doc_id has no label and copies none. Rows
    that repeat a doc_id count each, with E by other, smaller ids alone; a doc_id is good or toxic if any of its labels
    says so. Other columns are ignored. An empty table gives no rows.
    """
    failed = failures(docs)
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    known = failed.filter("doc_id is not null").join(told, "doc_id", "left")
    known = known.unionByName(failed.filter("doc_id is null").withColumns({"is_good": F.lit(False), "is_toxic": F.lit(False)}))
    count = lambda x: F.when(F.coalesce(x, F.lit(False)), F.col("n")).otherwise(0)
    s = cut(survivors(known.select("part", *FILTERS, "n", count("is_good").alias("good"), count("is_toxic").alias("toxic"))), "survivors")
    everything = (1 << len(FILTERS)) - 1
    t = steps(s.filter("subset = 0").select("part")).withColumns({"none": F.lit(0), "others": everything - F.col("own"), "every": F.lit(everything)})
    for side in ("before", "after", "none", "own", "others", "every"):
        named = s.select("part", F.col("subset").alias(side), *(F.col(x).alias(f"{side}_{x}") for x in ("n", "good", "toxic")))
        t = t.join(named, ["part", side], "left").fillna(0, [f"{side}_{x}" for x in ("n", "good", "toxic")])
    lost = lambda x: F.col(f"before_{x}") - F.col(f"after_{x}")
    t = t.select(
        "part", "filter_order", "step", "filter",
        F.col("after_n").alias("kept"),
        lost("n").alias("removed"),
        (F.col("none_n") - F.col("own_n") - lost("n")).alias("redundant"),
        (F.col("others_n") - F.col("every_n")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
    )
    return t.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
