"""The filter audit against a plain count, order by order, on rows with nulls, repeats, ties and clashing columns."""

from itertools import permutations

from pyspark.sql import functions as F

from tidelane.llm import filter_audit

LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, LONG, "a"),
    (2, LONG, "a"),
    (2, LONG, "b"),
    (3, LONG, None),
    (3, "short # text", ""),
    (3, "short # text", ""),
    (4, None, "a"),
    (5, "", "b"),
    (None, LONG, "a"),
    (None, None, None),
    (6, "same " * 70, "a"),
    (7, "LOUD " * 30 + LONG, "b"),
    (8, LONG + " Ä|ß", "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (8, 1, 0)]


def fails(rows):
    """Flags of each row, from the definitions."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
        words = [w for w in words if w]
        out.append((
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        ))
    return out


def by_hand(rows, labels):
    flags, out = fails(rows), {}
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, flags) if (r[2] or "") == part]
        for order in permutations(range(5)):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                out[part, "".join("ABCDE"[j] for j in order), step] = [
                    len(left), len(gone), sum(f[k] for _, f in own) - len(gone), sum(f[k] and sum(f) == 1 for _, f in own),
                    sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone),
                ]
    share = {}
    for (part, order, step), x in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + x[1]
    return {k: (*x, share[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_counts_are_those_of_each_order(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"n": F.lit(1), "part": F.lit("z"), "digest": F.lit(0), "A": F.lit(5)})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("n", F.lit(9))
    got = filter_audit.audit(docs, labels)
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in got.collect()} == by_hand(ROWS, LABELS)
    assert all(t == "bigint" for c, t in got.dtypes if c in columns)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    got = filter_audit.audit(one, labels)
    assert got.count() == 600
    assert got.filter("removed = 1").groupBy("filter").count().collect() == [("A", 120)]
