"""Rows without a doc_id connect documents like any others."""

from tidelane.llm import shingle_join


def text(first, n=200):
    return " ".join(f"w{k}" for k in range(first, first + n))


def test_a_set_of_rows_without_id_is_a_bridge(spark):
    """1 and 2 share too little, each links with the row between; 3 is a copy of a row without id, 4 stands alone."""
    rows = [(1, text(0)), (None, text(14)), (2, text(28)), (None, text(1000)), (3, text(1000)), (4, text(3000)), (None, text(5000)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_join.join(docs, 4, 85).filter("doc_id is not null").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert shingle_join.join(docs, 4, 85).count() == len(rows)
    assert {r.component_id for r in shingle_join.join(docs.filter("doc_id is not null"), 4, 85).collect()} == {1, 2, 3, 4}
