"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import bounded, cut, table
from tidelane.llm.decontamination import clean
from tidelane.llm.language_id import language, learn
from tidelane.llm.packing import pack
from tidelane.llm.pii import redact
from tidelane.llm.shingle_join import join

SEQUENCE = 2048
BROADCAST_IDS = 500_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which the learned languages can be told; only those without a letter (`und`) go.

    Text in a language that no label has gets the nearest learned one and stays.
    """
    bounded(spark)
    columns = docs.columns
    tagged = docs.withColumn("_said", language(F.col("text"), learn(docs)))
    return tagged.filter(F.col("_said.lang_pred") != "und").select(*columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group that five-word shingles with a Jaccard index of 0.8 or more connect.

    Rows are told apart by doc_id: those that repeat the least one stay, as do rows without a doc_id.
    """
    gone = cut(join(docs, width=5, percent=80).filter("doc_id != component_id").select("doc_id").distinct(), "copies")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to four fifths of its five-word shingles."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it replaced in the text."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of SEQUENCE tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE, 1)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", sanitised),
    ("packing", packed),
]

#: Tokens and suffix automata are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
