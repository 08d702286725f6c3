"""Documents through quality rules, line dedup, n-gram Jaccard join, mixing and SentencePiece, one after another.

Each stage works on what the one before kept and, but for the last, returns the columns of documents. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tectra.llm import common, line_dedup, mixing, ngram_join, pieces, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts have no words and go; repeated rows are judged alike, whatever their id."""
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters that three documents hold stay in the one of largest id. Rows of one id count as one document, a null id
    is less than any other; a null text becomes an empty one, and a text may lose all its lines and stays as an empty one."""
    kept = line_dedup.dedup_lines(docs, n_lines=None, n_dropped=None)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies, that of least id: five words, a similarity of 0.8. Rows of one id stay or go together;
    rows without id or without words stay."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights; a document that several epochs take has a row for each. Null sources and languages are the empty name; texts
    without words go with the epochs of a leaf that has some."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and of what they decode to, a row a row. Null and empty texts are begin and end alone."""
    return pieces.piece_digests(docs)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: The label model's verdicts can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
