"""A corpus pipeline: documents pass five stages, each of which works on all that its predecessor kept.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet to the shared folder and rereads as the next one's docs. All but the last return the columns of documents. A stage's table is removed
once the next one is written; the last of them is the caller's, as the result is read from it.

Defined results: documents whose text is null or empty are no toxic ones, have no lines to lose, are near copies of one another (one stays) and are mixed with
size 0; the last stage gives a null text no ids, an empty one an empty list. Documents without doc_id, or that share one, are told apart by their texts;
rows that repeat are copies. Documents without labels pass as others do. An empty table gives an empty table; further columns pass through but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import line_runs, mixing, piece_transducer, simhash, toxicity
from folioflow.llm.common import Tables
from folioflow.llm.queries import piece_model, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the largest doc_id alone; n_chars follows the text."""
    return line_runs.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles or more one stays."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.emit(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, and whether they decode to the text."""
    return piece_transducer.encode(docs, piece_model(), keep_text=False).select("doc_id", "source", "n_pieces", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: SimHash, the toxicity model and the piece transducer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stash, last = table(spark, sf_dir, "documents"), Tables(spark), None
    for name, stage in STAGES[:-1]:
        docs = stash.write(stage(spark, docs, sf_dir), name)
        if last:
            stash.remove(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
