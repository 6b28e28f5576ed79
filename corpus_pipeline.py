"""A corpus pipeline: each stage works on the documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import jaccard, packing, quality_classifier, quality_rules
from brindle.llm.texts import free_name, id_remainder, quoted
from brindle.session import remove_path, scratch_path
from brindle.sources import Tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Documents that score lower are rejected.
QUALITY = 0.3
#: Tables that a stage has written for itself, until its result is written.
_OWN: list[str] = []


def _boxed(docs: DataFrame, *inputs: str) -> DataFrame:
    """The rows whole, beside what an operator reads: no column is hidden by a result's."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), *inputs)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null text is judged as an empty one; repeated rows and rows without an id are judged by
    their texts, each for itself. All columns stay, whatever their names. An empty table gives no rows.
    """
    tables = Tables(spark, sf_dir)
    model = quality_classifier.train(tables.documents, tables.labels, "doc_id", "text", "quality",
                                     learnable=id_remainder("doc_id", 5) != 0)
    scored = quality_classifier.score_texts(_boxed(docs, "text"), "text", model)
    return scored.where(F.col("score") >= QUALITY).select("doc.*")


def keep_usual(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    A null text and one of under 50 words don't pass; rows without a language are a language of
    their own; repeated rows are judged alike. All columns stay, whatever their names. An empty
    table gives no rows.
    """
    judged = quality_rules.apply_rules(_boxed(docs, "text", "lang"), "text", "lang")
    return judged.where("kept").select("doc.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the first row in the table.

    Rows are told apart by their place, so repeated rows are copies whatever their ids, and ties
    can't be. Null texts and texts without words are nobody's duplicates and stay. All columns stay,
    whatever their names. An empty table gives no rows.
    """
    # rows are told apart by their place in the table, as ids may be null or repeated
    row = free_name(docs, "row")
    # written once: a file's splits, and so the numbers, may differ from job to job
    path = scratch_path(spark, "numbered")
    _OWN.append(path)
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    joined = jaccard.jaccard_join(numbered.select(row, "text"), row, "text")
    dropped = joined.where(F.col(row) != F.col("class_id")).select(row)
    return numbered.join(dropped, row, "left_anti").drop(row)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences.

    A null or empty text is one piece, of the closing id; repeated rows and rows without an id are
    packed like others. Only ``doc_id`` of a row's columns stays. An empty table gives no pieces.
    """
    return packing.pack_texts(
        docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=1,
        limits=packing.Limits(tokens=2048, segments=64, loss=2047))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("quality rules", keep_usual),
    ("n-gram Jaccard join", keep_one_of_each),
    ("packing", pack_documents),
]

#: SQL cannot express a stage; each is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written below the checkpoint folder and read again by the next.

    What a stage has read, or written for itself, is removed when its result is written; the
    last result stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        path, known = scratch_path(spark, name.replace(" ", "-")), len(_OWN)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        for old in (*_OWN[known:], *filter(None, [before])):
            remove_path(spark, old)
        del _OWN[known:]
        before = path
    return docs
