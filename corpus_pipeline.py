"""A corpus pipeline of five stages, each calling one operator of the subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. Every stage works on all rows that
the one before it kept.
"""

from __future__ import annotations

import atexit
from contextlib import suppress
from uuid import uuid4

import public_tokenizers
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import packing, secret_scan, simhash, toxicity
from leakloom.llm import quality as quality_scores
from leakloom.session import shared_folder


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text scores as one without any statistics; ties at the threshold
    stay; repeated rows stay or go together; whole texts count whatever their length; an
    empty table stays empty; extra columns of any name pass through.
    """
    labels = _labels(spark, sf_dir)
    stats = quality_scores.document_statistics(quality_scores.to_learn_from(docs, labels, "quality"))
    return quality_scores.kept(docs, quality_scores.fit(stats, labels, "quality"))


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    A null or empty text has nothing toxic in it; ties at the threshold go; repeated rows
    stay or go together; whole texts count whatever their length; an empty table stays
    empty; extra columns of any name pass through.
    """
    return toxicity.kept(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id.

    Texts without words (null and empty ones among them) are copies of each other; of
    several rows with one id that whose text comes first stays; rows without an id stay;
    an empty table stays empty; extra columns of any name pass through.
    """
    return simhash.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay.

    A null text stays null, an empty one empty; whole texts are searched whatever their
    length; repeated rows change alike; an empty table stays empty; extra columns of any
    name pass through.
    """
    return secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces in sequences of at most 1024 tokens.

    A null or empty text is its end token alone; a repeated row makes its pieces again;
    only texts of more than 1024 tokens are cut; an empty table gives no rows; columns
    other than id and text are left out.
    """
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", nontoxic), ("simhash", deduplicated), ("secrets", without_secrets), ("packing", packed)]

#: SQL can't express the classifiers, fingerprints and tokens; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents.

    What stands between two stages lies in the shared folder until the one after them is
    written; the last such table, which the result reads, goes when the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, name_of_run, before = shared_folder(spark), uuid4().hex, None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/pipeline-{name_of_run}-{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _removed(spark, before)
            before = path
    if before:
        atexit.register(_removed, spark, before)
    return docs


def _removed(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session was stopped before the driver ended
        return
    with suppress(Py4JError, OSError):  # or its Java side is gone
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
