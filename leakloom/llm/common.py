"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.session import ship_package


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether CRC-32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus == remainder


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under the names ``id`` and ``text``; a null text is the empty text.

    Other columns, whatever they are called, never reach an operator.
    """
    return df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Arrow batches to and from Python workers; rows of long texts are few in one, so that a worker's memory is bounded.
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes.

    Spark has this bound as a setting of the session only, read when a plan runs. A
    session with a smaller one keeps it; a larger one, or none, becomes BATCH_BYTES.
    """
    ship_package(df.sparkSession)
    now = df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, read on the driver, of a few MB; executors get it by broadcast and need no path."""
    with open(path, "rb") as f:
        return f.read()
