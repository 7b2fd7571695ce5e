"""Where shipped decisions go. A store tells which ids it has and takes new rows; any object that does can be handed in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.sources.formats import exists


class Store(Protocol):
    def known(self, rows: DataFrame) -> DataFrame:
        """Those of the rows' ids (decision_id) that the store has."""

    def append(self, rows: DataFrame) -> None:
        """Add rows, all or none of them."""


@dataclass
class TableStore:
    """A Parquet table, a folder for each day of ``ts``. One query writes to it at a time.

    A decision keeps its time, so one that is sent again is looked for in its own day
    alone, however large the table has become.
    """

    path: str

    def known(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        if not exists(spark, self.path):
            return rows.select("decision_id").limit(0)
        days = [r["day"] for r in rows.select(F.to_date("ts").alias("day")).distinct().collect()]  # of one batch
        return spark.read.parquet(self.path).filter(F.col("day").isin(days)).select("decision_id")

    def append(self, rows: DataFrame) -> None:
        rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(self.path).drop("day")


def checked_name(name: str) -> str:
    """A table's name that is one; anything else must not reach SQL."""
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
        raise ValueError(f"not a table's name: {name!r}")
    return name


@dataclass
class JdbcStore:
    """A table behind JDBC, with ``decision_id`` as its key."""

    url: str
    table: str
    properties: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        checked_name(self.table)

    def known(self, rows: DataFrame) -> DataFrame:
        ids = [r["decision_id"] for r in rows.select("decision_id").distinct().collect()]  # one batch
        stored = rows.sparkSession.read.jdbc(self.url, self.table, properties=self.properties).select(F.col("decision_id").cast("string").alias("decision_id"))
        return stored.filter(F.col("decision_id").isin(ids))

    def append(self, rows: DataFrame) -> None:
        # One partition is one transaction.
        rows.coalesce(1).write.jdbc(self.url, self.table, mode="append", properties=self.properties)
