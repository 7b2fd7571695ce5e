"""Shipping the decision log into a table with Structured Streaming.

The file source and its checkpoint follow the log's files; a batch that is repeated after
a crash adds nothing, since rows that the table holds are left out. Together that is
exactly-once in effect. Files must be complete when they appear (write, then rename).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.sources.formats import bare_path, exists
from leakloom.sources.logs import as_decisions, parsed_lines, rejection
from leakloom.streaming.stores import Store, TableStore


def _rows_at(path: str, like: DataFrame) -> DataFrame:
    """The rows written at ``path`` so far; none before the first batch."""
    spark = like.sparkSession
    return spark.read.schema(like.schema).parquet(path) if exists(spark, path) else like.limit(0)


def ship_batch(lines: DataFrame, table: str | Store, rejects: str, status: str | None = None, batch_id: int = 0) -> None:
    """One batch of lines (value): good rows new to ``table`` are appended, others go to ``rejects``.

    ``table`` is a store or the path of a Parquet table. Legacy lines are counted and
    skipped. ``status`` gets a row of counts for each batch.
    """
    store = TableStore(table) if isinstance(table, str) else table
    rows = rejection(parsed_lines(lines)).persist()
    try:
        records = rows.filter("kind = 'record'")
        good = as_decisions(records.filter("reject is null")).dropDuplicates(["decision_id"])
        store.append(good.join(store.known(good), "decision_id", "left_anti"))
        bad = records.filter("reject is not null").select("decision_id", "reject", F.col("value").alias("line")).dropDuplicates(["decision_id", "line"])
        known = _rows_at(rejects, bad).select("decision_id", "line")
        bad.join(known, ["decision_id", "line"], "left_anti").write.mode("append").parquet(rejects)
        if status:
            counts = rows.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count_if(F.col("kind") == "record").alias("records"), F.count_if(F.col("kind") == "legacy").alias("legacy"), F.count_if(F.col("reject").isNotNull() & (F.col("kind") == "record")).alias("rejected"), F.current_timestamp().alias("at"))
            counts.write.mode("overwrite").parquet(f"{status}/batch={batch_id}")
    finally:
        rows.unpersist()


def ship(spark: SparkSession, log_dir: str, table: str | Store, rejects: str, checkpoint: str, status: str | None = None, files_per_batch: int = 8, once: bool = True, after: Column | None = None):
    """The streaming query that ships all files of ``log_dir``; ends when there are no more if ``once``.

    ``after`` is where to start: files last written before that time are passed over.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(log_dir)
    if after is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= after).select("value")
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: ship_batch(batch, table, rejects, status, k))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def seen_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path) of the files that a query with this checkpoint has taken up."""
    entries = f"{checkpoint}/sources/0"
    if not exists(spark, entries):
        return spark.createDataFrame([], "path string")
    path = F.from_json("value", "struct<path:string>")["path"]
    return spark.read.text(entries).select(F.url_decode(path).alias("path")).filter("path is not null").distinct()


def lag(spark: SparkSession, log_dir: str, checkpoint: str) -> DataFrame:
    """One row: files and bytes of the log that are not taken up yet."""
    files = spark.read.format("binaryFile").load(log_dir).select("path", "length")  # sizes alone, nothing is read
    left = files.withColumn("_p", bare_path(F.col("path"))).join(seen_files(spark, checkpoint).select(bare_path(F.col("path")).alias("_p")), "_p", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("pending_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("pending_bytes"))


def totals(spark: SparkSession, status: str) -> DataFrame:
    """One row of what all batches so far came to, and when the last one ended."""
    return spark.read.parquet(status).agg(F.count(F.lit(1)).alias("batches"), F.sum("records").alias("records"), F.sum("legacy").alias("legacy"), F.sum("rejected").alias("rejected"), F.max("at").alias("last_ok"))


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, late ones dropped after ``late``: a convenience of this library."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
