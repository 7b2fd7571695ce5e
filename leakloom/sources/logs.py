"""The decision log: JSON lines, tolerant to what older writers left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakloom.sources.formats import bare_path

SCHEMA = T.StructType([
    T.StructField("decision_id", T.StringType()), T.StructField("request_id", T.StringType()), T.StructField("ts", T.DoubleType()),
    T.StructField("service", T.StringType()), T.StructField("format", T.StringType()), T.StructField("text_chars", T.IntegerType()),
    T.StructField("blocked", T.BooleanType()), T.StructField("decided_by", T.StringType()), T.StructField("doc_id", T.StringType()),
    T.StructField("doc_span", T.StringType()), T.StructField("input_span", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("pii_hits", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("hash_status", T.StringType()),
    T.StructField("signature_status", T.StringType()), T.StructField("total_ms", T.DoubleType()), T.StructField("prompt", T.StringType()),
])
ERROR = "error"


def parsed_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Lines with their fields and ``kind``: record, legacy (no JSON object, or no id) or blank."""
    record = F.from_json(F.col(line_col), SCHEMA, {"mode": "PERMISSIVE"})
    kind = F.when(~F.col(line_col).rlike(r"\S"), "blank").when(F.coalesce(record["decision_id"], F.lit("")) == "", "legacy").otherwise("record")
    return lines.withColumn("_r", record).withColumn("kind", kind).select(*lines.columns, "kind", "_r.*")


def rejection(rows: DataFrame) -> DataFrame:
    """``rows`` with ``reject``: why the table of decisions could not hold the row, or null."""
    known = lambda c, *values: F.col(c).isin(*values)
    needed = ["request_id", "ts", "text_chars", "blocked", "decided_by", "reason", "hash_status", "signature_status", "total_ms"]
    why = F.when(~F.col("decision_id").rlike("^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"), "22: decision_id is no uuid")
    for c in needed:
        why = why.when(F.col(c).isNull(), f"23: {c} is null")
    why = why.when(~known("decided_by", "windowhash", "signature", "none"), "23: decided_by").when(~known("hash_status", "ok", ERROR), "23: hash_status").when(~known("signature_status", "ok", ERROR, "skipped"), "23: signature_status")
    return rows.withColumn("reject", why)


def is_data_error(sqlstate: Column) -> Column:
    """Whether a store refused a row for what is in it (SQLSTATE classes 22 and 23), not for lack of a connection."""
    return F.coalesce(sqlstate.rlike("^2[23]"), F.lit(False))


def log_lines(decisions: DataFrame) -> DataFrame:
    """(value): decisions as lines of JSON, all columns of the log in their order, nulls too."""
    return decisions.select(F.to_json(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA]), {"ignoreNullFields": "false"}).alias("value"))


def append_log(decisions: DataFrame, folder: str, per_file: int = 100_000) -> bool:
    """Append decisions to the log's folder, in files of at most ``per_file`` lines that appear whole.

    What can't be written costs no decision: the answer is False then.
    """
    try:
        log_lines(decisions).write.mode("append").option("maxRecordsPerFile", per_file).text(folder)
    except Exception:  # whatever fails there, the decisions stand
        return False
    return True


def scanned(spark: SparkSession, log_dir: str, shipped: DataFrame) -> DataFrame:
    """One row over all files of a log: lines, shipped, pending, legacy and duplicate ids; ``shipped`` holds the paths that were read (path)."""
    lines = spark.read.text(log_dir).withColumn("path", bare_path(F.url_decode(F.col("_metadata.file_path"))))
    rows = parsed_lines(lines).filter("kind <> 'blank'").select("path", "kind", "decision_id")
    done = shipped.select(bare_path(F.col("path")).alias("path")).distinct().withColumn("_done", F.lit(True))
    rows = rows.join(done, "path", "left")
    record = F.col("kind") == "record"
    counts = rows.agg(F.count(F.lit(1)).alias("lines"), F.count_if(record & F.col("_done").isNotNull()).alias("shipped"), F.count_if(record & F.col("_done").isNull()).alias("pending"), F.count_if(~record).alias("legacy"))
    twice = rows.filter(record).groupBy("decision_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_ids"))
    return counts.crossJoin(twice)  # one row each


def tag_counts(decisions: DataFrame, prefix: str) -> DataFrame:
    """One row: the decisions whose request ids begin with ``prefix``, and how many different ids they have."""
    return decisions.filter(F.startswith("request_id", F.lit(prefix))).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("decision_id").alias("n_ids"))


def reviewed(decisions: DataFrame, texts: DataFrame | None = None, verdicts: DataFrame | None = None, queue: DataFrame | None = None) -> DataFrame:
    """``decisions`` with what review tables hold of their requests, one row a request in each (all by request_id).

    Columns of a review table that a decision has too get the table's name before them.
    """
    out = decisions
    for name, table in (("review", texts), ("judge", verdicts), ("queue", queue)):
        if table is not None:
            own = table.select("request_id", *[F.col(c).alias(f"{name}_{c}" if c in out.columns else c) for c in table.columns if c != "request_id"])
            out = out.join(own, "request_id", "left")
    return out


def as_decisions(rows: DataFrame) -> DataFrame:
    """Records as rows of the table of decisions: seconds become a timestamp, ratios floats, prompts are kept."""
    return rows.select("decision_id", "request_id", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("ts"), "service", "format", "text_chars", "blocked", "decided_by", "doc_id", "doc_span", "input_span", F.col("score").cast("float").alias("score"), "pii_hits", "reason", "hash_status", "signature_status", F.col("total_ms").cast("float").alias("total_ms"), "prompt", F.lit(True).alias("prompt_kept"))


def reconcile(logged: DataFrame, stored: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: lines, in_store, rejected, missing, duplicate_ids and ok, of logged, stored and rejected ids (decision_id)."""
    per_id = logged.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n"))
    there = stored.select("decision_id").distinct().withColumn("_s", F.lit(True))
    away = rejected.select("decision_id").distinct().withColumn("_r", F.lit(True))
    all_ = per_id.join(there, "decision_id", "left").join(away, "decision_id", "left")
    gone = F.col("_s").isNull() & F.col("_r").isNull()
    out = all_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count_if(F.col("_s").isNotNull()).alias("in_store"), F.count_if(F.col("_r").isNotNull()).alias("rejected"), F.count_if(gone).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("duplicate_ids") == 0))


def missing_ids(logged: DataFrame, stored: DataFrame, rejected: DataFrame) -> DataFrame:
    return logged.select("decision_id").distinct().join(stored, "decision_id", "left_anti").join(rejected, "decision_id", "left_anti")


def decision_rollup(decisions: DataFrame, ts: str = "ts") -> DataFrame:
    """(hour, decided_by, n, n_blocked): how many decisions of each detector an hour has."""
    return decisions.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour"), "decided_by").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("n_blocked"))


def expired(decisions: DataFrame, days: int, now) -> DataFrame:
    """Decisions whose prompts are dropped after so many days; the rows stay."""
    old = F.col("ts") < now - F.expr(f"INTERVAL {int(days)} DAYS")
    return decisions.withColumn("prompt", F.when(~old, F.col("prompt"))).withColumn("prompt_kept", F.col("prompt_kept") & ~old)
