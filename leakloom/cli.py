"""Command lines: python -m leakloom.cli COMMAND ... (each prints JSON)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leakloom.functions.spans import occurrences
from leakloom.functions.text import normalize_text
from leakloom.operators import ingest, registry
from leakloom.session import create_session
from leakloom.sources import formats, logs
from leakloom.streaming import shipper
from leakloom.streaming.stores import TableStore

DEMO = {"plain": "NDA - draft", "spaces": "NDA\u00a0\u2013\u3000draft", "crlf": "NDA - draft\r\n", "hidden": "NDA\u200b - draft", "tabs": "NDA\t-\tdraft"}


def _shown(spark: SparkSession, rows) -> None:
    for row in rows.toJSON().toLocalIterator():
        print(row)


def normalize(spark: SparkSession, args) -> None:
    """Text, a file's text, or variants of one text that all come out alike."""
    given = {"text": args.text} if args.text is not None else {"file": open(args.file, encoding="utf-8").read()} if args.file else DEMO
    rows = spark.createDataFrame(list(given.items()), "label string, raw string").withColumn("normalized", normalize_text(F.col("raw"))).collect()
    print(json.dumps({"results": [r.asDict() for r in rows], "all_equal": len({r["normalized"] for r in rows}) == 1}, ensure_ascii=False))


def find(spark: SparkSession, args) -> None:
    """Each place of a string in a document's searchable text, overlapping ones too, and the block that it lies in."""
    files = spark.read.format("binaryFile").load(args.path).select("path", "content")
    documents, _, index = ingest.ingest_files(files)
    places = documents.select("doc_id", F.explode(occurrences(F.col("text"), args.string)).alias("start")).withColumn("end", F.col("start") + len(args.string))
    _shown(spark, ingest.located(index, places))


def take_in(spark: SparkSession, args) -> None:
    """A folder's documents into an index: a table of documents and one of postings."""
    documents, postings, _ = ingest.ingest_directory(spark, args.folder)
    documents.write.mode("overwrite").parquet(f"{args.out}/documents")
    postings.write.mode("overwrite").parquet(f"{args.out}/postings")
    _shown(spark, documents.join(registry.ledger_counts(spark.read.parquet(f"{args.out}/postings")), "doc_id", "left").select("doc_id", "format", "error", F.coalesce("windows", F.lit(0)).alias("windows")).orderBy("doc_id"))


def span(spark: SparkSession, args) -> None:
    """The part of a document that a span names."""
    start, _, end = args.span.partition("-")
    own = spark.read.parquet(f"{args.index}/documents").filter(F.col("doc_id") == args.doc_id)
    _shown(spark, own.select("doc_id", F.substring("text", int(start) + 1, int(end) - int(start)).alias("slice")))


def listed(spark: SparkSession, args) -> None:
    """What a table of registered documents holds, without their contents."""
    _shown(spark, registry.list_documents(spark.read.parquet(args.table), args.status))


def log_check(spark: SparkSession, args) -> None:
    """Whether all decisions of a log are in the table or rejected, each once; the exit code tells too."""
    lines = logs.parsed_lines(spark.read.text(args.log)).filter("kind = 'record'").select("decision_id")
    empty = spark.createDataFrame([], "decision_id string")
    stored = TableStore(args.table).read(spark).select("decision_id") if formats.exists(spark, args.table) else empty
    rejected = spark.read.parquet(args.rejects).select("decision_id") if formats.exists(spark, args.rejects) else empty
    row = logs.reconcile(lines, stored, rejected).first()
    print(json.dumps(row.asDict()))
    if not row["ok"]:
        sys.exit(1)


def ship(spark: SparkSession, args) -> None:
    """Ship all files of a log that are not shipped yet."""
    shipper.ship(spark, args.log, args.table, args.rejects, args.checkpoint).awaitTermination()
    _shown(spark, shipper.lag(spark, args.log, args.checkpoint))


COMMANDS = {
    "normalize": (normalize, [("--text", {}), ("--file", {})]),
    "find": (find, [("path", {}), ("string", {})]),
    "ingest": (take_in, [("folder", {}), ("out", {})]),
    "span": (span, [("index", {}), ("doc_id", {}), ("span", {})]),
    "list": (listed, [("table", {}), ("--status", {})]),
    "log-check": (log_check, [("log", {}), ("table", {}), ("rejects", {})]),
    "ship": (ship, [("log", {}), ("table", {}), ("rejects", {}), ("checkpoint", {})]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="leakloom", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, (run, arguments) in COMMANDS.items():
        own = commands.add_parser(name, help=run.__doc__)
        own.set_defaults(run=run)
        for argument, how in arguments:
            own.add_argument(argument, **how)
    args = parser.parse_args(argv)
    args.run(spark or create_session(), args)


if __name__ == "__main__":
    main()
