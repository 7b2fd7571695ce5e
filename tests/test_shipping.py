import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from leakloom.sources import logs
from leakloom.streaming import shipper


def line(k, **change):
    row = {"decision_id": str(uuid.UUID(int=k)), "request_id": f"r{k}", "ts": 1.7e9 + k, "service": "s", "format": "f", "text_chars": 3, "blocked": False, "decided_by": "none", "doc_id": None, "doc_span": None, "input_span": None, "score": None, "pii_hits": None, "reason": "", "hash_status": "ok", "signature_status": "ok", "total_ms": 1.5, "prompt": "a\"b\n"}
    return json.dumps({**row, **change}, ensure_ascii=False)


def put(folder, name, lines):
    """Write, then rename, as the source needs it."""
    (folder / f".{name}").write_text("\n".join(lines) + "\n", encoding="utf-8")
    os.rename(folder / f".{name}", folder / name)


@pytest.fixture
def places(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log", *(str(tmp_path / x) for x in ("table", "rejects", "checkpoint", "status"))


def ship(spark, places):
    log, table, rejects, checkpoint, status = places
    shipper.ship(spark, str(log), table, rejects, checkpoint, status, files_per_batch=2).awaitTermination(120)
    return spark.read.parquet(table), spark.read.parquet(rejects)


def test_each_id_once_over_restarts(spark, places):
    for n in range(5):
        put(places[0], f"a{n}.jsonl", [line(k) for k in range(20 * n, 20 * n + 25)])  # files overlap
    table, _ = ship(spark, places)
    assert table.count() == table.select("decision_id").distinct().count() == 105
    put(places[0], "b.jsonl", [line(3), line(200), line(201), line(201)])
    table, _ = ship(spark, places)
    assert table.count() == 107


def test_a_batch_done_again_adds_nothing(spark, places):
    lines = spark.createDataFrame([(line(k),) for k in range(30)] + [(line(99, decided_by="x"),)], "value string")
    for _ in range(2):  # as after a crash between the append and the checkpoint
        shipper.ship_batch(lines, places[1], places[2])
    assert spark.read.parquet(places[1]).count() == 30 and spark.read.parquet(places[2]).count() == 1


def test_rejects_and_legacy_lines(spark, places):
    put(places[0], "a.jsonl", [line(1), line(2, decided_by="guess"), line(3, request_id=None), line(4, decision_id="no uuid"), "no json", "{}", "[1]", "", line(5)])
    table, rejects = ship(spark, places)
    assert table.count() == 2 and {r["reject"][:2] for r in rejects.collect()} == {"22", "23"} and rejects.count() == 3
    status = spark.read.parquet(places[4]).agg(F.sum("records"), F.sum("legacy"), F.sum("rejected")).first()
    assert tuple(status) == (5, 3, 3)
    row = table.filter("request_id = 'r1'").first()
    assert row["ts"].timestamp() == 1.7e9 + 1 and row["prompt"] == 'a"b\n' and row["prompt_kept"] is True


def test_reconciling(spark):
    ids = lambda *k: spark.createDataFrame([(str(x),) for x in k], "decision_id string")
    row = logs.reconcile(ids(1, 2, 3, 4, 4), ids(1, 2, 9), ids(3)).first()
    assert tuple(row) == (5, 2, 1, 1, 1, False) and logs.missing_ids(ids(1, 2, 3, 4, 4), ids(1, 2, 9), ids(3)).first()[0] == "4"
    assert logs.reconcile(ids(1), ids(1), ids().limit(0) if False else ids(7)).first()["ok"]
    assert tuple(logs.reconcile(ids(1).limit(0), ids(1), ids(1)).first()) == (0, 0, 0, 0, 0, True)


def test_retention(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", "old"), ("2026-03-01 00:00:00", "new")], "ts string, prompt string").selectExpr("cast(ts as timestamp) ts", "prompt", "true prompt_kept")
    rows = logs.expired(df, 30, F.lit("2026-03-02").cast("timestamp")).orderBy("ts").collect()
    assert [(r["prompt"], r["prompt_kept"]) for r in rows] == [(None, False), ("new", True)]


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = shipper.event_counts(stream, "1 day", "3650 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
