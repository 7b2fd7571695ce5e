import json

import pytest
from pyspark.sql import functions as F

from leakloom.functions import recognizers as r
from leakloom.operators import decisions, registry

AS_OF = None


@pytest.fixture(scope="module", autouse=True)
def _as_of(spark):
    global AS_OF
    AS_OF = F.lit("2026-01-01").cast("date")


BORN = "생년월일"
HITS = [
    ("id 900101-1234567.", ["KR_RRN"]),
    ("id 990231-1234567", []),
    ("id 301231-3234567", []),
    ("id 900101 5234567", ["KR_FOREIGN_REGISTRATION_NUMBER"]),
    ("1900101-1234567", []),
    ("call 010-1234-5678 or +82 10 1234 5678", ["KR_PHONE_NUMBER", "KR_PHONE_NUMBER"]),
    ("문서번호 010-1234-5678", []),
    ("Document ID: 01012345678", []),
    ("mail a.b+c@example.co.kr", ["EMAIL_ADDRESS"]),
    ("mail 가a@example.com", []),
    (f"{BORN}: 1990-01-02", ["KR_DATE_OF_BIRTH"]),
    ("adobe 1990/1/2", ["KR_DATE_OF_BIRTH"]),
    ("on 1990-01-02", []),
    ("dob 1990-13-02", []),
    ("작성일 1990-01-02 dob", []),
    ("", []),
]


def test_personal_data(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(HITS)], "k int, t string")
    got = {x["k"]: [h["entity_type"] for h in x["h"]] for x in df.select("k", r.all_hits(F.col("t"), as_of=AS_OF).alias("h")).collect()}
    assert got == {k: e for k, (_, e) in enumerate(HITS)}


def test_rules_need_their_labels(spark):
    table = spark.createDataFrame([("b", "TOKEN", "[0-9a-f]{8,}", 0.9, " token , api_key", 1, 1), ("a", "KEY", "AKIA[0-9A-Z]{4}", 1.0, None, 0, 1), ("c", "OFF", ".", 1.0, None, 0, 0), ("d", "BARE", "x+", 1.0, "", 1, 1)], "rule_id string, entity_type string, pattern string, score double, context_keywords string, requires_context int, enabled int")
    rules = r.load_rules(table)
    assert [x.rule_id for x in rules] == ["a", "b", "d"]
    texts = ["TOKEN = \"DEADBEEF00\"", "deadbeef00", "'api_key': 'deadbeef00", "akia12ab", "token is deadbeef00", "token=xxx"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [[h["entity_type"] for h in x["h"]] for x in df.select("k", r.all_hits(F.col("t"), rules, AS_OF).alias("h")).orderBy("k").collect()]
    assert got == [["TOKEN"], [], ["TOKEN"], ["KEY"], [], []]
    with pytest.raises(ValueError):
        r.load_rules(table.filter("enabled = 0"))


def test_order_and_counts(spark):
    df = spark.createDataFrame([("b@c.de 900101-1234567 a@b.de",)], "t string")
    row = df.select(r.all_hits(F.col("t"), as_of=AS_OF).alias("h")).select("h", r.hit_counts(F.col("h")).alias("c")).first()
    assert [h["start"] for h in row["h"]] == sorted(h["start"] for h in row["h"]) and row["c"] == "EMAIL_ADDRESS:2,KR_RRN:1"


@pytest.fixture(scope="module")
def decided(spark):
    secret = "The merger with the northern company is to be announced on the first of May and not before. "
    postings = registry.build_postings(spark.createDataFrame([("plan", secret * 2 + "Nobody outside the board may know of it yet."), ("other", "Lunch is served from noon until two in the hall.")], "doc_id string, text string")).cache()
    prompts = spark.createDataFrame([("doc", "see: " + secret + " 900101-1234567"), ("pii", "my number is 900101-1234567"), ("none", "hello"), ("null", None)], "request_id string, text string")
    return prompts, postings


def test_documents_first_then_signatures(decided):
    prompts, postings = decided
    rows = {x["request_id"]: x for x in decisions.decide(prompts, postings, as_of=AS_OF).collect()}
    assert {k: (x["blocked"], x["decided_by"], x["signature_status"], x["hash_status"], x["pii_hits"], x["doc_id"]) for k, x in rows.items()} == {
        "doc": (True, "windowhash", "skipped", "ok", None, "plan"), "pii": (True, "signature", "ok", "ok", "KR_RRN:1", None),
        "none": (False, "none", "ok", "ok", None, None), "null": (False, "none", "ok", "ok", None, None),
    }
    assert 0 < rows["doc"]["score"] <= 1 and rows["doc"]["input_span"] == "2-95"  # "e: The" reads like "before. The"


def test_without_an_index_signatures_decide(decided):
    prompts, _ = decided
    rows = {x["request_id"]: x for x in decisions.decide(prompts, None, as_of=AS_OF).collect()}
    assert rows["doc"]["decided_by"] == "signature" and {x["hash_status"] for x in rows.values()} == {"error"}


def test_enforcement_and_log(spark, decided):
    rows = decisions.decide(*decided, as_of=AS_OF)
    both = rows.withColumn("d", decisions.gateway_decision(F.col("blocked"), F.col("decided_by"))).withColumn("e", decisions.enforced(F.col("d"), F.col("request_id")))
    got = {x["request_id"]: x for x in both.collect()}
    assert got["none"]["e"] is None and got["none"]["d"]["action"] == "allow"
    assert got["pii"]["e"]["http_status"] == 403 and json.loads(got["pii"]["e"]["body"])["error"]["reason_code"] == "pii"
    assert got["doc"]["d"]["user_message"] == decisions.MESSAGE_DOCUMENT
    assert spark.range(1).select(decisions.enforced(decisions.unreachable(), F.lit("x"))).first()[0] is None
    assert decisions.log_rows(rows, F.expr("uuid()"), F.lit(1.0), F.lit("s"), F.lit("f"), F.lit(2.0)).columns == decisions.LOGGED
    assert [x[0] for x in spark.createDataFrame([("",), ("a",), ("a" * 201,), (None,)], "r string").select(decisions.valid_request(F.col("r"))).collect()] == [False, True, False, False]
