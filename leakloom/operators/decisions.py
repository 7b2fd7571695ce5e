"""Block or allow: registered text first, then personal data and credentials."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakloom.functions.recognizers import PERSONAL_DATA, all_hits, hit_counts
from leakloom.functions.spans import parse_span, span_label, span_text
from leakloom.functions.text import normalize_text
from leakloom.operators.matching import signals
from leakloom.session import checkpointed

HASH, SIGNATURE, NONE = "windowhash", "signature", "none"
# What users are told.
MESSAGE_DOCUMENT = "사내 기밀문서 내용이 포함되어 전송이 차단되었습니다. 문의 시 요청 번호를 알려주세요."
MESSAGE_DEFAULT = "Request blocked by AI Security Gateway."
MESSAGE_PERSONAL = "개인정보로 보이는 내용이 포함되어 전송이 차단되었습니다. 문의 시 요청 번호를 알려주세요."
#: The columns of a logged decision, in order.
LOGGED = ["decision_id", "request_id", "ts", "service", "format", "text_chars", "blocked", "decided_by", "doc_id", "doc_span", "input_span", "score", "pii_hits", "reason", "hash_status", "signature_status", "total_ms", "prompt"]


def decide(prompts: DataFrame, postings: DataFrame | None, id_col: str = "request_id", text_col: str = "text", recognizers=PERSONAL_DATA, as_of: Column | None = None, sampling: bool = True) -> DataFrame:
    """One decision per prompt.

    Any identifying window blocks; only prompts that pass are searched for signatures,
    any hit of which blocks. Without postings the hash detector counts as failed and
    signatures decide alone. Prompts are told apart by ``id_col``.
    """
    normal = prompts.select(F.col(id_col), normalize_text(F.col(text_col)).alias("prompt"))
    if postings is None:
        top = normal.select(id_col, F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("doc_span"), F.lit(None).cast("string").alias("input_span"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("windows")).limit(0)
    else:
        top = signals(normal, postings, id_col, "prompt", sampling).filter("signal_rank = 1").select(id_col, F.col("doc_id").cast("string").alias("doc_id"), span_label(F.col("doc_start"), F.col("doc_end")).alias("doc_span"), span_label(F.col("in_start"), F.col("in_end")).alias("input_span"), "score", "windows")
    both = normal.join(top, id_col, "left")
    hashed = F.col("doc_id").isNotNull()
    # A blocked prompt's text never reaches the patterns.
    hits = all_hits(F.when(hashed, F.lit("")).otherwise(F.col("prompt")), recognizers, as_of)
    rows = both.withColumn("_hits", hits).withColumn("pii_hits", hit_counts(F.col("_hits")))
    signed = F.size("_hits") > 0
    reason = F.when(hashed, F.format_string("%s %s: %d windows", "doc_id", "doc_span", "windows")).when(signed, F.concat(F.lit("signature: "), "pii_hits")).otherwise(F.lit("no match" if postings is not None else "windowhash error"))
    return rows.select(
        id_col,
        F.length("prompt").alias("text_chars"),
        (hashed | signed).alias("blocked"),
        F.when(hashed, HASH).when(signed, SIGNATURE).otherwise(NONE).alias("decided_by"),
        "doc_id", "doc_span", "input_span", "score", "pii_hits",
        reason.alias("reason"),
        F.lit("ok" if postings is not None else "error").alias("hash_status"),
        F.when(hashed, "skipped").otherwise("ok").alias("signature_status"),
        "prompt",
    )


@dataclass(frozen=True)
class Detector:
    """Something that looks at prompts: ``query`` makes (id, score, evidence, span, windows) of prompts (id, prompt).

    A prompt may have several rows, the strongest with the most windows and then the
    highest score. One with a score of at least ``threshold`` blocks; ``reason`` says why.
    """

    name: str
    entity_type: str
    query: Callable[[DataFrame, str], DataFrame]
    threshold: float = 0.0
    reason: Callable[[Column, Column], Column] | None = None


def percentage(share: Column) -> Column:
    """A share as whole per cent, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def hash_detector(postings: DataFrame, sampling: bool = True) -> Detector:
    """Prompts that repeat registered text."""

    def query(prompts: DataFrame, id_col: str) -> DataFrame:
        found = signals(prompts, postings, id_col, "prompt", sampling)
        return found.select(id_col, "score", F.col("doc_id").cast("string").alias("evidence"), span_label(F.col("doc_start"), F.col("doc_end")).alias("span"), "windows")

    return Detector(HASH, "CONFIDENTIAL_DOCUMENT", query, 0.0, lambda d, blocked: F.concat(d["evidence"], F.lit(" "), d["span"], F.lit(": "), d["windows"].cast("string"), F.lit(" windows, "), percentage(d["score"])))


def signature_detector(recognizers=PERSONAL_DATA, as_of: Column | None = None) -> Detector:
    """Prompts with personal data or credentials."""

    def query(prompts: DataFrame, id_col: str) -> DataFrame:
        hits = prompts.select(id_col, all_hits(F.col("prompt"), recognizers, as_of).alias("_hits")).filter(F.size("_hits") > 0)
        return hits.select(id_col, F.array_max(F.transform("_hits", lambda h: h["score"])).alias("score"), hit_counts(F.col("_hits")).alias("evidence"), F.lit(None).cast("string").alias("span"), F.size("_hits").cast("long").alias("windows"))

    return Detector(SIGNATURE, "PERSONAL_DATA", query, 0.0, lambda d, blocked: F.concat(F.lit("signature: "), d["evidence"]))


def decide_by(prompts: DataFrame, detectors: list[Detector], id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """(id, blocked, decided_by, entity_type, score, evidence, span, reason): the verdict of the first detector that blocks.

    Detectors are asked one after the other, each only for the prompts that those before
    it let pass. With none that blocks a prompt passes.
    """
    normal = checkpointed(prompts.select(F.col(id_col), normalize_text(F.col(text_col)).alias("prompt")))
    verdicts, left = None, normal
    for detector in detectors:
        strongest = Window.partitionBy(id_col).orderBy(F.desc("windows"), F.desc("score"), "evidence", "span")
        top = detector.query(left, id_col).withColumn("_n", F.row_number().over(strongest)).filter((F.col("_n") == 1) & (F.col("score") >= detector.threshold))
        d = F.struct("score", "evidence", "span", "windows")
        why = detector.reason(d, F.lit(True)) if detector.reason else F.lit(detector.name)
        own = checkpointed(top.select(id_col, F.lit(detector.name).alias("decided_by"), F.lit(detector.entity_type).alias("entity_type"), "score", "evidence", "span", why.alias("reason")))
        verdicts = own if verdicts is None else verdicts.unionByName(own)
        left = left.join(own.select(id_col), id_col, "left_anti")
    if verdicts is None:
        raise ValueError("no detector")
    both = normal.select(id_col).join(verdicts, id_col, "left")
    return both.select(id_col, F.col("decided_by").isNotNull().alias("blocked"), F.coalesce("decided_by", F.lit(NONE)).alias("decided_by"), "entity_type", "score", "evidence", "span", F.coalesce("reason", F.lit("no match")).alias("reason"))


def decided_slices(decisions: DataFrame, documents: DataFrame) -> DataFrame:
    """``decisions`` (doc_id, doc_span) with ``slice``, the registered text that they name (documents: doc_id, normalized_text)."""
    span = parse_span(F.col("doc_span"))
    own = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "normalized_text")
    return decisions.join(own, "doc_id", "left").withColumn("slice", F.when(F.col("doc_span").isNotNull(), span_text(F.col("normalized_text"), span["start"], span["end"]))).drop("normalized_text")


def gateway_decision(blocked: Column, decided_by: Column) -> Column:
    """struct<action, reason_code, user_message, http_status>: what the gateway carries out."""
    personal = decided_by == SIGNATURE
    return F.struct(
        F.when(blocked, "block").otherwise("allow").alias("action"),
        F.when(~blocked, "none").when(personal, "pii").otherwise("doc_excerpt").alias("reason_code"),
        F.when(blocked, F.when(personal, MESSAGE_PERSONAL).otherwise(MESSAGE_DOCUMENT)).alias("user_message"),
        F.when(blocked, 403).cast("int").alias("http_status"),
    )


def enforced(decision: Column, request_id: Column) -> Column:
    """struct<http_status, body>: the answer to a blocked request; null for one that passes, degraded or not."""
    body = F.to_json(F.struct(F.struct(F.lit("policy_violation").alias("type"), F.coalesce(decision["user_message"], F.lit(MESSAGE_DEFAULT)).alias("message"), decision["reason_code"].alias("reason_code"), request_id.alias("request_id")).alias("error")))
    return F.when(decision["action"] == "block", F.struct(F.coalesce(decision["http_status"], F.lit(403)).alias("http_status"), body.alias("body")))


def unreachable() -> Column:
    """The decision where the detector did not answer: allowed, and marked as such."""
    return F.struct(F.lit("allow_degraded").alias("action"), F.lit("detection_unreachable").alias("reason_code"), F.lit(None).cast("string").alias("user_message"), F.lit(None).cast("int").alias("http_status"))


def valid_request(request_id: Column) -> Column:
    """A request is taken up only with an id of 1 to 200 characters."""
    return F.coalesce(F.length(request_id).between(1, 200), F.lit(False))


def log_rows(decisions: DataFrame, decision_id: Column, ts: Column, service: Column, form: Column, total_ms: Column) -> DataFrame:
    """Decisions as the eighteen columns of the log."""
    extra = {"decision_id": decision_id, "ts": ts, "service": service, "format": form, "total_ms": total_ms}
    return decisions.select(*[extra[c].alias(c) if c in extra else F.col(c) for c in LOGGED])
