"""Prompts in the bodies of requests, and the events made of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email.parser import BytesParser
from email.policy import HTTP

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions.text import normalize_text
from leakloom.session import ship_package

ITEM = "array<struct<type:string,content:string,file_id:string,filename:string,image:string>>"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def responses_contents(body: Column) -> Column:
    """array<struct<type, content, file_id, filename, image>> of a responses-style body (a JSON string).

    ``input`` is a prompt, or a list of prompts and objects whose content is a prompt or a
    list of typed parts: texts, files and images (kept as JSON). Anything else, broken JSON
    too, holds nothing.
    """
    root = F.try_parse_json(body)
    given = F.try_variant_get(root, "$.input", "variant")
    text = lambda v: F.try_variant_get(v, "$", "string")
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    null = F.lit(None).cast("string")

    def item(kind: str, content=null, file_id=null, filename=null, image=null) -> Column:
        return F.struct(F.lit(kind).alias("type"), content.alias("content"), file_id.alias("file_id"), filename.alias("filename"), image.alias("image"))

    def part(v: Column) -> Column:
        kind = F.when(_is(at(v, "$.type"), "STRING"), text(at(v, "$.type")))
        return (
            F.when(kind == "input_text", item("prompt", F.coalesce(text(at(v, "$.text")), F.lit(""))))
            .when(kind == "input_file", item("file", null, text(at(v, "$.file_id")), text(at(v, "$.filename"))))
            .when(kind.isin("input_image", "image_url"), item("image", image=F.to_json(v)))
        )

    empty = F.array().cast(ITEM)

    def entry(v: Column) -> Column:
        content = at(v, "$.content")
        parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), part), lambda x: x.isNotNull())
        return (
            F.when(_is(v, "STRING"), F.array(item("prompt", text(v))).cast(ITEM))
            .when(_is(content, "STRING"), F.array(item("prompt", text(content))).cast(ITEM))
            .otherwise(F.coalesce(parts.cast(ITEM), empty))
        )

    listed = F.flatten(F.transform(F.try_variant_get(given, "$", "array<variant>"), entry))
    return F.when(_is(given, "STRING"), F.array(item("prompt", text(given))).cast(ITEM)).otherwise(F.coalesce(listed, empty))


CHAT = "struct<messages:array<struct<author:struct<role:string>,content:struct<content_type:string,parts:array<string>>>>>"


def chat_prompt(body: Column) -> Column:
    """The users' texts in a chat page's body (a JSON string), joined by line breaks; null if there are none."""
    root = F.try_parse_json(body)
    messages = F.try_variant_get(root, "$.messages", "array<variant>")
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    text = lambda v: F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))

    def parts(m: Column) -> Column:
        mine = (text(at(m, "$.author.role")) == "user") & (text(at(m, "$.content.content_type")) == "text")
        found = F.transform(F.try_variant_get(at(m, "$.content.parts"), "$", "array<variant>"), text)
        return F.when(mine, F.filter(found, lambda p: p.isNotNull() & p.rlike(r"(?U)\S"))).otherwise(F.array().cast("array<string>"))

    said = F.flatten(F.transform(messages, lambda m: F.coalesce(parts(m), F.array().cast("array<string>"))))
    return F.when(F.size(said) > 0, F.array_join(said, "\n"))


def user_prompts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, prompt): each conversation's user turns that are not blank, in order, joined by line breaks."""
    own = turns.filter((F.col(role_col) == "user") & F.col(text_col).rlike(r"(?U)\S"))
    said = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), F.col(text_col).alias("x"))))
    return own.groupBy(F.col(conv_col).alias("conv_id")).agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(said, lambda s: s["x"]), "\n").alias("prompt"))


def checkable_text(contents: Column) -> Column:
    """The normalised text of an event's contents: its items that are texts and not empty, joined by line breaks."""
    said = F.filter(F.transform(contents, lambda c: c["content"]), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(said) > 0, normalize_text(F.array_join(said, "\n"))).otherwise("")


def responses_event(request_id: Column, timestamp: Column, ip: Column, method: Column, endpoint: Column, body: Column) -> Column:
    """The event (JSON) of a responses-style request."""
    contents = responses_contents(body)
    model = F.try_variant_get(F.try_parse_json(body), "$.model", "string")
    return F.to_json(F.struct(request_id.alias("request_id"), timestamp.alias("timestamp"), F.struct(ip.alias("ip")).alias("client"), F.lit("OpenAI").alias("service"), F.struct(method.alias("method"), endpoint.alias("endpoint"), model.alias("model")).alias("request"), contents.alias("contents"), F.struct(F.size(contents).alias("content_count"), F.octet_length(body).alias("body_size")).alias("metadata")))


def file_event(request_id: Column, timestamp: Column, ip: Column, method: Column, endpoint: Column, filename: Column, purpose: Column, text: Column, body_size: Column) -> Column:
    """The event (JSON) of an uploaded file; without text if none could be read from it."""
    item = F.struct(F.lit("file").alias("type"), filename.alias("filename"), purpose.alias("purpose"), text.alias("content"))
    return F.to_json(F.struct(request_id.alias("request_id"), timestamp.alias("timestamp"), F.struct(ip.alias("ip")).alias("client"), F.lit("OpenAI").alias("service"), F.struct(method.alias("method"), endpoint.alias("endpoint")).alias("request"), F.array(item).alias("contents"), F.struct(F.lit(1).alias("content_count"), body_size.alias("body_size")).alias("metadata")))


def multipart_upload(content_type: str | None, body: bytes) -> dict:
    """purpose, filename and file_bytes of an uploaded form; nulls if it is none."""
    out = {"purpose": None, "filename": None, "file_bytes": None, "body_size": len(body)}
    if not re.match(r"multipart/form-data\b", content_type or "", re.IGNORECASE):
        return out
    form = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    for part in form.iter_parts() if form.is_multipart() else ():
        name = part.get_param("name", header="content-disposition")
        if name == "purpose":
            out["purpose"] = part.get_payload(decode=True).decode("utf-8", "ignore").strip()
        elif name == "file":
            out["filename"], out["file_bytes"] = part.get_filename(), part.get_payload(decode=True)
    return out


def uploads(requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, content_type, body) with purpose, filename, file_bytes and body_size of their forms."""
    kind = "request_id string, purpose string, filename string, file_bytes binary, body_size int"
    ship_package(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [multipart_upload(t, b or b"") for t, b in zip(batch["content_type"].to_pylist(), batch["body"].to_pylist(), strict=True)]
            columns = [pa.array([x[c] for x in found], k) for c, k in (("purpose", pa.string()), ("filename", pa.string()), ("file_bytes", pa.binary()), ("body_size", pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["request_id"], *columns], ["request_id", "purpose", "filename", "file_bytes", "body_size"])

    return requests.select(F.col("request_id").cast("string").alias("request_id"), F.col("content_type").cast("string").alias("content_type"), F.col("body").cast("binary").alias("body")).mapInArrow(run, kind)
