"""What kind of file a file is, by its first bytes and, for archives, its directory."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signatures, and the parts that tell office formats apart.
PDF = b"%PDF-"
ARCHIVES = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
PARTS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml"}
ENCRYPTED = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
HOSTS = {
    "chatgpt.com": "ChatGPT",
    "openai.com": "ChatGPT/OpenAI",
    "oaistatic.com": "ChatGPT/OpenAI",
    "oaiusercontent.com": "ChatGPT/OpenAI",
    "gemini.google.com": "Gemini",
    "claude.ai": "Claude",
    "anthropic.com": "Claude/Anthropic",
}


def archive_kind(content: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = set(archive.namelist())
    except zipfile.BadZipFile:
        return "zip-unknown"
    return next((kind for kind, part in PARTS.items() if part in names), "zip-unknown")


def detect_format(content: Column) -> Column:
    """pdf, docx, xlsx, zip-unknown or binary-unknown; only archives are opened, in Python."""

    @F.pandas_udf("string")
    def opened(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: None if x is None else archive_kind(bytes(x)))

    head = lambda n: F.substring(content, 1, n)
    archive = head(4).isin(*[F.lit(bytearray(x)) for x in ARCHIVES])
    return F.when(head(len(PDF)) == F.lit(bytearray(PDF)), "pdf").when(archive, opened(F.when(archive, content))).otherwise("binary-unknown")


def routed(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with format, route (document, text or failure) and text, for files of plain text.

    Unknown archives fail; whatever else is not a document is text if it is UTF-8.
    """
    rows = files.withColumn("format", detect_format(F.col("content")))
    text = F.expr("try_validate_utf8(cast(content AS string))")
    route = F.when(F.col("format").isin("pdf", "docx", "xlsx"), "document").when((F.col("format") == "zip-unknown") | text.isNull(), "failure").otherwise("text")
    return rows.withColumn("route", route).withColumn("text", F.when(F.col("route") == "text", text))


def read_directory(spark, path: str, glob: str = "*.{docx,xlsx,pdf}") -> DataFrame:
    """(path, content) of a folder's own files of these names, in order of path; no folders below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path)
    return files.select("path", "content").orderBy("path")


def extension_route(path: Column) -> Column:
    """docx, xlsx or pdf by the ending of the path, in any case; null for other files."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending.isin("docx", "xlsx", "pdf"), ending)


def bare_path(path: Column) -> Column:
    """A path without the scheme of local files, which Spark writes in more ways than one."""
    return F.regexp_replace(path, "^file:/+", "/")


def exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_file(spark, value: str) -> bool:
    """Whether a string names a file; what can't be a path, too long or malformed, is text."""
    if not value or len(value) > 4096 or "\0" in value or "\n" in value:
        return False
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(value)
        return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(path))
    except Exception:  # whatever the file system makes of it, it is no file
        return False


def process_input(spark, value: str) -> DataFrame:
    """One row (path, content, format, route, text) of an input: a file by what it holds, anything else as text."""
    if is_file(spark, value):
        return routed(spark.read.format("binaryFile").load(value).select("path", "content"))
    return spark.createDataFrame([(None, None, "text", "text", value)], "path string, content binary, format string, route string, text string")


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def service_for_host(host: Column, hosts: dict[str, str] = HOSTS) -> Column:
    """The service of the first domain that the host is or lies under; null for others."""
    host = F.lower(host)
    out = F.lit(None).cast("string")
    for domain, service in reversed(hosts.items()):
        out = F.when((host == domain) | F.endswith(host, F.lit(f".{domain}")), service).otherwise(out)
    return out
