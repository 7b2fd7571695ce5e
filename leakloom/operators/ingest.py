"""From files to searchable documents: parse, normalise, place blocks, post windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions.text import normalize_text, unwrapped_lines
from leakloom.operators.locate import build_index, described, linearize_table, locate
from leakloom.operators.registry import POSTING
from leakloom.operators.windows import WINDOW, windows
from leakloom.session import checkpointed
from leakloom.sources.formats import read_directory
from leakloom.sources.office import PARSERS, parse_documents


def stem(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def normalized_blocks(parsed: DataFrame, doc_id: Column | None = None) -> DataFrame:
    """Blocks of parsed files, as ``build_index`` takes them, raw and normalised.

    A page of lines becomes its paragraphs; the cells of a table are normalised one by
    one. Files that could not be parsed have no blocks.
    """
    doc_id = stem(F.col("path")) if doc_id is None else doc_id
    rows = parsed.filter("error is null").select(doc_id.alias("doc_id"), "format", F.explode("blocks").alias("b"))
    paged = F.col("b.type") == "page"
    texts = F.when(paged, unwrapped_lines(F.col("b.text"))).otherwise(F.array("b.text"))
    rows = rows.select("doc_id", "format", F.col("b.block_no").alias("_no"), F.when(paged, "paragraph").otherwise(F.col("b.type")).alias("type"), F.col("b.level").alias("level"), F.when(paged, F.col("b.section") + 1).alias("page"), F.when(~paged, F.col("b.section")).alias("section"), F.col("b.rows").alias("raw_rows"), F.posexplode(texts).alias("_part", "raw_text"))
    rows = rows.withColumn("block_no", F.shiftleft(F.col("_no").cast("long"), 20) + F.col("_part")).drop("_no", "_part")
    return _normal_cells(rows.withColumn("normalized_text", F.when(F.col("raw_text").isNotNull(), normalize_text(F.col("raw_text")))))


def _normal_cells(blocks: DataFrame) -> DataFrame:
    """``blocks`` with normalized_rows; the cells of tables alone are taken apart and put together again."""
    tables = blocks.filter("raw_rows is not null").select("doc_id", "block_no", F.posexplode("raw_rows").alias("_row", "_cells")).select("doc_id", "block_no", "_row", F.posexplode("_cells").alias("_col", "_cell"))
    normal = tables.withColumn("_cell", normalize_text(F.col("_cell")))
    rows = normal.groupBy("doc_id", "block_no", "_row").agg(F.array_sort(F.collect_list(F.struct("_col", "_cell"))).alias("_cells")).withColumn("_cells", F.transform("_cells", lambda c: c["_cell"]))
    whole = rows.groupBy("doc_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("_row", "_cells"))).alias("_rows")).select("doc_id", "block_no", F.transform("_rows", lambda r: r["_cells"]).alias("normalized_rows"))
    return blocks.join(whole, ["doc_id", "block_no"], "left")


def document_texts(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): the searchable text of each document, its blocks that have any joined by line breaks."""
    local = F.coalesce(F.when(F.col("type") == "table", linearize_table(F.col("normalized_rows"))).otherwise(F.col("normalized_text")), F.lit(""))
    own = blocks.select("doc_id", "block_no", local.alias("_text")).filter("_text <> ''")
    listed = F.array_sort(F.collect_list(F.struct("block_no", "_text")))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda b: b["_text"]), "\n").alias("text"))


def post(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, doc_id, start, end) of all windows of texts (doc_id, text) that are normalised already."""
    return windows(documents, "doc_id", "text", window).select(*POSTING)


def ingest_files(files: DataFrame, parsers=PARSERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of files (path, content): their documents (doc_id, path, format, error, text), postings, and index of blocks.

    A file is parsed once. A document without a text keeps a row, with an error.
    """
    parsed = checkpointed(parse_documents(files, parsers))
    blocks = normalized_blocks(parsed)
    texts = checkpointed(document_texts(blocks))
    documents = parsed.select(stem(F.col("path")).alias("doc_id"), "path", "format", "error").join(texts, "doc_id", "left")
    documents = documents.withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), "no text")))
    return documents, post(texts), build_index(blocks)


def ingest_directory(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``ingest_files`` of a folder's own docx, xlsx and pdf files."""
    return ingest_files(read_directory(spark, folder))


def located(index: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, start, end, block_index, type, where): places of documents in words."""
    found = locate(index, places)
    return found.select("doc_id", "start", "end", "block_index", "type", described(found).alias("where")).orderBy("doc_id", "start")
