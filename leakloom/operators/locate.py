"""Where in a document a place of its searched text comes from."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakloom.functions.text import WHITE
from leakloom.session import ship_package

CELL_GAP = " | "
#: A run without any white space of Python's \s.
WORD_CHAR = WHITE.replace("[", "[^", 1)
WORD = f"{WORD_CHAR}+"
AROUND = 10
#: Words of a batch that a worker hands back.
ROWS = 1 << 14
#: Which characters are white space, to str.split as to \s; none is beyond these.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def word_positions(text: Column) -> Column:
    """array<struct<index, start, end, word>> of runs without white space.

    One scan of the text in an Arrow batch: texts have tens of thousands of words, and
    ``find_all`` takes ten times as long where nearly all of a text is matches. A batch
    holds the words of all its texts; for a whole table take ``word_rows``.
    """

    @F.pandas_udf("array<struct<index:int,start:int,end:int,word:string>>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else [{"index": i, "start": m.start(), "end": m.end(), "word": m[0]} for i, m in enumerate(re.finditer(r"\S+", x))])

    return words(text)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``text.split()`` start and end."""
    white = _SPACE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(_SPACE) - 1)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def word_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, index, start, end, word) of each run without white space, a row each.

    Workers hand back ``ROWS`` words at most at a time, so a table costs them no more
    memory than its largest text does.
    """
    ship_package(texts.sparkSession)
    rows = texts.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0

            def out() -> pa.RecordBatch:
                owner = np.repeat([x[0] for x in found], [len(x[1]) for x in found])  # noqa: B023
                places = (np.concatenate(x).astype(np.int32) for x in list(zip(*found, strict=True))[1:4])  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *map(pa.array, places), pa.array([w for x in found for w in x[4]], pa.string())], [id_col, "index", "start", "end", "word"])  # noqa: B023

            for k, text in enumerate(batch.column(1)):
                start, end = word_places(text := text.as_py())
                words, a = text.split(), 0
                while a < len(words):
                    b = min(len(words), a + ROWS - held)
                    found.append((k, np.arange(a, b), start[a:b], end[a:b], words[a:b]))
                    held, a = held + b - a, b
                    if held == ROWS:
                        yield out()
                        found, held = [], 0
            if found:
                yield out()

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, index int, start int, end int, word string")


def word_indices(text: Column, start: Column, end: Column) -> Column:
    """array<int>: the words of the text that share a character with start to end, told by counting words before them."""
    words = lambda n: F.regexp_count(F.substring(text, F.lit(1), n), F.lit(WORD))
    inside = F.substring(text, start, F.lit(2)).rlike(rf"\A{WORD_CHAR}{{2}}") & (start > 0)  # the start is inside a word
    first, last = words(start) - F.when(inside, 1).otherwise(0), words(end) - 1
    return F.when(text.isNotNull() & start.isNotNull(), F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))


def linearize_table(rows: Column) -> Column:
    """The text of a table (array<array<string>>): cells joined by a bar, rows by line breaks."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, CELL_GAP)), "\n")


def cell_spans(rows: Column) -> Column:
    """array<struct<row, col, start, end>> of a table's cells in its text, row by row."""
    kind = "array<struct<row:int,col:int,start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("row"), F.array().cast(kind).alias("cells"))

    def add_row(state: Column, row: Column) -> Column:
        inner = F.struct(state["at"].alias("at"), F.lit(0).alias("col"), F.array().cast(kind).alias("cells"))

        def add_cell(s: Column, cell: Column) -> Column:
            end = s["at"] + F.length(cell)
            own = F.array(F.struct(state["row"].alias("row"), s["col"].alias("col"), s["at"].alias("start"), end.alias("end")))
            return F.struct((end + len(CELL_GAP)).alias("at"), (s["col"] + 1).alias("col"), F.concat(s["cells"], own).alias("cells"))

        done = F.aggregate(row, inner, add_cell)
        line = F.length(F.array_join(row, CELL_GAP))
        return F.struct((state["at"] + line + 1).alias("at"), (state["row"] + 1).alias("row"), F.concat(state["cells"], done["cells"]).alias("cells"))

    return F.aggregate(rows, start, add_row, lambda s: s["cells"])


def offset_map(raw: str, normal: str) -> list[int]:
    """For each character of ``normal`` the place in ``raw`` it comes from, about.

    Equal stretches map one to one; a replaced one spreads evenly over what it replaces;
    what was inserted stands at the end of what came before.
    """
    if raw == normal:
        return list(range(len(normal)))
    if not raw:
        return [0] * len(normal)
    out: list[int] = []
    before = 0
    for what, a, b, c, d in difflib.SequenceMatcher(a=raw, b=normal, autojunk=False).get_opcodes():
        if what == "equal":
            out += range(a, b)
        elif what == "replace":
            out += [min(a + k * (b - a) // (d - c), b - 1) for k in range(d - c)]
        elif what == "insert":
            out += [before] * (d - c)
        if what != "insert":
            before = b
    return out


def with_offset_map(rows: DataFrame, raw_col: str, normal_col: str, name: str = "offset_map") -> DataFrame:
    """``rows`` with the offset map of each; null, for the identity, where the texts are equal. Those never reach Python's differ."""

    @F.pandas_udf("array<int>")
    def mapped(raw: pd.Series, normal: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else offset_map(r or "", n) for r, n in zip(raw, normal, strict=True)])

    raw, normal = F.coalesce(F.col(raw_col), F.lit("")), F.coalesce(F.col(normal_col), F.lit(""))
    changed = raw != normal
    return rows.withColumn(name, mapped(F.when(changed, raw), F.when(changed, normal)))


def build_index(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_no, type, normalized_text, raw_text, normalized_rows, raw_rows, ...) with their places.

    Adds block_index, local_text, raw_local_text, global_start, global_end, cells and
    offset_map (null for the identity). Words are counted where a place asks for them. Blocks without text are left out; the document's text is the others
    joined by line breaks, so each starts one past the end of the one before.
    """
    table = F.col("type") == "table"
    local = F.coalesce(F.when(table, linearize_table(F.col("normalized_rows"))).otherwise(F.col("normalized_text")), F.lit(""))
    raw = F.coalesce(F.when(table, linearize_table(F.col("raw_rows"))).otherwise(F.col("raw_text")), F.lit(""))
    rows = blocks.withColumn("local_text", local).withColumn("raw_local_text", raw).filter(F.col("local_text") != "")
    order = Window.partitionBy("doc_id").orderBy("block_no")
    before = F.coalesce(F.sum(F.length("local_text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("block_index", F.row_number().over(order) - 1).withColumn("global_start", before.cast("int")).withColumn("global_end", (F.col("global_start") + F.length("local_text")).cast("int"))
    placed = placed.withColumn("cells", F.when(table, cell_spans(F.col("normalized_rows"))))
    return with_offset_map(placed, "raw_local_text", "local_text")


def locate(index: DataFrame, places: DataFrame) -> DataFrame:
    """For each of ``places`` (doc_id, start, end; end may be null) where it lies, or nulls if in no block.

    A place belongs to the block that its start lies in; the character that joins two
    blocks is in none. Adds block_index, type, local_start, local_end, raw_start, raw_end,
    raw_snippet, word_indices and cell. The range condition rides on the equi-join by
    document.
    """
    asked = places.withColumn("_end", F.coalesce("end", F.col("start") + 1)).withColumn("_id", F.monotonically_increasing_id())
    own = index.withColumnRenamed("doc_id", "_doc")
    hit = asked.join(own, (F.col("doc_id") == F.col("_doc")) & (F.col("start") >= F.col("global_start")) & (F.col("start") < F.col("global_end")), "left")
    start = (F.col("start") - F.col("global_start")).cast("int")
    end = F.greatest(start + 1, F.least(F.col("_end") - F.col("global_start"), F.length("local_text"))).cast("int")
    hit = hit.withColumn("local_start", start).withColumn("local_end", end)
    raw_start = F.coalesce(F.get("offset_map", F.col("local_start")), F.col("local_start"))
    raw_end = F.coalesce(F.get("offset_map", F.least(F.col("local_end"), F.size("offset_map")) - 1) + 1, F.col("local_end"))
    hit = hit.withColumn("raw_start", raw_start).withColumn("raw_end", raw_end)
    from_ = F.greatest(F.col("raw_start") - AROUND, F.lit(0))
    snippet = F.when(F.col("raw_local_text") != "", F.substring("raw_local_text", from_ + 1, F.least(F.length("raw_local_text"), F.col("raw_end") + AROUND) - from_))
    words = word_indices(F.col("local_text"), F.col("local_start"), F.col("local_end"))
    cell = F.get(F.filter("cells", lambda c: (c["start"] <= F.col("local_start")) & (F.col("local_start") < c["end"])), F.lit(0))
    extra = [c for c in ("page", "section") if c in index.columns]
    return hit.select(*places.columns, "block_index", "type", *extra, "local_start", "local_end", "raw_start", "raw_end", snippet.alias("raw_snippet"), words.alias("word_indices"), cell.alias("cell"))


def described(located: DataFrame) -> Column:
    """One line that tells people where a located place is."""
    # What people are told.
    has = lambda c: F.col(c) if c in located.columns else F.lit(None)
    bits = F.concat_ws(
        ", ",
        F.when(has("page").isNotNull(), F.concat(has("page").cast("string"), F.lit("페이지"))),
        F.when(has("section").isNotNull(), F.concat(F.lit("섹션 "), has("section").cast("string"))),
        F.concat(F.col("block_index").cast("string"), F.lit("번 블록("), F.col("type"), F.lit(")")),
        F.when(F.col("cell").isNotNull(), F.concat((F.col("cell.row") + 1).cast("string"), F.lit("행 "), (F.col("cell.col") + 1).cast("string"), F.lit("열"))),
        F.when(F.size("word_indices") > 0, F.concat(F.lit("단어 #"), F.col("word_indices")[0].cast("string"))),
    )
    return F.when(F.coalesce(F.col("raw_snippet"), F.lit("")) != "", F.concat(bits, F.lit(" - 원문: ..."), F.col("raw_snippet"), F.lit("..."))).otherwise(bits)

