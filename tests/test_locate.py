import difflib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakloom.operators import locate

ROWS = [["name", "n"], ["kim", "12"], ["", "x y"]]


def test_words_and_tables(spark):
    df = spark.createDataFrame([("  ab \n가나 c",)], "t string").withColumn("r", F.array(*[F.array(*map(F.lit, r)) for r in ROWS]))
    row = df.select(locate.word_positions(F.col("t")).alias("w"), locate.linearize_table(F.col("r")).alias("x"), locate.cell_spans(F.col("r")).alias("c")).first()
    assert [(w["index"], w["start"], w["end"], w["word"]) for w in row["w"]] == [(0, 2, 4, "ab"), (1, 6, 8, "가나"), (2, 9, 10, "c")]
    assert row["x"] == "name | n\nkim | 12\n | x y"
    assert [row["x"][c["start"] : c["end"]] for c in row["c"]] == [x for r in ROWS for x in r]
    assert [(c["row"], c["col"]) for c in row["c"]] == [(i, j) for i in range(3) for j in range(2)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=12), st.text("ab -", max_size=12))
def test_offset_maps(raw, normal):
    got = locate.offset_map(raw, normal)
    assert len(got) == len(normal) and all(0 <= x <= len(raw) for x in got)
    for a, b, n in difflib.SequenceMatcher(a=raw, b=normal, autojunk=False).get_matching_blocks():
        assert got[b : b + n] == list(range(a, a + n))


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("d", 0, "heading", "Title  here", "Title here", None, None, 1, None),
        ("d", 1, "paragraph", "", "", None, None, 1, None),
        ("d", 2, "table", None, None, ROWS, ROWS, 2, 0),
        ("d", 3, "paragraph", "last", "last", None, None, 2, None),
        ("e", 0, "paragraph", "other", "other", None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, "doc_id string, block_no int, type string, raw_text string, normalized_text string, raw_rows array<array<string>>, normalized_rows array<array<string>>, page int, section int")
    return locate.build_index(blocks).cache()


def test_blocks_have_their_places(index):
    rows = index.filter("doc_id = 'd'").orderBy("block_index").collect()
    assert [(r["block_index"], r["global_start"], r["global_end"]) for r in rows] == [(0, 0, 10), (1, 11, 35), (2, 36, 40)]
    assert "\n".join(r["local_text"] for r in rows) == "Title here\nname | n\nkim | 12\n | x y\nlast"


def test_locating(spark, index):
    asked = [("d", 6, 10), ("d", 10, None), ("d", 20, 23), ("d", 39, 99), ("d", 40, None), ("d", -1, None), ("x", 0, None), ("e", 1, None)]
    rows = {(r["doc_id"], r["start"]): r for r in locate.locate(index, spark.createDataFrame(asked, "doc_id string, start int, end int")).collect()}
    assert len(rows) == len(asked)
    at = rows["d", 6]
    assert (at["block_index"], at["local_start"], at["local_end"], at["raw_start"], at["raw_end"], at["word_indices"], at["raw_snippet"]) == (0, 6, 10, 7, 11, [1], "Title  here")
    assert rows["d", 10]["block_index"] is None and rows["d", 40]["block_index"] is None and rows["d", -1]["block_index"] is None and rows["x", 0]["block_index"] is None
    cell = rows["d", 20]["cell"]
    assert (cell["row"], cell["col"]) == (1, 0) and rows["d", 39]["local_end"] == 4 and rows["e", 1]["block_index"] == 0
    told = locate.locate(index, spark.createDataFrame([("d", 20, 23)], "doc_id string, start int, end int"))
    assert told.select(locate.described(told)).first()[0].startswith("2페이지, 섹션 0, 1번 블록(table), 2행 1열, 단어 #")


def test_words_by_rows(spark, monkeypatch):
    monkeypatch.setattr(locate, "ROWS", 3)
    texts = [(1, "  ab \n가나 c"), (2, "a b c d e f g"), (3, ""), (4, None), (5, " x\x1cy 😀z ")]
    rows = locate.word_rows(spark.createDataFrame(texts, "k long, t string"), "k", "t").collect()
    assert sorted(tuple(r) for r in rows) == [(k, i, m.start(), m.end(), m[0]) for k, t in texts for i, m in enumerate(re.finditer(r"\S+", t or ""))]


def test_words_come_in_bounded_batches(spark):
    """One text's words, too many for a batch, leave a worker in several."""
    df = spark.createDataFrame([(1, "w " * 3 * locate.ROWS)], "k long, t string")
    sizes = locate.word_rows(df, "k", "t").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 3 * locate.ROWS and max(r["n"] for r in sizes) <= locate.ROWS
