import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakloom.functions import spans, text


def normal(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["n"] for r in df.select("k", text.normalize_text(F.col("t")).alias("n")).orderBy("k").collect()]


CASES = [
    ("A\u00a0\u00a0B\u3000C\u200bD\tE", "A B CD E"),
    ("\u201cNDA\u201d \u2013 \u2018draft\u2019 \u2022 bullet", "\"NDA\" - 'draft' - bullet"),
    ("line1\r\nline2\rline3", "line1\nline2\nline3"),
    ("a\x00b\x01c\x1fd\x7fe", "abcde"),
    (None, ""),
    ("", ""),
    ("\u1112\u1161\u11ab\u1100\u1173\u11af", "한글"),
    ("a  \nb\n\n\n\nc   d", "a\nb\n\nc d"),
    ("\n \u2028 x \u1680\u0085\n", "x"),
    ("\u00b7\u2043●▪", "----"),
    ("e\u200b\u0301", "e\u0301"),
    ("① \u216b Ａ", "① \u216b Ａ"),
]


def test_normalisation(spark):
    assert normal(spark, [a for a, _ in CASES]) == [b for _, b in CASES]


def test_a_second_pass_may_change_a_text(spark):
    once = normal(spark, ["e\u200b\u0301"])
    assert normal(spark, once) == ["é"] != once


def plain_normal(x):
    x = unicodedata.normalize("NFC", x.replace("\r\n", "\n").replace("\r", "\n"))
    x = "".join(c for c in x if c not in text.INVISIBLE and not (ord(c) < 32 and c not in "\t\n" or ord(c) == 127))
    x = "".join(" " if c in text.SPACES else "'" if c in text.APOSTROPHES else '"' if c in text.QUOTES else "-" if c in text.DASHES + text.BULLETS else c for c in x)
    x = re.sub(" +\n", "\n", x)
    return re.sub("\n{3,}", "\n\n", re.sub(" {2,}", " ", x)).strip()


def test_normalisation_by_chance(spark):
    import random

    g = random.Random(1)
    letters = text.INVISIBLE + text.SPACES + text.QUOTES + text.DASHES + text.BULLETS + "\r\n\n  abé\u0301\u1112\u1161\u11ab\x00\x1f\x85\u2028\u1680x😀"
    texts = ["".join(g.choice(letters) for _ in range(g.randrange(30))) for _ in range(500)]
    assert normal(spark, texts) == [plain_normal(t) for t in texts]


def test_compaction(spark):
    df = spark.createDataFrame([("Ab | 1,가\tZㄱé漢.",), ("",), ("...",)], "t string")
    rows = df.select(text.compact_text(F.col("t")), text.compact_with_offsets(F.col("t")), text.kept_length(F.col("t")), text.window_count(F.col("t"), 3)).collect()
    assert [r[0] for r in rows] == ["ab1가z", "", ""]
    assert [(x["ch"], x["off"]) for x in rows[0][1]] == [("a", 0), ("b", 1), ("1", 5), ("가", 7), ("z", 9)]
    assert [r[2] for r in rows] == [10, 0, 0] and [r[3] for r in rows] == [3, 0, 0]


def test_without_white_space(spark):
    df = spark.createDataFrame([("010 - 1234\n5678\u2003x",)], "t string")
    assert df.select(text.normalize_for_matching(F.col("t"))).first()[0] == "010-12345678x"


@pytest.mark.parametrize(
    "lines,paragraphs",
    [
        ("A wrapped\nline.\nNext one", ["A wrapped line.", "Next one"]),
        ("hyphen-\nated word", ["hyphenated word"]),
        ("one\n\ntwo\n\n\nthree", ["one", "two", "three"]),
        ("intro\n- item\n1) other", ["intro", "- item", "1) other"]),
        ("ﬁne ﬂow\u00ad", ["fine flow"]),
        ("", []),
    ],
)
def test_unwrapping(spark, lines, paragraphs):
    assert spark.createDataFrame([(lines,)], "t string").select(text.unwrapped_lines(F.col("t"))).first()[0] == paragraphs


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["ab", "a", "x1", "😀", "-", "12"]), max_size=12).map("".join))
def test_positions(spark, t):
    pattern = r"(?<!x)[a-z]\d?|\d+"
    got = spark.createDataFrame([(t,)], "t string").select(spans.find_all(F.col("t"), pattern)).first()[0]
    assert [(m["start"], m["end"], m["value"]) for m in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)]


def test_masks_spans_and_slices(spark):
    df = spark.createDataFrame([("ab 12 cd 345", 3, 5)], "t string, a int, b int")
    row = df.select(spans.mask(F.col("t"), spans.find_all(F.col("t"), r"\d+")), spans.span_text(F.col("t"), F.col("a"), F.col("b")), spans.span_label(F.col("a"), F.col("b")), spans.parse_span(F.lit("3-5")), spans.occurrences(F.lit("aaa"), "aa")).first()
    assert row[0] == "ab ** cd ***" and row[1] == "12" and row[2] == "3-5" and tuple(row[3]) == (3, 5) and row[4] == [0, 1]
    with pytest.raises(Exception, match="bad span"):
        df.select(spans.span_text(F.col("t"), F.lit(-1), F.col("b"))).collect()
