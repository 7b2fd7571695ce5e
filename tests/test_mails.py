import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from leakloom.functions import recognizers
from leakloom.plans import catalog, oracles

#: Addresses beside what the look-around of ``PERSONAL_DATA`` rejects.
TOUCHED = [
    "Write to a.b@example.com.", "x@y.de, z@y.de; müller@example.de", "가a@example.com", "a@b.com_x@c.de", "a@b.com-", "a@b.com+c@d.fr", "a@b.com2 a@b.c a@.com", "100%a@b.com%", "a@b.commé", "a@b@c.de@e.fr",
    "a@b.com\nc@d.es. e@f.fr", "@b.com", "", None, "..a..@b..com..", "no address",
]


@pytest.fixture(scope="module")
def touched(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("touched"))
    spark.createDataFrame(list(enumerate(TOUCHED)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["email_hits", "mask_hits", "pii_summary"])
def test_addresses_that_something_touches(spark, touched, name):
    df = catalog.queries()[name](spark, touched)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{touched}/documents.parquet/*.parquet')")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    expected = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))


def test_plain_addresses_by_chance(spark):
    g = random.Random(3)
    texts = ["".join(g.choice("ab.@@-_%9é 가c") for _ in range(g.randrange(4, 60))) + g.choice(["", "a@bc.de", "@bb.cc"]) * 2 for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    hits = df.select("k", recognizers.PLAIN_EMAIL.hits(F.col("t"), F.current_date()).alias("h")).collect()
    found = {r["k"]: [(h["start"], h["end"]) for h in r["h"]] for r in hits}
    assert found == {k: [m.span() for m in re.finditer(oracles.EMAIL, t)] for k, t in enumerate(texts)} and sum(map(len, found.values())) > 1000


def test_long_runs_take_no_square(spark):
    df = spark.createDataFrame([("a" * 1_000_000 + " x@y.de",)], "t string")
    assert len(df.select(recognizers.PLAIN_EMAIL.hits(F.col("t"), F.current_date()).alias("h")).first()["h"]) == 1
