import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leakloom.llm import byte_tokens, packing
from leakloom.llm.byte_tokens import ByteTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return ByteTokenizer(f.read())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "don't", "é", "x", "1", "#", "​", "\x1c", "\x85"]), max_size=20).map("".join))
def test_ids_are_the_library_s(library, own, text):
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20), st.integers(1, 12), st.sampled_from([0.1, 0.25, 0.6]))
def test_a_plan_holds_each_length_as_often_as_there_is(counts, groups, large):
    plan = packing.plan(counts, 64, groups, large)
    held = Counter()
    for slots, times in plan:
        assert times > 0 and sum(a * n for a, n in slots) <= 64
        for length, n in slots:
            held[length] += n * times
    assert held == Counter({k: v for k, v in counts.items() if v})
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in plan) >= -(-total // 64)


def test_few_sequences():
    counts = {k: 50 + 3 * k % 17 for k in range(1, 1025)}
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in packing.plan(counts)) <= 1.01 * -(-total // 1024)


def test_wrong_lengths_are_errors():
    with pytest.raises(ValueError):
        packing.plan({0: 1})
    with pytest.raises(ValueError):
        packing.plan({1025: 1})


def check(rows, docs, library, capacity):
    expected = Counter()
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        edges = [0, len(ids)] if len(ids) <= capacity else [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            expected[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_awkward_documents(spark, awkward, nothing, library):
    rows = packing.pack_documents(awkward, PATH).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in awkward.collect()], library, 1024)
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_whole_table_and_hot_lengths(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    hot = docs.unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit("the very same text").alias("text")))
    pieces = packing.checkpointed(packing.tokenized_pieces(hot, PATH).select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    rows = packing.packed(pieces, ranked=50).collect()
    used = check(rows, [(r["doc_id"], r["text"]) for r in hot.collect()], library, 1024)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


@pytest.mark.parametrize("white", [" ", "\n", " \n"])
def test_long_runs_of_white_space(white, monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        tokens = byte_tokens.ByteTokenizer(f.read())
    for text in (f"a{white * 30}b", f"{white * 30}", f"a{white * 30}", f"{white * 30}9{white * 30}!", "".join([f"a{white * 30}", *tokens.special, white * 30])):
        for encode in (tokens.encode, tokens.encode_ordinary):
            whole = encode(text).tolist()
            with monkeypatch.context() as m:
                m.setattr(byte_tokens, "WHITE", re.compile(r"\s{10,}"))
                assert encode(text).tolist() == whole
    assert tokens.tables.decode(tokens.encode(" " * 2_000_000 + "x").tolist()) == " " * 2_000_000 + "x"
