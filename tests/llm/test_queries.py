"""Every query of the subpackage as it is registered: its columns, types and rows, against plain versions over a whole table."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leakloom.llm import queries
from tests.llm.test_embeddings import plain as plain_links
from tests.llm.test_embeddings import plain_top
from tests.llm.test_packing import check
from tests.llm.test_secret_scan import plain as plain_base
from tests.llm.test_simhash import plain_components, plain_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def run(spark):
    def run(name, types):
        rows = queries.queries()[name](spark, SF)
        assert dict(rows.dtypes).items() >= types.items()
        return rows.collect()

    return run


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


def digest(text):
    return sha256(text.encode()).hexdigest()


def test_op1(run, table):
    got = run("op1_chat_format", {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"})
    said = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list)
    for r in [*table("conversations"), {"conv_id": -1, "turn": 0, "role": "user", "text": said}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": said}]:
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    assert {r["conv_id"] for r in got} == set(turns) and len(got) == len(turns)
    for r in got:
        own = sorted(turns[r["conv_id"]])
        learnt = "".join(text for _, role, text in own if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(learnt), digest(learnt))
        assert r["turns_sha256"] == digest("".join(f"{role}\n{text}\n" for _, role, text in own))
        assert r["formatted_chars"] >= sum(len(role) + len(text) + 24 for _, role, text in own)


@pytest.mark.parametrize(("name", "modulus", "remainder"), [("op2_toxicity", 5, 0), ("op9_quality_classifier", 3, 1)])
def test_scores(run, table, name, modulus, remainder):
    got = run(name, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in table("documents"))
    assert all(r["held_out"] == held(r["doc_id"], modulus, remainder) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_op3(run, table):
    got = run("op3_embedding_near_dedup", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"})
    expected = plain_links([(r["vec_id"], r["embedding"], r["label"]) for r in table("embeddings")])
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == expected and len(got) == len(expected)


def test_op4(run, table):
    got = run("op4_best_fit_packing", {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    used = check([r.asDict() | {"id": r["doc_id"]} for r in got], [(r["doc_id"], r["text"]) for r in table("documents")], library, 1024)
    assert used <= 1.02 * math.ceil(sum(r["length"] for r in got) / 1024) + 1


def test_op5(run, table):
    got = run("op5_simhash_near_dup", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    docs = table("documents")
    ids, prints = np.array([r["doc_id"] for r in docs]), np.array([plain_print(r["text"] or "", 4) for r in docs], np.uint64)
    expected = plain_components(prints, ids, 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {int(i): (f"{int(p):016x}", int(c)) for i, p, c in zip(ids, prints, expected, strict=True)}


def test_op6(run, table):
    got = run("op6_exact_top_k", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"})
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == plain_top([(r["vec_id"], r["embedding"]) for r in table("embeddings")], 5)


def test_op7(run, table):
    got = {r["doc_id"]: r for r in run("op7_secret_scan", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"})}
    for doc in table("documents"):
        base, r = plain_base(doc["text"] or ""), got[doc["doc_id"]]
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == digest(",".join(written))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("random")] == written
        places = [(int(x.split(":")[1]), ("assign", "access", "hex", "random").index(x.split(":")[0])) for x in spans]
        assert places == sorted(places)


def test_op8(run, table):
    got = {r["doc_id"]: r for r in run("op8_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})}
    docs = table("documents")
    known = {r["lang"] for r in docs if r["lang"] is not None and not held(r["doc_id"], 5, 0)}
    assert set(got) == {r["doc_id"] for r in docs}
    for doc in docs:
        r = got[doc["doc_id"]]
        assert r["held_out"] == held(doc["doc_id"], 5, 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in known if any(map(str.isalpha, doc["text"] or "")) else r["lang_pred"] == "und"


def test_op10(run, table):
    got = {r["doc_id"]: r for r in run("op10_trie_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for doc in table("documents"):
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids
        r = got[doc["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))


def test_pipeline_packs_what_the_stages_leave(spark, run, table):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        came, docs = docs, stage(spark, docs, SF)
        assert docs.columns == came.columns
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = run("pipeline", {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    used = check([r.asDict() | {"id": r["doc_id"]} for r in got], left, library, 1024)
    assert 0 < used <= 1.05 * math.ceil(sum(r["length"] for r in got) / 1024) + 1
    assert 0 < len(left) < len(table("documents"))


def test_stages_of_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0, None), (4, 1, 0), (4, None, 1), (5, 1, 1), (6, 1, 0), (None, 1, 1), (99, 0, 7)], "doc_id long, quality int, toxic int")
    for name, docs in (("awkward", awkward), ("nothing", nothing)):
        for learnt in (labels, labels.limit(0)):
            folder = tmp_path / f"{name}-{learnt.isEmpty()}"
            learnt.write.parquet(f"{folder}/labels.parquet")
            for _, stage in corpus_pipeline.STAGES:
                out = stage(spark, docs, str(folder))
                rows = out.count()
                assert not rows or name == "awkward"
                if stage.__name__ != "packed":
                    assert out.columns == docs.columns and rows <= docs.count()
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
