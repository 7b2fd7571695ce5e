"""The registry of protected documents: its states, and the postings of its windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions.text import normalize_text
from leakloom.operators import overlap
from leakloom.operators.windows import WINDOW, changed_windows, windows
from leakloom.session import checkpointed, ship_package

POSTING = ["hash", "doc_id", "start", "end"]
#: Windows in as many documents as this identify none of them.
SHARED_BY = 2


def build_postings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(hash, doc_id, start, end) of all windows of the documents' normalised texts."""
    normal = documents.select(F.col(id_col).alias("doc_id"), normalize_text(F.col(text_col)).alias("_normal"))
    return windows(normal, "doc_id", "_normal", window).select(*POSTING)


def identifying(postings: DataFrame) -> DataFrame:
    """The postings whose window stands in one document only, however often it stands there.

    The smallest and largest document tell that without a distinct count, and are
    aggregated before the shuffle, so a line that all documents share costs one row a task.
    """
    single = postings.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a = b").select("hash")
    return postings.join(single, "hash", "left_semi")


def identifying_counts(postings: DataFrame) -> DataFrame:
    """(doc_id, n_postings) of the postings that identify a document: one pass over the postings, one combined shuffle."""
    of_hash = postings.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).filter("doc_id = b")
    return of_hash.groupBy("doc_id").agg(F.sum("n").alias("n_postings"))


def identifying_counts_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``identifying_counts`` of documents that have no postings yet: where their ids are whole numbers, no posting is shuffled."""
    if not overlap.compares(documents, id_col, window):
        return identifying_counts(build_postings(documents, id_col, text_col, window))
    return overlap.identifying_counts(documents.select(id_col, normalize_text(F.col(text_col)).alias("_normal")), id_col, "_normal", window)


def shared_windows(postings: DataFrame) -> DataFrame:
    """(hash, n_docs) of the windows that identify no document."""
    return postings.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= SHARED_BY)


def shared_counts_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(n_docs, n_windows): how many windows of the documents stand in so many of them, two at least."""
    if not overlap.compares(documents, id_col, window):
        return shared_windows(build_postings(documents, id_col, text_col, window)).groupBy("n_docs").agg(F.count(F.lit(1)).alias("n_windows"))
    return overlap.shared_counts(documents.select(id_col, normalize_text(F.col(text_col)).alias("_normal")), id_col, "_normal", window)


def _side_by_side(one: DataFrame, other: DataFrame) -> DataFrame:
    """Each posting of either index once, with ``x`` where the first has it and ``y`` where the other does.

    Both sides are read once and meet in one aggregate, which combines repeats before the shuffle.
    """
    yes, no = F.lit(True), F.lit(False)
    both = one.select(*POSTING, yes.alias("x"), no.alias("y")).unionByName(other.select(*POSTING, no.alias("x"), yes.alias("y")))
    return both.groupBy(*POSTING).agg(F.max("x").alias("x"), F.max("y").alias("y"))


def postings_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to add and what to remove to get from ``old`` to ``new``."""
    changed = checkpointed(_side_by_side(old, new).filter("x <> y"))
    return changed.filter("y").select(*POSTING), changed.filter("x").select(*POSTING)


def changed_counts(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_added, n_removed): how many postings ``postings_diff`` would add and remove, of documents that it changes.

    A posting names its document, so it is enough that both states of a document meet:
    their texts are dealt out by id, and only those that differ are cut into windows.
    """
    ship_package(old.sparkSession)
    state = lambda df, is_new: df.select(F.col(id_col).alias("doc_id"), F.lit(is_new).alias("_new"), normalize_text(F.col(text_col)).alias("_text"))
    both = state(old, False).unionByName(state(new, True)).repartition("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, texts = None, False, (set(), set())
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            found = []
            for doc_id, new, text in zip(*batch.columns, strict=True):
                doc_id = doc_id.as_py()
                if not known or doc_id != at:
                    if texts[0] != texts[1]:
                        found.append((at, *changed_windows(*texts, window)))
                    at, known, texts = doc_id, True, (set(), set())
                texts[new.as_py()].add(text.as_py())
            yield _counted(found, kind)
        if texts[0] != texts[1]:
            yield _counted([(at, *changed_windows(*texts, window))], kind)

    counted = both.mapInArrow(run, f"doc_id {both.schema['doc_id'].dataType.simpleString()}, n_added long, n_removed long")
    return counted.filter("n_added > 0 or n_removed > 0")


def _counted(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [list(x) for x in zip(*found, strict=True)] or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (kind, pa.int64(), pa.int64()), strict=True)], ["doc_id", "n_added", "n_removed"])


def replace_postings(current: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """``current`` with the postings of ``documents`` (doc_id) replaced by ``new``.

    Written as a new version of the table and swapped in, there is no time in which a
    document is not covered; done twice it comes to the same.
    """
    ids = documents.select("doc_id").distinct()
    return current.select(*POSTING).join(ids, "doc_id", "left_anti").select(*POSTING).unionByName(new.select(*POSTING).join(ids, "doc_id", "left_semi").select(*POSTING).distinct())


def retire_document(postings: DataFrame, doc_id) -> tuple[DataFrame, DataFrame]:
    """The postings without a document's, and how many those were (one row: removed)."""
    mine = F.col("doc_id").eqNullSafe(F.lit(doc_id))
    return postings.filter(~mine), postings.agg(F.count_if(mine).alias("removed"))


def in_both(one: DataFrame, other: DataFrame) -> DataFrame:
    """The postings that two indexes share, each once."""
    return one.select(*POSTING).intersect(other.select(*POSTING))


def all_postings(*parts: DataFrame) -> DataFrame:
    """The postings of all parts, each once."""
    out = parts[0].select(*POSTING)
    for part in parts[1:]:
        out = out.unionByName(part.select(*POSTING))
    return out.distinct()


def append_postings(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` and ``new`` without looking at what is there; what both hold stays once."""
    return all_postings(current, new)


def delete_postings(current: DataFrame, gone: DataFrame) -> DataFrame:
    """``current`` without the postings of ``gone``, whether it has them or not."""
    return current.select(*POSTING).join(gone.select(*POSTING), POSTING, "left_anti")


def index_totals(current: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents and windows that the registry counts for active documents, those that the index has, and whether they agree.

    An index holds a window of a document once however often it stands there, so its
    postings are counted by place.
    """
    active = current.filter("status = 'active'").agg(F.count_if(F.col("index_status") == "indexed").alias("documents"), F.coalesce(F.sum("index_windows"), F.lit(0)).cast("long").alias("windows"))
    own = postings.join(current.filter("status = 'active'").select("doc_id"), "doc_id", "left_semi").select(*POSTING).distinct()
    there = own.agg(F.count_distinct("doc_id").alias("indexed_documents"), F.count(F.lit(1)).alias("indexed_windows"))
    both = active.crossJoin(there)  # one row each
    return both.withColumn("ok", (F.col("documents") == F.col("indexed_documents")) & (F.col("windows") == F.col("indexed_windows")))


# --- the ledger: what stands in the index, by document ----------------------------


def windows_of(postings: DataFrame, doc_id) -> DataFrame:
    """(hash, start, end) of a document, in order of start."""
    return postings.filter(F.col("doc_id").eqNullSafe(F.lit(doc_id))).select("hash", "start", "end").orderBy("start", "end", "hash")


def ledger_upsert(ledger: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``ledger`` with ``rows`` in place of those of the same key; several rows of one key are an error."""
    other = [c for c in ledger.columns if c != key]
    once = rows.groupBy(key).agg(*[F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several rows of one document"))).otherwise(F.first(c)).alias(c) for c in other])
    return ledger.join(rows.select(key), key, "left_anti").select(*ledger.columns).unionByName(once.select(*ledger.columns))


def ledger_counts(postings: DataFrame) -> DataFrame:
    """(doc_id, windows) of each document in the ledger."""
    return postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"))


def index_parity(one: DataFrame, other: DataFrame) -> DataFrame:
    """Per document: postings in both, only in the first, only in the second."""
    both = _side_by_side(one, other)
    return both.groupBy("doc_id").agg(F.count_if(F.col("x") & F.col("y")).alias("in_both"), F.count_if(~F.col("y")).alias("only_first"), F.count_if(~F.col("x")).alias("only_second"))


# --- states ----------------------------------------------------------------------

SUPPORTED = ("pdf", "docx", "xlsx")


def register(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The registry after ``incoming`` (doc_id, filename, original, format, title, classification, registered_by).

    All columns of ``current`` and ``outcome``: created, updated, unchanged, or null where
    nothing came in. Same bytes of an active document without an error only fill in
    metadata; anything else counts the version up and has it indexed again. Formats that
    are not supported, empty ids and several rows of one id are errors.
    """
    bad = ~F.col("format").isin(*SUPPORTED) | F.col("format").isNull() | (F.coalesce(F.col("doc_id"), F.lit("")) == "")
    once = incoming.withColumn("doc_id", F.when(bad, F.raise_error(F.lit("unsupported document"))).otherwise(F.col("doc_id")))
    once = once.groupBy("doc_id").agg(*[F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several versions of one document"))).otherwise(F.first(c)).alias(c) for c in once.columns if c != "doc_id"])
    came = once.select("doc_id", *[F.col(c).alias(f"_{c}") for c in once.columns if c != "doc_id"], F.lit(True).alias("_came"))
    both = current.join(came, "doc_id", "full_outer")
    new, came_in = F.col("version").isNull(), F.col("_came").isNotNull()
    same = F.col("original").eqNullSafe(F.col("_original")) & (F.col("status") == "active") & (F.col("index_status") != "error")
    outcome = F.when(~came_in, F.lit(None)).when(new, "created").when(same, "unchanged").otherwise("updated")
    changed = outcome.isin("created", "updated")
    either = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    after = {
        "filename": F.when(changed, F.col("_filename")).otherwise(F.col("filename")),
        "original": F.when(changed, F.col("_original")).otherwise(F.col("original")),
        "version": F.when(new, 1).when(outcome == "updated", F.col("version") + 1).otherwise(F.col("version")).cast("int"),
        "title": F.when(came_in, either("title")).otherwise(F.col("title")),
        "classification": F.when(came_in, either("classification")).otherwise(F.col("classification")),
        "status": F.when(changed, F.lit("active")).otherwise(F.col("status")),
        "index_status": F.when(changed, F.lit("pending")).otherwise(F.col("index_status")),
        "index_error": F.when(changed, F.lit(None)).otherwise(F.col("index_error")),
        "registered_at": F.when(changed, now).otherwise(F.col("registered_at")),
        "registered_by": F.when(changed, F.col("_registered_by")).otherwise(F.col("registered_by")),
        "retired_at": F.when(changed, F.lit(None)).otherwise(F.col("retired_at")),
    }
    return both.select(*[after[c].alias(c) if c in after else F.col(c) for c in current.columns], outcome.alias("outcome"))


def retire(current: DataFrame, ids: list, now: Column) -> DataFrame:
    """Active documents of these ids are retired and wait to be taken out of the index."""
    hit = F.col("doc_id").isin(*ids) & (F.col("status") == "active")
    return current.withColumns({"status": F.when(hit, "retired").otherwise(F.col("status")), "retired_at": F.when(hit, now).otherwise(F.col("retired_at")), "index_status": F.when(hit, "pending").otherwise(F.col("index_status")), "index_error": F.when(hit, F.lit(None)).otherwise(F.col("index_error"))})


def request_reindex(current: DataFrame, ids: list | None = None) -> DataFrame:
    """Documents (all, or of these ids) wait to be indexed again, unless they just are."""
    hit = (F.col("index_status") != "indexing") & (F.col("doc_id").isin(*ids) if ids is not None else F.lit(True))
    return current.withColumns({"index_status": F.when(hit, "pending").otherwise(F.col("index_status")), "index_error": F.when(hit, F.lit(None)).otherwise(F.col("index_error"))})


def recover(current: DataFrame) -> DataFrame:
    """What was being indexed when a run ended waits again."""
    return current.withColumn("index_status", F.when(F.col("index_status") == "indexing", "pending").otherwise(F.col("index_status")))


def pending(current: DataFrame) -> DataFrame:
    """What waits to be indexed, first come first."""
    return current.filter("index_status = 'pending'").orderBy("registered_at", "doc_id")


def claim(current: DataFrame, n: int = 1) -> DataFrame:
    """``current`` with the first ``n`` documents that wait now being indexed; ``claimed`` tells which.

    Written as the table's next version by the one job that claims, so no two have the
    same document.
    """
    first = pending(current).limit(n).select("doc_id", F.lit(True).alias("_mine"))
    both = current.join(F.broadcast(first), "doc_id", "left")  # n rows
    mine = F.col("_mine").isNotNull()
    return both.withColumn("index_status", F.when(mine, "indexing").otherwise(F.col("index_status"))).withColumn("claimed", mine).drop("_mine")


def index_pending(current: DataFrame, postings: DataFrame, parse, now: Column, n: int = 16) -> tuple[DataFrame, DataFrame, bool]:
    """One turn of the indexer: registry and postings after it, and whether there was anything to do.

    ``parse`` makes (doc_id, text, error) of the claimed documents (doc_id, filename,
    original); one that is retired only loses its postings. What was left half done by a
    run that ended is claimed again after ``recover``.
    """
    taken = checkpointed(claim(current, n))
    mine = taken.filter("claimed")
    if mine.isEmpty():
        return current, postings, False
    live = mine.filter("status <> 'retired'")
    texts = checkpointed(parse(live.select("doc_id", "filename", "original")).select("doc_id", normalize_text(F.col("text")).alias("text"), "error"))
    new = windows(texts.filter("error is null"), "doc_id", "text").select(*POSTING)
    new = checkpointed(new)
    counts = ledger_counts(new)
    results = mine.select("doc_id", "version").join(texts, "doc_id", "left").join(counts, "doc_id", "left").select("doc_id", "version", F.col("text").alias("normalized_text"), "error", "windows")
    after = indexing_outcome(taken.drop("claimed"), results, now).drop("outcome")
    return checkpointed(after), checkpointed(replace_postings(postings, new, mine.select("doc_id"))), True


def indexing_outcome(current: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The registry after indexing ``results`` (doc_id, version, normalized_text, error, windows).

    ``outcome``: retired, indexed, error (no text, or no window, is one), superseded where
    the version or state moved on meanwhile and nothing is changed, null where there is
    no result.
    """
    came = results.select("doc_id", F.col("version").alias("_version"), F.col("normalized_text").alias("_text"), F.col("error").alias("_error"), F.col("windows").alias("_windows"), F.lit(True).alias("_came"))
    both = current.join(came, "doc_id", "left")
    failed = F.coalesce(F.col("_error"), F.when(F.coalesce(F.col("_text"), F.lit("")) == "", F.lit("no text")).when(F.coalesce(F.col("_windows"), F.lit(0)) == 0, F.lit("no windows")))
    live = (F.col("version") == F.col("_version")) & (F.col("index_status") == "indexing")
    outcome = F.when(F.col("_came").isNull(), F.lit(None)).when(~live, "superseded").when(F.col("status") == "retired", "retired").when(failed.isNotNull(), "error").otherwise("indexed")
    done = outcome.isin("retired", "indexed")
    after = {
        "index_status": F.when(done, "indexed").when(outcome == "error", "error").otherwise(F.col("index_status")),
        "index_windows": F.when(outcome == "retired", 0).when(outcome == "indexed", F.col("_windows")).otherwise(F.col("index_windows")).cast("int"),
        "normalized_text": F.when(outcome == "indexed", F.col("_text")).otherwise(F.col("normalized_text")),
        "text_chars": F.when(outcome == "indexed", F.length("_text")).otherwise(F.col("text_chars")).cast("int"),
        "index_error": F.when(done, F.lit(None)).when(outcome == "error", F.substring(failed, 1, 2000)).otherwise(F.col("index_error")),
        "indexed_at": F.when(done, now).otherwise(F.col("indexed_at")),
    }
    return both.select(*[after[c].alias(c) if c in after else F.col(c) for c in current.columns], outcome.alias("outcome"))


LISTED = ["doc_id", "filename", "version", "title", "classification", "status", "index_status", "index_windows", "text_chars", "index_error", "registered_at", "registered_by", "indexed_at", "retired_at"]


def list_documents(current: DataFrame, status: str | None = None) -> DataFrame:
    """Metadata only, in order of doc_id."""
    rows = current.select(*[c for c in LISTED if c in current.columns])
    return (rows.filter(F.col("status") == status) if status else rows).orderBy("doc_id")


def status_summary(current: DataFrame) -> DataFrame:
    """(state, n) of each status and index status, in order."""
    return current.groupBy(F.concat_ws("/", "status", "index_status").alias("state")).agg(F.count(F.lit(1)).alias("n")).orderBy("state")
