"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``MAX_ORDER`` bytes with the counts of
what follows them. A byte is coded in its longest known context; if that never saw
it, an escape (method C: as likely as the context has distinct successors) leads to
the next shorter one, where what the longer one has seen is excluded, down to all byte
values alike. Statistics are frozen after learning, so a byte's code length is a
function of the byte and the ``MAX_ORDER`` before it, and is exact. The language with
the shortest code is predicted.

Code lengths of the sequences that the languages have seen most are worked out once, for
all languages side by side, into a hash table of bounded size; scoring a text is one
look-up a byte. All other sequences are worked out when they come, to the same lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.llm.common import held_out, in_batches, narrow
from leakloom.session import checkpointed

MAX_ORDER = 4
#: A bounded sample to learn from: rows and bytes for each language, bytes of all together, and languages: those with the
#: most rows to learn from. A column of dirty names can't make the model larger than that.
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 2_000_000
TOTAL_BYTES = 16_000_000
LANGUAGES = 400
#: Parts that a language's ids are first looked through in.
PARTS = 256
#: Code lengths (sequences times languages) that the table holds.
CELLS = 8 << 20
#: Bytes that are scored at a time, and sequences that a worker remembers besides the table.
SCORED = 1 << 20
REMEMBERED = 1 << 18
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


def sequences(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-cased texts with the ``order`` before each as numbers (zeros before a text), and where texts start."""
    parts = [bytes(order) + text.lower().encode() for text in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    packed = np.zeros(len(raw), np.uint64)
    for k in range(order + 1):
        packed[k:] |= raw[: len(raw) - k].astype(np.uint64) << np.uint64(8 * k)
    lengths = np.array([len(x) for x in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(raw), bool)
    for k in range(order):
        inside[starts + k] = False
    return packed[inside], starts - order * np.arange(len(parts))


@dataclass
class Tree:
    """One language's counts: by order, sorted sequences (context and successor) with their counts."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]

    def prepare(self) -> None:
        """Totals and distinct successors of each context, and both after excluding what a longer context has seen."""
        self.contexts, self.totals, self.distinct, self.left_total, self.left_distinct = [], [], [], [], []
        for order, (keys, counts) in enumerate(zip(self.keys, self.counts, strict=True)):
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            totals = np.add.reduceat(counts, first) if len(keys) else np.zeros(0, np.int64)
            distinct = np.diff(np.r_[first, len(keys)])
            self.contexts.append(contexts)
            self.totals.append(totals)
            self.distinct.append(distinct)
            if order:
                mask = np.uint64((1 << 8 * order) - 1)
                below = self.counts[order - 1][np.searchsorted(self.keys[order - 1], keys & mask)]
                seen = np.add.reduceat(below, first) if len(keys) else np.zeros(0, np.int64)
                at = np.searchsorted(self.contexts[order - 1], contexts & np.uint64((1 << 8 * (order - 1)) - 1))
                self.left_total.append(self.totals[order - 1][at] - seen)
                self.left_distinct.append(self.distinct[order - 1][at] - distinct)
            else:
                self.left_total.append(None)
                self.left_distinct.append(None)

    def code_lengths(self, packed: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each sequence."""
        bits = np.zeros(len(packed))
        open_ = np.ones(len(packed), bool)
        total = np.full(len(packed), -1, np.int64)  # after exclusions; -1: nothing is excluded yet
        distinct = np.zeros(len(packed), np.int64)
        for order in range(len(self.keys) - 1, -1, -1):
            if not len(self.keys[order]):
                continue
            own = packed & np.uint64((1 << 8 * (order + 1)) - 1)
            context = own >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            known = open_ & (self.contexts[order][at] == context)
            t = np.where(total < 0, self.totals[order][at], total)
            d = np.where(total < 0, self.distinct[order][at], distinct)
            place = np.minimum(np.searchsorted(self.keys[order], own), len(self.keys[order]) - 1)
            hit = known & (self.keys[order][place] == own)
            bits[hit] += np.log2((t + d)[hit] / self.counts[order][place][hit])
            open_ &= ~hit
            miss = known & ~hit & (d > 0)
            bits[miss] += np.log2((t + d)[miss] / d[miss])
            if order:
                total = np.where(known, self.left_total[order][at], total)
                distinct = np.where(known, self.left_distinct[order][at], distinct)
        alphabet = len(self.keys[0])
        bits[open_] += math.log2(max(1, 256 - alphabet))
        return bits


class PpmModel:
    """The trees of some languages, in alphabetical order, and the table of code lengths."""

    def __init__(self, trees: dict[str, Tree], order: int = MAX_ORDER):
        self.order = order
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]
        for tree in self.trees:
            tree.prepare()
        keys = self._most_seen(CELLS // max(1, len(self.trees)))
        self.bits = self.worked_out(keys)
        self._hash(keys)
        self.late_keys, self.late_bits = np.zeros(0, np.uint64), np.zeros((0, len(self.languages)))

    def _most_seen(self, n: int) -> np.ndarray:
        """At most ``n`` sequences, those of the highest counts over all languages; ties go by number."""
        if not self.trees:
            return np.zeros(0, np.uint64)
        keys, back = np.unique(np.concatenate([t.keys[self.order] for t in self.trees]), return_inverse=True)
        if len(keys) <= n:
            return keys
        counts = np.bincount(back, weights=np.concatenate([t.counts[self.order] for t in self.trees]), minlength=len(keys))
        return np.sort(keys[np.argsort(-counts, kind="stable")[:n]])

    def worked_out(self, packed: np.ndarray) -> np.ndarray:
        out = np.zeros((len(packed), len(self.trees)))
        for k, tree in enumerate(self.trees):
            out[:, k] = tree.code_lengths(packed)
        return out

    @property
    def remembered(self) -> int:
        """Sequences that a worker remembers: fewer of them where there are many languages."""
        return min(REMEMBERED, CELLS // max(1, len(self.trees)))

    def _hash(self, keys: np.ndarray) -> None:
        """Open addressing: each key stands in the first free slot from its own on."""
        self.width = max(10, int(2 * len(keys)).bit_length())
        size = 1 << self.width
        self.slots = np.full(size, np.uint64(2**64 - 1))
        self.rows = np.zeros(size, np.int32)
        waiting, at, self.reach = np.arange(len(keys)), self._slot(keys), 0
        while len(waiting):
            self.reach += 1
            free = self.slots[at] == np.uint64(2**64 - 1)
            taken, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.slots[taken] = keys[waiting[placed]]
            self.rows[taken] = waiting[placed]
            rest = np.ones(len(waiting), bool)
            rest[placed] = False
            waiting, at = waiting[rest], (at[rest] + 1) % size

    def _slot(self, packed: np.ndarray) -> np.ndarray:
        return ((packed * MIX) >> np.uint64(64 - self.width)).astype(np.int64)

    def _late(self, packed: np.ndarray) -> np.ndarray:
        """Code lengths of sequences that are not in the table."""
        wanted, back = np.unique(packed, return_inverse=True)
        at = np.minimum(np.searchsorted(self.late_keys, wanted), max(0, len(self.late_keys) - 1))
        new = wanted[self.late_keys[at] != wanted] if len(self.late_keys) else wanted
        if len(new):
            if len(self.late_keys) + len(new) > self.remembered:
                self.late_keys, self.late_bits, new = self.late_keys[:0], self.late_bits[:0], wanted
            keys = np.concatenate([self.late_keys, new])
            order = np.argsort(keys, kind="stable")
            self.late_keys, self.late_bits = keys[order], np.concatenate([self.late_bits, self.worked_out(new)])[order]
        return self.late_bits[np.searchsorted(self.late_keys, wanted)[back]]

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) bits of whole texts."""
        total = np.zeros((len(texts), len(self.languages)))
        if not len(self.languages):
            return total
        packed, starts = sequences(texts, self.order)
        edges = np.r_[starts, len(packed)]
        at_once = max(1 << 10, min(SCORED, CELLS // len(self.languages)))
        for a in range(0, len(packed), at_once):
            part = packed[a : a + at_once]
            rows = self._rows(part)
            bits = self.bits[np.maximum(rows, 0)]
            late = np.flatnonzero(rows < 0)
            if len(late):
                bits[late] = self._late(part[late])
            b = a + len(part)
            some = np.flatnonzero((edges[:-1] < b) & (edges[1:] > a) & (edges[1:] > edges[:-1]))
            total[some] += np.add.reduceat(bits, np.maximum(edges[some] - a, 0), axis=0, dtype=np.float64)
        return total

    def _rows(self, packed: np.ndarray) -> np.ndarray:
        """Rows of the table, -1 for sequences that are not in it."""
        at = self._slot(packed)
        found = self.slots[at]
        rows = np.where(found == packed, self.rows[at], -1)
        waiting = np.flatnonzero((found != packed) & (found != np.uint64(2**64 - 1)))
        at = at[waiting]
        for _ in range(self.reach):
            if not len(waiting):
                break
            at = (at + 1) & ((1 << self.width) - 1)
            found = self.slots[at]
            hit = found == packed[waiting]
            rows[waiting[hit]] = self.rows[at[hit]]
            rest = ~hit & (found != np.uint64(2**64 - 1))
            waiting, at = waiting[rest], at[rest]
        return rows

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of the shortest code and its posterior probability, all languages being as likely before."""
        bits = self.code_lengths(texts)
        out = []
        for text, own in zip(texts, bits, strict=True):
            if not len(own) or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
            else:
                best = int(own.argmin())
                out.append((self.languages[best], float(1 / np.exp2(np.minimum(0, own[best] - own)).sum())))
        return out


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int, remainder: int, rows: int, languages: int) -> DataFrame:
    """lang and text of at most ``rows`` ids of each language: those that hash lowest, held-out ids left out.

    Rows without an id or a language are not learnt from; rows with a null text take
    their places without teaching anything. The ``languages`` with the most rows are
    learnt, ties going by name. Ids are chosen in two steps, parts of a language first,
    so that no task has all ids of a language. What is broadcast are ``rows`` times
    ``languages`` ids at most. An id that stands in several rows of a language has the
    text that comes first.
    """
    keys = docs.select(docs[id_col].cast("long").alias("id"), docs[lang_col].cast("string").alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"), modulus, remainder))
    largest = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    keys = keys.join(F.broadcast(largest), "lang").withColumn("part", F.pmod(F.xxhash64("id") % 1_000_003, F.lit(PARTS)))
    first = Window.partitionBy("lang", "part").orderBy(F.xxhash64("id"), "id")
    of_parts = keys.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows).drop("n", "part")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = of_parts.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows).select("id", "lang")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).dropna()
    return texts.join(F.broadcast(chosen), ["id", "lang"]).groupBy("lang", "id").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, remainder: int = 0, order: int = MAX_ORDER, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES, languages: int = LANGUAGES) -> PpmModel:
    """Trees of the languages of a bounded sample of rows whose id's CRC-32 does not leave ``remainder``.

    A language's whole texts are learnt until there are ``sample_bytes``, or an equal part
    of ``total_bytes`` where there are many languages. Trees are counted on the executors,
    one language in one task; the driver gets their counts, bounded by ``total_bytes``.
    """
    texts = checkpointed(sampled(docs, id_col, text_col, lang_col, modulus, remainder, sample_rows, languages))
    learnt = texts.select("lang").distinct().count()
    sample_bytes = min(sample_bytes, total_bytes // max(1, learnt))
    texts = texts.repartition("lang").sortWithinPartitions("lang", F.xxhash64("id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, held = None, [], 0

        def grown() -> Iterator[pa.RecordBatch]:
            if own:
                packed, _ = sequences(own, order)
                for k in range(order + 1):
                    keys, counts = np.unique(packed & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([k], pa.int32()), pa.array([keys.astype("<u8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["lang", "depth", "keys", "counts"])

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if lang != now:
                    yield from grown()
                    now, own, held = lang, [], 0
                if held < sample_bytes:
                    own.append(text)
                    held += len(text.encode())
        yield from grown()

    found = in_batches(texts, count, "lang string, depth int, keys binary, counts binary").collect()
    trees: dict[str, Tree] = {}
    for row in sorted(found, key=lambda r: (r["lang"], r["depth"])):
        tree = trees.setdefault(row["lang"], Tree([], []))
        tree.keys.append(np.frombuffer(row["keys"], "<u8"))
        tree.counts.append(np.frombuffer(row["counts"], "<i8"))
    return PpmModel({k: t for k, t in trees.items() if len(t.keys[0])}, order)


def identify(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """id, held_out, lang_pred and score (the posterior probability) of every whole text.

    Texts that are null, empty or without a letter, and all texts where no language was
    learnt, are ``und`` with score 0. Ties go to the language first by name. A text of any
    length is scored whole, some bytes at a time; repeated rows score alike; an empty table
    gives no rows; columns other than id and text, whatever their names, have no say.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TOTAL_BYTES and CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found, texts, held = [], [], 0
            for text in batch["text"].to_pylist():
                texts.append(text)
                held += len(text)
                if held > SCORED:
                    found += own.predict(texts)
                    texts, held = [], 0
            found += own.predict(texts) if texts else []
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = in_batches(narrow(docs, id_col, text_col), run, "id long, lang_pred string, score double")
    return rows.select("id", held_out(F.col("id"), modulus, remainder).alias("held_out"), "lang_pred", "score")
