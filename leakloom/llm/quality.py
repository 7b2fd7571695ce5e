"""Quality scores: random Fourier features over document statistics.

Features that are cosines of random projections approximate a Gaussian kernel, so a
ridge regression on them approximates a kernel machine; its normal equations are sums
over rows, taken in each partition and then added up a few at a time. The raw scores
of the rows learnt from, each by the weights of the half of the rows that it is not in,
are counted in bins, and an isotonic (never falling) curve through the bins turns a raw
score into a probability. All labelled rows are learnt from; the driver gets two matrices
and one table of bins, whatever the corpus holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.llm.common import free_name, held_out, in_batches, narrow
from leakloom.session import checkpointed

FEATURES = 256
RIDGE = 3e-3
BINS = 512
SEED = 9
#: Labelled ids that are broadcast, at most (8 bytes each).
LISTED = 1 << 22
#: Partial sums that are added up in one task.
FAN_IN = 16
NAMES = ("chars", "words", "lines", "letters", "upper", "digits", "space", "beyond_ascii", "full_stops", "commas", "exclamations", "pipes", "symbols", "word_length", "word_spread", "distinct_words", "common_word", "capitals", "shouts", "wordless", "line_length", "repeated_lines", "byte_entropy", "odd_ends")
LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def statistics(text: str) -> list[float]:
    """The statistics named in NAMES, of a whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = len(raw)
    share = lambda chars: float(sum(counts[ord(c)] for c in chars)) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    p = counts[counts > 0] / n
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)),
        float(counts[LETTERS].sum()) / n, float(counts[65:91].sum()) / n, float(counts[48:58].sum()) / n, share(" \t\n\r"), float(counts[128:].sum()) / n,
        share("."), share(","), share("!"), share("|"), share("#$%&*@^~<>{}[]=+_\\/"),
        min(float(lengths.mean()), 50.0), min(float(lengths.std()), 50.0), len(seen) / m, max(seen.values(), default=0) / m,
        sum(map(str.istitle, words)) / m, sum(map(str.isupper, words)) / m, sum(w.lower() == w.upper() for w in seen) / max(1, len(seen)),
        math.log1p(len(text) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), float(-(p * np.log(p)).sum()),
        sum(not w[-1].isalnum() for w in words) / m,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(text) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rows, pa.list_(pa.float64()))], ["id", "stats"])

    return in_batches(narrow(docs, id_col, text_col), run, "id long, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(NAMES)))
    weights: np.ndarray | None = None
    edges: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.5]))
    features: int = FEATURES
    seed: int = SEED

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features and a constant; distances are in standard deviations, over the root of their number."""
        rng = np.random.default_rng(self.seed)
        frequencies = rng.standard_normal((len(NAMES), self.features)) / math.sqrt(len(NAMES))
        phases = rng.uniform(0, 2 * math.pi, self.features)
        scaled = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(scaled @ frequencies + phases) * math.sqrt(2 / self.features), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats)) if self.weights is None or not len(stats) else self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    return batch[name].values.to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(NAMES)))


def summed(rows: DataFrame, add, fan_in: int = FAN_IN) -> np.ndarray | None:
    """The sum of ``add(batch)`` (arrays of one shape) over all batches; tasks add up first, then ever fewer tasks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = add(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["part"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch["part"]:
                own = np.frombuffer(part.as_py(), "<f8")
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = in_batches(rows, first, "part binary")
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        parts = in_batches(parts.repartition(tasks), together, "part binary")
    found = parts.collect()
    return np.frombuffer(found[0]["part"], "<f8") if found else None


def isotonic(totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The never falling sequence of least squares to totals / weights: pool adjacent violators."""
    blocks: list[list[float]] = []
    for t, w in zip(totals, weights, strict=True):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), t / w) for t, w, k in blocks]) if blocks else np.zeros(0)


def to_learn_from(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", modulus: int = 3, remainder: int = 1, limit: int = LISTED) -> DataFrame:
    """The rows of ``docs`` that ``fit`` learns from, if a count proves that their ids fit a broadcast; else all of them.

    Either way the same model is learnt; this only spares the statistics of other rows.
    """
    learnt = free_name(docs, "learnt")
    ids = labels.filter(F.col(label_col).cast("double").isNotNull()).select(F.col(id_col).cast("long").alias(learnt)).dropna().filter(~held_out(F.col(learnt), modulus, remainder)).distinct()
    if ids.limit(limit + 1).count() > limit:
        return docs
    return docs.join(F.broadcast(ids), docs[id_col].cast("long") == F.col(learnt), "left_semi")


def fit(stats: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", modulus: int = 3, remainder: int = 1, features: int = FEATURES, ridge: float = RIDGE) -> QualityModel:
    """A model from the labelled rows whose id's CRC-32 does not leave ``remainder``.

    Each pair of a row and a non-null label of its id counts once. Without any, all
    scores are one half; with labels of one kind, they are that label.
    """
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("double").alias("y")).dropna()
    rows = checkpointed(stats.join(known, "id").filter(~held_out(F.col("id"), modulus, remainder)).select("stats", "y", (F.xxhash64("id") % 2 == 0).alias("half")))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    sums = summed(rows, moments)
    if sums is None:
        return QualityModel(features=features)
    n, d = sums[0], len(NAMES)
    mean = sums[1 : 1 + d] / n
    spread = np.sqrt(np.maximum(sums[1 + d :] / n - mean * mean, 0))
    model = QualityModel(mean, np.where(spread > 1e-9, spread, 1.0), features=features)
    size = features + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y, half = model.fourier(_matrix(batch)), batch["y"].to_numpy(), batch["half"].to_numpy(zero_copy_only=False)
        return np.concatenate([np.concatenate([(z[own].T @ z[own]).ravel(), z[own].T @ y[own], [own.sum()]]) for own in (half, ~half)])

    def solved(part: np.ndarray) -> np.ndarray:
        gram, right, rows_in = part[: size * size].reshape(size, size), part[size * size : -1], part[-1]
        penalty = np.full(size, ridge * rows_in)
        penalty[-1] = 1e-9 * rows_in
        return np.linalg.solve(gram + np.diag(penalty), right)

    halves = summed(rows, normal).reshape(2, -1)
    model.weights = solved(halves.sum(axis=0))
    # A row's raw score for the curve comes from the half that it is not in.
    other = [solved(halves[1 - k]) if halves[1 - k][-1] else model.weights for k in (0, 1)]

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        z, half = model.fourier(_matrix(batch)), batch["half"].to_numpy(zero_copy_only=False)
        raw, y = np.where(half, z @ other[0], z @ other[1]), batch["y"].to_numpy()
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS), np.bincount(at, weights=raw, minlength=BINS)])

    weights, totals, raws = summed(rows, binned).reshape(3, BINS)
    some = weights > 0
    model.edges, model.levels = raws[some] / weights[some], isotonic(totals[some], weights[some])
    return model


def score(stats: DataFrame, model: QualityModel, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """id, held_out, score and predicted of every row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(model.score(_matrix(batch)))], ["id", "score"])

    rows = in_batches(stats.select("id", "stats"), run, "id long, score double")
    return rows.select("id", held_out(F.col("id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: QualityModel, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least so much, with all their columns; a null text is an empty one."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(np.array([statistics(x or "") for x in batch.column(at).to_pylist()]).reshape(-1, len(NAMES)))
            yield batch.filter(pa.array(scores >= at_least))

    return in_batches(docs, run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, remainder: int = 1) -> DataFrame:
    """Scores of all ``docs`` by a model of their labelled part.

    Null and empty texts have all-zero statistics and get the score of such; a text of any
    length is read whole; repeated rows score alike; an empty table gives no rows; columns
    other than id and text, whatever their names, have no say.
    """
    stats = checkpointed(document_statistics(docs, id_col, text_col))
    return score(stats, fit(stats, labels, label_col, id_col, modulus, remainder), modulus, remainder)
