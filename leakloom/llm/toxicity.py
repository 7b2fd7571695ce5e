"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on all windows of toxic texts and one on all
windows of ordinary texts. A window is compressed twice: with the ordinary dictionary
alone, and with the toxic one laid before it, so that what is ordinary in a toxic text
costs the same both ways and the bytes that the toxic dictionary saves tell what is not.
The difference of the lengths is the window's gain; it may be negative.

Gains are compared with calibrated thresholds. For calibration the texts are dealt into
two halves and the dictionaries of either half meet the windows of the other one, toxic
and ordinary ones alike, so no window is judged by a dictionary that has seen its text.
Each gain gets a weight, a never falling function fitted to how often it occurs in toxic
and in ordinary texts. A document's evidence is the sum over all windows of its whole
text, and a never falling curve, fitted to the same halves, turns it into a score.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.llm.common import held_out, in_batches, narrow
from leakloom.llm.quality import isotonic

WINDOW = 128
#: The compressor's search: tables that hold the whole dictionary, of which nothing is forgotten.
SEARCH = {"compression_level": 6, "min_match": 4, "hash_log": 22, "chain_log": 22, "search_log": 4, "strategy": zstandard.STRATEGY_GREEDY}
#: The compressor begins no match in the last bytes of what it is given, so each window has these after it.
TAIL = bytes(16)
#: Sizes of the dictionaries, with the trainer's segments and the strings that it counts.
ORDINARY = {"size": 1_000_000, "k": 64, "d": 8}
TOXIC = {"size": 32_000, "k": 16, "d": 6}
#: The trainer puts what it chooses first at the end and cuts some hundred bytes off there for its tables. In every third
#: sample of the toxic dictionary stands this string of control characters, so that it is what is chosen first and cut.
FIRST = np.random.default_rng(2).integers(0, 8, 320, dtype=np.uint8).tobytes()
#: A bounded sample to learn from: rows of each label, and bytes.
SAMPLE_ROWS = {0: 6000, 1: 3000}
SAMPLE_BYTES = {0: 24_000_000, 1: 12_000_000}
#: Gains beyond these count as these.
LEAST, MOST = -16, 24
EVIDENCE = 30.0
#: How much of the score orders documents of one calibrated level among themselves.
FINE = 0.02


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The lower-cased text cut at spaces into pieces of about ``size`` bytes; nothing is left out."""
    raw = text.lower().encode()
    out, at, n = [], 0, len(raw)
    while at < n:
        to = min(n, at + size)
        if to < n:
            space = raw.rfind(b" ", at + size // 2, to)
            to = space + 1 if space > 0 else to
        out.append(raw[at:to])
        at = to
    return out


def trained(texts: Iterable[str], size: int, k: int, d: int, first: bytes = b"", window: int = WINDOW) -> bytes:
    """The content of a dictionary of the texts' windows, each distinct one counted once.

    Windows too few for the trainer are the content themselves.
    """
    samples = list(dict.fromkeys(x for text in texts for x in windows(text, window)))
    total = sum(map(len, samples))
    if total > 4096 and len(samples) > 16:
        try:
            marked = [x + first if n % 3 == 0 else x for n, x in enumerate(samples)] if first else samples
            return zstandard.train_dictionary(max(256, min(size, total // 2)) + len(first), marked, k=k, d=d, f=20, split_point=1.0, accel=1).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * (MOST - LEAST + 1))
    points: np.ndarray = field(default_factory=lambda: np.zeros(1))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(1))
    window: int = WINDOW

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def _compressors(self):
        if "_made" not in self.__dict__:
            search = dict(SEARCH)
            how = zstandard.ZstdCompressionParameters.from_level(search.pop("compression_level"), write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **search)
            made = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
                if dictionary:
                    dictionary.precompute_compress(compression_params=how)
                made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how).compress)
            self._made = made
        return self._made

    def lengths(self, window: bytes) -> tuple[int, int]:
        """Bytes of a window under the ordinary dictionary, and with the toxic one before it."""
        plain, both = self._compressors()
        window += TAIL
        return len(plain(window)), len(both(window))

    def gains(self, text: str) -> list[int]:
        """The bytes that the toxic dictionary saves in each window, from LEAST to MOST."""
        return [max(LEAST, min(MOST, a - b)) for a, b in map(self.lengths, windows(text, self.window))]

    def weighed(self, gains: list[int]) -> float:
        return max(-EVIDENCE, min(EVIDENCE, sum(self.weights[x - LEAST] for x in gains)))

    def evidence(self, text: str) -> float:
        return self.weighed(self.gains(text)) if self.toxic else 0.0

    def score(self, text: str) -> float:
        evidence = self.evidence(text)
        level = float(np.interp(evidence, self.points, self.levels))
        return (1 - FINE) * level + FINE / (1 + math.exp(-evidence / 5))

    def calibrate(self, ordinary: list[list[int]], toxic: list[list[int]]) -> None:
        """Weights and curve from the gains of ordinary and toxic texts."""
        if not ordinary or not toxic:
            return
        seen = [np.bincount(np.concatenate([np.zeros(0, np.int64), *map(np.array, x)]).astype(np.int64) - LEAST, minlength=MOST - LEAST + 1) + 1.0 for x in (ordinary, toxic)]
        seen = [x / x.sum() for x in seen]
        share = isotonic(seen[1], seen[0] + seen[1])  # more bytes saved never speak against toxicity
        self.weights = np.log(share / (1 - share)).tolist()
        x = np.array([self.weighed(g) for g in [*ordinary, *toxic]])
        y = np.r_[np.zeros(len(ordinary)), np.ones(len(toxic))]
        self.points, at = np.unique(x, return_inverse=True)
        totals = np.bincount(at).astype(np.float64)
        self.levels = isotonic(np.bincount(at, weights=y), totals)


def dictionaries(ordinary: list[str], toxic: list[str], window: int = WINDOW) -> ToxicityModel:
    """A model that is not calibrated yet."""
    return ToxicityModel(trained(ordinary, **ORDINARY, window=window), trained(toxic, **TOXIC, first=FIRST, window=window), window=window)


def learn(ordinary: list[str], toxic: list[str], window: int = WINDOW) -> ToxicityModel:
    """A model from texts of either kind, of which equal ones count once.

    Without toxic texts all scores are low, without ordinary ones high. A kind with a
    single text is calibrated on the text that its dictionary has seen.
    """
    ordinary, toxic = list(dict.fromkeys(ordinary)), list(dict.fromkeys(toxic))
    if not toxic or not ordinary:
        model = ToxicityModel(window=window)
        model.levels = np.ones(1) if toxic else np.zeros(1)
        return model
    gains: list[list[list[int]]] = [[], []]
    for fold in (0, 1):
        taught = [texts[fold::2] or texts for texts in (ordinary, toxic)]
        half = dictionaries(*taught, window)
        for own, texts in zip(gains, (ordinary, toxic), strict=True):
            own += [half.gains(text) for text in texts[1 - fold :: 2]]
    model = dictionaries(ordinary, toxic, window)
    model.calibrate(*gains)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0, rows: dict[int, int] = SAMPLE_ROWS, size: dict[int, int] = SAMPLE_BYTES) -> ToxicityModel:
    """A model from a bounded sample of labelled rows whose id's CRC-32 does not leave ``remainder``.

    Of each label those ids are taken that hash lowest, ``rows`` at most; texts are whole
    and no more of them are begun than fill ``size`` bytes. Rows without an id, ids that are
    labelled both ways and labels other than 0 and 1 are not learnt from; of an id that
    stands in several rows the text that comes first is. One task on an executor learns;
    the driver gets the model, which has a bounded size.
    """
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"), modulus, remainder))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").select("id", "label")
    # Only of ids that have a text here.
    known = known.join(docs.select(docs[id_col].cast("long").alias("id")), "id", "left_semi")
    # The lowest of each task first, then of those: at most rows[0] + rows[1] ids in all, which the broadcast relies on.
    lowest = [known.filter(F.col("label") == x).orderBy(F.xxhash64("id"), "id").limit(rows[x]) for x in (0, 1)]
    texts = narrow(docs, id_col, text_col).join(F.broadcast(lowest[0].unionByName(lowest[1])), "id")
    texts = texts.groupBy("label", "id").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions("label", F.xxhash64("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = {0: [], 1: []}, {0: 0, 1: 0}
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if held[label] < size[label]:
                    own[label].append(text)
                    held[label] += len(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(own[0], own[1]))], pa.binary())], ["model"])

    found = in_batches(texts, run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else learn([], [])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """id, held_out, score and predicted of every whole text.

    Null and empty texts have no windows and get the score of no evidence. A text of any
    length is scored whole, window by window; ties and repeated rows score alike; an empty
    table gives no rows; columns other than id and text, whatever their names, have no say.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([shared.value.score(x) for x in batch["text"].to_pylist()], pa.float64())], ["id", "score"])

    rows = in_batches(narrow(docs, id_col, text_col), run, "id long, score double")
    return rows.select("id", held_out(F.col("id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: ToxicityModel, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``below``, with all their columns.

    A null text is an empty one; repeated rows stay or go together; an empty table gives
    no rows; no column is added, so none can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(x or "") < below for x in batch.column(at).to_pylist()], pa.bool_()))

    return in_batches(docs, run, docs.schema)
