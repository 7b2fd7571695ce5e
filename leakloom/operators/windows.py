"""All-position window hashes.

A window is ``WINDOW`` kept characters in a row. Its hash is that of a rolling hash
modulo 2^61 - 1; here all windows of a text are hashed at once by doubling: the hashes
of all runs of 2L characters come from those of L in one vectorised step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.session import ship_package

WINDOW = 30
# The hash's modulus, base and multiplier.
MODULUS = (1 << 61) - 1
BASE = 1_000_003
MULTIPLIER = 0x9E3779B97F4A7C15
#: Rows of a batch that a worker hands back.
ROWS = 1 << 16
#: Hashes that are broadcast to sift probes with, at most (8 bytes each).
SIFTED = 1 << 22

_M = np.uint64(MODULUS)


def _product(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo 2^61 - 1 of numbers below it, in 64 bits: 2^61 counts as 1."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    cross = a1 * b0 + a0 * b1
    least = a0 * b0
    total = np.uint64(2) * (a1 * b1) + (cross >> np.uint64(30)) + ((cross & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (least >> np.uint64(61)) + (least & _M)
    return _rest(total)


def _rest(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & _M)
    return np.where(x >= _M, x - _M, x)


def window_hashes(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The hash of every run of ``window`` codes; none if there are fewer."""
    n = len(codes)
    if n < window:
        return np.zeros(0, np.int64)
    part, length = codes.astype(np.uint64), 1
    done, covered = None, 0  # of the first ``covered`` characters of each window
    rest = window
    while True:
        if rest & 1:
            here = part[covered : covered + n - window + 1]
            done = here if done is None else _rest(_product(done, np.uint64(pow(BASE, length, MODULUS))) + here)
            covered += length
        rest >>= 1
        if not rest:
            break
        part = _rest(_product(part[:-length], np.uint64(pow(BASE, length, MODULUS))) + part[length:])
        length *= 2
    return _product(done, np.uint64(MULTIPLIER % MODULUS)).astype(np.int64)


def compact(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the kept characters, letters lowered, and their places."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    upper = (codes >= 65) & (codes <= 90)
    kept = upper | ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)) | ((codes >= 0xAC00) & (codes <= 0xD7A3))
    return np.where(upper, codes + 32, codes)[kept], np.flatnonzero(kept).astype(np.int32)


def windows(texts: DataFrame, id_col: str, text_col: str, window: int = WINDOW, among: np.ndarray | None = None) -> DataFrame:
    """(id, pos, hash, start, end, n_windows, input_len) of all windows of normalised texts, or of those whose hash is in sorted ``among``.

    pos counts windows; start and end are places in the text; n_windows is how many the
    text has and input_len the place after its last kept character. Null and short texts
    have none. ``among`` (at most ``SIFTED`` hashes) spares the shuffle all other windows.
    """
    spark = texts.sparkSession
    ship_package(spark)
    rows = texts.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if among is not None and len(among) > SIFTED:
        raise ValueError("too many hashes to broadcast")
    sifted = None if among is None else spark.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pos, hashes, start, end, sizes, held = [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                which = np.repeat(np.array(owner, np.int64), [len(x) for x in pos])
                columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pos, hashes, start, end)]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
                per_text = np.repeat(np.array(sizes, np.int64).reshape(-1, 2), [len(x) for x in pos], axis=0)  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True)), pa.array(per_text[:, 0]), pa.array(per_text[:, 1].astype(np.int32))], [id_col, "pos", "hash", "start", "end", "n_windows", "input_len"])  # noqa: B023

            for k, text in enumerate(batch.column(1).to_pylist()):
                codes, places = compact(text)
                own = window_hashes(codes, window)
                at = np.arange(len(own), dtype=np.int32)
                if sifted is not None and len(own):
                    known = sifted.value
                    near = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                    at = at[known[near] == own] if len(known) else at[:0]
                for a in range(0, len(at), ROWS):
                    some = at[a : a + ROWS]
                    owner.append(k)
                    sizes.append((len(own), int(places[-1]) + 1))
                    pos.append(some)
                    hashes.append(own[some])
                    start.append(places[some])
                    end.append(places[some + window - 1] + 1)
                    held += len(some)
                    if held >= ROWS:
                        yield out()
                        owner, pos, hashes, start, end, sizes, held = [], [], [], [], [], [], 0
            if owner:
                yield out()

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, pos int, hash long, start int, end int, n_windows long, input_len int")


def _places(text: str, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of a text's windows, in order of start."""
    codes, places = compact(text)
    hashes = window_hashes(codes, window)
    return places[: len(hashes)], places[window - 1 :][: len(hashes)] + 1, hashes


def changed_windows(old: set[str], new: set[str], window: int = WINDOW) -> tuple[int, int]:
    """How many windows at their places only the new texts have, and how many only the old ones."""
    if len(old) > 1 or len(new) > 1:
        was, now = ({x for t in texts for x in zip(*(c.tolist() for c in _places(t, window)), strict=True)} for texts in (old, new))
        return len(now - was), len(was - now)
    (s, e, h), (s2, e2, h2) = (_places("".join(texts), window) for texts in (old, new))
    at, at2 = np.intersect1d(s, s2, assume_unique=True, return_indices=True)[1:]
    same = int(((h[at] == h2[at2]) & (e[at] == e2[at2])).sum())
    return len(h2) - same, len(h) - same


def exact_hash(codes):
    """The same hash of an array<int> column of one window, in decimals alone."""
    decimal = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    powers = F.array(*[decimal(pow(BASE, WINDOW - 1 - k, MODULUS)) for k in range(WINDOW)])
    terms = F.zip_with(codes, powers, lambda c, p: (c.cast("decimal(8,0)") * p).cast("decimal(38,0)"))
    total = F.aggregate(terms, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    rolled = F.pmod(total, decimal(MODULUS)).cast("decimal(20,0)")
    return F.pmod((rolled * decimal(MULTIPLIER)).cast("decimal(38,0)"), decimal(MODULUS)).cast("long")
