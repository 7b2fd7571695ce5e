"""Best-fit packing by a linear grouping scheme.

The planner never sees documents: it works on how many pieces there are of each
length, at most ``capacity`` numbers whatever the corpus holds. It

1. gives each piece of full length a sequence of its own;
2. takes the large lengths in descending order in groups of equal cardinality and
   rounds each up to the largest of its group, which leaves a few sizes;
3. optimises configurations of those few sizes (a linear program solved by column
   generation, its solution rounded down);
4. substitutes the actual lengths for the rounded ones, which are never larger;
5. puts what rounding left over and the small lengths in by best fit, largest first.

Its result is a short table of bin patterns with multiplicities. The pieces find
their places in it by their rank within their length, so that a length which half
of all documents share is dealt out like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.llm.byte_tokens import ByteTokenizer
from leakloom.llm.common import BATCH_BYTES, file_bytes, in_batches, narrow
from leakloom.session import checkpointed

CAPACITY = 1024
#: Lengths above this share of the capacity are grouped; the others are small.
LARGE = 1 / 6
#: Groups of equal cardinality, hence sizes that configurations are made of.
GROUPS = 200
#: How far from its optimum, at most, the linear program may stop.
GAP = 5e-4
TURNS = 15
#: Rows that one window partition ranks.
RANKED = 50_000


def tokenized_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """Documents as token pieces of at most ``capacity``: id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its ids and then ``end_id``. Where it is longer than ``capacity``
    every piece is full but the first. A null or empty text is ``end_id`` alone; a
    repeated row makes its pieces again; an empty table gives no rows. Only id and text
    reach the operator, so other columns may have any name.
    """
    model = docs.sparkSession.sparkContext.broadcast(file_bytes(docs.sparkSession, vocabulary))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer.shared(model.value)
        for batch in batches:
            ids, pieces, starts, lengths, tokens, held = [], [], [], [], [], 0
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = np.append(tokenizer.encode(text), np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)] if len(own) > capacity else [0, len(own)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    ids.append(doc)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    tokens.append(own[a:b].tobytes())
                held += 4 * len(own)
                if held > BATCH_BYTES:
                    yield _pieces(ids, pieces, starts, lengths, tokens)
                    ids, pieces, starts, lengths, tokens, held = [], [], [], [], [], 0
            yield _pieces(ids, pieces, starts, lengths, tokens)

    return in_batches(narrow(docs, id_col, text_col), cut, "id long, piece int, start long, length int, ids binary")


def _pieces(ids: list, pieces: list, starts: list, lengths: list, tokens: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(tokens, pa.binary())], ["id", "piece", "start", "length", "ids"])


# --- the planner -----------------------------------------------------------------


class Pattern:
    """Bins of one content: what went in first is in ``parent``; then ``count`` pieces of ``length``."""

    __slots__ = ("count", "length", "parent")

    def __init__(self, parent: Pattern | None, length: int, count: int):
        self.parent, self.length, self.count = parent, length, count

    def slots(self) -> list[tuple[int, int]]:
        out, at = [], self
        while at:
            out.append((at.length, at.count))
            at = at.parent
        return out[::-1]


def equal_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """The lengths, largest first, cut into groups of equal cardinality (the last may be smaller)."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations of a few sizes with how often to use each: the linear program's optimum, rounded down.

    Column generation: the dual prices of the present basis go to an integer knapsack,
    whose best configuration enters as long as it is worth more than one bin.
    """
    n = len(sizes)
    held = np.array(sizes)
    basis = np.diag((capacity // held).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    # Equal groups make ties, and ties can send the simplex method round in circles: a trace of difference ends them.
    need = np.array(demand, float) + 1e-3 * ((np.arange(n) * 0.6180339887) % 1)
    step_of = int(held.min())  # rooms that are less apart never build on each other
    for turn in range(TURNS * n):  # whatever the turn, the basis is a way to pack everything
        prices = inverse.sum(axis=0)  # every configuration costs one bin
        worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for first in range(step_of, capacity + 1, step_of):
            rooms = np.arange(first, min(first + step_of, capacity + 1))
            left = rooms[:, None] - held[None, :]
            with_each = np.where(left >= 0, worth[np.maximum(left, 0)] + prices, -1.0)
            best = with_each.argmax(axis=1)
            own = with_each[np.arange(len(rooms)), best]
            # A room that nothing is added to is worth as much as the next smaller one.
            from_ = np.maximum.accumulate(np.where(own > worth[first - 1] + 1e-12, own, worth[first - 1]))
            fresh = (own >= from_) & (own > np.r_[worth[first - 1], from_[:-1]] + 1e-12)
            worth[rooms], chosen[rooms] = from_, np.where(fresh, best, -1)
        if worth[capacity] <= 1 + GAP:  # the optimum is no lower than the present cost over this worth
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if chosen[room] < 0:
                room -= 1
            else:
                column[chosen[room]] += 1
                room -= sizes[chosen[room]]
        # Sums of products, not the linear algebra library: its threads would contend with the cluster's driver.
        level, step = (inverse * need).sum(axis=1), (inverse * column).sum(axis=1)
        ratios = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - step[:, None] * row
        inverse[out] = row
    level = (inverse * np.array(demand, float)).sum(axis=1)
    found: dict[tuple[int, ...], int] = {}
    left = np.array(demand, np.int64)
    for j in range(n):
        config = np.rint(basis[:, j]).astype(np.int64)
        times = min(int(level[j] + 1e-6), int((left[config > 0] // config[config > 0]).min(initial=1 << 60)))
        if times > 0:
            left -= times * config
            key = tuple(config.tolist())
            found[key] = found.get(key, 0) + times
    return list(found.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[tuple[list[tuple[int, int]], int]]:
    """Bin patterns [(length, pieces), ...] with multiplicities that hold each length exactly as often as counted."""
    counts = {k: v for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths are from 1 to the capacity")
    bins: dict[int, list[tuple[Pattern, int]]] = {}  # by the room left
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((pattern, times))

    if capacity in counts:
        put(0, Pattern(None, capacity, 1), counts.pop(capacity))
    big = {k: v for k, v in counts.items() if k > large * capacity}
    rest = {k: v for k, v in counts.items() if k not in big}
    if big:
        grouped = equal_groups(big, groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for group in grouped:  # equal sizes are one
            merged.setdefault(group[0][0], []).extend(group)
        sizes = list(merged)
        stock = [list(merged[s]) for s in sizes]
        for config, times in configurations(sizes, [sum(n for _, n in s) for s in stock], capacity):
            slots = [g for g, n in enumerate(config) for _ in range(n)]
            while times:
                # As many bins as every group can fill alike before one of its lengths runs out.
                each = []
                for g in dict.fromkeys(slots):
                    need, at, room = slots.count(g), 0, times
                    run, have = stock[g][-1]
                    if have >= need:
                        each.append((g, [(run, need)], have // need))
                    else:
                        mixed, at = [], len(stock[g]) - 1
                        while need:
                            length, have = stock[g][at]
                            mixed.append((length, min(have, need)))
                            need, at = need - mixed[-1][1], at - 1
                        each.append((g, mixed, 1))
                room = min([times, *(n for *_, n in each)])
                pattern, used = None, 0
                for g, taken, _ in each:
                    for length, n in taken:
                        pattern, used = Pattern(pattern, length, n), used + length * n
                        i = next(i for i in range(len(stock[g]) - 1, -1, -1) if stock[g][i][0] == length)
                        stock[g][i] = (length, stock[g][i][1] - n * room)
                    stock[g] = [x for x in stock[g] if x[1]]
                put(capacity - used, pattern, room)
                times -= room
        for runs in stock:
            for length, n in runs:
                rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                whole = left // fit
                put(capacity - fit * length, Pattern(None, length, fit), whole)
                if left % fit:
                    put(capacity - left % fit * length, Pattern(None, length, left % fit), 1)
                left = 0
                continue
            room = rooms[at]
            pattern, times = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            fit = room // length
            whole = min(times, left // fit)
            put(room - fit * length, Pattern(pattern, length, fit), whole)
            left, times = left - whole * fit, times - whole
            if times and left:  # fewer than fill one such bin
                put(room - left * length, Pattern(pattern, length, left), 1)
                left, times = 0, times - 1
            put(room, pattern, times)
    return [(pattern.slots(), times) for found in bins.values() for pattern, times in found]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, pieces a bin, first bin, place in the bin) in order of rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first_bin = 0
    for slots, times in patterns:
        offset = 0
        for length, n in slots:
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, n, first_bin, offset))
            ranks[length] = rank + n * times
            offset += n * length
        first_bin += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def packed(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE, ranked: int = RANKED) -> DataFrame:
    """``pieces`` (id, piece, start, length and more) with sequence_id and offset.

    Sequences hold at most ``capacity`` tokens without gaps. ``pieces`` is read three
    times and has to be the same each time, so hand in a checkpoint. Ties and repeated rows
    are dealt out like any other piece; an empty table gives no rows. Columns named
    ``_salt``, ``_row``, ``_n``, ``_before``, ``_rank``, ``sequence_id`` or ``offset`` are an error.
    """
    if taken := {"_salt", "_row", "_n", "_before", "_rank", "sequence_id", "offset"} & {x.lower() for x in pieces.columns}:
        raise ValueError(f"columns {sorted(taken)} are in use")
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast(places(plan(counts, capacity, groups, large)))
    salts = F.create_map(*[F.lit(x) for k, v in counts.items() if v > ranked for x in (k, -(-v // ranked))]) if any(v > ranked for v in counts.values()) else None
    buckets = F.coalesce(salts[F.col("length")], F.lit(1)) if salts is not None else F.lit(1)
    # By place, so that a repeated row is dealt out too; a checkpoint gives every pass the same places.
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), buckets))
    inner = Window.partitionBy("length", "_salt").orderBy("id", "piece", "start")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = salted.withColumn("_row", F.row_number().over(inner)).join(offsets, ["length", "_salt"]).withColumn("_rank", (F.col("_row") + F.col("_before") - 1).cast("long")).drop("_salt", "_row", "_before")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    rows = own[int(length[part[0]])]
                    at = np.searchsorted(rows[:, 0], rank[part], side="right") - 1
                    inside = rank[part] - rows[at, 0]
                    sequence[part] = rows[at, 2] + inside // rows[at, 1]
                    offset[part] = rows[at, 3] + inside % rows[at, 1] * length[part]
            names = [x for x in batch.schema.names if x != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "_rank")
    return in_batches(numbered, seat, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset.

    What is kept between the passes are five numbers a piece, not the tokens.
    """
    cut = tokenized_pieces(docs, vocabulary, id_col, text_col, capacity, end_id)
    kept = checkpointed(cut.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed(kept, capacity)
