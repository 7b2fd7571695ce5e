"""SimHash near-duplicates by pigeonring filtering.

Fingerprints that differ in at most ``budget`` bits are linked. The 64 bits form a
ring of ``budget + 1`` segments. If two fingerprints are that close, then from some
segment on every chain of consecutive segments keeps within its share of the budget:
the first l segments differ in at most floor(l * budget / (budget + 1)) bits
together, so the first not at all, the first two in at most one bit, and so on round
the ring. The first two segments of the chain are the key of a hash join: one side
gives them as they are, the other also with each single zero bit of the second
segment set. Pairs that meet must pass the rest of the chain, then the full Hamming
check.

Copies, and texts with equal fingerprints, are one node, however many there are. In a
bucket, verified links are reduced to stars at once, so a group of near copies gives
as many rows as it has members and not as it has pairs. Buckets with more than
``block`` fingerprints on the index side are cut into blocks, each of which meets
every probe in a task of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.llm.common import free_name, in_batches, narrow
from leakloom.llm.components import connected_components
from leakloom.session import checkpointed

SEED = 42
SHINGLE = 5
BUDGET = 4
BLOCK = 4096
#: For a given similarity: bits of a fingerprint and of a segment; found at least so often right there, by all tests together;
#: segments of a chain that are checked. None hangs on how many rows there are.
SIMILARITY = 0.8
BITS = 256
KEY_BITS = 18
RECALL = 0.95
CHAIN = 3
#: Shingles that are counted at a time, and bytes of a text whose words are there at a time.
HASHED = 1 << 16
READ = 1 << 18
GAP = re.compile(rb"[\x09-\x0d\x20]")
#: Pairs that are compared at a time.
PAIRS = 1 << 18
#: Shingles of texts that are compared with each other at a time.
COMPARED = 1 << 20
#: Standard deviations by which a pair right at the similarity may differ in more bits than expected.
SIGMAS = 3
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _hashes(raw: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 of the shingles of a lowered text, some of its words at a time; fewer words than a shingle has are one."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    words: list[bytes] = []
    at, some = 0, False
    while at < len(raw):
        gap = GAP.search(raw, at + READ)
        end = gap.start() if gap else len(raw)
        words += raw[at:end].split()
        if len(words) >= shingle:
            some = True
            yield np.array([digest(join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)), strict=False)], np.uint64)
            words = words[len(words) - shingle + 1 :]
        at = end
    if words and not some:
        yield np.array([digest(join(words), SEED)], np.uint64)


def _majority(hashes: Iterable[np.ndarray], bits: int) -> np.ndarray:
    """A bit is set if it is in over half the hashes. The bits after the first 64 are mixed from a hash."""
    ones, total = np.zeros(bits, np.int64), 0
    for mixed in hashes:
        total += len(mixed)
        for k in range(bits // 64):
            if k:
                mixed = mixed + np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = mixed ^ (mixed >> np.uint64(27))
            set_bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            for at in range(0, len(set_bits), 255):
                ones[64 * k : 64 * k + 64] += np.add.reduce(set_bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > total).view(">u8").astype(np.uint64)


def fingerprint_words(text: str, shingle: int = SHINGLE, bits: int = 64) -> np.ndarray:
    """A text's fingerprint as 64-bit words; all zero for a text without words.

    Words are what ASCII white space leaves of the text with A-Z in lower case. A bit is
    set if it is in over half the shingles' hashes, repeats included. The first 64 bits
    of a hash are the shingle's XXH64, the others are mixed from it.
    """
    return _majority(_hashes(text.encode().translate(LOWER), shingle), bits)


def set_fingerprint(text: str, shingle: int = SHINGLE, bits: int = BITS) -> np.ndarray:
    """The same over the distinct shingles, so that repeats, which a Jaccard similarity does not see, do not count."""
    found = shingle_set(text, shingle)
    return _majority((found[at : at + HASHED] for at in range(0, len(found), HASHED)), bits)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH64, sorted; none for a text without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text.encode().translate(LOWER), shingle)]))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned."""
    return int(fingerprint_words(text, shingle)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fingerprint (a signed long with the same bits) of every whole text; null texts are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, shingle) for text in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found.view(np.int64))], ["id", "fingerprint"])

    return in_batches(narrow(docs, id_col, text_col), run, "id long, fingerprint long")


def segments(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments, from the highest bits down."""
    count = budget + 1
    widths = [64 // count + (k < 64 % count) for k in range(count)]
    return [(64 - sum(widths[: k + 1]), w) for k, w in enumerate(widths)]


def _cut(values: np.ndarray, segment: tuple[int, int]) -> np.ndarray:
    return (values >> np.uint64(segment[0])) & np.uint64((1 << segment[1]) - 1)


def keyed(prints: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(which fingerprint, its key, whether it is the index side) for all chains and variants."""
    ring = segments(budget)
    here = np.arange(len(prints))
    for k, first in enumerate(ring):
        second = ring[(k + 1) % len(ring)]
        exact = (np.uint64(k) << np.uint64(56)) | (_cut(prints, first) << np.uint64(second[1]))
        after = _cut(prints, second)
        yield here, exact | after, True
        yield here, exact | after, False
        if 2 * budget // len(ring) >= 1:
            for bit in range(second[1]):
                flip = np.uint64(1 << bit)
                zero = here[(after & flip) == 0]
                yield zero, (exact | after | flip)[zero], False


def in_chain(one: np.ndarray, other: np.ndarray, first: np.ndarray, budget: int) -> np.ndarray:
    """Whether the chain from segment ``first`` on keeps within its budgets, all round the ring.

    The last of these conditions is the full Hamming check.
    """
    ring = segments(budget)
    apart = one ^ other
    each = np.stack([np.bitwise_count(_cut(apart, s)) for s in ring]).astype(np.int64)
    kept = apart != 0
    so_far = np.zeros(len(apart), np.int64)
    column = np.arange(len(apart))
    for step in range(len(ring)):
        so_far += each[(first + step) % len(ring), column]
        kept &= so_far <= (step + 1) * budget // len(ring)
    return kept


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each linked node but the smallest of its component, with that smallest."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    hung = label != np.arange(len(nodes))
    return nodes[hung], nodes[label[hung]]


def close_pairs(nodes: DataFrame, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes (node, fingerprint) that connect whatever is at most ``budget`` bits apart.

    They connect the same components as all such pairs would, in fewer rows.
    """
    schema = "key long, probe boolean, fingerprint long, node long"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                own, node = part["fingerprint"].to_numpy(), part["node"].to_numpy()
                rows = [(which, key, np.full(len(which), not index)) for which, key, index in keyed(own.view(np.uint64), budget)]
                which = np.concatenate([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)), pa.array(np.concatenate([r[2] for r in rows])), pa.array(own[which]), pa.array(node[which])], ["key", "probe", "fingerprint", "node"])

    rows = in_batches(nodes.select("fingerprint", "node"), spread, schema)
    large = checkpointed(rows.filter("not probe").groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    if large.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:
        rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.array(F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("block", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    met = rows.select("key", "block", "probe", "fingerprint", "node").repartition("key", "block").sortWithinPartitions("key", "block", "probe")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the index side of the group that the last batch ended in
        for batch in batches:
            now = [batch[x].to_numpy(zero_copy_only=False) for x in ("key", "block", "probe", "fingerprint", "node")]
            if carried is not None:
                now = [np.concatenate(x) for x in zip(carried, now, strict=True)]
            key, part, probe, own, node = now
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
            sizes = np.bincount(group, weights=~probe, minlength=len(starts)).astype(np.int64)
            last = group == len(starts) - 1
            carried = [x[last & ~probe] for x in now]
            probes = np.flatnonzero(probe & (sizes[group] > 0))
            totals = np.cumsum(sizes[group[probes]])
            a, b = [], []
            at = 0
            while at < len(probes):
                done = totals[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(totals, done + PAIRS, side="right")))
                mine = np.repeat(probes[at:to], sizes[group[probes[at:to]]])
                within = np.arange(len(mine)) - np.repeat(np.r_[0, totals[at : to - 1] - done], sizes[group[probes[at:to]]])
                theirs = starts[group[mine]] + within
                good = in_chain(own[mine].view(np.uint64), own[theirs].view(np.uint64), (key[mine].view(np.uint64) >> np.uint64(56)).astype(np.int64), budget)
                if good.any():
                    x, y = stars(node[mine[good]], node[theirs[good]])
                    a.append(x)
                    b.append(y)
                at = to
            if a:
                x, y = stars(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return in_batches(met, meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable by links, of every row.

    Texts without words share the fingerprint zero and are linked like any others.
    Repeated rows keep a row each; rows of one id are one node. A row without an id is in
    the component of the texts like its own, but links nothing to it. A text of any length
    is read whole; fingerprints right at the budget are linked; an empty table gives no
    rows. Only id and text reach the operator, so other columns may have any name.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fingerprint").agg(F.min("id").alias("node"))
    found = connected_components(close_pairs(nodes.filter("node is not null"), budget, block).unionByName(_same_id(prints, nodes)), "a", "b")
    named = nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    rows = prints.join(named, "fingerprint")
    return rows.select("id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def apart(similarity: float) -> float:
    """The share of bits in which texts of a Jaccard similarity of their shingles are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def within(bits: int, similarity: float) -> int:
    """Bits of ``bits`` in which texts right at ``similarity`` differ at most, but for one pair in several hundred."""
    share = apart(similarity)
    return min(bits, math.ceil(bits * share + SIGMAS * math.sqrt(bits * share * (1 - share))))


def tables_for(key_bits: int, similarity: float = SIMILARITY, recall: float = RECALL, bits: int = BITS) -> int:
    """How many segments find ``recall`` of the pairs right at ``similarity``, the chain and Hamming tests included.

    Which segments two fingerprints share depends on how many bits they differ in, so
    that number is summed over.
    """
    share, differ = apart(similarity), np.arange(within(bits, similarity) + 1)
    chance = np.exp([math.lgamma(bits + 1) - math.lgamma(n + 1) - math.lgamma(bits - n + 1) + n * math.log(share) + (bits - n) * math.log(1 - share) for n in differ.tolist()])
    chain = 1.0
    for step in range(1, CHAIN):
        n = step * key_bits
        chain *= sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(within(n, similarity) + 1))
    met = chain * np.prod([np.maximum(0, bits - differ - k) / (bits - k) for k in range(key_bits)], axis=0)
    tables = 1
    while tables < 1 << 14 and chance @ (1 - (1 - met) ** tables) < recall:
        tables += 1
    return tables


def rings(key_bits: int, tables: int, bits: int = BITS) -> list[np.ndarray]:
    """Orders of the bits: as they are, then shuffled, as many as it takes for ``tables`` segments."""
    orders = -(-tables // (bits // key_bits))
    return [np.arange(bits) if k == 0 else np.random.default_rng([SEED, k]).permutation(bits) for k in range(orders)]


def similar_links(nodes: DataFrame, key_bits: int, tables: int, similarity: float = SIMILARITY, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """Links (a, b) between nodes (node, fingerprint of ``bits`` bits) that agree in a whole segment and are close, for an exact check.

    The segments of ``key_bits`` bits form a ring; where there are more of them than the
    bits have room for, further rings have the bits in other orders. Nodes that agree in
    one meet; the chain from there on must keep within its share for CHAIN segments, then
    the full Hamming distance within its own. Buckets give stars, never pairs; those of
    more than ``block`` nodes are cut into blocks that meet two by two.
    """
    kinds = "key long, own int, low int, high int, node long, fingerprint binary"
    orders, each = rings(key_bits, tables, bits), bits // key_bits
    chains = np.zeros((CHAIN, tables, bits), bool)  # the bits of the chain so far, without its first segment
    for step in range(1, CHAIN):
        for t in range(tables):
            chains[step, t] = chains[step - 1, t]
            chains[step, t, orders[t // each][(t + step) % each * key_bits :][:key_bits]] = True
    chains = np.packbits(chains, axis=2).view(">u8").astype(np.uint64)
    budget, budgets = within(bits, similarity), [within(step * key_bits, similarity) for step in range(CHAIN)]

    def segment(prints: np.ndarray, t: int) -> np.ndarray:
        at, inside = divmod(t % each * key_bits, 64)
        value = prints[:, at] << np.uint64(inside)
        if inside + key_bits > 64:
            value = value | (prints[:, at + 1] >> np.uint64(64 - inside))
        return value >> np.uint64(64 - key_bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.slice(first, 2048)
                prints = np.frombuffer(b"".join(part["fingerprint"].to_pylist()), "<u8").reshape(len(part), -1)
                single = np.unpackbits(prints.astype(">u8").view(np.uint8), axis=1)
                zeros = pa.array(np.zeros(len(part), np.int32))
                for t in range(tables):
                    if t % each == 0:
                        turned = np.ascontiguousarray(np.packbits(single[:, orders[t // each]], axis=1)).view(">u8").astype(np.uint64)
                    key = (np.uint64(t) << np.uint64(48)) | segment(turned, t)
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), zeros, zeros, zeros, part["node"], part["fingerprint"]], ["key", "own", "low", "high", "node", "fingerprint"])

    rows = in_batches(nodes.select("node", "fingerprint"), spread, kinds)
    large = checkpointed(rows.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    if not large.isEmpty():
        rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    met = rows.select("key", "low", "high", "own", "node", "fingerprint").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compare(key, low, high, own, node, prints) -> pa.RecordBatch:
        a, b, held = [], [], 0
        step = 1
        here = np.arange(len(key))
        while True:
            here = here[here + step < len(key)]
            there = here + step
            together = (key[here] == key[there]) & (low[here] == low[there]) & (high[here] == high[there])
            here = here[together]
            if not len(here):
                break
            there = here + step
            good = (low[here] == high[here]) | (own[here] != own[there])
            i, j = here[good], there[good]
            differ = prints[i] ^ prints[j]
            for chain in range(1, CHAIN):
                kept = np.bitwise_count(differ & chains[chain, key[i] >> 48]).sum(axis=1, dtype=np.int64) <= budgets[chain]
                i, j, differ = i[kept], j[kept], differ[kept]
            close = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= budget
            a.append(node[i[close]])
            b.append(node[j[close]])
            held += len(a[-1])
            if held > PAIRS:  # a dense bucket's pairs become stars before there are many of them
                x, y = stars(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
            step += 1
        x, y = stars(np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            now = [batch[x].to_numpy() for x in ("key", "low", "high", "own", "node")]
            now.append(np.frombuffer(b"".join(batch["fingerprint"].to_pylist()), "<u8").reshape(len(batch), -1))
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            held = [x[last] for x in now]
            yield compare(*(x[~last] for x in now))
        if held is not None:
            yield compare(*held)

    return in_batches(met, meet, "a long, b long")


def alike(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever nodes have a Jaccard similarity of at least ``similarity``.

    All pairs are compared but those that are connected already.
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(distinct), bool)
    label = np.arange(len(nodes))
    a, b = [], []
    for i in range(len(nodes)):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - 1e-6]
        if not len(rest):
            continue
        own = place[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        first = np.cumsum(sizes[rest]) - sizes[rest]
        hits = marked[place[np.repeat(starts[rest] - first, sizes[rest]) + np.arange(sizes[rest].sum())]]
        common = np.add.reduceat(hits, first, dtype=np.int64)
        marked[own] = False
        good = rest[common / (sizes[rest] + sizes[i] - common) >= similarity]
        if len(good):
            joined, at = np.unique(label[good], return_index=True)
            a.append(np.full(len(at), nodes[i]))
            b.append(nodes[good[at]])
            label[np.isin(label, joined)] = label[i]
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def verified_links(docs: DataFrame, met: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, similarity: float = SIMILARITY, compared: int = COMPARED) -> DataFrame:
    """Links (a, b) between ids that one component of ``met`` (node, component) holds and whose texts are ``similarity`` alike.

    The similarity is the Jaccard similarity of the sets of shingles, without estimate.
    Components with more than ``compared`` shingles are cut into blocks that meet two by two.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, shingle) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["component"], batch["id"], pa.array([len(x) for x in sets], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["component", "node", "n", "shingles"])

    texts = narrow(docs, id_col, text_col).join(met, F.col("id") == F.col("node")).select("component", "id", "text")
    rows = checkpointed(in_batches(texts, spread, "component long, node long, n long, shingles binary").filter("n > 0"))
    large = checkpointed(rows.groupBy("component").agg(F.sum("n").alias("n")).filter(F.col("n") > compared).select("component", F.ceil(F.col("n") / compared).cast("int").alias("blocks")))
    if large.isEmpty():
        rows = rows.select("*", F.lit(0).alias("low"), F.lit(0).alias("high"))
    else:
        rows = rows.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> own or blocks = 1")
        rows = rows.select("component", "node", "shingles", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    together = rows.select("component", "low", "high", "node", "shingles").repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets, seen = None, [], [], set()

        def done() -> pa.RecordBatch:
            a, b = alike(np.array(nodes, np.int64), sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for *now, node, raw in zip(*(batch[x].to_pylist() for x in ("component", "low", "high", "node", "shingles")), strict=True):
                if now != group:
                    if len(nodes) > 1:
                        yield done()
                    group, nodes, sets = now, [], []
                if not nodes or node != nodes[-1]:
                    seen = set()
                if raw not in seen:  # repeated rows of one id
                    seen.add(raw)
                    nodes.append(node)
                    sets.append(np.frombuffer(raw, "<u8"))
        if len(nodes) > 1:
            yield done()

    return in_batches(together, meet, "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, key_bits: int = KEY_BITS) -> DataFrame:
    """id and component_id of every row, texts whose shingles are ``similarity`` alike being linked.

    Such texts differ in too many of 64 bits for an exact index, so fingerprints are
    longer, and have as many segments as find RECALL of the pairs right at ``similarity``,
    and nearly all closer ones. They only say which texts may be alike; the shingles themselves say
    which are. Which pairs are found does not hang on what other rows there are: length,
    budgets and segments are parameters, and size decides only into how many blocks a
    bucket is cut. ``key_bits`` trades segments for bucket size: two more bits make
    buckets a quarter as large and the segments half as many again.
    Rules for rows and ids are those of ``near_duplicates``.
    """
    tables = tables_for(key_bits, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_fingerprint(text, shingle).astype("<u8").tobytes() for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.binary())], ["id", "fingerprint"])

    prints = checkpointed(in_batches(narrow(docs, id_col, text_col), run, "id long, fingerprint binary"))
    nodes = prints.groupBy("fingerprint").agg(F.min("id").alias("node"))
    links = similar_links(nodes.filter("node is not null"), key_bits, tables, similarity, block)
    links = verified_links(docs, connected_components(links, "a", "b"), id_col, text_col, shingle, similarity)
    found = connected_components(links.unionByName(_same_id(prints, nodes)), "a", "b")
    named = nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fingerprint").select("id", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, key_bits: int = KEY_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one is left of each group of near-duplicates.

    That is the one with the group's smallest id; of several rows with this id, the one
    whose text comes first. Rows without an id have nothing to be told apart by and stay.
    Null and empty texts are copies of each other; texts right at the similarity are
    alike; an empty table gives no rows; columns of any name pass through.
    """
    found = similar_components(docs, id_col, text_col, shingle, similarity, key_bits=key_bits)
    kept, several = free_name(docs, "kept"), free_name(docs, "several")
    first = found.filter("id = component_id").select(F.col("id").alias(kept)).distinct()
    left = docs.join(first, docs[id_col].cast("long") == F.col(kept), "left_semi")
    nameless = docs.filter(docs[id_col].isNull())
    if left.select(id_col).groupBy(id_col).count().filter("count > 1").isEmpty():
        return left.unionByName(nameless)
    order = Window.partitionBy(id_col).orderBy(F.coalesce(F.col(text_col), F.lit("")))
    return left.withColumn(several, F.row_number().over(order)).filter(F.col(several) == 1).drop(several).unionByName(nameless)


def _same_id(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of one id that stands in several rows."""
    several = prints.groupBy("id").agg(F.min(F.xxhash64("fingerprint")).alias("low"), F.max(F.xxhash64("fingerprint")).alias("high")).filter("low <> high and id is not null").select("id")
    return prints.join(several, "id").join(nodes, "fingerprint").select(F.col("id").alias("a"), F.col("node").alias("b"))
