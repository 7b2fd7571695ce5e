"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary learnt from ordinary text packs words into few tokens; random strings
break into many. Runs of key-like characters with few characters a token are
reported as ``random``, unless they are known digests, identifiers, or inside what
the fixed patterns found. What is left of a run outside those is tested whole, then
by its pieces between joining characters, then by windows, so that readable text
around a random string does not hide it. Kinds, in order: assign, access, hex, random.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.llm.byte_tokens import PRE_TOKENS
from leakloom.llm.common import file_bytes, in_batches, narrow

KINDS = ("assign", "access", "hex", "random")
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 16
#: One of these is in every text that ASSIGN matches; searching for them is far quicker.
CUES = ("passw", "secret", "token", "apikey", "api_key")
#: The other patterns' matches lie in runs of at least this many such characters.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
CANDIDATE_LEAST = 20
#: Fewer characters a token than this is random.
EFFICIENCY = 2.0

#: Known digests: hexadecimal of a hash function's length; UUIDs.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})\Z")
#: The same inside a run, and what joins the pieces of a run.
DIGESTS = re.compile(r"(?<![A-Za-z0-9])" + DIGEST.pattern.removesuffix(r"\Z") + r"(?![A-Za-z0-9])")
PIECE = re.compile(r"[A-Za-z0-9]+")
#: Identifiers: words in lower, upper or capitalised letters, joined by underscores, hyphens, slashes or plus
#: signs or run together, with numbers only as parts of their own; plain numbers; rules of one character.
IDENTIFIER = re.compile(r"(?:[_/+=-]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[A-Za-z](?=[_/+=-]|\Z)|(?<![A-Za-z0-9])[0-9]++(?=[_/+=-]|\Z)))++[0-9]{0,4}[_/+=-]*\Z")


def _outside(spans: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """What of start to end is in none of the spans."""
    out = []
    for a, b in sorted(spans):
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
    if start < end:
        out.append((start, end))
    return out


class SecretScanner:
    _shared: dict[int, SecretScanner] = {}

    def __init__(self, ranks_file: bytes, efficiency: float = EFFICIENCY):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        self.tokens = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.efficiency = efficiency

    @classmethod
    def shared(cls, ranks_file: bytes, efficiency: float = EFFICIENCY) -> SecretScanner:
        key = hash((ranks_file, efficiency))
        if key not in cls._shared:
            cls._shared[key] = cls(ranks_file, efficiency)
        return cls._shared[key]

    def random(self, run: str) -> bool:
        """Whether a run of key-like characters is a random string."""
        if len(run) < CANDIDATE_LEAST or DIGEST.match(run) or IDENTIFIER.match(run):
            return False
        if sum((run.lower() != run, run.upper() != run, any(map(str.isdigit, run)))) < 2:
            return False  # one kind of character is a word, a number or a rule
        return len(run) < self.efficiency * len(self.tokens.encode_ordinary(run))

    def within(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the random strings in a run: all of it, else its pieces, else windows of what is left.

        Where only windows tell, a place may reach some characters into the text around.
        """
        found: list[tuple[int, int]] = []
        for a, b in _outside([m.span() for m in DIGESTS.finditer(run)], 0, len(run)):
            if self.random(run[a:b]):
                found.append((a, b))
                continue
            pieces = [m.span() for m in PIECE.finditer(run, a, b) if self.random(m[0])]
            found += pieces
            for x, y in _outside(pieces, a, b):
                if IDENTIFIER.match(run[x:y]):
                    continue
                end = -1
                for at in range(x, y - CANDIDATE_LEAST + 1):
                    if self.random(run[at : at + CANDIDATE_LEAST]):
                        if at <= end:
                            found[-1] = (found[-1][0], at + CANDIDATE_LEAST)
                        else:
                            found.append((at, at + CANDIDATE_LEAST))
                        end = at + CANDIDATE_LEAST
        return found

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind; code points, end exclusive."""
        found: list[tuple[int, int, int]] = []
        low = text.lower()
        if any(cue in low for cue in CUES):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        covers, at = [(a, b) for a, _, b in found], 0  # in order, and none overlaps another
        for run in RUN.finditer(text):
            a, b = run.span()
            while at < len(covers) and covers[at][1] <= a:
                at += 1
            to = at
            while to < len(covers) and covers[to][0] < b:
                to += 1
            own = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= ACCESS_LEAST]
            own += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= HEX_LEAST]
            found += own
            for x, y in _outside([(m, n) for m, _, n in own] + covers[at:to], a, b):
                if y - x >= CANDIDATE_LEAST:
                    found += [(x + m, 3, x + n) for m, n in self.within(text[x:y])]
        return [(KINDS[kind], a, b) for a, kind, b in sorted(found)]

    def redacted(self, text: str, instead: str) -> str:
        out, at = [], 0
        for _, a, b in self.spans(text):
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], instead]
            at = b
        return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", efficiency: float = EFFICIENCY) -> DataFrame:
    """Each document with its spans: id, spans array<struct<kind, start, end>>.

    Null and empty texts have no spans. Whole texts are read whatever their length;
    repeated rows are scanned like any other; an empty table gives no rows. Only id and
    text reach the operator, so other columns may have any name.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(file_bytes(docs.sparkSession, ranks_path))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner.shared(ranks.value, efficiency)
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(text)] for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(spans, kind)], ["id", "spans"])

    return in_batches(narrow(docs, id_col, text_col), run, "id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, ranks_path: str, text_col: str = "text", length_col: str | None = "n_chars", instead: str = "[secret]", efficiency: float = EFFICIENCY) -> DataFrame:
    """``docs`` with the secrets in their texts replaced; every row and column stays, a null text stays null.

    ``length_col``, where there is such a column, follows the new text of changed rows.
    Texts of any length are read whole; repeated rows change alike; an empty table gives
    no rows; no column is added, so none can clash.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(file_bytes(docs.sparkSession, ranks_path))
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner.shared(ranks.value, efficiency)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            done = [t and scanner.redacted(t, instead) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(done, batch.schema.field(at).type)
            if length_at is not None:
                columns[length_at] = pa.array([n if t is d or t == d else len(d) for n, t, d in zip(columns[length_at].to_pylist(), texts, done, strict=True)], batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return in_batches(docs, run, docs.schema)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
