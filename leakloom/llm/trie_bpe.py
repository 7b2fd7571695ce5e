"""BPE encoding and decoding by a prefix-sharing trie.

The encoding of a word's prefix is that of a shorter prefix and one last token, and
of all tokens that the prefix ends with only one agrees with the last token before
it. So a state (last token, where it starts) tells everything about a prefix. The
distinct words of a batch go into a trie; a depth-first walk computes each node's
state from those above it, once for all words that share the prefix; at a word's end
its ids are read off backwards. Documents then only look their words up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from leakloom.llm.byte_tokens import written_bytes
from leakloom.llm.common import BATCH_BYTES, file_bytes, in_batches, narrow

#: The words of the vocabulary's pre-tokenizer, with Unicode's white space spelt out.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"
#: Words that a worker remembers, twice over: when there are more, those not met since the last time are forgotten.
REMEMBERED = 300_000
#: Pairs of tokens that it remembers.
PAIRS = 400_000
#: Longer words are met one by one and not remembered.
LONG = 64
NEVER = 1 << 60


class TrieBpe:
    _shared: dict[int, TrieBpe] = {}

    def __init__(self, content: bytes):
        stored = json.loads(content)
        model = stored["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in stored.get("added_tokens", [])}
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        back = {c: b for b, c in enumerate(written_bytes())}
        ends = bytes(range(256))

        def symbols(token: str) -> tuple[bytes, bool]:
            closed = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            return bytes(back[c] for c in (token[: -len(self.suffix)] if closed else token)), closed

        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        formed: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if rank <= max(formed.get(a, -1), formed.get(b, -1)) or whole in self.parts:
                raise ValueError("a merge stands before the merges of its parts, or makes a token again")
            formed[whole] = rank
            self.merged[a, b] = (rank, whole)
            self.parts[whole] = (a, b)
        self.formed = formed
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        self.agrees_cache: dict[int, bool] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        made = set()
        for token, i in sorted(vocab.items(), key=lambda x: formed.get(x[1], -1)):
            if token in self.special:
                continue
            if i in self.parts:
                a, b = self.parts[i]
                if not (a in made and b in made and self._undisturbed(a, b, formed[i])):
                    continue  # no text is ever encoded to this token
            spelt, closed = symbols(token)
            made.add(i)
            (self.closed if closed else self.open)[spelt] = i
        self.begins = {spelt[:k] for spelt in [*self.open, *self.closed] for k in range(1, len(spelt))} | set(self.open)
        missing = [b for b in ends if bytes([b]) not in self.open or (self.suffix and bytes([b]) not in self.closed)]
        if missing:
            raise ValueError("the vocabulary lacks single bytes")
        self.find = regex.compile(WORDS).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.back = back
        self.odd = re.compile(r"[^\x00-ɏ]").search
        library = Tokenizer.from_str(content.decode())
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    @classmethod
    def shared(cls, content: bytes) -> TrieBpe:
        key = hash(content)
        if key not in cls._shared:
            cls._shared[key] = cls(content)
        return cls._shared[key]

    # Which tokens can stand side by side.

    def _right_edge(self, token: int) -> list[tuple[int, int]]:
        """(piece, rank of the merge that takes it in) of the pieces at a token's right edge, over time."""
        if token not in self._right:
            out, at, until = [], token, NEVER
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.formed[at], self.parts[at][1]
            self._right[token] = out
        return self._right[token]

    def _left_edge(self, token: int) -> list[tuple[int, int]]:
        if token not in self._left:
            out, at, until = [], token, NEVER
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.formed[at], self.parts[at][0]
            self._left[token] = out
        return self._left[token]

    def _undisturbed(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge across the border of a and b comes before both are complete (and before ``before``).

        Merges run in order of rank, equal ones from left to right: a merge of rank r
        finds a piece at the right edge of a if r is below the rank that takes the piece
        in, and one at the left edge of b if r is not above that.
        """
        merged = self.merged
        for y, until_y in self._left_edge(b):
            for x, until_x in self._right_edge(a):
                hit = merged.get((x, y))
                if hit is not None and hit[0] < min(until_x, before) and hit[0] <= until_y:
                    return False
        return True

    def agrees(self, a: int, b: int) -> bool:
        key = a << 24 | b
        found = self.agrees_cache.get(key)
        if found is None:
            if len(self.agrees_cache) > PAIRS:
                self.agrees_cache.clear()
            found = self.agrees_cache[key] = self._undisturbed(a, b)
        return found

    # The trie.

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(place in ``words``, ids) of each distinct word, in the order of the walk."""
        root: dict = {}
        ends_here = -1
        for k, word in enumerate(words):
            node = root
            for b in word[:-1]:
                child = node.get(b)
                if child is None:
                    child = node[b] = {}
                node = child
            node.setdefault(ends_here, []).append((word[-1], k))
        last: list[int] = [-1]  # by depth: the last token of the prefix,
        start: list[int] = [0]  # where it starts,
        reach: list[int] = [0]  # and how many of its last bytes begin some token
        single = [bytes([b]) for b in range(256)]
        final = self.closed if self.suffix else self.open
        stack: list[tuple[bytes, dict]] = [(b"", root)]
        while stack:
            path, node = stack.pop()
            if path:
                depth = len(path)
                del last[depth:], start[depth:], reach[depth:]
                token, begin = self._state(path, last, self.open, reach)
                last.append(token)
                start.append(begin)
            for end, k in node.get(ends_here, ()):
                token, at = self._state(path + single[end], last, final, reach, False)
                ids = [token]
                while at:
                    ids.append(last[at])
                    at = start[at]
                yield k, ids[::-1]
            for b, child in node.items():
                if b != ends_here:
                    stack.append((path + single[b], child))

    def _state(self, path: bytes, last: list[int], tokens: dict[bytes, int], reach: list[int], keep: bool = True) -> tuple[int, int]:
        """(last token, where it starts) of the prefix ``path``, from the states of shorter ones.

        A token that ends here begins within what could begin a token one byte before, so
        no longer suffix needs a look.
        """
        n = len(path)
        longest = reach[n - 1] + 1
        if keep:
            while longest > 1 and path[n - longest :] not in self.begins:
                longest -= 1
            reach.append(longest)
        for at in range(n - longest, n):
            token = tokens.get(path[at:])
            if token is not None and (not at or self.agrees(last[at], token)):
                return token, at
        raise AssertionError("every prefix has one encoding")

    # Texts.

    def words(self, text: str) -> list[str]:
        """The words of an ordinary text, as the vocabulary's normaliser and pre-tokenizer make them.

        Texts beyond the Latin blocks go to the library's own normaliser and
        pre-tokenizer, whose edition of Unicode may differ from Python's.
        """
        if text.isascii():
            return self.find(text.lower())
        if self.odd(text):
            text = self.normalizer.normalize_str(text) if self.normalizer else text
            return [bytes(map(self.back.__getitem__, word)).decode() for word, _ in self.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(unicodedata.normalize("NFC", text).lower())

    def _learn(self, fresh: list[str]) -> None:
        for k, ids in self.encode_words([w.encode() for w in fresh]):
            self.known[fresh[k]] = pack("<%dI" % len(ids), *ids)

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids, decoded text) of each text."""
        block: list[list] = []
        size = 0
        for text in texts:
            parts = self.split(text)
            block.append([p if k % 2 else self.words(p) for k, p in enumerate(parts)])
            size += len(text)
            if size > 1 << 21:
                yield from self._encoded(block)
                block, size = [], 0
        yield from self._encoded(block)

    def _encoded(self, block: list[list]) -> Iterator[tuple[bytes, str]]:
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        fresh: set[str] = set()
        for parts in block:
            for words in parts[::2]:
                fresh.update(words)
        fresh.difference_update(self.known)
        for word in fresh & self.before.keys():
            self.known[word] = self.before.pop(word)
        fresh.difference_update(self.known)
        self._learn(list(fresh))
        get = self.known.__getitem__
        for parts in block:
            ids: list[bytes] = []
            for k, part in enumerate(parts):
                if k % 2:
                    ids.append(pack("<I", self.special[part]))
                else:
                    ids.extend(map(get, part))
            own = b"".join(ids)
            yield own, self.decode(own)
        for word in [w for w in fresh if len(w) > LONG]:
            del self.known[word]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included: this vocabulary has no decoder, so tokens stand apart."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their ids (little-endian unsigned 32-bit) and the text these decode to.

    A null or empty text, or one of white space alone, has no ids and decodes to the
    empty text. A text of any length is encoded whole; repeated rows are encoded like any
    other; an empty table gives no rows. Only id and text reach the operator, so other
    columns may have any name.
    """
    model = docs.sparkSession.sparkContext.broadcast(file_bytes(docs.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TrieBpe.shared(model.value)
        for batch in batches:
            ids, done, held, first = [], [], 0, 0
            for own, text in bpe.encode_batch(batch["text"].to_pylist()):
                ids.append(own)
                done.append(text)
                held += len(own) + len(text)
                if held > BATCH_BYTES:
                    yield _encoded_rows(batch["id"].slice(first, len(ids)), ids, done)
                    first, ids, done, held = first + len(ids), [], [], 0
            yield _encoded_rows(batch["id"].slice(first, len(ids)), ids, done)

    return in_batches(narrow(docs, id_col, text_col), run, "id long, ids binary, decoded string")


def _encoded_rows(docs: pa.Array, ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])
