"""The byte-level BPE of a tokenizers file, run by tiktoken.

A tokenizers file lists merges in order of rank and numbers their results alike, so
its vocabulary turned back into bytes is a tiktoken rank table. tiktoken then makes
the same ids several times as fast; the tests hold it against the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import tiktoken

#: How byte-level vocabularies write bytes, and the pattern of their pre-tokens.
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: tiktoken's pattern fails on runs of about a million white-space characters, so longer ones than this go round it.
WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{20000,}")


def written_bytes() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100 on."""
    spare = iter(range(256))
    return [chr(b) if b in set(PRINTABLE) else chr(256 + next(spare)) for b in range(256)]


class ByteTokenizer:
    _shared: dict[int, ByteTokenizer] = {}

    def __init__(self, content: bytes):
        stored = json.loads(content)
        back = {c: b for b, c in enumerate(written_bytes())}
        special = {x["content"]: x["id"] for x in stored.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special}
        self.special = special
        self.tables = tiktoken.Encoding("stored", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def shared(cls, content: bytes) -> ByteTokenizer:
        """One for each vocabulary and worker process."""
        key = hash(content)
        if key not in cls._shared:
            cls._shared[key] = cls(content)
        return cls._shared[key]

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers; the strings of special tokens are those tokens."""
        return self._around(text, lambda x: self.tables.encode_to_numpy(x, allowed_special="all"), tuple(self.special))

    def encode_ordinary(self, text: str) -> np.ndarray:
        return self._around(text, lambda x: self.tables.encode_to_numpy(x, disallowed_special=()), ())

    def _around(self, text: str, encode: Callable[[str], np.ndarray], special: tuple[str, ...]) -> np.ndarray:
        """The ids of a text whose long white-space runs are cut out as the pre-tokens that they are.

        The last character of a run is the next pre-token's, but before a special token and at the end.
        """
        out, at = [], 0
        for run in WHITE.finditer(text):
            end = run.end() - (run.end() < len(text) and not text.startswith(special, run.end()))
            out += [encode(text[at : run.start()]), np.array(self.tables._encode_single_piece(text[run.start() : end]), np.uint32)]
            at = end
        return np.concatenate([*out, encode(text[at:])]) if out else encode(text)
