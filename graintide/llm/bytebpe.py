"""Byte-level BPE of a public tokenizer file, as the tokenizers library encodes.

Texts of common characters go through tiktoken over the vocabulary of the same file, which is several times faster
and gives the same ids; any other text goes through tokenizers itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the split that the byte-level pre-tokenizer applies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which both libraries agree beyond doubt: printable Latin, its usual punctuation and plain white space.
UNCOMMON = re.compile(r"[^\t\n\r -~\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, by the usual rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    _made: dict[str, "ByteBpe"] = {}

    @classmethod
    def of(cls, path: str) -> "ByteBpe":
        """One coder per worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        to_byte = byte_alphabet()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.exact = Tokenizer.from_str(json.dumps(content | {"truncation": None, "padding": None}))
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.plain = Tokenizer.from_str(json.dumps(content | {"truncation": None, "padding": None}))
        self.plain.encode_special_tokens = True
        self.spelling = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in special.items()}

    def encode(self, text: str) -> np.ndarray:
        if UNCOMMON.search(text):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)

    def encode_plain(self, text: str) -> np.ndarray:
        """As encode, but the strings of special tokens are text like any other."""
        if UNCOMMON.search(text):
            return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        return [self.spelling.get(i, b"") for i in range(max(self.spelling) + 1)]
