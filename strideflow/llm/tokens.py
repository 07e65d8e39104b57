"""Token counts under a public byte-level BPE vocabulary.

The vocabulary file's path is a parameter; executors load it once per process.
Stretches of over ``RUN`` blanks, which the pattern's engine can't take, are
encoded as the one piece that the pattern makes of them; the sizes are those of
the whole text.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: the pattern that the vocabulary's words are cut by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RUN = 4000
_LONG = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


class Tokenizer:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._core = self._encoding.encode_ordinary
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        if len(text) < RUN or not _LONG.search(text):
            return self._core(text)
        out, at = [], 0
        for m in _LONG.finditer(text):
            end = m.end() - (m.end() < len(text))  # the last blank goes with what follows
            out += self._core(text[at : m.start()])
            out += self._encoding._core_bpe.encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + self._core(text[at:])

    def count(self, text: str) -> int:
        return len(self.encode(text)) if text else 0


@lru_cache(maxsize=4)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(path)
