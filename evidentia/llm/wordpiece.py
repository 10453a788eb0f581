"""Ids of the public word-level BPE tokenizer, with a cache of words.

The tokenizer lower-cases, drops white space, splits at character classes and
merges within a piece, so the ids of a text are the ids of its chunks between
white space, one after the other. Chunks repeat, so their ids are kept; the
merges of a new piece run on the tokenizer's own merge ranks. Texts with
characters for which Unicode tables may differ, or with the special tokens'
strings, go to the tokenizer itself, whole.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Characters that take the slow way: other white space, number signs, all from
#: U+0250 but dashes, quotes, bullet, ellipsis and euro, and what may begin a
#: special token.
SLOW = re.compile(
    "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\u2012\u2015-\u2017\u201a\u201b\u201e-\u2021\u2023-\u2025\u2027-\u20ab\u20ad-\U0010ffff]|<\\|"
)
#: The tokenizer's own split, for the other characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
END = b"\xff"  # stands for the end of a word; no byte of UTF-8
CHUNKS = 250_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 characters for
    themselves, the others counted from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_alphabet()
        ids = {}
        for token, at in vocab.items():
            core, end = (token[:-4], END) if token.endswith("</w>") else (token, b"")
            if all(c in letters for c in core):
                ids[bytes(letters[c] for c in core) + end] = at
        order = [bytes([b]) for b in range(256)]
        order += sorted((k for k in ids if len(k) > 1), key=lambda k: (len(k) > 2 or k[-1:] != END, ids[k]))
        ranks = {k: r for r, k in enumerate(order)}
        self._id = [ids.get(k, 0).to_bytes(4, "little") for k in order]
        self._merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _piece(self, piece: str) -> bytes:
        of = self._id
        return b"".join([of[r] for r in self._merge(piece.encode() + END)])

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CHUNKS:
            self.clear()
        if chunk.isalpha():
            ids = self._piece(chunk)
        elif chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            ids = self[chunk[:-1]] + self._piece(chunk[-1])
            return ids  # not kept: the word is
        else:
            ids = b"".join(map(self._piece, PIECES.findall(chunk)))
        self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null is empty."""
        if not text:
            return b""
        if SLOW.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.lru_cache(1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
