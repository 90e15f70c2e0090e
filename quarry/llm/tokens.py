"""Whole-text encoding with a fixed vocabulary of the ``tokenizers`` library.

A vocabulary whose normaliser composes, joins white space and lower-cases, and whose splitter takes
runs of letters and of signs apart (``WORDWISE``), never looks across white space: a text's ids are
its chunks' ids joined.  A bounded per-worker table remembers each chunk's ids.  A chunk of letters
(ASCII and Latin ones that are composed already) and signs after them goes to the model as its
two words; any other chunk is encoded by the library.  ASCII texts are lower-cased first, which makes
the table smaller, unless they hold ``<|``: special tokens are matched before the normaliser.

Any other vocabulary encodes whole texts by the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import keep_until_other_work

#: Chunks remembered by a Python worker before its table starts anew.
MAX_CHUNKS = 600_000

# The normaliser and splitter that this module's rules are for.
WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)

_encoders: dict[str, Encoder] = {}

#: Letters that are lower-cased one to one and composed already, then signs but ' and <.
_WORD_SIGNS = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:;=-@\\[-`{-~]*)")

# Byte-level vocabularies write a byte as a character: itself where that is printable, else one beyond 255.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LETTERS = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}


def _foldable(text: bytes) -> bool:
    """Whether lower-casing A-Z before the library sees the text leaves its ids as they are."""
    return text.isascii() and b"<|" not in text


class Encoder(dict):
    """Maps a chunk's bytes to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        held = json.loads(self.tokenizer.to_str())
        plain = all("<|" in t["content"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in held["added_tokens"])
        self.wordwise = plain and (held["normalizer"], held["pre_tokenizer"]) == WORDWISE and held["model"]["type"] == "BPE" and not held["model"].get("ignore_merges")
        keep_until_other_work(self.clear)

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if _foldable(chunk) and (low := chunk.lower()) != chunk:
            out = self[low]
        elif found := _WORD_SIGNS.fullmatch(text := chunk.decode()):
            word, signs = found.groups()
            out = self._ids([t.id for t in self.model.tokenize(word.lower().translate(_LETTERS))])
            if signs:
                out += self[signs.encode()]
        else:
            out = self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def encode(self, text: bytes | None, end: bytes = b"") -> bytes:
        """All ids of a whole text (null: none) and ``end``, as little-endian bytes."""
        if len(self) > MAX_CHUNKS:
            self.clear()
        if not text:
            return end
        if not self.wordwise:
            return self._ids(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids) + end
        return b"".join(map(self.__getitem__, (text.lower() if _foldable(text) else text).split())) + end


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
