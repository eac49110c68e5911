"""Token ids of whole texts, exactly those of the tokenizers library.

Both public vocabularies first split a text into pieces and then merge inside
each piece, so a piece has the same ids wherever it stands. Texts of plain Latin
script are split here with the vocabulary's own pattern and the library encodes
each different piece once; every other text goes to the library whole. Tests
compare the two ways.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np

from vecspark.llm._shared import CLEARERS
from vecspark.llm._words import chunks

#: The piece patterns of the two vocabularies, with their letter, number
#: and space classes written out for the characters that are split here.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼-¾", r"\t\n\r \xa0"
PATTERNS = {
    "byte_bpe_50k.json": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+",
    "word_bpe_49k.json": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+",
}
#: Other scripts, control characters, combining marks and special-token strings go whole.
WHOLE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞]|<\|")
#: Pieces remembered by one worker; on reaching it the memory starts afresh.
REMEMBERED = 1_000_000
#: Likewise for the characters remembered.
REMEMBERED_CHARS = 40_000_000


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of that name is; never copied into the library."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Piece to number; a new piece gets the next one and waits to be encoded.

    A piece with a character of WHOLE gets -1: its text goes to the library whole.
    """

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.given = self.chars = 0

    def __missing__(self, piece: str) -> int:
        n = -1
        if not WHOLE.search(piece):
            self.new.append(piece)
            n = self.given
            self.given += 1
        self.chars += len(piece)
        self[piece] = n
        return n


class Encoder:
    """Ids of texts by one tokenizer file; one for each worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        pattern = PATTERNS.get(os.path.basename(path))
        self.pattern = re.compile(pattern) if pattern else None
        self.lower = os.path.basename(path) == "word_bpe_49k.json"
        self.size = self.tok.get_vocab_size()
        self._clear()

    def _clear(self) -> None:
        self.known = _Known()
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.used = self.done = 0

    def _learn(self) -> None:
        """Encode the waiting pieces in one call."""
        pieces, self.known.new = self.known.new, []
        enc = self.tok.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids, owner = np.array(enc.ids, np.int32), np.array(enc.word_ids, np.int64)
        n, at = self.done, self.used
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + 1 + len(pieces) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[at : at + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(pieces)] = at + np.cumsum(np.bincount(owner, minlength=len(pieces)))
        self.used, self.done = at + len(ids), n + len(pieces)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts are looked up together, about a megabyte at once."""
        out: list[np.ndarray] = []
        for a, b in chunks([len(t) for t in texts], 1_000_000):
            if len(self.known) >= REMEMBERED or self.known.chars >= REMEMBERED_CHARS:
                self._clear()
            at, counts, whole = [], [], {}
            for i, text in enumerate(texts[a:b]):
                found = np.zeros(0, np.int64)
                if self.pattern is not None:
                    plain = unicodedata.normalize("NFC", text).lower() if self.lower else text
                    pieces = self.pattern.findall(plain)
                    found = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
                if self.pattern is None or len(found) and found.min() < 0:
                    whole[i], found = self._whole(text), found[:0]
                counts.append(len(found))
                at.append(found)
            if self.known.new:
                self._learn()
            at = np.concatenate(at)
            first = self.ends[at]
            n = self.ends[at + 1] - first
            ends = np.cumsum(n)
            flat = self.flat[np.arange(n.sum()) + np.repeat(first - ends + n, n)]
            ends = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
            out += [whole.get(i, flat[ends[i] : ends[i + 1]]) for i in range(b - a)]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


_ENCODERS: dict[str, Encoder] = {}
CLEARERS.append(_ENCODERS.clear)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
