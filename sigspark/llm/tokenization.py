"""Whole-text token ids of the ``tokenizers`` library, fast on repeated words.

The library's encoders split a text into pre-tokens first. Some places are a
pre-token border whatever stands around them (white space after a visible
character, an ASCII letter beside a digit or sign, and so on). A batch is cut
there, equal pieces are encoded once by the library, and the ids are gathered
back in text order. Texts that hold a special token's string go to the library
as a whole.
"""
from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from sigspark.llm.text import column_buffer, lower_ascii, ranges

#: Pieces remembered by one Python worker; beyond it the memory is cleared.
CACHE_PIECES = 600_000

_SPACE, _LETTER, _DIGIT, _SIGN, _HIGH, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _HIGH
# borders between two ASCII kinds
_BORDER = np.zeros((6, 6), bool)
for _a in (_LETTER, _DIGIT, _SIGN):
    for _b in (_LETTER, _DIGIT, _SIGN):
        _BORDER[_a, _b] = _a != _b
    _BORDER[_a, _SPACE] = True
_BORDER = _BORDER.ravel()


def piece_borders(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted byte positions where a piece starts; every row start is one."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _KIND[buf]
    cut = np.zeros(n, bool)
    cut[1:] = _BORDER[kind[:-1] * 6 + kind[1:]]
    # an apostrophe may open a contraction together with the letter behind it
    cut[1:] &= ~((buf[:-1] == 39) & (kind[1:] == _LETTER))
    # white space after a character beyond ASCII that is not itself white space
    at = np.flatnonzero((kind[1:] == _SPACE) & (kind[:-1] == _HIGH)) + 1
    if len(at):
        b1, b2, b3 = buf[at - 1], buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
        blank = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 >= 0xE1) & (b3 <= 0xE3))
        cut[at[~blank]] = True
    # a single line break between two visible ASCII characters stands alone
    if n > 2:
        visible = (kind >= _LETTER) & (kind <= _SIGN)
        cut[2:] |= (buf[1:-1] == 10) & visible[:-2] & visible[2:]
    cut[off[:-1][off[:-1] < n]] = True
    return np.flatnonzero(cut)


def byte_alphabet() -> list[str]:
    """Character of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others take the characters from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class TextEncoder:
    """Ids of whole texts; one per Python worker (see ``worker_encoder``)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)).encode(), re.I) if added else None
        spec = self.tokenizer.normalizer
        self.lowers = spec is not None and "Lowercase" in repr(spec)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        """A piece that is one Latin word is one pre-token: the library's model takes it without the other steps."""
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha() and max(word) < "\u0250":
            if self.lowers:
                word = word.lower()
                if max(word) < "\u0250":
                    return [t.id for t in self.model.tokenize(self.byte_chars(word))]
            else:
                return [t.id for t in self.model.tokenize(self.byte_chars(piece))]
        return self.encode(piece)

    def byte_chars(self, text: str) -> str:
        """The text in the model's alphabet, one character for each byte."""
        return text if text.isascii() and " " not in text else "".join([self.alphabet[b] for b in text.encode("utf-8")])

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.place) + len(pieces) > CACHE_PIECES:
            self._clear()
        place = self.place
        fresh = [p for p in pieces if p not in place]
        if fresh:
            ids: list[int] = []
            sizes = np.empty(len(fresh), np.int64)
            for i, p in enumerate(fresh):
                got = self._piece(p.decode("utf-8"))
                sizes[i] = len(got)
                ids.extend(got)
            first = len(place)
            place.update(zip(fresh, range(first, first + len(fresh))))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, np.array(ids, np.int32)])
        return np.fromiter((place[p] for p in pieces), np.int64, len(pieces))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids int32, row offsets) of a string column; null counts as empty."""
        buf, off = column_buffer(column)
        rows = len(off) - 1
        whole: dict[int, np.ndarray] = {}
        if self.special is not None and len(buf):
            data = buf.tobytes()
            hit = {int(np.searchsorted(off, m.start(), side="right")) - 1 for m in self.special.finditer(data)}
            whole = {r: np.array(self.encode(data[off[r]: off[r + 1]].decode("utf-8")), np.int32) for r in hit}
        if self.lowers:
            buf = lower_ascii(buf)
        starts = piece_borders(buf, off)
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        row_of = np.searchsorted(off, starts, side="right") - 1
        bounds = np.append(starts, len(buf)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                       [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = pieces.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[place]
        flat = self.pool[ranges(self.starts[place], sizes)]
        counts = np.bincount(row_of, weights=sizes, minlength=rows).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if not whole:
            return flat, offsets
        parts = [whole.get(r, flat[offsets[r]: offsets[r + 1]]) for r in range(rows)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[str, TextEncoder] = {}


def worker_encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker; loaded once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
