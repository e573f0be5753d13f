"""Vectorised splitting of texts into hashed words.

A word is a run of letters, digits and marks of any script, lower-cased; all
else separates. In scripts that are written without blanks (Han, kana, Thai, Lao,
Burmese, Khmer) each character is a word. Everything works on arrays of code points, so positions are
character positions in the original text.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Characters that are handled at a time; a longer text is one piece.
PIECE_CHARS = 500_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def fold_table() -> np.ndarray:
    """For each code point its lower-case code point if it belongs to words, else 0."""
    fold = np.zeros(0x110000, np.uint32)
    for cp in range(0x33480):
        ch = chr(cp)
        if ch.isalnum() or unicodedata.category(ch)[0] == "M":
            low = ch.lower()
            fold[cp] = ord(low) if len(low) == 1 else cp
    return fold


#: Code points of scripts without blanks between words.
_UNSPACED = np.array([(0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x33480)], np.uint32)


def _edges(points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; the last point belongs to none."""
    if not len(points) or points.max() < _UNSPACED[0, 0]:
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        return edges[0::2], edges[1::2]
    at = np.searchsorted(_UNSPACED[:, 0], points, side="right") - 1
    single = inside & (at >= 0) & (points <= _UNSPACED[at, 1])
    split = np.zeros(len(points) + 1, bool)  # a word may not go on from the point before to this one
    split[1:-1] = single[1:] | single[:-1] | ~inside[1:] | ~inside[:-1]
    split[0] = split[-1] = True
    return np.flatnonzero(inside & split[:-1]), np.flatnonzero(inside & split[1:]) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


_BLOCK = 1 << 20
_BASE = int(_M1) | 1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, modulo 2**64, for a block of places."""
    up = np.full(_BLOCK, _BASE, np.uint64)
    down = np.full(_BLOCK, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _word_hashes(folded: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the characters of each word: differences of running sums of a polynomial, moved back to place 0."""
    up, down = _powers()
    total = np.zeros(len(folded) + 1, np.uint64)
    step = [1]  # the base's power at each block
    for s in range(0, len(folded), _BLOCK):
        x = folded[s : s + _BLOCK].astype(np.uint64)
        x = (x * _M2) ^ (x << np.uint64(17))
        x *= up[: len(x)]
        if s:
            x *= np.uint64(step[-1])
            x[:1] += total[s : s + 1]
        np.cumsum(x, out=total[s + 1 : s + 1 + len(x)])
        step.append(step[-1] * pow(_BASE, _BLOCK, 2**64) % 2**64)
    back = down[begin & (_BLOCK - 1)]
    if len(folded) > _BLOCK:
        back = back * np.array([pow(p, -1, 2**64) for p in step], np.uint64)[begin >> 20]
    return mixed((total[end] - total[begin]) * back + (end - begin).astype(np.uint64))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a line feed; where each text begins, and the end."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode(f"utf-32-{sys.byteorder[0]}e", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


@dataclass
class Words:
    """The words of several texts: hashes, character spans over the joined texts, where each text's words begin, and the line feeds."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_begin: np.ndarray
    feeds: np.ndarray


def split_words(texts: list[str]) -> Words:
    points, text_begin = code_points(texts)
    folded = fold_table()[points]
    inside = folded != 0
    begin, end = _edges(points, inside)  # the last point is a line feed
    feeds = np.flatnonzero(points == 10)
    first = np.searchsorted(begin, text_begin)
    if not len(begin):
        return Words(np.zeros(0, np.uint64), begin, end, first, text_begin, feeds)
    return Words(_word_hashes(folded, begin, end), begin, end, first, text_begin, feeds)


def pieces(texts: list[str], chars: int = PIECE_CHARS):
    """Ranges (from, to) over ``texts`` of about ``chars`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
