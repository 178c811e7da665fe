"""Texts of an Arrow batch as one array of letters: lower-cased code points, 0 for anything that is neither letter nor mark."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Code points from here on hold no letters.
LIMIT = 0x32400
#: Bits of a code point in an n-gram's key.
BITS = 21


@functools.cache
def lut() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> lower-case letter or mark (0: neither), and whether it is a letter."""
    low, letter = np.zeros(LIMIT, np.uint32), np.zeros(LIMIT, bool)
    for cp in range(LIMIT):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            low[cp] = ord(chr(cp).lower()[0])
            letter[cp] = kind == "L"
    return low, letter


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(("\n" + "\n\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]) if texts else np.zeros(0, np.int64)
    return np.minimum(flat, LIMIT - 1), starts


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, starts): each text between two 0s; starts[i] is where text i's leading 0 stands."""
    flat, starts = _points(texts)
    return lut()[0][flat], starts


def letters(texts: list[str]) -> np.ndarray:
    """Letters in each text; marks alone are none."""
    flat, starts = _points(texts)
    return np.add.reduceat(lut()[1][flat].astype(np.int64), starts) if texts else np.zeros(0, np.int64)


def squeezed(c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of 0 become one 0; starts follow (a text's leading 0 is always kept)."""
    keep = c != 0
    keep[1:] |= keep[:-1]
    keep[0] = True
    keep[starts] = True
    at = np.cumsum(keep) - 1
    return c[keep], at[starts]
