"""Hashed words and word beginnings of whole texts, many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: bytes that make up words: letters and digits of ASCII, and all bytes of other characters; A-Z lower-cased
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: lengths in bytes of the word beginnings that are terms of their own, and the longest word told apart to its end
STEMS = (4, 5, 6, 7, 8)
LONGEST = 32
PRIME = np.uint64(0x100000001B3)
BASIS = np.uint64(0xCBF29CE484222325)
#: bytes of text handled at once
PART = 4 << 20


def parts(texts: pa.Array):
    """Consecutive texts of about PART bytes, as (first row, byte array, offsets); a null is an empty text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, side="right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, words of each row): every word and word beginning, as a 64-bit hash, of the texts in ``data``."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n, np.int64)
    low = LOWER[data]
    word = IN_WORD[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(word)]
    begins[inner] = word[inner]  # a text's first word never joins the last of the text before
    starts = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    cuts = inner[inner > 0] - 1
    stops[cuts] = word[cuts]
    sizes = np.flatnonzero(stops) + 1 - starts
    rows = np.searchsorted(offsets, starts, side="right") - 1
    out_rows, out_terms = [], []
    hashes, live = np.full(len(starts), BASIS), np.arange(len(starts))
    for i in range(LONGEST):
        live = live[sizes[live] > i]
        if not len(live):
            break
        hashes[live] = (hashes[live] ^ low[starts[live] + i]) * PRIME
        if i + 1 in STEMS:
            out_rows.append(rows[live])
            out_terms.append(mixed(hashes[live] + np.uint64(i + 1)))
    out_rows.append(rows)
    out_terms.append(mixed(hashes))
    return np.concatenate(out_rows), np.concatenate(out_terms), np.bincount(rows, minlength=n)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class Lookup:
    """Places of hashes in a short list of them."""

    def __init__(self, wanted: np.ndarray):
        self.order = np.argsort(wanted)
        self.sorted = wanted[self.order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, place in the list) of those that are in it."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at) or not len(self.sorted):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        good = self.sorted[place] == hashes[at]
        return at[good], self.order[place[good]]
