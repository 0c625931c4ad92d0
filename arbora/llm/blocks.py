"""Arrow text columns as numpy word tables, in blocks of bounded size.

A text column reaches Python as one UTF-8 byte buffer plus offsets. The helpers
below find words (maximal runs of bytes other than ASCII white space) and hash
them without decoding a single string, so a block costs a few vector passes.
ASCII bytes never occur inside a multi-byte UTF-8 sequence, hence byte-level
splitting equals code-point-level splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a single longer text forms a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes whose prefix sums are held at once while words are hashed.
HASH_BYTES = 1 << 20

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit constants that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed) * U64(0xD1342543DE82EF95))


_BYTE = stream(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_STEP = U64(0x5851F42D4C957F2D)
_BACK = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_UP = _powers(_STEP, HASH_BYTES + 1)
_DOWN = _powers(_BACK, HASH_BYTES + 1)


class Block:
    """Rows [lo, hi) of a batch: their bytes, and the offsets of each row in them."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_bounds(block: Block, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (one longer)."""
    gap = outside[block.data]
    n = len(gap)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64)
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    at = block.offsets[:-1]
    before[at[at < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    ends_at = block.offsets[1:]
    after[ends_at[ends_at > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, block.offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; fold makes A-Z equal to a-z.

    Polynomial over random byte codes by prefix sums, cut into pieces of
    HASH_BYTES; a single longer range is hashed on its own.
    """
    out = np.empty(len(starts), U64)
    table = _FOLDED if fold else _BYTE
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right"))
        if j <= i:
            word = data[starts[i] : ends[i]].tobytes()
            out[i] = U64(xxhash.xxh64_intdigest(word.lower() if fold else word, seed=7))
            i += 1
            continue
        base, top = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(top - base + 1, U64)
        np.cumsum(table[data[base:top]] * _UP[: top - base], out=sums[1:])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * _DOWN[s]
        i = j
    return mix(out)


def windows(hashes: np.ndarray, first: np.ndarray, width: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and whether each run lies in one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    factors = stream(width, seed) | U64(1)
    out = np.zeros(n, U64)
    for k in range(width):
        out += hashes[k : k + n] * factors[k]
    row_end = np.repeat(first[1:], np.diff(first))
    return mix(out), np.arange(n) + width <= row_end[:n]


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def line_table(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (split at line feeds), and the first line of each row."""
    feeds = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([block.offsets[1:], feeds]))
    per_row = np.searchsorted(feeds, block.offsets)
    return starts, ends, per_row + np.arange(len(block) + 1)


def repeated_lines(block: Block, word_starts: np.ndarray) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    starts, ends, first = line_table(block)
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    view, out = memoryview(block.data), np.zeros(len(block), np.int64)
    for i in range(len(block)):
        a, b = first[i], first[i + 1]
        if b - a < 2:
            continue
        seen, again = set(), 0
        for k in range(a, b):
            if worded[k]:
                h = xxhash.xxh3_64_intdigest(view[starts[k] : ends[k]])
                again += h in seen
                seen.add(h)
        out[i] = again
    return out


def repeated_window_words(hashes: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """Per row: words covered by runs of ``width`` words that the row holds twice or more."""
    runs, whole = windows(hashes, first, width)
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(whole)
    if len(at):
        row = np.searchsorted(first, at, "right") - 1
        keys = runs[at] ^ mix(row.astype(U64) + U64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
    return sums_by_row(np.cumsum(cover[:-1]) > 0, first)
