"""Vectorised words and hashes over the UTF-8 bytes of Arrow string columns.

A column is taken as one byte buffer; words are found with a table of separator bytes, and each word's 64-bit
hash comes from prefix sums of a polynomial over random byte values, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95  # odd, 5 mod 8: their powers stay distinct
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; tables are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, CHUNK_BYTES + 1), base, U)
        table[0] = 1
        have = np.cumprod(table, dtype=U)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_BYTE = mixed(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def separators(spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Words are `[^\x20\x09-\x0D]+`.
BLANK = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
NOT_ALNUM = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each row (and the end) the number of words before it."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~sep[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the bytes before each position, and the factors that make stretches comparable wherever they start."""
    sums = np.zeros(len(buf) + 1, U)
    values = (_BYTE_LOWER if lower else _BYTE)[buf]
    values *= powers(_P, len(buf))
    np.cumsum(values, out=sums[1:])
    return sums, powers(inverse(_P), len(buf) + 1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of words; with lower, A-Z count as a-z."""
    sums, scale = prefix_sums(buf, lower)
    return mixed((sums[ends] - sums[starts]) * scale[starts])


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of width consecutive words, at each start that has them (whatever row they are in)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    q = _Q + 8 * salt
    if width <= 8:
        out = words[:n].copy()
        for k in range(1, width):
            out *= U(q)
            out += words[k : k + n]
        return mixed(out)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(q, len(words)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(inverse(q), len(words) + 1)[:n])


def span_hashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of stretches of words of any sizes."""
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(_Q, len(words)), out=sums[1:])
    return mixed((sums[starts + sizes] - sums[starts]) * powers(inverse(_Q), len(words) + 1)[starts] + sizes.astype(U))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each c of counts, one after another."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(counts) - counts, counts)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
