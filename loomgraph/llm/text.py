"""Vectorised kernels over the buffers of Arrow text columns.

Every kernel works on the bytes of many documents at once, in chunks of a bounded number of bytes, so a worker's
memory does not follow the size of an Arrow batch. A single document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one call of a kernel works on.
CHUNK_BYTES = 1 << 18

#: The bytes that separate words, 0x09 to 0x0D and 0x20.
SEPARATORS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words longer than this are hashed one by one.
LONG_WORD = 128
#: Masks for the first 0 to 8 bytes of a little-endian word.
_HEAD = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK64 = (1 << 64) - 1


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until none of ``columns`` has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in the bytes) of successive rows. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 4 * CHUNK_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers.clear()
        for base in (_BASE, inverse):
            p = np.full(size, base & _MASK64, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Prefix sums of units times powers of the base; units are 64-bit words."""
    p, _ = powers(len(units))
    out = np.empty(len(units) + 1, np.uint64)
    out[0] = 0
    np.cumsum(units * p, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the units in [start, end), which does not depend on where they stand."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and the offsets of documents among the words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~_IS_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: its length and then its bytes, eight at a time, each step spread by ``mix``.

    Words of up to eight bytes never collide with others of their length; longer ones only as random numbers do. (A
    polynomial modulo a power of two, as ``span_hash`` is, has colliding words of a simple structure.)
    """
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * np.uint64(_BASE))
    if not len(out):
        return out
    wide = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    left, at = lengths, starts
    short = left <= LONG_WORD
    which = np.flatnonzero(short)
    left, at = left[which], at[which]
    while len(which):
        part = wide[at] & _HEAD[np.minimum(left, 8)]
        out[which] = mix(out[which] ^ part) + np.uint64(_BASE)
        more = left > 8
        which, left, at = which[more], left[more] - 8, at[more] + 8
    for i in np.flatnonzero(~short).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return mix(out)


def anchor_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A faster hash of each word, for what only picks candidates: words of a certain structure collide."""
    return span_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1)), starts, ends)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    have, out = 1, keys
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


#: Bits of a place within the units of one call; so many low bits of a hash are not compared.
_PLACE_BITS = 24


def leftmost_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each ``width`` consecutive keys of 40 bits or less.

    Works on stretches whose places fit into the low bits, so the result depends on the keys alone, however many."""
    n = len(keys) - width + 1
    step = (1 << _PLACE_BITS) - width
    out = np.empty(n, np.int64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for first in range(0, n, step):
        part = keys[first : min(first + step + width - 1, len(keys))]
        least = sliding_min((part << np.uint64(_PLACE_BITS)) | np.arange(len(part), dtype=np.uint64), width)
        out[first : first + len(least)] = (least & low).astype(np.int64) + first
    return out


def runs(units: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Split the windows of every document into runs that share an anchor.

    The anchor of a window is its ``gram`` of consecutive units with the least hash, the leftmost of equals. It is
    a function of the window's content alone, so equal windows have equal anchors wherever they stand. Returns for
    each run: document, first window's start (in all units), number of windows, anchor hash.
    """
    n = len(units)
    z = np.zeros(0, np.int64)
    if n < window:
        return z, z, z, np.zeros(0, np.uint64)
    sums = prefix_sums(units)
    at = np.arange(n - gram + 1)
    grams = span_hash(sums, at, at + gram)
    # the place breaks ties among equal leading bits, and the bits compared are the same for a text of any length
    anchor = leftmost_min(grams >> np.uint64(_PLACE_BITS), window - gram + 1)
    # a window is valid if it ends within the document in which it starts
    doc_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    valid = np.arange(len(anchor)) + window <= offs[1:][doc_of]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (doc_of[1:] != doc_of[:-1])
    starts = np.flatnonzero(new)
    # every run ends where the next one starts or where valid windows end
    stops = np.flatnonzero(np.concatenate((valid[:-1] & (new[1:] | ~valid[1:]), valid[-1:]))) + 1
    return doc_of[starts], starts, stops - starts, grams[anchor[starts]]
