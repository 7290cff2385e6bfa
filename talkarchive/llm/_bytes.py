"""Numpy views of Arrow text columns: word bounds, word hashes, and packed integer lists.

Everything here works on the bytes of one Arrow table inside one Spark task.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

#: Fixed values of the word rules: bytes that end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: all but digits, letters and non-ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


_libc = None


def tidy() -> None:
    """Gives memory that this worker has freed back to the system: idle workers stay alive between stages.

    Large blocks come from the system's allocator and as mappings of their own, so that freeing them returns them.
    """
    global _libc
    if _libc is None:
        _libc = False
        with contextlib.suppress(OSError, AttributeError):
            _libc = ctypes.CDLL("libc.so.6")
            _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            pa.set_memory_pool(pa.system_memory_pool())
    if _libc:
        _libc.malloc_trim(0)


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text. Offsets start at 0."""
    arr = one_array(column).cast(pa.large_binary()).fill_null(b"")
    arr = one_array(arr)
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, 8 * arr.offset)
    size = int(off[-1] - off[0])
    data = np.frombuffer(arr.buffers()[2], np.uint8, size, int(off[0])) if size else np.empty(0, np.uint8)
    return data, off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray, ends_word: np.ndarray = SPACE):
    """(starts, ends, word_off): byte bounds of each word; words word_off[d]:word_off[d+1] are document d's."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    gap = ends_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    inner = off[1:-1]
    edge[1:-1] = gap[:-1]
    edge[inner] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[1:-1] = gap[1:]
    edge[inner] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S32)


def lanes(data: np.ndarray) -> np.ndarray:
    """A view whose item i is the little-endian 8-byte integer at byte i (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def hash_spans(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step; view is lanes(data)."""
    length = ends - starts
    h = length.astype(np.uint64) * _M2 + _M1
    live, at = np.arange(len(starts)), starts
    left = length
    while len(live):
        got = view[at] & _MASKS[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ got) + _M1
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def rolling(word_hash: np.ndarray, word_off: np.ndarray, width: int, base: int = 0x2545F4914F6CDD1D):
    """Rabin-Karp hashes of all `width`-word windows inside documents: (first word of each, hash)."""
    n = len(word_hash)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inverse = pow(base, -1, 2**64)
    up = np.full(n, base, np.uint64)
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hash * up, out=sums[1:])
    down = np.full(n, inverse, np.uint64)
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    h = (sums[width:] - sums[: n - width + 1]) * down[: n - width + 1]
    whole = np.ones(n - width + 1, bool)
    for k in word_off[1:-1]:  # windows that would cross into the next document
        whole[max(0, k - width + 1) : k] = False
    first = np.flatnonzero(whole)
    return first, mix(h[first])


def cover(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over n items of those inside [f, f + width) for any f in first."""
    return cover_spans(first, np.minimum(first + width, n), n)


def cover_spans(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask over n items of those inside any [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n], out=step[:n]) > 0


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 as differences of the least whole number of bytes that holds them all; first byte: that number."""
    if not len(values):
        return b"\x01"
    diff = np.empty(len(values), np.uint64)
    diff[0] = values[0]
    diff[1:] = values[1:] - values[:-1]
    top = int(diff[1:].max()) if len(values) > 1 else 0
    width = max(1, (top.bit_length() + 7) // 8)
    body = diff[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(diff[0]).to_bytes(8, "little") + body.tobytes()


def unpack_sorted(payload: bytes) -> np.ndarray:
    width = payload[0]
    if len(payload) == 1:
        return np.empty(0, np.uint64)
    body = np.frombuffer(payload, np.uint8, -1, 9).reshape(-1, width)
    diff = np.zeros((len(body) + 1, 8), np.uint8)
    diff[0] = np.frombuffer(payload, np.uint8, 8, 1)
    diff[1:, :width] = body
    return np.cumsum(diff.reshape(-1).view("<u8"), dtype=np.uint64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start + 1, .. of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    at = np.cumsum(lengths) - lengths
    out[at[0]] = starts[0]
    out[at[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def slices(batches, size: int):
    """(ids, bytes, offsets) of about `size` bytes of text at most; a longer text comes alone."""
    for batch in batches:
        data, off = text_bytes(batch["text"])
        cuts, last = [0], 0
        while last < len(off) - 1:
            last = max(last + 1, int(np.searchsorted(off, off[last] + size, "right")) - 1)
            cuts.append(last)
        tidy()
        for a, b in zip(cuts, cuts[1:]):
            yield batch["doc_id"].slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
