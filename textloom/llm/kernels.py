"""Vectorised text kernels on UTF-8 bytes: word spans, word hashes and Rabin-Karp hashes of runs of words.

Words are hashed by a chain of bijections over blocks of eight bytes. Runs of words are hashed as
polynomials modulo the prime 2^61 - 1 with fixed random bases: modulo a power of two, Thue-Morse
sequences would collide under every base.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: The bytes 0x20 and 0x09-0x0D separate words.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1
#: The modulus of running hashes, and two bases.
PRIME = (1 << 61) - 1
BASES = tuple(int(x) for x in np.random.default_rng(20240229).integers(1 << 40, PRIME - 1, 2))
_P, _LOW = np.uint64(PRIME), np.uint64((1 << 32) - 1)
#: Bytes up to which a word is hashed in blocks; a longer one goes through XXH3 on its own.
_SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _half(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, not yet below it but below 2^61 + 8."""
    high = x >> np.uint64(61)
    x = x & _P
    x += high
    return x


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1."""
    x = _half(x)
    x -= (x >= _P) * _P
    return x


def _times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo 2^61 - 1 before the last fold, from products of 32-bit halves; a is below 2^62, b below 2^61."""
    b = np.asarray(b, np.uint64)
    up, down = np.uint64(32), np.uint64(29)
    ah, al, bh, bl = a >> up, a & _LOW, b >> up, b & _LOW
    mid = ah * bl
    mid += al * bh
    al *= bl
    ah *= bh
    ah *= np.uint64(8)
    ah += mid >> down
    mid &= np.uint64((1 << 29) - 1)
    mid <<= up
    ah += mid
    ah += al & _P
    al >>= np.uint64(61)
    ah += al
    return ah


def times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo 2^61 - 1, both below it."""
    return fold(_times(a, b))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^61 - 1."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out[: n - len(out)], pow(base, len(out), PRIME))])
    return out[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums modulo 2^61 - 1 of values below it; the first is 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    high = np.cumsum(values >> np.uint64(32), dtype=np.uint64)
    low = fold(np.cumsum(values & _LOW, dtype=np.uint64))
    out[1:] = fold((((high << np.uint64(32)) & _P) | (high >> np.uint64(29))) + low)
    return out


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with about `most` bytes of text; a longer text is alone in its run."""
    for nth, batch in enumerate(batches):
        if nth % 16 == 15:
            release()
        if not batch.num_rows:
            continue
        _, off = texts_of(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in data, and per text the first word's number, with the total at the end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    sep = _SEPARATOR[data]
    before = np.empty_like(sep)
    before[0], before[1:] = True, sep[:-1]
    after = np.empty_like(sep)
    after[-1], after[:-1] = True, sep[1:]
    inner = off[1:-1]
    before[inner[inner < len(data)]] = True
    after[inner[inner > 0] - 1] = True
    start, end = np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """A 64-bit hash per word; words are handled in blocks, so that a long text needs little memory."""
    out = np.empty(len(start), np.uint64)
    view = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    for lo in range(0, len(start), block):
        at, n = start[lo : lo + block], end[lo : lo + block] - start[lo : lo + block]
        h = mix(n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows = np.flatnonzero(n <= _SHORT)
        for k in range(0, _SHORT, 8):
            rows = rows[n[rows] > k]
            if not len(rows):
                break
            place, left = at[rows] + k, np.minimum(8, n[rows] - k)
            # the last bytes of data are read from the eighth before its end
            back = np.maximum(0, place - (len(data) - 8))
            if len(data) >= 8:
                x = view[place - back] >> (back * 8).astype(np.uint64)
            else:
                x = np.array([int.from_bytes(data[p : p + 8].tobytes(), "little") for p in place], np.uint64)
            x &= np.uint64(_MASK) >> ((8 - left) * 8).astype(np.uint64)
            h[rows] = mix(h[rows] ^ x)
        for r in np.flatnonzero(n > _SHORT):
            h[r] = xxhash.xxh3_64_intdigest(data[at[r] : at[r] + n[r]])
        out[lo : lo + block] = h
    return out


def _rolled(x: np.ndarray, k: int, base: int) -> np.ndarray:
    """The polynomial of each run of k values, put together from runs of powers of two."""
    out, done, width = None, 0, 1
    n = len(x) - k + 1
    while True:
        if k & width:
            if out is None:
                out = x
            else:
                m = min(len(out), len(x) - done)
                out = _half(_half(_times(out[:m], pow(base, width, PRIME))) + x[done : done + m])
            done += width
        if 2 * width > k:
            return fold(out[:n])
        x = _half(_half(_times(x[:-width], pow(base, width, PRIME))) + x[width:])
        width *= 2


def window_hashes(words: np.ndarray, k: int, salt: int = 0, block: int = 1 << 14) -> np.ndarray:
    """Rabin-Karp hashes of all runs of k words, 64 bits from two bases; run j covers words j .. j+k-1."""
    out = np.empty(max(0, len(words) - k + 1), np.uint64)
    for lo in range(0, len(out), block):
        x = fold(words[lo : lo + block + k - 1] ^ np.uint64(salt))
        out[lo : lo + block] = mix(_rolled(x, k, BASES[0]) ^ mix(_rolled(x, k, BASES[1]) ^ np.uint64(salt)))
    return out


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of each k neighbours, by doubling."""
    if len(x) < k:
        return x[:0]
    width, out = 1, x
    while 2 * width <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = k - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
