"""Words of many texts at once, as arrays over the bytes of an Arrow column.

A text column is one byte buffer with offsets. Words are found and hashed by
array arithmetic over pieces of that buffer, so memory is bounded by the piece
and not by a document, and no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a permutation, so unequal stays unequal."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values for a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = stream(7, 16) | np.uint64(1)

#: Word bytes: all but the six ASCII spaces.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: ASCII letters and digits, and every byte of a longer character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base & _MASK
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step & _MASK
    return out


class _Tables:
    """Byte values, with A-Z as a-z, and powers of the base; made once a process."""

    values: np.ndarray | None = None
    powers = inverses = np.empty(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if cls.values is None:
            values = stream(1, 256)
            values[0x41:0x5B] = values[0x61:0x7B]
            cls.values = values
        if len(cls.powers) < n:
            n = max(n, 4096)
            cls.powers, cls.inverses = _powers(_BASE, n), _powers(_BASE_INVERSE, n)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def pieces(body: np.ndarray, offsets: np.ndarray, word: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that no word crosses."""
    at, end = 0, len(body)
    while at < end:
        stop = min(end, at + size)
        if stop < end:
            doc_end = int(offsets[np.searchsorted(offsets, stop)])
            ahead = stop
            while ahead < doc_end:  # to the next separator or the end of the document
                free = np.flatnonzero(~word[body[ahead : min(doc_end, ahead + 4096)]])
                if len(free):
                    doc_end = ahead + int(free[0])
                    break
                ahead += 4096
            stop = min(doc_end, end) if doc_end > at else end
        yield at, stop
        at = stop


def words(body: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of every word; A-Z hash as a-z. Words end with their text."""
    begins, ends, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for low, high in pieces(body, offsets, word):
        part = body[low:high]
        n = len(part)
        _Tables.upto(n + 1)
        inside = word[part]
        cut = np.zeros(n + 1, bool)
        cut[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        first = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        last = np.flatnonzero(inside & (~after | cut[1:])) + 1
        if not len(first):
            continue
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(inside, _Tables.values[part], np.uint64(0)) * _Tables.powers[:n], out=sums[1:])
        begins.append(first + low)
        ends.append(last + low)
        hashes.append(mix((sums[last] - sums[first]) * _Tables.inverses[first]))
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(hashes)


def word_hash(text: str) -> int:
    """The hash that ``words`` gives one word."""
    body = np.frombuffer(text.encode(), np.uint8)
    _, _, hashed = words(body, np.array([0, len(body)]), np.ones(256, bool))
    return int(hashed[0])


def counts_by_text(begins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words begin in each text."""
    return np.diff(np.searchsorted(begins, offsets))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of k words; a shorter text is one run, an empty one none."""
    n = len(hashes)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        here = hashes[j:] * _FACTORS[j]
        out[: n - j] += np.where(left[: n - j] > j, here, np.uint64(0)) if j else here
    size = np.repeat(counts, counts)
    whole = (size >= k) & (left >= k) | (size < k) & (left == size)
    # A short run also tells its length, so that it equals no longer one.
    out += np.minimum(size, k).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out[whole]), owner[whole]
