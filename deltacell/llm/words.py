"""Word, shingle and set hashing for batches of whole texts, as array code inside Spark tasks.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, lower-cased for A-Z where asked. All functions
take a batch of texts as one byte buffer with offsets, so there is no loop over words. Null texts
count as empty. Hashes are 64 bits wide and depend on the bytes alone.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

U = np.uint64
_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
_P = U(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = U(pow(int(_P), -1, 1 << 64))
_MUL = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Texts of a batch are taken in runs of about this many bytes, which bounds what the arrays hold.
RUN_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> U(30))) * _MUL[0]
    h = (h ^ (h >> U(27))) * _MUL[1]
    return h ^ (h >> U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORWARD = _powers(1 << 16, _P)
_BACKWARD = _powers(1 << 16, _P_INVERSE)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _FORWARD, _BACKWARD
    if n >= len(_FORWARD):
        if n > 4 * RUN_BYTES:
            return _powers(n, _P), _powers(n, _P_INVERSE)
        size = max(n, 2 * len(_FORWARD))
        _FORWARD, _BACKWARD = _powers(size, _P), _powers(size, _P_INVERSE)
    return _FORWARD, _BACKWARD


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES):
    """(first, end) of texts that together have about ``limit`` bytes, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def text_batches(df) -> None:
    """Send long texts to tasks a thousand rows at a time; ten thousand, Spark's default, suit short rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _give_back() -> None:
    """Return freed memory to the system, as idle workers live on beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batches, limit: int = RUN_BYTES):
    """Record batches cut into slices of about ``limit`` bytes, so that what a task makes of one stays small."""
    for batch in batches:
        n = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
    _give_back()


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (one more at the end)."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~_SPACE[raw]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    ends = inside[:-1] & ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, from prefix sums of a polynomial modulo 2^64."""
    forward, backward = _power_table(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * forward[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * backward[starts] + (ends - starts).astype(np.uint64) * _MUL[3])


def hashed_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each text (one more at the end)."""
    if lower:
        raw = _LOWER[raw]
    starts, ends, first = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), first


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of every ``size`` consecutive words."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, U(size), np.uint64)
    for i in range(size):
        out = mix(out * _MUL[4] + words[i:i + n])
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin.

    A text with fewer words than ``size`` has its whole sequence as its only shingle; one without
    words has none.
    """
    words, first = hashed_words(raw, offsets)
    counts = np.diff(first)
    grams = window_hashes(words, size)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(len(grams)) + size <= first[1:][owner[:len(grams)]] if len(grams) else np.zeros(0, bool)
    values, owners = grams[whole], owner[:len(grams)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([window_hashes(words[first[i]:first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        values, owners = np.concatenate([values, extra]), np.concatenate([owners, short])
    if len(short):
        order = np.argsort(owners, kind="stable")
        values, owners = values[order], owners[order]
    bounds = np.searchsorted(owners, np.arange(len(counts) + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values), np.concatenate([[0], np.cumsum(sizes)])
