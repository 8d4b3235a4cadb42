"""Vectorised word kernels over Arrow string buffers, shared by the Python-side operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = [9, 10, 11, 12, 13, 32]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; wraps modulo 2**64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(separators, lower: bool = True) -> np.ndarray:
    """256 bytes: 0 for a separator, else the byte itself with A-Z in lower case.

    A NUL that is no separator becomes 0xFF, which no UTF-8 text holds.
    """
    t = np.arange(256, dtype=np.uint8)
    t[0] = 255
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    return t


#: words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z
SPACE_WORDS = byte_table(_SPACE)
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z (A-Z fold before the class applies)
ALNUM_WORDS = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

#: base of the word hash, and its powers over one block of bytes
_BASE, _BLOCK = 0x9E6C63D0876A9A47, 1 << 15
_POW = np.cumprod(np.r_[U64(1), np.full(_BLOCK, U64(_BASE), U64)], dtype=U64)
_INVERSE = np.cumprod(np.r_[U64(1), np.full(_BLOCK, U64(pow(_BASE, -1, 1 << 64)), U64)], dtype=U64)


def string_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls become empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """The batch in runs of rows with about ``most_bytes`` of text each (one row at least): bounded temporaries."""
    text = batch.column(batch.schema.get_field_index(column))
    text = text.cast(pa.large_string())
    lengths = np.diff(string_views(text)[1])
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


def tidied(run):
    """``run`` for mapInArrow, giving freed memory back at the end: idle workers stay beside later stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return wrapped


def hash_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Words of several texts laid end to end.

    Returns (hash of each word, byte start, byte end, first word of each text plus the total).
    A word never spans two texts. Hashes are 64-bit and the same on every machine.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(offsets), np.int64)
    t = table[raw]
    word = t != 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    edge = np.concatenate([[0] * int(word[0]), edge, [n] * int(word[-1])]).astype(np.int64)
    begin, end = edge[0::2], edge[1::2]
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    inner = inner[word[inner] & word[inner - 1]]  # a text that ends where the next begins, without a blank
    if len(inner):
        begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
    return _hash_spans(t, begin, end), begin, end, np.searchsorted(begin, offsets)


def _hash_spans(t: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of t[begin:end] for each span: the sum of its bytes times powers of a base, from differences of running sums.

    Powers start anew with every block, so that few of them are needed; a span over several blocks is summed block by block.
    """
    n = len(t)
    values = t.astype(U64)
    for i in range(0, n, _BLOCK):
        values[i : i + _BLOCK] *= _POW[: min(_BLOCK, n - i)]
    running = np.zeros(n + 1, U64)
    np.cumsum(values, out=running[1:])
    at, block = begin % _BLOCK, begin // _BLOCK
    stop = np.minimum(end, (block + 1) * _BLOCK)
    sums = (running[stop] - running[begin]) * _INVERSE[at]
    over = np.flatnonzero(stop < end)
    scale = _POW[_BLOCK - at[over]]  # what the base's power is at the next block's first byte
    while len(over):
        start = stop[over]
        stop[over] = np.minimum(end[over], start + _BLOCK)
        sums[over] += (running[stop[over]] - running[start]) * scale
        scale = scale * _POW[_BLOCK]
        more = stop[over] < end[over]
        over, scale = over[more], scale[more]
    return splitmix(sums ^ ((end - begin).astype(U64) << U64(56)))


_MULT = splitmix(np.arange(1, 65, dtype=U64)) | U64(1)


def hash_windows(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of every run of ``words`` consecutive word hashes (runs may span texts; callers drop those)."""
    n = len(h) - words + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(words):
        total += splitmix(h[k : k + n] ^ _MULT[k % 64]) * _MULT[(k + 7) % 64]
    return splitmix(total)


def hash_sequence(h: np.ndarray) -> np.uint64:
    """Hash of one whole sequence of word hashes; differs from any window's."""
    k = np.arange(len(h))
    total = np.sum(splitmix(h ^ _MULT[k % 64]) * _MULT[(k + 7) % 64], dtype=U64)
    return splitmix(np.array([total ^ U64(0xABCDEF * (len(h) + 1))], U64))[0]
