"""Vector functions on array columns; sums are in double precision and in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from larkfield.functions.text import normalize_text
from larkfield.runtime import ship_active


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def is_valid(a: Column, dim: int) -> Column:
    """Of the right length and finite throughout."""
    return F.coalesce(
        (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )


def hashed_vector(text: str | None, dim: int = 512, sizes: tuple[int, ...] = (2, 3)) -> list[float]:
    """Counts of hashed character n-grams of the text without white space, at unit length."""
    compact = "".join(normalize_text(text).split())
    out = np.zeros(dim)
    for n in sizes:
        for i in range(max(len(compact) - n + 1, 0)):
            digest = hashlib.blake2b(compact[i : i + n].encode(), digest_size=8).digest()
            out[int.from_bytes(digest, "big") % dim] += 1
    length = np.linalg.norm(out) or 1.0
    return (out / length).tolist()


#: characters of the texts that are counted at once
SLICE_CHARS = 1 << 18
#: n-grams whose buckets a worker keeps
_KEPT = 1 << 18
_buckets: dict[tuple[int, int, int], int] = {}


def _bucket(gram: int, n: int, dim: int) -> int:
    """The bucket of an n-gram, given as its code points in base 2^21."""
    key = (gram, n, dim)
    if key not in _buckets:
        if len(_buckets) >= _KEPT:
            _buckets.clear()
        text = "".join(chr(gram >> 21 * (n - 1 - k) & 0x1FFFFF) for k in range(n))
        _buckets[key] = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") % dim
    return _buckets[key]


def hashed_vectors(texts: list[str | None], dim: int = 512, sizes: tuple[int, ...] = (2, 3)) -> np.ndarray:
    """``hashed_vector`` of each text, as rows; an n-gram, of three characters at most, is hashed once, however often it occurs."""
    if max(sizes) > 3:
        return np.array([hashed_vector(t, dim, sizes) for t in texts]).reshape(len(texts), dim)
    compact = ["".join(normalize_text(t).split()) for t in texts]
    points = np.frombuffer("".join(compact).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) for t in compact])
    owner = np.repeat(np.arange(len(compact)), [len(t) for t in compact])
    out = np.zeros(len(compact) * dim)
    for n in sizes:
        at = np.flatnonzero(np.arange(len(points)) + n <= ends[owner]) if len(points) else np.zeros(0, np.int64)
        gram = np.zeros(len(at), np.int64)
        for k in range(n):
            gram = gram << 21 | points[at + k]
        distinct, which = np.unique(gram, return_inverse=True)
        bucket = np.array([_bucket(g, n, dim) for g in distinct.tolist()], np.int64)
        out += np.bincount(owner[at] * dim + bucket[which], minlength=len(out)) if len(at) else 0
    out = out.reshape(len(compact), dim)
    length = np.sqrt((out * out).sum(axis=1))
    return out / np.where(length == 0, 1.0, length)[:, None]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts of ``SLICE_CHARS`` or one that is longer, and no more than 256."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size):
        if i > begin and (held + n > SLICE_CHARS or i - begin == 256):
            yield texts.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if len(texts) > begin:
        yield texts.slice(begin)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hash_embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for part in _slices(batch):
            rows = hashed_vectors(part.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def hash_embed(text: Column | str) -> Column:
    """``hashed_vector`` of a column."""
    ship_active()
    return _hash_embed(text)


def hash_embed_name(dim: int = 512, sizes: tuple[int, ...] = (2, 3)) -> str:
    """Names the configuration, so that vectors of different encoders are never compared."""
    return f"hashing-{dim}-{'-'.join(map(str, sizes))}"
