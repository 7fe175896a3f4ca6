"""What a model would do, behind plain functions, with deterministic defaults that need no network."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.operators.graph import cut

DIMENSIONS = 256
#: Texts are hashed in slices of about so many characters.
SLICE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    """By code point."""
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def _vectors(texts: list[str], dims: int) -> np.ndarray:
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in low])
    c = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low)), size)
    solid = _alphanumeric()[np.minimum(c, 0x10FFFF)]
    edge = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros((len(low), dims), dtype=np.float32)
    up, down = _powers(len(c))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((c.astype(np.uint64) + _U(1)) * up)])
    words = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
    inner = solid[1:] & solid[:-1]
    inner[start[end - start < 3]] = False  # such a word has no pair but itself
    first = np.flatnonzero(inner)
    pairs = c[first].astype(np.uint64) + _U(1) + (c[first + 1].astype(np.uint64) + _U(1)) * _U(_BASE) + _U(2)
    h = _mix(np.concatenate([words, pairs]))
    at = np.concatenate([doc[start], doc[first]]) * dims + (h % _U(dims)).astype(np.int64)
    sign = np.where(h >> _U(63), 1.0, -1.0)
    v = np.bincount(at, weights=sign, minlength=len(low) * dims).reshape(len(low), dims).astype(np.float32)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n, n, 1)


def hashed_vector(body: str, dims: int = DIMENSIONS) -> np.ndarray:
    """A unit vector of signed, hashed counts of words and of pairs of characters in them; zero for a text without words."""
    return _vectors([body], dims)[0]


def embedder(dims: int = DIMENSIONS) -> Callable[[Column], Column]:
    """Column of texts to Column of vectors: the stand-in for an embedding model, in Arrow batches. Null texts have no vector."""
    most = int(X.EMBED_TOKENS / X.TOKENS_PER_CHAR)

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        known = [t[:most] for t in texts.drop_null().to_pylist()]
        parts, at = [np.zeros((0, dims), dtype=np.float32)], 0
        while at < len(known):
            end, held = at, 0
            while end < len(known) and (end == at or held + len(known[end]) <= SLICE):
                held += len(known[end])
                end += 1
            parts.append(_vectors(known[at:end], dims))
            at = end
        there = texts.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(there) * dims]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).ravel()), mask=pa.array(~there))

    return embed


def query_embedder(dims: int = DIMENSIONS) -> Callable[[str], list[float]]:
    return lambda q: hashed_vector(q, dims).tolist()


def cached(df: DataFrame, cache: DataFrame | None, key: Column, compute: Callable[[DataFrame], DataFrame], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with a model's output columns, new cache entries): only content that the cache lacks is computed, and once.

    cache: (cache_key, *columns); compute adds columns to a table. Hits are a join on the content's hash, misses its anti join.
    """
    keyed = df.withColumn("cache_key", key)
    once = keyed.dropDuplicates(["cache_key"])
    missing = once if cache is None else once.join(cache.select("cache_key"), "cache_key", "left_anti")
    new = cut(compute(missing).select("cache_key", *columns))
    known = new if cache is None else cache.select("cache_key", *columns).unionByName(new)
    return keyed.join(known, "cache_key"), new
