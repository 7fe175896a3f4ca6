"""Shared pieces: vectorised word hashing, the shared checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size is below this; beyond it the join shuffles.
BROADCAST_LIMIT = 32 << 20
#: Text is hashed in slices of about so many bytes, so that a worker's arrays stay small.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_U = np.uint64


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one, in local mode only: executors elsewhere couldn't read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loregrid-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its measured rows fit BROADCAST_LIMIT; as it is otherwise."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_LIMIT else df


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """base**i and base**-i modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


class Words:
    """The words (runs of bytes other than ASCII white space) of a slice of texts.

    start, end: byte positions in data; hash: 64-bit; doc: index of the text; first: index of each text's first word,
    with one more entry at the end; offset: byte offset of each text in data, with one more entry.
    """

    def __init__(self, data: np.ndarray, offset: np.ndarray, lower: bool = True) -> None:
        self.data, self.offset, n = data, offset, len(data)
        if not n:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
        else:
            solid = ~_SPACE[data]
            edge = np.zeros(n + 1, dtype=bool)
            edge[offset] = True
            before = np.empty(n, dtype=bool)
            before[0] = False
            before[1:] = solid[:-1]
            self.start = np.flatnonzero(solid & (~before | edge[:-1]))
            after = np.empty(n, dtype=bool)
            after[-1] = False
            after[:-1] = solid[1:]
            self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
            up, down = _BYTES.get(n + 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + _U(1)) * up[:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offset)
        self.doc = np.repeat(np.arange(len(offset) - 1), np.diff(self.first))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text, and the index of each run's first word."""
        k = len(self.hash)
        if k < n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        up, down = _WORDS.get(k + 1)
        sums = np.zeros(k + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:k], out=sums[1:])
        at = np.flatnonzero(self.doc[: k - n + 1] == self.doc[n - 1 :])
        return mix((sums[at + n] - sums[at]) * down[at] + _U(n)), at


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about limit bytes; null texts count as empty. A longer text is alone, and whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offset = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offset, offset[a] + limit, side="right")) - 1)
        yield a, b, data[offset[a] : offset[b]], offset[a : b + 1] - offset[a]
        a = b


def whole_key(df: DataFrame, key: str) -> Column:
    """The key as a long; a TypeError where it is no whole number."""
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{key} has to be a whole number, not {kind}")
    return F.col(key).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front until df has no such column (upper and lower case count as equal)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
