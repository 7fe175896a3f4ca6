"""Approximate nearest neighbours, by an inverted multi-index.

The two halves of a vector are quantised separately, so that K codewords a half give K * K cells. A query visits cells
in order of the summed distances of its halves to the cell's codewords (multi-sequence traversal with a heap) until
they hold enough entries, which are then ranked by exact distance. Cells, in order, are cut into shards of about
SHARD_ENTRIES entries, a larger cell into several; a query goes only to the shards that hold cells it visits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.llm.common import BROADCAST_LIMIT, cut, mix, whole_key

K, ITERATIONS = 10, 6
#: Entries a cell should hold on average, as long as a table of all cells may be broadcast; from there on cells grow.
CELL, MOST_CELLS = 16, BROADCAST_LIMIT // 16
#: The codebooks are fitted to about so many vectors, those whose keys have the lowest hashes.
FIT_ROWS = 1 << 16
#: The number of candidates is set so that SAMPLE queries, answered exactly as well, find this share of their neighbours.
RECALL, SAMPLE = 0.95, 128
#: Entries are copied once for every part of the queries that come to their shard; a part is ranked in slices.
SHARD_ENTRIES, QUERIES_PER_PART, QUERIES_PER_SLICE = 1 << 16, 1 << 15, 1 << 11


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector, their float64 matrix) of a list column whose good rows all have one length."""
    length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if not len(length) or length.max() <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    at = np.flatnonzero(length > 0)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return at, flat.reshape(len(at), -1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)


def codebooks(x: np.ndarray, size: int, iterations: int = ITERATIONS) -> list[np.ndarray]:
    """Two codebooks of the rows of x by Lloyd's algorithm, begun at its first rows; each in order along its longest axis."""
    half = max(1, x.shape[1] // 2)
    out = []
    for part in (x[:, :half], x[:, half:]):
        book = np.unique(part[:size], axis=0)
        for _ in range(iterations if part.shape[1] else 0):
            total, n = np.zeros_like(book), np.zeros(len(book))
            for s in range(0, len(part), 4096):
                code = squared(part[s : s + 4096], book).argmin(axis=1)
                n += np.bincount(code, minlength=len(book))
                np.add.at(total, code, part[s : s + 4096])
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
            done = np.abs(moved - book).max(initial=0) < 1e-6
            book = moved
            if done:
                break
        axis = np.linalg.svd(book - book.mean(0), full_matrices=False)[2][0] if book.shape[1] and len(book) > 1 else np.zeros(book.shape[1])
        out.append(book[np.argsort(book @ axis, kind="stable")])
    return out


def traverse(left: np.ndarray, right: np.ndarray, filled: np.ndarray, wanted: int, goal: set[int] | None = None) -> list[int]:
    """Cells (as left * len(right) + right) in order of summed distance until they hold `wanted` entries, or all of goal was met; empty cells are passed over."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    la, rb = left[a].tolist(), right[b].tolist()
    a_, b_ = a.tolist(), b.tolist()
    width, n, m = len(b_), len(a_), len(b_)
    heap, got, out = [(la[0] + rb[0], 0, 0)], 0, []
    reach = [0] * (n + 1)  # by row, columns taken so far: a cell is ready once the ones above and to its left are
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        reach[i] = j + 1
        cell = a_[i] * width + b_[j]
        c = int(filled[cell])
        if c:
            got += c
            out.append(cell)
            if goal is not None:
                goal.discard(cell)
                if not goal:
                    break
        if i + 1 < n and reach[i + 1] == j:
            heapq.heappush(heap, (la[i + 1] + rb[j], i + 1, j))
        if j + 1 < m and (i == 0 or reach[i - 1] > j + 1):
            heapq.heappush(heap, (la[i] + rb[j + 1], i, j + 1))
    return out


def _encode(shared, half: int):
    def run(batches):
        one, two = shared.value
        for batch in batches:
            at, x = _matrix(batch.column(1))
            if len(at):
                cell = squared(x[:, :half], one).argmin(1) * len(two) + squared(x[:, half:], two).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cell.astype(np.int32))], names=["k", "v", "cell"])

    return run


def _exact(queries: np.ndarray, names: np.ndarray, k: int):
    """A task's k nearest entries to each sampled query: (query number, distance, cell)."""

    def run(batches):
        best = np.full((len(queries), k), np.inf)
        cells = np.full((len(queries), k), -1, dtype=np.int64)
        for batch in batches:
            _, x = _matrix(batch.column(1))
            if not len(x):
                continue
            keys, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for s in range(0, len(x), 4096):
                d = squared(queries, x[s : s + 4096])
                d[names[:, None] == keys[None, s : s + 4096]] = np.inf
                d, c = np.concatenate([best, d], 1), np.concatenate([cells, np.broadcast_to(cell[s : s + 4096], d.shape)], 1)
                pick = np.argsort(d, axis=1, kind="stable")[:, :k]
                best, cells = np.take_along_axis(d, pick, 1), np.take_along_axis(c, pick, 1)
        q, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, j]), pa.array(cells[q, j].astype(np.int32))], names=["q", "d", "cell"])

    return run


def calibrate(entries: DataFrame, books: list[np.ndarray], filled: np.ndarray, half: int, k: int, recall: float, sample: int) -> tuple[int, float]:
    """(candidates a query needs to find `recall` of its k neighbours, cells that holds), judged on `sample` queries."""
    rows = entries.orderBy(F.xxhash64("k"), "k").limit(sample).collect()
    x, names = np.array([r["v"] for r in rows], dtype=np.float64), np.array([r["k"] for r in rows])
    near = entries.mapInArrow(_exact(x, names, k), "q int, d double, cell int").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "cell"))), 1, k).alias("b")).collect()
    left, right = squared(x[:, :half], books[0]), squared(x[:, half:], books[1])
    needed, cells = [], []
    for r in near:
        goal = {b["cell"] for b in r["b"]}
        at, held = {}, 0
        for c in traverse(left[r["q"]], right[r["q"]], filled, int(filled.sum()), goal):
            held += int(filled[c])
            at[c] = held
        needed.extend(at[b["cell"]] for b in r["b"])
        cells.append(len(at) / max(1, held))
    if not needed:
        return 1, 1.0
    wanted = int(np.quantile(needed, recall, method="higher"))
    return wanted, float(np.mean(cells)) * wanted


def pack_cells(cells: np.ndarray) -> bytes:
    """A set of cells: a byte that tells the form, then the numbers, or the first of them and a bit for each from there on, whichever is shorter."""
    cells = np.sort(cells)
    if 4 * len(cells) <= (int(cells[-1]) - int(cells[0])) // 8 + 5:
        return b"n" + cells.astype(np.int32).tobytes()
    bits = np.zeros(int(cells[-1]) - int(cells[0]) + 1, dtype=bool)
    bits[cells - cells[0]] = True
    return b"b" + cells[:1].astype(np.int32).tobytes() + np.packbits(bits).tobytes()


def unpack_cells(data: bytes) -> np.ndarray:
    if data[:1] == b"n":
        return np.frombuffer(data, dtype=np.int32, offset=1)
    first = np.frombuffer(data, dtype=np.int32, count=1, offset=1)[0]
    return (np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=5))) + first).astype(np.int32)


def shards_of(filled: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last shard of each cell, if shards take about so many entries of the cells in order."""
    upto = np.cumsum(filled)
    return ((upto - filled) // entries).astype(np.int32), (np.maximum(upto - 1, 0) // entries).astype(np.int32)


def _place(shared):
    """Every entry with its shard; those of a cell in several shards are spread by their keys."""

    def run(batches):
        first, last = shared.value
        for batch in batches:
            if batch.num_rows:
                k, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                width = (last[cell] - first[cell] + 1).astype(np.uint64)
                shard = first[cell] + (mix(k.view(np.uint64)) % width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", "k", "v", "cell"])

    return run


def _route(shared, half: int, wanted: int):
    """Each query once for every shard that it visits, with the cells there."""

    def run(batches):
        (one, two), filled, first, last = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                batch = whole.slice(s, 256)
                at, x = _matrix(batch.column(1))
                if not len(at):
                    continue
                left, right = squared(x[:, :half], one), squared(x[:, half:], two)
                row, shard, cells = [], [], []
                for i in range(len(at)):
                    visit = np.array(traverse(left[i], right[i], filled, wanted), dtype=np.int32)
                    width = last[visit] - first[visit] + 1
                    visit, home = np.repeat(visit, width), np.repeat(first[visit] + width - np.cumsum(width), width) + np.arange(width.sum())
                    order = np.argsort(home, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                        row.append(i)
                        shard.append(int(home[part[0]]))
                        cells.append(pack_cells(visit[part]))
                take = pa.array(at[row])
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(cells, pa.binary())], names=["shard", "k", "v", "cells"])

    return run


def nearest_of(keys: np.ndarray, entries: np.ndarray, cell: np.ndarray, asked: np.ndarray, queries: np.ndarray, visits: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry row, squared distance) of the k nearest entries of each query in the cells that it visits, its own key left out; ties go to lower keys."""
    order = np.lexsort((keys, cell))
    names, first = np.unique(cell[order], return_index=True)
    last = np.append(first[1:], len(order))
    who = np.repeat(np.arange(len(visits)), [len(v) for v in visits])
    what = np.concatenate(visits) if len(visits) else np.zeros(0, dtype=np.int64)
    by = np.argsort(what, kind="stable")
    who, what = who[by], what[by]
    edge = np.flatnonzero(np.diff(what, prepend=-1))
    best_d = np.full((len(visits), k), np.inf)
    best_i = np.full((len(visits), k), -1, dtype=np.int64)
    for s, e in zip(edge, np.append(edge[1:], len(what))):
        at = np.searchsorted(names, what[s])
        if at == len(names) or names[at] != what[s]:
            continue
        q, rows = who[s:e], order[first[at] : last[at]]
        for c in range(0, len(rows), 4096):
            r = rows[c : c + 4096]
            d = squared(queries[q], entries[r])
            d[keys[r][None, :] == asked[q][:, None]] = np.inf
            near = d.min(axis=1) <= best_d[q, -1]  # most cells hold nothing nearer
            if not near.any():
                continue
            qs, d = q[near], d[near]
            all_d = np.concatenate([best_d[qs], d], axis=1)
            all_i = np.concatenate([best_i[qs], np.broadcast_to(r, d.shape)], axis=1)
            key = np.where(all_i >= 0, keys[all_i], np.iinfo(np.int64).max)
            pick = np.lexsort((key, all_d), axis=1)[:, :k]
            best_d[qs] = np.take_along_axis(all_d, pick, 1)
            best_i[qs] = np.take_along_axis(all_i, pick, 1)
    q, j = np.nonzero(np.isfinite(best_d))
    return q, best_i[q, j], best_d[q, j]


def _rank(k: int):
    def of(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = {"k": pa.int64(), "neighbor": pa.int64(), "d": pa.float64()}
        if not asked.num_rows or not held.num_rows:
            return pa.table({c: pa.array([], t) for c, t in schema.items()})
        _, entries = _matrix(held.column("v").combine_chunks())
        _, queries = _matrix(asked.column("v").combine_chunks())
        keys, mine = held.column("k").to_numpy(), asked.column("k").to_numpy()
        cell, packs, out = held.column("cell").to_numpy(), asked.column("cells"), []
        for s in range(0, len(mine), QUERIES_PER_SLICE):
            part = slice(s, s + QUERIES_PER_SLICE)
            visits = [unpack_cells(x.as_py()) for x in packs[part]]
            q, i, d = nearest_of(keys, entries, cell, mine[part], queries[part], visits, k)
            out.append((mine[part][q], keys[i], d))
        who, what, far = (np.concatenate(x) for x in zip(*out))
        return pa.table({"k": who, "neighbor": what, "d": far})

    return of


def _vectors(df: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(k, v) of the rows that have a key and a vector of finite numbers."""
    v = F.col(vector).cast(kind)
    good = df.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(whole_key(df, key).alias("k"), v.alias("v"))
    return good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def nearest_neighbours(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL, sample: int = SAMPLE, queries: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest rows of df, but those with the same key, by Euclidean distance, found approximately.

    Asked are the rows of queries (which has the same two columns), all rows of df if none are given. All rows of df are
    in the index; its codebooks are fitted to about fit_rows of them. Keys are whole numbers, else a TypeError is raised.
    Defined cases: null vectors, and vectors that are empty, hold nulls or aren't finite, neither ask nor are found;
    nor do those whose length isn't the commonest in df (the longer of equals); a null key takes no part; of rows with one
    key, the least vector counts; ties go to lower keys; with fewer than k other rows all are given; without other
    rows, or without queries, the result is empty; other columns don't matter.
    """
    spark = df.sparkSession
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    good = _vectors(df, key, vector, kind)
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    of_one_key = lambda x: x.where(F.size("v") == dims["d"]).groupBy("k").agg(F.min("v").alias("v"))
    vectors = cut(of_one_key(good))
    n = vectors.count()
    half = max(1, dims["d"] // 2)
    size = int(max(1, min(MOST_CELLS**0.5, round((n / CELL) ** 0.5))))
    some = vectors if n <= fit_rows else vectors.where(F.shiftrightunsigned(F.xxhash64("k"), 1) < F.lit(int(fit_rows / n * 2**63)))
    sample_of = some.select("k", "v", F.xxhash64("k").alias("h")).toArrow().sort_by([("h", "ascending"), ("k", "ascending")])
    books = codebooks(_matrix(sample_of.column("v").combine_chunks())[1].reshape(-1, dims["d"]), size)
    del sample_of
    sc = spark.sparkContext
    entries = cut(vectors.mapInArrow(_encode(sc.broadcast(books), half), f"k long, v {kind}, cell int"))
    filled = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for r in entries.groupBy("cell").count().toArrow().to_batches():  # at most MOST_CELLS rows
        filled[r.column(0).to_numpy()] = r.column(1).to_numpy()
    first, last = shards_of(filled, SHARD_ENTRIES)
    shards = int(last.max(initial=0)) + 1
    wanted, cells = calibrate(entries, books, filled, half, k, recall, sample)
    asking = vectors if queries is None else cut(of_one_key(_vectors(queries, key, vector, kind)))
    asked = asking.mapInArrow(_route(sc.broadcast((books, filled, first, last)), half, wanted), f"shard int, k long, v {kind}, cells binary")
    # queries that meet in a shard, if each visits so many cells, all in different shards at worst
    parts = max(1, math.ceil((n if queries is None else asking.count()) * min(1.0, cells / shards) / QUERIES_PER_PART))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts)))
    held = entries.mapInArrow(_place(sc.broadcast((first, last))), f"shard int, k long, v {kind}, cell int")
    held = held.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "k", "v", "cell")
    near = asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(_rank(k), "k long, neighbor long, d double")
    best = near.groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "neighbor"))), 1, k).alias("b"))
    out = best.select(F.col("k").alias("vec_id"), F.posexplode("b").alias("rank", "b"))
    return out.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("b.neighbor").alias("neighbor_id"), F.sqrt("b.d").alias("distance"))
