"""Documents whose sets of word n-grams have at least a given Jaccard similarity: their classes, and how many links each has.

1. N-grams that very many texts hold are found first, by lossy counts of each task. They come last in the order of all
   n-grams and are sent straight to their documents. All others go, packed, to shards of the hash space, which count in
   how many documents each one is. Those in a single document can't be shared; the rest go back, packed, to blocks of
   documents with their frequency.
2. So each document has its n-grams in one order for everybody, rare first, the unshared ones in front. Two sets that
   reach the threshold must share an n-gram of their prefixes in that order; a document whose prefix is all unshared has
   no partner. Prefixes go to shards again (equal sets of a batch once); documents of compatible lengths that meet there
   are linked, and the links' components say which documents have to be together.
3. The sets of linked documents (one of each class of equal sets) go to their component, once. There they are joined on
   prefix n-grams, rare first, behind length, positional and suffix filters, and each surviving pair is verified once.
   No pair leaves its task: only how many links each set has, and which set stands for those linked to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.llm.common import BROADCAST_LIMIT, Words, cut, free_name, mix, small, text_slices, whole_key
from loregrid.llm.components import connected_components, forest

N, THRESHOLD = 5, 0.4
#: A component with more sets, or more bytes of them, is joined block against block.
BLOCK, BLOCK_BYTES = 2048, 64 << 20
ENTRIES_PER_SHARD, FLUSH = 1 << 21, 1 << 19
#: N-grams that occur so often at least aren't counted by shard, and how many a task's lossy counts hold.
HOT, COUNTED = 1 << 17, 1 << 20
_MASK40 = np.uint64((1 << 40) - 1)


def sets_of(data: np.ndarray, offset: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct n-grams, sorted. A text with fewer than n words, but any, has one: all its words."""
    w = Words(data, offset)
    h, at = w.ngrams(n)
    doc = w.doc[at]
    count = np.diff(w.first)
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            g, p = w.ngrams(m)
            keep = np.isin(p, w.first[short])
            h, doc = np.concatenate([h, g[keep]]), np.concatenate([doc, w.doc[p[keep]]])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _pack(shard: np.ndarray, key: np.ndarray, size: np.ndarray, h: np.ndarray, level: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each shard: its documents (key, set size, number of n-grams here), five bytes of each n-gram, and a level byte if there is one. Rows come in order of documents."""
    order = np.argsort(shard, kind="stable")
    key, size, h, shard = key[order], size[order], h[order], shard[order]
    edge = np.flatnonzero(np.diff(shard)) + 1
    packs, docs = [], []
    for s, e in zip([0, *edge], [*edge, len(h)]) if len(h) else ():
        k, z = key[s:e], size[s:e]
        new = np.append(0, np.flatnonzero((k[1:] != k[:-1]) | (z[1:] != z[:-1])) + 1)
        pack = np.diff(k[new], prepend=0).tobytes() + z[new].astype(np.int32).tobytes() + np.diff(np.append(new, e - s)).astype(np.int32).tobytes()
        pack += np.ascontiguousarray((h[s:e] & _MASK40).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
        packs.append(pack if level is None else pack + level[order[s:e]].tobytes())
        docs.append(len(new))
    at = shard[np.append(0, edge)] if len(h) else shard
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(docs if len(h) else [], pa.int32()), pa.array(packs if len(h) else [], pa.binary())], names=["shard", "docs", "pack"])


#: of: the shard that counted the n-grams; -1 where that is still to be done.
PACKED = "shard int, of int, docs int, pack binary"


def _with_of(batch: pa.RecordBatch, of: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, of, dtype=np.int32)), *batch.columns[1:]], names=["shard", "of", "docs", "pack"])


def _unpack(table: pa.Table, leveled: bool = False):
    keys, sizes, hashes, levels = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for m, pack in zip(table.column("docs").to_pylist(), table.column("pack").to_pylist()):
        count = np.frombuffer(pack, dtype=np.int32, count=m, offset=12 * m)
        n = int(count.sum())
        keys.append(np.repeat(np.cumsum(np.frombuffer(pack, dtype=np.int64, count=m)), count))
        sizes.append(np.repeat(np.frombuffer(pack, dtype=np.int32, count=m, offset=8 * m), count))
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(pack, dtype=np.uint8, count=5 * n, offset=16 * m).reshape(-1, 5)
        hashes.append(wide.view(np.uint64).ravel())
        if leveled:
            levels.append(np.frombuffer(pack, dtype=np.uint8, offset=16 * m + 5 * n))
    return np.concatenate(keys), np.concatenate(sizes), np.concatenate(hashes), np.concatenate(levels)


def lossy_sum(held: tuple[np.ndarray, np.ndarray], values: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values with their counts, both added up; of more than limit values the less frequent go."""
    v = np.concatenate([held[0], values])
    order = np.argsort(v, kind="stable")
    v, c = v[order], np.concatenate([held[1], counts])[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, dtype=np.int64)
    v, c = v[first], np.add.reduceat(c, first) if len(v) else c
    if len(v) > limit:
        more = c > np.partition(c, len(c) - limit // 2)[len(c) - limit // 2]
        v, c = v[more], c[more]
    return v, c


def _often_task(n: int, limit: int):
    """(hash, occurrences) of the n-grams that a task meets often: all that occur in more than one of each 2 MB slice's texts, as far as limit goes."""

    def run(batches):
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            for _, _, data, offset in text_slices(batch.column(0)):
                v, c = np.unique(Words(data, offset).ngrams(n)[0], return_counts=True)
                several = c > 1
                held = lossy_sum(held, v[several], c[several], limit)
        several = held[1] >= 8
        yield pa.RecordBatch.from_arrays([pa.array(held[0][several].view(np.int64)), pa.array(held[1][several])], names=["h", "c"])

    return run


def hot_ngrams(docs: DataFrame, n: int, entries: float, least: int) -> np.ndarray:
    """Sorted hashes of the n-grams that occur at least `least` times; more often where so many would be too large to broadcast."""
    least = max(least, math.ceil(entries * 8 / BROADCAST_LIMIT))
    found = docs.select("t").mapInArrow(_often_task(n, COUNTED), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    return np.sort(found.select("h").toArrow().column(0).to_numpy().view(np.uint64))


def _scatter_task(n: int, shards: int, shared):
    """All n-grams of all texts, packed: hot ones by block of documents, by their number among the hot ones, others by shard of the hash space."""

    def packs(parts, hot):
        key, size, h = (np.concatenate(x) for x in zip(*parts))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            is_hot = hot[at] == h
            if is_hot.any():
                k = key[is_hot]
                block = (mix(k.view(np.uint64)) % np.uint64(shards)).astype(np.int32)
                yield _with_of(_pack(block, k, size[is_hot], at[is_hot].astype(np.uint64), np.full(len(k), 255, dtype=np.uint8)), shards)
                key, size, h = key[~is_hot], size[~is_hot], h[~is_hot]
        if len(h):
            yield _with_of(_pack(((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int32), key, size, h), -1)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offset in text_slices(batch.column(1)):
                doc, h = sets_of(data, offset, n)
                parts.append((keys[a:b][doc], np.bincount(doc, minlength=b - a)[doc], h))
                held += len(h)
                if held >= FLUSH:
                    yield from packs(parts, shared.value)
                    parts, held = [], 0
        if held:
            yield from packs(parts, shared.value)

    return run


def _count(blocks: int):
    """A shard's n-grams that several rows have, with a level that grows with the log of their number, packed by block of documents; hot n-grams pass."""

    def of(table: pa.Table) -> pa.Table:
        counted = table.column("of").to_numpy() >= 0
        ready, table = table.filter(pa.array(counted)), table.filter(pa.array(~counted))
        if not table.num_rows:
            return ready
        key, size, h, _ = _unpack(table)
        shard = table.column("shard")[0].as_py()
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s))
        df = np.empty(len(h), dtype=np.int64)
        df[order] = np.repeat(np.diff(first), np.diff(first))
        several = df > 1
        key, size, h, df = key[several], size[several], h[several], df[several]
        level = np.round(8 * np.log2(df)).clip(0, 254).astype(np.uint8)
        block = (mix(key.view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
        out = pa.Table.from_batches([_with_of(_pack(block, key, size, h, level), shard)])
        return pa.concat_tables([out, ready.cast(out.schema)])

    return of


def _order(threshold: float):
    """A block's documents that can have partners: their shared n-grams, rare first, and how many of them are in the prefix."""

    def of(table: pa.Table) -> pa.Table:
        key, size, h, level = _unpack(table, True)
        counts = [int(np.frombuffer(p, dtype=np.int32, count=m, offset=12 * m).sum()) for m, p in zip(table.column("docs").to_pylist(), table.column("pack").to_pylist())]
        h = h | (np.repeat(table.column("of").to_numpy(), counts).astype(np.uint64) << np.uint64(40))
        order = np.lexsort((h, level, size, key))
        key, size, h = key[order], size[order].astype(np.int64), h[order]
        once = np.ones(len(key), dtype=bool)
        once[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (h[1:] != h[:-1])
        key, size, h = key[once], size[once], h[once]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1])
        first = np.append(np.flatnonzero(new), len(key))
        k, shared = key[new], np.diff(first)
        z = np.maximum(size[new], shared)
        take = np.minimum(prefix_length(z, threshold) - (z - shared), shared)
        doc = np.cumsum(new) - 1
        s1, s2 = _signature(doc, h, len(k))
        alone = shared < z  # it has n-grams of its own, so no other set equals it
        s1, s2 = np.where(alone, k, s1), np.where(alone, -1, s2)
        use = np.flatnonzero(take > 0)
        sets = [h[first[i] : first[i + 1]].tobytes() for i in use.tolist()]
        return pa.table({"k": k[use], "size": z[use], "take": take[use], "s1": s1[use], "s2": s2[use], "set": pa.array(sets, pa.binary())})

    return of


def _signature(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each document's set."""
    sums = []
    first = np.searchsorted(doc, np.arange(n + 1))
    for salt in (0x1234567, 0x89ABCDEF01):
        c = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(mix(mix(h ^ np.uint64(salt)) + np.uint64(salt)), out=c[1:])
        sums.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _prefix_task(batches):
    """The prefixes of documents, packed by shard; of equal sets in a batch only one's, as they are linked anyway."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size, s1, s2 = (batch.column(i).to_numpy() for i in (1, 3, 4))
        order = np.lexsort((s2, s1, size))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(size[order]) != 0) | (np.diff(s1[order]) != 0) | (np.diff(s2[order]) != 0)
        batch = batch.take(pa.array(np.sort(order[new])))
        key, size, take = (batch.column(i).to_numpy() for i in range(3))
        h = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64, count=int(t)) for x, t in zip(batch.column(5), take)])
        yield _with_of(_pack((h >> np.uint64(40)).astype(np.int32), np.repeat(key, take), np.repeat(size, take), h), -1)


def _links(threshold: float):
    def of(table: pa.Table) -> pa.Table:
        key, size, h, _ = _unpack(table)
        order = np.argsort((h << np.uint64(24)) | np.minimum(size, (1 << 24) - 1).astype(np.uint64), kind="stable")
        key, size, h = key[order], size[order], h[order]
        start = np.ones(len(h), dtype=bool)
        start[1:] = (h[1:] != h[:-1]) | (size[:-1] < threshold * size[1:] - 1e-9)
        first = key[np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))]
        apart = first != key
        node, root = forest(first[apart], key[apart])
        return pa.table({"a": pa.array(node[node != root], pa.int64()), "b": pa.array(root[node != root], pa.int64())})

    return of


def _suffix_profile(tokens: list[np.ndarray], bins: int = 16) -> np.ndarray:
    """How a set's tokens spread over fixed ranges of the order: the pivots of the suffix filter."""
    return np.stack([np.bincount(((t * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.int64), minlength=bins) for t in tokens])


def join_sets(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, overlap) with Jaccard >= threshold, i from left and j from right (boolean), each unordered pair once.

    size may be above a set's length: what is missing is shared with nobody, and comes first in the order. Prefix tokens are taken rare first; the first one a pair shares decides by its positions (nothing rarer is shared),
    then fixed-pivot suffix filtering bounds the Hamming distance of the sets. Matrices of all pairs hold a byte or a float; all else goes by rows.
    """
    m = len(sets)
    length = np.array([len(s) for s in sets], dtype=np.int64)
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.lexsort((values, df))] = np.arange(len(values))
    owner = np.repeat(np.arange(m), length)
    r = rank[inverse]
    order = np.lexsort((r, owner))
    r = r[order]
    first = np.concatenate([[0], np.cumsum(length)])
    position = np.arange(len(r)) - first[owner] + (size - length)[owner]
    inside = (position < prefix_length(size, threshold)[owner]) & (df[np.argsort(rank)][r] > 1)
    tok, own, pos = r[inside], owner[inside], position[inside]
    del order, r, position, inside
    order = np.lexsort((own, tok))
    tok, own, pos = tok[order], own[order], pos[order]
    rows = range(0, m, 256)
    open_ = np.zeros((m, m), dtype=bool)
    for s in rows:
        a, b = size[s : s + 256, None], size[None, :]
        open_[s : s + 256] = (left[s : s + 256, None] & right[None, :] | right[s : s + 256, None] & left[None, :]) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)  # length filter
    np.fill_diagonal(open_, False)
    need = lambda a, b: np.ceil(threshold / (1 + threshold) * (size[a] + size[b]) - 1e-9)
    maybe = np.zeros((m, m), dtype=bool)
    edge = np.flatnonzero(np.diff(tok)) + 1
    for s, e in zip([0, *edge], [*edge, len(tok)]):
        if e - s > 1:
            g, rest = own[s:e], size[own[s:e]] - pos[s:e]
            at = np.ix_(g, g)
            new = open_[at]
            if new.any():
                x, y = np.nonzero(new)
                good = np.minimum(rest[x], rest[y]) >= need(g[x], g[y])  # positional filter
                maybe[g[x[good]], g[y[good]]] = True
                open_[at] = False
    del open_
    profile = _suffix_profile(sets)
    pairs = 0
    for s in rows:
        i, j = np.nonzero(np.triu(maybe[s : s + 256], s + 1))
        if len(i):
            i = i + s
            apart = np.concatenate([np.abs(profile[i[p : p + (1 << 16)]] - profile[j[p : p + (1 << 16)]]).sum(axis=1) for p in range(0, len(i), 1 << 16)])
            good = (length[i] + length[j] - apart) // 2 >= need(i, j)  # suffix filter
            maybe[i[~good], j[~good]] = False
            pairs += int(good.sum())
        maybe[s : s + 256] = np.triu(maybe[s : s + 256], s + 1)
    none = np.zeros(0, dtype=np.int64)
    if not pairs:
        return none, none, none
    used = np.flatnonzero(maybe.any(axis=0) | maybe.any(axis=1))
    shared = df[inverse] > 1
    width = int((df > 1).sum())
    total = None
    if pairs * 25e-6 > 2e-10 * len(used) ** 2 * width + 1e-9 * len(used) * width:  # many pairs: all overlaps by matrix products
        back = np.full(m, -1)
        back[used] = np.arange(len(used))
        total = np.zeros((len(used), len(used)), dtype=np.float32)
        who, col = back[owner], (np.cumsum(df > 1) - 1)[inverse]
        take = shared & (who >= 0)
        who, col = who[take], col[take]
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        step = 1024
        for s in range(0, width, step):
            a, b = np.searchsorted(col, [s, s + step])
            dense = np.zeros((len(used), min(step, width - s)), dtype=np.float32)
            dense[who[a:b], col[a:b] - s] = 1
            for t in range(0, len(used), 1024):
                total[t : t + 1024] += dense[t : t + 1024] @ dense.T
    out = []
    for s in rows:
        i, j = np.nonzero(maybe[s : s + 256])
        if not len(i):
            continue
        i = i + s
        if total is not None:
            overlap = total[back[i], back[j]].astype(np.int64)
        else:
            overlap = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], dtype=np.int64)
        good = overlap >= threshold * (size[i] + size[j] - overlap) - 1e-9
        out.append((i[good].astype(np.int32), j[good].astype(np.int32), overlap[good].astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _join_task(threshold: float):
    """(key, size, number of documents that it is linked to here, least key of those that it is linked to here, directly or through others) of a tile's sets."""

    def of(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        order = np.lexsort((table.column("size").to_numpy(), table.column("k").to_numpy()))
        k, block, size, w = (table.column(c).to_numpy()[order] for c in ("k", "block", "size", "w"))
        packs = table.column("set")
        sets = [np.frombuffer(packs[int(i)].as_py(), dtype=np.uint64) for i in order]
        i, j, _ = join_sets(sets, size, block == x, block == y, threshold)
        links = np.bincount(i, weights=w[j], minlength=len(k)) + np.bincount(j, weights=w[i], minlength=len(k))
        node, root = forest(k[i], k[j])
        at = np.flatnonzero(links > 0)
        return pa.table({"k": k[at], "size": size[at], "n": links[at].astype(np.int64), "root": root[np.searchsorted(node, k[at])] if len(at) else k[at]})

    return of


def ngram_join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, n_links): one row for every key of the table.

    Two documents are linked if their sets of word n-grams have a Jaccard similarity of at least threshold. n_links is the
    number of documents that a document is linked to, copies included; class_id is the least key among those linked to
    it, directly or through others, and itself. Words are runs of anything but ASCII white space, ASCII letters in lower
    case. Exact but for hashes of 40 bits and more. Keys are whole numbers, else a TypeError is raised.
    Defined cases: a text of fewer than n words has its whole word sequence as its one n-gram; null, empty and blank
    texts have no n-grams and no links; rows with a null key take no part; equal rows with one key are one document,
    and rows with one key and different texts are looked at apart (those with equally many n-grams pooled), their links,
    to each other too, added up; texts of any length are whole; an empty table gives an empty result; other columns
    don't matter.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sc = df.sparkSession.sparkContext
    keyed = df.where(F.col(key).isNotNull()).select(whole_key(df, key).alias("k"), F.col(text).alias("t"))
    docs = keyed.where(F.col("t").isNotNull())
    entries = (docs.agg(F.sum(F.length("t"))).first()[0] or 0) / 6
    shards = max(1, math.ceil(entries / ENTRIES_PER_SHARD))
    often = sc.broadcast(hot_ngrams(docs, n, entries, hot))
    packs = docs.mapInArrow(_scatter_task(n, shards, often), PACKED)
    counted = packs.groupBy("shard").applyInArrow(_count(shards), PACKED)
    held = cut(counted.groupBy("shard").applyInArrow(_order(threshold), "k long, size long, take long, s1 long, s2 long, set binary"))
    signed = held.select("k", "size", "s1", "s2")
    least = signed.groupBy("size", "s1", "s2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("w"))
    copies = signed.join(least.where("w > 1"), ["size", "s1", "s2"]).select(F.col("k").alias("a"), F.col("rep").alias("b"))
    links = held.select("k", "size", "take", "s1", "s2", "set").mapInArrow(_prefix_task, PACKED).groupBy("shard").applyInArrow(_links(threshold), "a long, b long")
    comps = connected_components(links.unionByName(copies))

    classes = cut(signed.join(comps.withColumnRenamed("node", "k"), "k").join(least, ["size", "s1", "s2"]))
    reps = classes.where("k = rep").select("k", "size", "s1", "s2", "w", F.col("component").alias("comp"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") * 8 / BLOCK_BYTES)).cast("int")
    count = reps.groupBy("comp").agg(parts.alias("blocks"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    found = held.select("k", "size", "s1", "s2", "set").join(reps.join(count, "comp"), ["k", "size", "s1", "s2"])
    placed = found.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    tiles = placed.select("*", other).select("comp", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "k", "size", "w", "set")
    linked = cut(tiles.groupBy("comp", "x", "y").applyInArrow(_join_task(threshold), "k long, size long, n long, root long"))

    star = classes.where("k <> rep").select(F.col("k").alias("a"), F.col("rep").alias("b"))
    near = connected_components(star.unionByName(linked.select(F.col("k").alias("a"), F.col("root").alias("b"))))
    of_reps = linked.groupBy(F.col("k").alias("rep"), "size").agg(F.sum("n").alias("n"))
    own = classes.join(of_reps, ["rep", "size"], "left").groupBy("k").agg(F.sum(F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    out = keyed.select("k").distinct().join(own, "k", "left").join(near.withColumnRenamed("node", "k"), "k", "left")
    return out.select(F.col("k").alias("doc_id"), F.coalesce("component", "k").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with one document, that with the least key, of each of ngram_join's classes.

    Defined cases: rows with a null key stay, and so do null, empty and blank texts, which are linked to none; rows with
    the least key of a class all stay; an empty table gives an empty table; other columns pass through, whatever their
    names.
    """
    name = free_name(df, "lg_gone")
    gone = cut(ngram_join(df, key, text, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(name)))
    return df.join(small(gone, 16), F.col(key).cast("long") == F.col(name), "left_anti")


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END)) AS g FROM w WHERE len(w) > 0),
r AS (SELECT g, min(doc_id) AS rep, list(doc_id) AS members FROM g GROUP BY g),
e AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM r),
o AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE o >= {THRESHOLD} * (n + m - o) - 1e-9),
reach AS (SELECT rep AS node, rep AS root FROM r UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node WHERE reach.root < l.b),
c AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
n AS (SELECT l.a, sum(len(r.members)) AS n FROM l JOIN r ON r.rep = l.b GROUP BY 1),
m AS (SELECT unnest(r.members) AS doc_id, c.class_id, len(r.members) - 1 + coalesce(n.n, 0) AS n_links FROM r JOIN c ON c.node = r.rep LEFT JOIN n ON n.a = r.rep)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links FROM documents d LEFT JOIN m USING (doc_id)
"""
