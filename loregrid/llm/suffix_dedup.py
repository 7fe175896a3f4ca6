"""Removal of long word sequences that occur earlier in the corpus, by sorting suffixes.

A repeat of `length` words always has an anchor: the least hash among the shorter runs of words inside it, chosen from
the window alone, so that equal windows have equal anchors at equal offsets. Suffixes are bucketed by anchor. Buckets
with one anchor hold no repeat and go no further; of the others, only the words around the anchor are moved. Within a
bucket the suffixes are sorted deep-shallow: multikey quicksort to SHALLOW words, then blind tries for the groups that
still agree. Suffixes that agree to the full depth are one repeat, of which the first occurrence stays.

An anchor at more than HOT places has no bucket: its places are first reduced to classes with the same words around
them, and the windows of these meet by a hash of the whole window, so that no task holds all places of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregrid.llm.common import Words, cut, free_name, mix, small, text_slices, whole_key

LENGTH, SHALLOW, HOT = 50, 8, 1 << 12


def anchors(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word index, hash, first window, last window) of each anchor; windows are word indices and each has one anchor."""
    short = max(1, length * 2 // 5)
    span = length - short + 1  # runs of `short` words in a window
    n = len(w.hash)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    g, at = w.ngrams(short)
    h = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    h[at] = g
    best, width = np.arange(n), 1
    pick = lambda x, y: np.where(h[x] <= h[y], x, y)  # noqa: E731  (the left one of equals)
    while width * 2 <= span:
        best[: n - width] = pick(best[: n - width], best[width:])
        width *= 2
    if width < span:
        off = span - width
        best[: n - off] = pick(best[: n - off], best[off:].copy())
    start = np.flatnonzero(w.doc[: n - length + 1] == w.doc[length - 1 :])
    a = best[start]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (w.doc[start[1:]] != w.doc[start[:-1]])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(a)) - 1
    return a[lo], h[a[lo]], start[lo], start[hi]


def multikey_quicksort(rows: list[tuple], items: list[int], depth: int, limit: int) -> Iterator[list[int]]:
    """Groups of items whose rows agree in their first `limit` entries, in order of these."""
    stack = [(items, depth)]
    while stack:
        part, d = stack.pop()
        if len(part) == 1 or d == limit:
            yield part
            continue
        pivot = rows[part[len(part) // 2]][d]
        less, same, more = [], [], []
        for i in part:
            x = rows[i][d]
            (same if x == pivot else less if x < pivot else more).append(i)
        if more:
            stack.append((more, d))
        stack.append((same, d + 1))
        if less:
            stack.append((less, d))


class _Node:
    __slots__ = ("depth", "leaf", "next")

    def __init__(self, depth: int, leaf: list[int]) -> None:
        self.depth, self.leaf, self.next = depth, leaf, {}


def _common(a: tuple, b: tuple) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def blind_trie(rows: list[tuple], items: list[int]) -> Iterator[list[int]]:
    """Groups of items with equal rows, in order. Inner nodes know only where their leaves part; one comparison with the leaf found blindly places a row."""
    full = len(rows[items[0]])
    root = _Node(full, [items[0]])
    for i in items[1:]:
        row, node = rows[i], root
        while node.next:
            node = node.next.get(row[node.depth]) or next(iter(node.next.values()))
        other = rows[node.leaf[0]]
        if other == row:
            node.leaf.append(i)
            continue
        d = _common(other, row)
        node = root
        while node.next and node.depth < d:
            node = node.next[row[node.depth]]
        if node.next and node.depth == d:
            node.next[row[d]] = _Node(full, [i])
            continue
        below = _Node(node.depth, node.leaf)
        below.next = node.next
        node.depth, node.leaf, node.next = d, [], {other[d]: below, row[d]: _Node(full, [i])}
    stack = [root]
    while stack:
        node = stack.pop()
        if node.next:
            stack.extend(node.next[x] for x in sorted(node.next, reverse=True))
        else:
            yield node.leaf


def deep_shallow(rows: list[tuple], shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Groups of equal rows, in lexicographic order of the rows; all rows have one length."""
    if not rows:
        return
    for group in multikey_quicksort(rows, list(range(len(rows))), 0, min(shallow, len(rows[0]))):
        if len(group) == 1:
            yield group
        else:
            yield from blind_trie(rows, group)


def repeats(key: list[int], at: list[int], lead: list[int], words: list[bytes], length: int) -> tuple[list, list, list]:
    """Of one bucket's anchors (key, anchor's word number, words in front of it, 32-bit words): (key, from, to) of windows that occurred before.

    A window is a repeat if an equal one begins earlier, by (key, word number), and does not overlap it.
    """
    classes: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for k, a, f, b in zip(key, at, lead, words):
        classes.setdefault((f, b), []).append((k, a))
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    names = list(classes)
    least = [min(classes[c]) for c in names]
    # offset of a window from the anchor -> the earliest place of each class's window
    best: list[dict[int, tuple[int, int]]] = []
    if len(names) == 1:
        f, b = names[0]
        best.append(dict.fromkeys(range(f - (len(b) // 4 - length), f + 1), least[0]))
    else:
        rows, owner, offset = [], [], []
        for c, (f, b) in enumerate(names):
            w = tuple(np.frombuffer(b, dtype=np.uint32).tolist())
            for s in range(len(w) - length + 1):
                rows.append(w[s : s + length])
                owner.append(c)
                offset.append(f - s)
        best = [{} for _ in names]
        for group in deep_shallow(rows):
            # equal windows have their anchors at equal offsets
            first = min(least[owner[i]] for i in group)
            for i in group:
                best[owner[i]][offset[i]] = first
    for c, name in enumerate(names):
        windows = sorted(best[c].items(), reverse=True)  # leftmost window first
        whole = len({v for _, v in windows}) == 1
        for k, a in classes[name]:
            first = windows[0][1]
            if whole and first[0] != k:
                runs = [(a - windows[0][0], a - windows[-1][0] + length)]
            else:
                runs = []
                for o, (k0, a0) in windows:
                    if k0 == k and a - a0 < length:
                        continue
                    s = a - o
                    if runs and s <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], s + length)
                    else:
                        runs.append((s, s + length))
            for s, e in runs:
                out[0].append(k)
                out[1].append(s)
                out[2].append(e)
    return out


def _anchor_task(length: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offset in text_slices(batch.column(1)):
                w = Words(data, offset, lower=False)
                at, h, _, _ = anchors(w, length)
                doc = w.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[a:b][doc]), pa.array((at - w.first[doc]).astype(np.int32))], names=["h", "k", "p"])

    return run


def _segment_task(length: int, hot: bool):
    """The words around each anchor that occurs more than once: of those with a number below 0, which are the hot ones' -1 - number, or of the others."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            tied = batch.column(2)
            for a, b, data, offset in text_slices(batch.column(1)):
                part = tied.slice(a, b - a)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(b - a), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                mine = (flat < 0) == hot
                if not mine.any():
                    continue
                flat, owner = np.where(hot, -1 - flat[mine], flat[mine]), owner[mine]
                w = Words(data, offset, lower=False)
                at, h, lo, hi = anchors(w, length)
                doc = w.doc[at]
                place = at - w.first[doc]
                use = np.flatnonzero(np.isin((doc << np.int64(32)) | place, (owner << np.int64(32)) | flat))
                if not len(use):
                    continue
                short = (w.hash >> np.uint64(32)).astype(np.uint32)
                words = [short[s:e].tobytes() for s, e in zip(lo[use].tolist(), (hi[use] + length).tolist())]
                columns = [pa.array(h[use].view(np.int64)), pa.array(keys[a:b][doc[use]]), pa.array(place[use].astype(np.int32)), pa.array((at[use] - lo[use]).astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "k", "p", "lead", "words"])

    return run


def _windows(length: int):
    """Every window of each class of equal surroundings: the class, the window's offset from the anchor, 128 bits of its words."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows, offsets, first, second = [], [], [], []
                for i, (lead, words) in enumerate(zip(batch.column(1).to_pylist(), batch.column(6).to_pylist())):
                    w = np.lib.stride_tricks.sliding_window_view(np.frombuffer(words, dtype=np.uint32), length).astype(np.uint64)
                    for out, salt in ((first, 0x9E3779B97F4A7C15), (second, 0xC2B2AE3D27D4EB4F)):
                        out.append(mix((mix(w + np.uint64(salt)) * (np.arange(length, dtype=np.uint64) * np.uint64(2) + np.uint64(salt | 1))).sum(axis=1, dtype=np.uint64)))
                    rows.append(np.full(len(w), i))
                    offsets.append(lead - np.arange(len(w)))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(take) for c in batch.columns[:6]), pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(second).view(np.int64))],
                    names=["h", "lead", "c1", "c2", "k0", "p0", "o", "w1", "w2"])

    return run


def hot_repeats(places: DataFrame, length: int) -> DataFrame:
    """(k, s, e) as repeats() gives them, of places (h, k, p, lead, words) of anchors that are too many for a bucket."""
    named = places.select("h", "lead", F.xxhash64("words").alias("c1"), F.xxhash64(F.lit(1), "words").alias("c2"), "k", "p", "words")
    surroundings = ["h", "lead", "c1", "c2"]
    classes = cut(named.groupBy(*surroundings).agg(F.min(F.struct("k", "p")).alias("f"), F.first("words").alias("words")).select(*surroundings, F.col("f.k").alias("k0"), F.col("f.p").alias("p0"), "words"))
    windows = classes.mapInArrow(_windows(length), "h long, lead int, c1 long, c2 long, k0 long, p0 int, o int, w1 long, w2 long")
    same = ["h", "o", "w1", "w2"]
    first = windows.groupBy(*same).agg(F.min(F.struct("k0", "p0")).alias("f"))
    best = windows.join(first, same).groupBy(*surroundings).agg(F.collect_list(F.struct("o", "f")).alias("b"))
    best = small(best, 2048, classes.count())  # else the join of the places with their classes is left to the optimiser, which splits a hot one
    bad = F.filter("b", lambda x: (x["f"]["k0"] != F.col("k")) | (F.col("p") - x["f"]["p0"] >= length))
    run = lambda s, e: F.struct((F.col("p") - s).alias("s"), (F.col("p") - e + length).alias("e"))
    runs = F.when(F.size("bad") == F.size("b"), F.array(run(F.array_max("b.o"), F.array_min("b.o")))).otherwise(F.transform("bad", lambda x: run(x["o"], x["o"])))
    return named.drop("words").join(best, surroundings).withColumn("bad", bad).where(F.size("bad") > 0).select("k", F.inline(runs))


def _repeat_task(length: int):
    """Over rows in order of h, bucket by bucket."""

    def emit(rows, out):
        if len(rows[0]) > 1:
            for held, new in zip(out, repeats(*rows, length)):
                held.extend(new)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["k", "s", "e"])

    def run(batches):
        now, rows, out = None, ([], [], [], []), ([], [], [])
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3, 4)]
            edge = (np.flatnonzero(np.diff(h)) + 1).tolist()
            for s, e in zip([0, *edge], [*edge, len(h)]):
                if h[s] != now:
                    emit(rows, out)
                    now, rows = h[s], ([], [], [], [])
                for held, column in zip(rows, columns):
                    held.extend(column[s:e])
            if len(out[0]) > 50_000:
                yield batch_of(out)
                out = ([], [], [])
        emit(rows, out)
        yield batch_of(out)

    return run


def cut_words(data: np.ndarray, offset: np.ndarray, starts: list, ends: list) -> tuple[list[bytes], list[int]]:
    """Each text without its words in [start, end) runs and the white space after them; and how many words went."""
    w = Words(data, offset, lower=False)
    texts, gone = [], []
    for i in range(len(offset) - 1):
        a, b = w.first[i], w.first[i + 1]
        out = np.zeros(b - a + 1, dtype=np.int64)
        if starts[i]:
            np.add.at(out, np.array(starts[i]), 1)
            np.add.at(out, np.minimum(np.array(ends[i]), b - a), -1)
        drop = np.cumsum(out[:-1]) > 0
        begin = np.append(w.start[a:b], offset[i + 1])
        keep = np.ones(offset[i + 1] - offset[i], dtype=bool)
        flips = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
        for s, e in zip(flips[::2].tolist(), flips[1::2].tolist()):
            keep[begin[s] - offset[i] : begin[e] - offset[i]] = False
        texts.append(data[offset[i] : offset[i + 1]][keep].tobytes())
        gone.append(int(drop.sum()))
    return texts, gone


def suffix_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """df's texts without sequences of at least `length` words that occur earlier in the table.

    Words are runs of anything but ASCII white space and are compared by 32 bits of their hashes each, so a window of 50
    by 1600 (of 128 bits again where an anchor is at more than `hot` places). A window of `length` words goes if the
    first equal window, by (key, word number), is in another row or does not overlap it; the union of such windows is
    removed, each word with the white space after it. n_repeated (words removed) is added, with underscores in front
    where df has such a name. All rows come back. Defined cases: a null text stays null, and a text with fewer than
    `length` words stays as it is (n_repeated 0); a row with a null key takes no part and stays as it is; rows with one
    key count as one place, so that equal rows with one key stay alike; an empty table gives an empty table; other
    columns pass through; texts of any length are whole. Keys are whole numbers, else a TypeError is raised.
    """
    gone = free_name(df, "n_repeated")
    keyed = df.where(F.col(key).isNotNull())
    docs = keyed.select(whole_key(df, key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    found = docs.mapInArrow(_anchor_task(length), "h long, k long, p int")
    several = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    if several.where(F.col("c") > hot).isEmpty():
        place, crowded = F.col("p"), None
        tied = found.join(several.select("h").hint("shuffle_hash"), "h", "left_semi")
    else:
        place, crowded = F.when(F.col("c") > hot, -1 - F.col("p")).otherwise(F.col("p")), F.exists("tied", lambda p: p < 0)
        tied = found.join(several.hint("shuffle_hash"), "h")
    tied = tied.groupBy("k").agg(F.collect_set(place).alias("tied"))
    tied = tied if crowded is None else cut(tied)
    segments = "h long, k long, p int, lead int, words binary"
    around = docs.join(tied, "k").mapInArrow(_segment_task(length, False), segments)
    runs = around.repartition("h").sortWithinPartitions("h").mapInArrow(_repeat_task(length), "k long, s int, e int")
    if crowded is not None:
        runs = runs.unionByName(hot_repeats(cut(docs.join(tied.where(crowded), "k").mapInArrow(_segment_task(length, True), segments)), length))
    own = [free_name(df, x) for x in ("lg_k", "lg_s", "lg_e")]
    lists = runs.groupBy("k").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e")).toDF(*own)
    joined = keyed.join(lists, F.col(key).cast("long") == F.col(own[0]), "left").drop(own[0])

    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(gone, T.IntegerType())])

    def clean(batches):
        for batch in batches:
            column = batch.column(at)
            starts, ends = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            change = [i for i, s in enumerate(starts) if s]
            texts, counts = column, np.zeros(batch.num_rows, dtype=np.int32)
            if change:
                part = column.take(pa.array(change))
                new: list[bytes] = []
                for a, b, data, offset in text_slices(part):
                    got, n = cut_words(data, offset, [starts[i] for i in change[a:b]], [ends[i] for i in change[a:b]])
                    new.extend(got)
                    counts[change[a:b]] = n
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[change] = True
                texts = pc.replace_with_mask(column, pa.array(mask), pa.array(new, pa.binary()).cast(column.type))
            columns = list(batch.columns[:-2])
            columns[at] = texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*batch.schema.names[:-2], gone])

    out = joined.mapInArrow(clean, schema)
    return out.unionByName(df.where(F.col(key).isNull()).withColumn(gone, F.lit(0)))


ORACLE = """
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+[ \\t\\n\\v\\f\\r]*') AS spaced, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS w, regexp_extract(text, '^[ \\t\\n\\v\\f\\r]*') AS lead FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS p FROM words)),
firsts AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(p) OVER o AS p0 FROM windows WINDOW o AS (PARTITION BY h ORDER BY doc_id, p)),
flagged AS (SELECT doc_id, p FROM firsts WHERE d0 <> doc_id OR p - p0 >= 50),
gone AS (SELECT DISTINCT doc_id, q FROM flagged, range(0, 50) x(o), LATERAL (SELECT p + o AS q) y),
each_word AS (SELECT doc_id, unnest(spaced) AS s, generate_subscripts(spaced, 1) AS q FROM words),
cut AS (SELECT e.doc_id, coalesce(string_agg(s, '' ORDER BY e.q) FILTER (WHERE g.q IS NULL), '') AS text, count(g.q) AS n FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.q = e.q GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(c.n, 0) = 0 THEN d.text ELSE w.lead || c.text END AS text, d.lang, d.source, d.n_chars, CAST(coalesce(c.n, 0) AS INTEGER) AS n_repeated
FROM documents d JOIN words w USING (doc_id) LEFT JOIN cut c USING (doc_id)
"""
