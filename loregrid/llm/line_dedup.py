"""Corpus-wide removal of repeated lines.

Two Bloom filters per shard of the hash space (seen once, seen twice) are filled from 8-byte line hashes. Lines that
the second filter lets through are suspected repeats; only their text is shuffled, to be confirmed exactly and to
choose the first occurrence. Everything else stays where it was read, until the texts meet the list of lines to drop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.llm.common import BROADCAST_LIMIT, cut, free_name

PROBES, BITS_PER_LINE, LINES_PER_SHARD = 4, 16, 1 << 19


def _slots(h: np.ndarray, m: int) -> np.ndarray:
    """Bit positions of each hash, one row per probe."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(k) * high) & np.uint64(m - 1) for k in range(PROBES)]).astype(np.int64)


class Bloom:
    def __init__(self, m: int) -> None:
        self.m, self.bits = m, np.zeros(m, dtype=bool)

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.bits[_slots(h, self.m)].all(axis=0)

    def add(self, h: np.ndarray) -> None:
        self.bits[_slots(h, self.m)] = True

    def longs(self) -> np.ndarray:
        return np.packbits(self.bits, bitorder="little").view(np.int64)


def filter_bits(n: int) -> int:
    """Bits of a filter for n lines: a power of two, 64 at least."""
    return 1 << max(6, int(np.ceil(np.log2(max(1, n) * BITS_PER_LINE))))


def two_filters(h: np.ndarray, often: np.ndarray, step: int = 1 << 14) -> Bloom:
    """The filter of hashes seen twice. often: whether the sender already saw the hash more than once."""
    once, twice = Bloom(filter_bits(len(h))), Bloom(filter_bits(len(h)))
    for i in range(0, len(h), step):
        part, again = h[i : i + step], often[i : i + step]
        values, first, counts = np.unique(part, return_index=True, return_counts=True)
        del first
        twice.add(np.concatenate([values[(counts > 1) | once.has(values)], part[again]]))
        once.add(values)
    return twice


def _task_hashes(batches):
    """Each batch's distinct hashes, and whether a hash was in it more than once: hot lines leave a task once a batch."""
    for batch in batches:
        h, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(counts > 1)], names=["h", "often"])


def _build(table: pa.Table) -> pa.Table:
    h = table.column("h").to_numpy()
    twice = two_filters(h, table.column("often").to_numpy())
    shard = table.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int32()), "m": pa.array([twice.m], pa.int64()), "bits": pa.array([twice.longs()], pa.list_(pa.int64()))})


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    at = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("p", "line"))
    return at.where(F.col("line").rlike(r"\S"))


def _probe(h: Column, m: Column, bits: Column) -> Column:
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    found = F.lit(True)
    for k in range(PROBES):
        at = (low + F.lit(k) * high).bitwiseAND(m - 1)
        word = F.get(bits, F.shiftright(at, 6).cast("int"))
        found = found & F.expr("true").eqNullSafe(F.call_function("getbit", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return found


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", drop_empty: bool = True) -> DataFrame:
    """df with each non-blank line kept only at its first occurrence, by (key, line number), in the whole table.

    Lines are compared exactly, as they stand between line feeds. Blank lines stay and are never compared. Columns
    n_lines and n_dropped are added (with underscores in front where df has such names). A document that loses all its
    non-blank lines is dropped with drop_empty, else its text holds what blank lines remain. Defined cases: a null or
    blank text is kept as it is (n_lines 0 for null); a row with a null key takes no part and is kept as it is;
    rows with the same key are one place, so equal rows all keep the same lines, and where their texts differ each loses
    only lines that are repeats themselves (unless two lines at one place have one 64-bit hash: then both stay); an empty
    table gives an empty table; other columns pass through, whatever their names.
    """
    n = _lines(df, key, text).count()
    shards = max(1, -(-n // LINES_PER_SHARD))
    shard = F.pmod(F.hash("h"), F.lit(shards)).alias("shard")
    sent = _lines(df, key, text).select(F.xxhash64("line").alias("h")).mapInArrow(_task_hashes, "h long, often boolean")
    filters = cut(sent.select(shard, "h", "often").groupBy("shard").applyInArrow(_build, "shard int, m long, bits array<long>"))
    size = filters.agg(F.coalesce(F.sum(F.size("bits") * 8), F.lit(0))).first()[0]
    hashed = _lines(df, key, text).select("k", "p", "line", F.xxhash64("line").alias("h")).select("k", "p", "line", "h", shard)
    seen = _probe(F.col("h"), F.col("m"), F.col("bits"))
    if size <= BROADCAST_LIMIT:
        suspects = hashed.join(F.broadcast(filters), "shard").where(seen).select("k", "p", "line", "h")
    else:  # filters stay where they are: only places and hashes go to them, and the texts meet their suspected places
        places = hashed.select("k", "p", "h", "shard").join(filters, "shard").where(seen).groupBy("k").agg(F.collect_set("p").alias("places"))
        texts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
        picked = F.transform(F.array(F.split("t", "\n", -1)), lambda w: F.transform("places", lambda p: F.struct(p.alias("p"), F.get(w, p).alias("line"))))[0]
        # of rows with one key, a text may have no such line, or a blank one
        suspects = texts.join(places, "k").select("k", F.inline(picked)).where(F.col("line").rlike(r"\S")).select("k", "p", "line", F.xxhash64("line").alias("h"))
    # The text itself is the grouping key: a hash collision or a false positive ends as a group of its own.
    first = suspects.groupBy("line").agg(F.min(F.struct("k", "p", "h")).alias("f"))
    marks = suspects.select("k", "p", "h", F.lit(True).alias("s")).unionByName(first.select("f.k", "f.p", "f.h", F.lit(False).alias("s")))
    # The hash tells lines of rows with one key apart.
    at = F.struct("p", "h")
    lists = marks.groupBy("k").agg(F.collect_set(F.when(F.col("s"), at)).alias("s"), F.collect_set(F.when(~F.col("s"), at)).alias("f"))
    drops = lists.select("k", F.array_except("s", "f").alias("drop")).where(F.size("drop") > 0)

    d, left, total, lost = (free_name(df, x) for x in ("lg_drop", "lg_left", "n_lines", "n_dropped"))
    at = free_name(df, "lg_k")
    joined = df.join(drops.select(F.col("k").alias(at), F.col("drop").alias(d)), F.col(key) == F.col(at), "left").drop(at)
    parts = F.split(F.col(text), "\n", -1)
    # numbers of lines are taken away as a set, in one go, after those of another row with this key are left out
    gone = lambda w: F.transform(F.filter(d, lambda x: F.xxhash64(F.get(w, x["p"])) == x["h"]), lambda x: x["p"])
    kept = F.transform(F.array(parts), lambda w: F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), gone(w)), lambda i: F.get(w, i)))[0]
    out = joined.withColumn(total, F.when(F.col(text).isNull(), 0).otherwise(F.size(parts))).withColumn(left, F.when(F.col(d).isNotNull() & F.col(text).isNotNull(), kept))
    out = out.withColumn(lost, F.when(F.col(left).isNull(), 0).otherwise(F.col(total) - F.size(left)))
    out = out.withColumn(text, F.when(F.col(left).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    if drop_empty:
        out = out.where((F.col(lost) == 0) | F.col(text).rlike(r"\S"))
    return out.select(*df.columns, total, lost)


ORACLE = r"""
WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS line FROM {docs}),
ranked AS (SELECT doc_id, p, line, regexp_matches(line, '\S') AS solid, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS r FROM lines),
cut AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT solid OR r = 1), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE solid AND r > 1) AS n_dropped FROM ranked GROUP BY doc_id)
SELECT d.doc_id, c.text, d.lang, d.source, {n_chars} AS n_chars, CAST(c.n_lines AS INTEGER) AS n_lines, CAST(c.n_dropped AS INTEGER) AS n_dropped
FROM {docs} d JOIN cut c USING (doc_id) WHERE c.n_dropped = 0 OR regexp_matches(c.text, '\S')
"""
