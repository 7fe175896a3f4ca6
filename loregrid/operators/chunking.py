"""Markdown documents to chunks, and texts to batches of a model's size.

Cutting and merging go from left to right with a state, so they are Python over Arrow batches; everything else about a
chunk (module, type, tags, references, ids) is Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.operators.graph import cut, numbered, once

BATCH_TEXTS, BATCH_TOKENS, BLOCK_ROWS = 16, 7000, 1 << 16
#: A worker holds the chunks of so many characters of documents at a time.
SLICE = 1 << 20
CHUNK = "section string, heading_chain string, text string, chunk_index int, total_chunks int"


def heading_parts(body: str, level: int) -> list[tuple[str, str]]:
    """(title, content) of the parts of a text that begin with headings of a level; what stands before has the title ''."""
    starts = [m.span() for m in re.finditer(rf"^{'#' * level}\s+.+$", body, re.M)]
    edges = [*(a for a, _ in starts), len(body)]
    found = [("", body[: edges[0]].strip())]
    for (a, b), end in zip(starts, edges[1:]):
        head = body[a:b]
        found.append((head.lstrip("#").strip(), f"{head}\n\n{body[b:end].strip()}".strip()))
    return [(t, c) for t, c in found if c]


def pack(pieces: list[str], limit: int, sep: str, overlap: int = 0) -> list[str]:
    """Pieces joined up to `limit` characters each. The next group begins with the last whole pieces of the one before, if they fit in `overlap`."""
    groups, held, size = [], [], 0
    for piece in pieces:
        width = len(piece) + len(sep)
        if held and size + width > limit:
            groups.append(held)
            room, keep = overlap, len(held)
            while keep and room >= len(held[keep - 1]) + len(sep):
                keep -= 1
                room -= len(held[keep]) + len(sep)
            held, size = held[keep:], overlap - room
        held = [*held, piece]
        size += width
    return [sep.join(g) for g in ([*groups, held] if held else groups)]


def bounded(body: str, limit: int = X.MAX_CHUNK, overlap: int = X.OVERLAP) -> Iterator[str]:
    """Pieces of at most `limit` characters: by paragraphs, then by lines, then anywhere."""
    if len(body) <= limit:
        yield body
        return
    for part in pack(body.split("\n\n"), limit, "\n\n", overlap):
        for line in [part] if len(part) <= limit else pack(part.split("\n"), limit, "\n"):
            yield from (line[i : i + limit] for i in range(0, max(len(line), 1), limit))


def _chain(*titles: str) -> str:
    return " > ".join(t for t in titles if t)


def _thin(body: str) -> bool:
    solid = (x for x in body.split("\n") if x.strip() and not x.strip().startswith(("#", "---", "> ")))
    return len("".join(solid).strip()) < X.LEAST_TEXT


def _translations(title: str, content: str) -> bool:
    return bool(re.search("多语言|i18n|国际化", title, re.I)) or any(re.search(X.TRANSLATION_TABLE, x) for x in content.split("\n")[:10])


def chunks_of(body: str) -> list[tuple[str, str, str]]:
    """(section, heading chain, text) of a document's chunks, in order.

    Sections by second-level headings, long ones by third-level headings, what is still long by paragraphs. A short or
    thin chunk joins the one behind it, the last one the one before it.
    """
    top = next((x.strip() for x in body.split("\n") if x.strip().startswith("# ")), "").lstrip("# ").strip()
    raw: list[tuple[str, str, str]] = []
    for title, content in heading_parts(body, 2):
        if _translations(title, content):
            continue
        subs = heading_parts(content, 3) if len(content) > X.MAX_CHUNK else []
        if len(subs) > 1:
            for sub, part in subs:
                raw.extend((_chain(title, sub), _chain(top, title, sub), p) for p in bounded(part))
        else:
            raw.extend((title, _chain(top, title), p) for p in bounded(content))
    out: list[tuple[str, str, str]] = []
    carried = None
    for section, chain, part in raw:
        if not part.strip():
            continue
        short = _thin(part) and carried is None
        if carried:
            section, chain, part = section or carried[0], chain or carried[1], f"{carried[2]}\n\n{part}"
            carried = None
        if short or len(part) < X.MIN_CHUNK:
            carried = section, chain, part
        else:
            out.append((section, chain, part))
    if carried and out:
        section, chain, part = out.pop()
        carried = section, chain, f"{part}\n\n{carried[2]}"
    return [*out, carried] if carried else out


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, whose texts in a column have up to `most` bytes together; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def chunk_documents(docs: DataFrame, embed=None, now=None) -> DataFrame:
    """Chunks (T1) of documents (source: relative path, text, and optionally mtime).

    doc_id is the source, so files of one name in different folders stay apart; heading_chain is kept. With embed
    (a function of a Column of texts that gives a Column of vectors) there is an embedding.
    """
    mtime = F.col("mtime").cast("timestamp") if "mtime" in docs.columns else F.lit(None).cast("timestamp")
    body = F.col("text")
    plain = docs.select("source", once(X.normalize_newlines(body)).alias("text"), mtime.alias("doc_mtime"))
    base = plain.select("source", "text", "doc_mtime", X.doc_version(body).alias("doc_version"), X.cross_refs(body).alias("cross_refs"))
    carried = ["source", "doc_mtime", "doc_version", "cross_refs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = [pa.string()] * 3
        for batch in batches:
            for part in sliced(batch, "text"):
                rows = []
                for i, body in enumerate(part.column("text").to_pylist()):
                    parts = chunks_of(body) if body else []
                    rows.extend((i, *p, k, len(parts)) for k, p in enumerate(parts))
                at, *made = zip(*rows) if rows else [()] * 6
                kept = part.select(carried).take(pa.array(at, pa.int64()))
                columns = [pa.array(x, kind) for x, kind in zip(made, (*text, pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*carried, *(c.split()[0] for c in CHUNK.split(", "))])

    cut = base.mapInArrow(run, f"source string, doc_mtime timestamp, doc_version string, cross_refs array<string>, {CHUNK}")
    p = F.col("source")
    vector = embed(F.col("text")) if embed else F.lit(None).cast("array<float>")
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return cut.select(
        X.chunk_id(p, F.col("chunk_index")).alias("id"), "text", vector.alias("embedding"), X.module_name(p).alias("module"), X.doc_type(p).alias("doc_type"), "source", "section", "heading_chain", "cross_refs",
        X.tags(p).alias("tags"), p.alias("doc_id"), "chunk_index", "total_chunks", "doc_version", "doc_mtime", stamp.alias("indexed_at"),
    )


def batch_numbers(tokens: list[int], texts: int = BATCH_TEXTS, most: int = BATCH_TOKENS) -> list[int]:
    """The batch of each text: a batch is full at `texts` of them, or when the next one's tokens would not fit."""
    out, batch, held, used = [], 0, 0, 0
    for t in tokens:
        if held and (held >= texts or used + t > most):
            batch, held, used = batch + 1, 0, 0
        held, used = held + 1, used + t
        out.append(batch)
    return out


def next_starts(tokens: np.ndarray, texts: int, most: int) -> np.ndarray:
    """For a batch that begins at each place, where the next one begins: a batch takes one text at least."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    n = len(tokens)
    return np.minimum(np.maximum(np.searchsorted(upto, upto[:-1] + most, side="right") - 1, np.arange(n) + 1), np.arange(n) + texts)


def _walk(tokens: np.ndarray, begin: int, end: int, texts: int, most: int) -> list[int]:
    """Starts of the batches from place begin up to end, and of the one behind them."""
    step = next_starts(tokens, texts, most)
    out = [begin]
    while out[-1] < end:
        out.append(int(step[out[-1]]))
    return out


def token_batches(df: DataFrame, group: str, order: str, text: str = "text", texts: int = BATCH_TEXTS, most: int = BATCH_TOKENS, block: int = BLOCK_ROWS) -> DataFrame:
    """(group, order, tokens, batch): batches of a model's size within each group, in order.

    Where batches begin depends on all that is before, but a batch has at most `texts` texts: so each block of rows is
    gone through once for every place at which its first batch may begin, the blocks' results are chained by group,
    and then each block is numbered. No task holds more than a block, or a few numbers for each block of a group.
    """
    tokens = F.coalesce(X.estimated_tokens(X.truncated(F.col(text), most)), F.lit(0))
    rows = numbered(df.select(group, order, tokens.alias("tokens")), [group, order], "lg_n")
    least = rows.groupBy(F.col(group).alias("lg_g")).agg(F.min("lg_n").alias("lg_first"))
    rows = rows.join(least, F.col(group).eqNullSafe(F.col("lg_g"))).withColumn("lg_at", F.col("lg_n") - F.col("lg_first")).drop("lg_n", "lg_g")
    rows = cut(rows)
    placed_rows = rows.select(F.col("lg_first").alias("g"), F.floor(F.col("lg_at") / block).alias("block"), F.col("lg_at").alias("i"), "tokens")
    # a block sees the texts behind it that its last batch may take
    ahead = placed_rows.where((F.col("block") > 0) & (F.col("i") % block < texts)).withColumn("block", F.col("block") - 1)
    seen = placed_rows.unionByName(ahead)

    def summed(table: pa.Table) -> pa.Table:
        g, b = table.column("g")[0].as_py(), table.column("block")[0].as_py()
        place = np.argsort(table.column("i").to_numpy())
        t, n = table.column("tokens").to_numpy()[place].astype(np.int64), len(place)
        end = min(block, n)
        out = []
        for e in range(min(texts, end)) if b else (0,):
            starts = _walk(t, e, end, texts, most)
            out.append((g, b, e, starts[-1] - block, len(starts) - 1))
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out)], names=["g", "block", "entry", "leave", "batches"])

    def chained(table: pa.Table) -> pa.Table:
        """The place in each block at which its first batch begins, and that batch's number."""
        g = table.column("g")[0].as_py()
        ways = {(b, e): (x, n) for b, e, x, n in zip(*(table.column(c).to_pylist() for c in ("block", "entry", "leave", "batches")))}
        b, entry, batch, out = 0, 0, 0, []
        while (b, 0) in ways:
            out.append((g, b, entry, batch))
            entry, n = ways.get((b, entry), (entry, 0))  # a last block may lie within a batch as a whole
            b, batch = b + 1, batch + n
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out)], names=["g", "block", "entry", "batch"])

    def placed(table: pa.Table) -> pa.Table:
        g, b = table.column("g")[0].as_py(), table.column("block")[0].as_py()
        place = np.argsort(table.column("i").to_numpy())
        t, i = table.column("tokens").to_numpy()[place].astype(np.int64), table.column("i").to_numpy()[place]
        end, entry, first = min(block, len(t)), table.column("entry")[0].as_py(), table.column("batch")[0].as_py()
        starts = np.array(_walk(t, entry, end, texts, most)[:-1])
        number = first - 1 + np.searchsorted(starts, np.arange(end), side="right")  # texts before the entry belong to the batch before
        return pa.table({"g": pa.array(np.full(end, g)), "i": pa.array(i[:end]), "lg_batch": pa.array(number.astype(np.int32))})

    ways = seen.groupBy("g", "block").applyInArrow(summed, "g long, block long, entry long, leave long, batches long")
    entries = ways.groupBy("g").applyInArrow(chained, "g long, block long, entry long, batch long")
    numbers = seen.join(entries, ["g", "block"]).groupBy("g", "block").applyInArrow(placed, "g long, i long, lg_batch int")
    out = rows.join(numbers.toDF("lg_g", "lg_i", "lg_batch"), (F.col("lg_first") == F.col("lg_g")) & (F.col("lg_at") == F.col("lg_i")))
    return out.select(group, order, "tokens", F.col("lg_batch").alias("batch"))
