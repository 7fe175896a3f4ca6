"""Sampled SentencePiece segmentation: forward filtering and backward sampling over the piece lattice, and decoding.

No piece crosses the start of a space-led run, so the lattice of a text falls apart into those of its runs. The forward
sums are computed once per distinct run of a slice of texts; all runs of all texts are then sampled together, each with
random numbers that depend on the seed, the row's key and the run's place alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregrid.llm.common import _BYTES, free_name, mix, text_slices, whole_key

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A longer run without a space is cut, before its lattice is built, where no piece crosses: there the lattice falls apart anyway.
LONG_RUN = 512
SLICE = 1 << 20
#: The lattices of so many distinct runs are kept from slice to slice of a task.
KEPT_RUNS = 120_000
_U = np.uint64


@dataclass(frozen=True)
class Pieces:
    """A vocabulary, as bytes: the space mark is a space. score: log weight of each piece; -inf where it is never sampled."""

    text: tuple[bytes, ...]
    score: tuple[float, ...]
    byte: tuple[int, ...]  # id of each of the 256 byte pieces
    unknown: float  # log weight of a byte piece


def load(model_file: str = MODEL) -> Pieces:
    """Pieces of a SentencePiece model with byte fallback.

    Where scores are merge ranks (BPE: 0, -1, -2, ...), a rank's weight is taken by Zipf's law, log(1 / (rank + 3)).
    Control, unknown and unused pieces, and runs of several spaces (which have no rank), are never sampled.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    text, score, byte = [], [], [0] * 256
    raw = [m.get_score(i) for i in range(m.get_piece_size())]
    ranked = min(raw) < -1000
    for i, s in enumerate(raw):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
            score.append(-np.inf)
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or s <= -1e8 or "▁" in piece[1:]:
            text.append(piece.replace("▁", " ").encode() if not (m.is_control(i) or m.is_unknown(i)) else b"")
            score.append(-np.inf)
        else:
            text.append(piece.replace("▁", " ").encode())
            score.append(float(-np.log(3 - s)) if ranked else float(s))
    if not any(byte):
        raise ValueError("the model has no byte pieces, so decoding could lose text")
    low = min(s for s in score if np.isfinite(s))
    return Pieces(tuple(text), tuple(score), tuple(byte), low - 2)


@lru_cache(maxsize=2)
def _trie(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Next node by (node, byte), and the piece that ends at a node (-1: none). Node 0 is the root; -1 leads nowhere."""
    nodes: list[dict[int, int]] = [{}]
    end = [-1]
    for i, (t, s) in enumerate(zip(pieces.text, pieces.score)):
        if np.isfinite(s) and t:
            at = 0
            for c in t:
                nxt = nodes[at].get(c)
                if nxt is None:
                    nxt = nodes[at][c] = len(nodes)
                    nodes.append({})
                    end.append(-1)
                at = nxt
            end[at] = i
    table = np.full((len(nodes), 256), -1, dtype=np.int32)
    for i, d in enumerate(nodes):
        if d:
            table[i, list(d)] = list(d.values())
    return table, np.array(end, dtype=np.int32)


def crossed(data: np.ndarray, pieces: Pieces, step: int = 1 << 18) -> np.ndarray:
    """Whether a piece, or a character, that begins before a byte goes on through it."""
    table, ends = _trie(pieces)
    n = len(data)
    change = np.zeros(n + 1, dtype=np.int32)
    for s in range(0, n, step):
        at = np.arange(s, min(n, s + step))
        node, depth = np.zeros(len(at), dtype=np.int32), 0
        while len(at):
            node = table[node, data[at + depth]]
            live = (node >= 0) & (at + depth + 1 < n)
            depth += 1
            hit = at[(node >= 0) & (ends[node] >= 0)]
            if depth > 1:
                change[hit + 1] += 1
                change[hit + depth] -= 1
            at, node = at[live], node[live]
    return (np.cumsum(change[:n]) > 0) | ((data & 0xC0) == 0x80)


def runs_of(data: np.ndarray, offset: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of a slice (a space begins a run, a line feed is one, parts of a long run are some), and each run's text."""
    n = len(data)
    begin = np.zeros(n + 1, dtype=bool)
    begin[:-1] |= (data == 32) | (data == 10)
    begin[1:] |= data == 10
    begin[offset] = True
    start = np.flatnonzero(begin[:-1])
    size = np.diff(np.append(start, n))
    extra = []
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        a, e = int(start[i]), int(start[i] + size[i])
        free = a + np.flatnonzero(~crossed(data[a:e], pieces))
        while e - a > LONG_RUN:
            x = int(np.searchsorted(free, a + LONG_RUN, side="right"))
            if x and free[x - 1] > a:
                a = int(free[x - 1])
            elif x < len(free):
                a = int(free[x])
            else:
                break
            extra.append(a)
    if extra:
        start = np.unique(np.concatenate([start, extra]))
    return start, np.searchsorted(offset, start, side="right") - 1


def _hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = _BYTES.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[:n], out=sums[1:])
    end = np.append(start[1:], n)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of several stretches one after the other, and where each begins (with one more entry)."""
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(start - first[:-1], size)
    return data[at], first


@dataclass
class Lattice:
    """Edges into each node (byte position within the distinct runs), with cumulative chances within the node."""

    first: np.ndarray  # of each node, its first edge
    source: np.ndarray
    piece: np.ndarray
    chance: np.ndarray
    origin: np.ndarray  # of each run, its first node
    end: np.ndarray  # of each run, its last node


def lattice(data: np.ndarray, first: np.ndarray, pieces: Pieces, alpha: float) -> Lattice:
    """Forward filtering: every node's log sum over the paths to it, and the chances of the edges that enter it."""
    table, ends = _trie(pieces)
    n, runs = len(data), len(first) - 1
    # node of a position p of run r: p + r, so that every run has a node more than bytes
    run = np.repeat(np.arange(runs, dtype=np.int32), np.diff(first))
    first = first.astype(np.int32)
    at, node = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    left = first[run + 1] - at
    begin, size_of, which = [], [], []
    depth = 0
    while len(at):
        node = table[node, data[at + depth]]
        live = np.flatnonzero(node >= 0)
        at, node = at[live], node[live]
        depth += 1
        end = ends[node]
        hit = np.flatnonzero(end >= 0)
        begin.append(at[hit])
        size_of.append(np.full(len(hit), depth, dtype=np.int32))
        which.append(end[hit])
        more = np.flatnonzero(left[at] > depth)
        at, node = at[more], node[more]
    b, size, w = np.concatenate(begin), np.concatenate(size_of), np.concatenate(which)
    del begin, size_of, which, left
    # byte pieces, where a character has no piece of its own
    lead = (data & 0xC0) != 0x80
    lead[first[:-1]] = True
    head = np.flatnonzero(lead)
    wide = np.diff(np.append(head, n))
    spans = np.zeros(n, dtype=np.int32)
    spans[head] = wide
    known = np.zeros(n, dtype=bool)
    known[b[size == spans[b]]] = True
    lost = np.flatnonzero(np.repeat(~known[head], wide)).astype(np.int32)
    b, size = np.concatenate([b, lost]), np.concatenate([size, np.ones(len(lost), dtype=np.int32)])
    w = np.concatenate([w, np.array(pieces.byte, dtype=np.int32)[data[lost]]])
    score = np.array(pieces.score, dtype=np.float64) * alpha
    score[list(pieces.byte)] = pieces.unknown * alpha
    # edges in order of the position in the run at which they end, then of the run
    r = run[b]
    step = b + size - first[r]
    order = np.argsort(step.astype(np.int64) * (n + 1) + b + size, kind="stable").astype(np.int32)
    b, size, w, r, step = (x[order] for x in (b, size, w, r, step))
    source = b + r
    target = source + size
    del b, size, r, order
    edge = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(step))
    del step
    total = np.full(n + runs, -np.inf)
    total[first[:-1] + np.arange(runs)] = 0
    chance = np.empty(len(source), dtype=np.float32)
    for i in range(len(edge) - 1):
        x = slice(edge[i], edge[i + 1])
        t = target[x]
        v = total[source[x]] + score[w[x]]
        new = np.flatnonzero(np.diff(t, prepend=-1))
        most = np.maximum.reduceat(v, new)
        width = np.diff(np.append(new, len(t)))
        with np.errstate(invalid="ignore"):
            p = np.exp(v - np.repeat(most, width))
        p[~np.isfinite(p)] = 0
        whole = np.maximum(np.add.reduceat(p, new), 1e-300)
        total[t[new]] = np.where(np.isfinite(most), most + np.log(whole), -np.inf)
        c = np.cumsum(p / np.repeat(whole, width))
        chance[x] = c - np.repeat(np.concatenate([[0], c[new[1:] - 1]]), width)
    order = np.argsort(target, kind="stable").astype(np.int32)
    source, w, chance = source[order], w[order], chance[order]
    enter = np.zeros(n + runs + 1, dtype=np.int32)
    np.cumsum(np.bincount(target, minlength=n + runs), out=enter[1:])
    chance[enter[1:][np.diff(enter) > 0] - 1] = 2.0  # the last edge of a node takes what rounding leaves
    nodes = np.arange(runs, dtype=np.int32)
    return Lattice(enter, source, w, chance, first[:-1] + nodes, first[1:] + nodes)


def joined(a: Lattice, b: Lattice) -> Lattice:
    """Both lattices in one; b's runs come after a's."""
    nodes, edges = np.int32(len(a.first) - 1), np.int32(len(a.source))
    return Lattice(np.concatenate([a.first[:-1], b.first + edges]), np.concatenate([a.source, b.source + nodes]), np.concatenate([a.piece, b.piece]),
                   np.concatenate([a.chance, b.chance]), np.concatenate([a.origin, b.origin + nodes]), np.concatenate([a.end, b.end + nodes]))


def _uniform(state: np.ndarray) -> np.ndarray:
    return (mix(state) >> _U(11)).astype(np.float64) * 2.0**-53


def sample(lat: Lattice, which: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of many runs at once: (pieces of all runs, one run after the other; pieces of each run)."""
    n = len(which)
    count = np.zeros(n, dtype=np.int64)
    who, node, origin = np.arange(n), lat.end[which], lat.origin[which]
    steps = []
    k = 0
    while len(who):
        u = _uniform(state[who] + _U(k * 0xD1342543DE82EF95 & (2**64 - 1)))
        e = lat.first[node].copy()
        behind = np.flatnonzero(lat.chance[e] <= u)
        while len(behind):
            e[behind] += 1
            behind = behind[lat.chance[e[behind]] <= u[behind]]
        steps.append((who, lat.piece[e]))
        count[who] += 1
        node = lat.source[e]
        more = node > origin
        who, node, origin = who[more], node[more], origin[more]
        k += 1
    last = np.cumsum(count) - 1
    out = np.empty(int(count.sum()), dtype=np.int32)
    for k, (who, piece) in enumerate(steps):
        out[last[who] - k] = piece
    return out, count


def encode_slice(data: np.ndarray, offset: np.ndarray, keys: np.ndarray, pieces: Pieces, alpha: float, seed: int, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text); kept holds lattices for later slices. A text that isn't empty gets a space in front first, as the model expects."""
    n = len(offset) - 1
    some = np.diff(offset) > 0
    size = np.diff(offset) + some
    new = np.concatenate([[0], np.cumsum(size)])
    body = np.full(new[-1], 32, dtype=np.uint8)
    body[np.arange(len(data)) + np.repeat(new[:-1] + some - offset[:-1], np.diff(offset))] = data
    data, offset = body, new
    if not len(data):
        return np.zeros(0, dtype=np.int32), np.zeros(n, dtype=np.int64)
    start, doc = runs_of(data, offset, pieces)
    length = np.diff(np.append(start, len(data)))
    values, one, inverse = np.unique(_hashes(data, start), return_index=True, return_inverse=True)
    kept = {} if kept is None else kept
    known = kept.get("hash", np.zeros(0, dtype=np.uint64))
    which, new = np.zeros(len(values), dtype=np.int64), np.ones(len(values), dtype=bool)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        new = known[at] != values
        which[~new] = kept["run"][at[~new]]
    lat = kept.get("lattice")
    if new.any():
        text, first = _gather(data, start[one[new]], length[one[new]])
        which[new] = len(known) + np.arange(int(new.sum()))
        fresh = lattice(text, first, pieces, alpha)
        lat = fresh if lat is None else joined(lat, fresh)
        if len(lat.end) <= KEPT_RUNS:
            h, run = np.concatenate([known, values[new]]), np.concatenate([kept.get("run", np.zeros(0, dtype=np.int64)), which[new]])
            order = np.argsort(h)
            kept.update(hash=h[order], run=run[order], lattice=lat)
    base = mix(keys.astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15) ^ _U(seed & (2**64 - 1)))
    state = mix(base[doc] + (start - offset[doc]).astype(np.uint64))
    ids, count = sample(lat, which[inverse], state)
    return ids, np.bincount(doc, weights=count, minlength=n).astype(np.int64)


def decode_ids(ids: np.ndarray, count: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, size of each): the pieces' bytes, without the space in front."""
    size = np.array([len(t) for t in pieces.text])
    blob = np.frombuffer(b"".join(pieces.text), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    data, _ = _gather(blob, at[ids], size[ids])
    doc = np.repeat(np.arange(len(count)), count)
    whole = np.bincount(doc, weights=size[ids], minlength=len(count)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(whole)])[:-1]
    keep = np.ones(len(data), dtype=bool)
    keep[first[whole > 0]] = False
    return data[keep], whole - (whole > 0)


def sentencepiece_encode(df: DataFrame, key: str = "doc_id", text: str = "text", model_file: str = MODEL, alpha: float = 1.0, seed: int = 42, keep_text: bool = False) -> DataFrame:
    """df with sampled piece ids instead of its text (beside it with keep_text).

    Keys are whole numbers, else a TypeError is raised. Adds pieces (array of ids), n_pieces and lossless (whether decoding gave back the text, byte for byte), with
    underscores in front where df has such names. A segmentation is drawn with chance proportional to the product of its
    pieces' weights to the power alpha; it depends on seed, key and text only. Defined cases: a null text has null
    pieces, n_pieces 0 and null lossless; an empty text has no pieces; a null key counts as key 0; rows with one key and text
    get one segmentation; bytes of characters without a piece become byte pieces; texts of any length are encoded
    whole; an empty table gives an empty table; other columns pass through.
    """
    pieces = df.sparkSession.sparkContext.broadcast(load(model_file))
    at = df.columns.index(text)
    names = [free_name(df, x) for x in ("pieces", "n_pieces", "lossless")]
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    hidden = free_name(df, "lg_key")
    schema = T.StructType([*fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])

    def run(batches):
        p, kept = pieces.value, {}
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            nulls = batch.column(at).is_null()
            for a, b, data, offset in text_slices(batch.column(at), SLICE):
                ids, count = encode_slice(data, offset, keys[a:b], p, alpha, seed, kept)
                back, size = decode_ids(ids, count, p)
                same = size == np.diff(offset)
                if same.all():
                    wrong = np.repeat(np.arange(b - a), size)[back != data]
                    same[wrong] = False
                else:
                    cut = np.concatenate([[0], np.cumsum(size)])
                    same = np.array([back[cut[i] : cut[i + 1]].tobytes() == data[offset[i] : offset[i + 1]].tobytes() for i in range(b - a)])
                none = nulls.slice(a, b - a).to_numpy(zero_copy_only=False)
                where = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(where), pa.array(ids), mask=pa.array(none))
                columns = [c.slice(a, b - a) for i, c in enumerate(batch.columns[:-1]) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(count), pa.array(same, mask=none)], names=[*(f.name for f in fields), *names])

    return df.withColumn(hidden, F.coalesce(whole_key(df, key), F.lit(0))).mapInArrow(run, schema)


def sentencepiece_decode(df: DataFrame, pieces_column: str = "pieces", model_file: str = MODEL, text: str = "text") -> DataFrame:
    """df with a column of the texts that its piece ids stand for; null ids give a null text. Bytes that are no UTF-8 (of ids that were not encoded here) are replaced."""
    pieces = df.sparkSession.sparkContext.broadcast(load(model_file))
    at, name = df.columns.index(pieces_column), free_name(df, text)

    def run(batches):
        p = pieces.value
        for batch in batches:
            lists = batch.column(at)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, size = decode_ids(lists.flatten().to_numpy(zero_copy_only=False), count, p)
            cut = np.concatenate([[0], np.cumsum(size)]).tolist()
            raw = data.tobytes()
            texts = [None if null else raw[cut[i] : cut[i + 1]].decode("utf-8", "replace") for i, null in enumerate(lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
