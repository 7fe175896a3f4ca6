"""Quality classifier: document evidence with site posteriors, shrunk through two levels.

A logistic model over whole-text features gives each document's evidence. Grouped sums of it give each host, and each
path within a host, a posterior share of good documents: hosts shrink toward the corpus, paths toward their host, the
more the fewer documents they have. The strengths of shrinking are estimated from the groups (method of moments).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregrid.llm.common import Words, cut, free_name, small, text_slices

#: The classifier is fitted on at most so many labelled rows, those whose keys have the lowest hashes.
MAX_TRAINING_ROWS = 20_000
FEATURES = ("length", "upper", "symbols", "bars", "digits", "letters", "adjacent", "distinct", "word_length", "symbol_ends", "shout_words", "commonest")

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
for _c in b"*$%#&!?~^=_+<>{}@\\":
    _CLASS[_c] = 4
_CLASS[ord("|")] = 5
for _c in b" \t\n\r\v\f":
    _CLASS[_c] = 6


def features(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a slice, over its whole bytes; an empty text has zeros."""
    n = len(offset) - 1
    size = np.diff(offset).astype(float)
    kind = _CLASS[data]
    doc = np.repeat(np.arange(n), np.diff(offset))
    counts = np.bincount(doc * 8 + kind, minlength=n * 8).reshape(n, 8).astype(float)
    # capitals in two-byte Latin-1 letters: C3 80 to C3 9E
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) if len(data) else np.zeros(0, dtype=int)
    upper = counts[:, 1] + np.bincount(doc[wide], minlength=n)
    w = Words(data, offset)
    words = np.maximum(np.diff(w.first), 1).astype(float)
    per = lambda mask: np.bincount(w.doc[mask], minlength=n)
    same = np.zeros(len(w.hash), dtype=bool)
    if len(same):
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        last, first = data[w.end - 1], data[w.start]
        before = data[np.maximum(w.end - 2, w.start)]
        order = np.lexsort((w.hash, w.doc))
        h, d = w.hash[order], w.doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        run = np.diff(np.append(np.flatnonzero(new), len(h)))
        distinct = np.bincount(d[new], minlength=n)
        commonest = np.zeros(n)
        np.maximum.at(commonest, d[new], run)
        ends = per((_CLASS[last] == 4) & (_CLASS[before] == 4))
        shouts = per((_CLASS[first] == 1) & (_CLASS[data[np.minimum(w.start + 1, w.end - 1)]] == 1) & (w.end - w.start > 1))
    else:
        distinct = commonest = ends = shouts = np.zeros(n)
    some = np.maximum(size, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    out = np.stack([np.log1p(size), upper / letters, counts[:, 4] / some, np.sqrt(counts[:, 5] / words), counts[:, 3] / some, (counts[:, 1] + counts[:, 2]) / some, per(same) / words,
                    distinct / np.sqrt(words), np.minimum(size / words, 40), ends / words, shouts / words, commonest / words], axis=1)
    out[size == 0] = 0
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design((x - self.mean) / self.scale) @ self.weight, -12, 12)

    @staticmethod
    def design(z: np.ndarray) -> np.ndarray:
        z = np.clip(z, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z**2 / 8], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
    """Ridge logistic regression by Newton steps; with labels of one kind only, a constant."""
    base = (y.sum() + 1) / (len(y) + 2)
    good = x[y > 0.5]
    mean, scale = (good.mean(0), good.std(0) + 1e-3) if len(good) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = Logistic.design((x - mean) / scale) if len(x) else np.zeros((0, 1 + 2 * x.shape[1]))
    b = np.zeros(z.shape[1] if len(x) else 1 + 2 * len(FEATURES))
    b[0] = np.log(base / (1 - base))
    if len(good) and len(good) < len(y):
        penalty = np.full(len(b), ridge)
        penalty[0] = 1e-6
        balance = np.where(y > 0.5, 0.5 / base, 0.5 / (1 - base)) * 2 * min(base, 1 - base)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            g = z.T @ (balance * (y - p)) - penalty * b
            h = (z * (balance * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, g)
            b += step * min(1, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
    return Logistic(mean, scale, b, base)


def _with(df: DataFrame, text: str, name: str, kind: str, of) -> DataFrame:
    """df with a column that of(bytes, offsets) computes from each slice of texts."""
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches):
        for batch in batches:
            got = [of(data, offset) for _, _, data, offset in text_slices(batch.column(at))]
            new = np.concatenate(got) if got else np.zeros(0)
            column = pa.array(list(new), pa.list_(pa.float64())) if new.ndim == 2 else pa.array(new, pa.float64())
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> Logistic:
    """Fit on at most max_rows labelled documents, those whose keys have the lowest hashes. Of a key's several labels the lowest counts, of its several texts the one with the lowest hash; null keys and labels don't."""
    wanted = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("lg_k")).agg(F.min(F.col(label)).cast("double").alias("lg_y"))
    wanted = wanted.orderBy(F.xxhash64("lg_k"), "lg_k").limit(max_rows)
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("lg_k2"), F.col(text).alias("lg_t"))
    rows = docs.join(F.broadcast(wanted), F.col("lg_k2") == F.col("lg_k")).groupBy("lg_k", "lg_y").agg(F.min_by("lg_t", F.xxhash64("lg_t")).alias("lg_t"))
    got = _with(rows, "lg_t", "f", "array<double>", features).select("lg_k", "lg_y", "f").toPandas().sort_values("lg_k", kind="stable")
    x = np.array(got["f"].tolist()).reshape(len(got), len(FEATURES))
    return fit(x, got["lg_y"].to_numpy(dtype=float))


def strength(n: str, s: str, parent: str) -> str:
    """SQL for the moment estimate of a Beta strength: groups with n documents, s good ones, and a mean `parent`."""
    between = f"sum({n} * pow({s} / {n} - {parent}, 2)) / sum({n}) - sum({parent} * (1 - {parent})) / sum({n})"
    return f"least(1e4D, greatest(1D, coalesce(sum({n} * {parent} * (1 - {parent})) / sum({n}) / greatest(1e-6D, {between}) - 1D, 1e4D)))"


def site_posteriors(scored: DataFrame, host: str, path: str, p: str) -> DataFrame:
    """(lg_host, lg_path, lg_n, lg_s, prior strength and parent mean of the path) from grouped sums; null hosts and paths are groups too."""
    paths = scored.groupBy(F.col(host).alias("lg_host"), F.col(path).alias("lg_path")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("s"))
    paths = cut(paths)
    hosts = paths.groupBy("lg_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg((F.sum("hs") / F.sum("hn")).alias("mu"))
    h = hosts.crossJoin(F.broadcast(whole))
    k = h.agg(F.expr(strength("hn", "hs", "mu")).alias("k1"))
    h = h.crossJoin(F.broadcast(k)).withColumn("hm", F.expr("(k1 * mu + hs) / (k1 + hn)"))
    q = paths.join(h.select(F.col("lg_host").alias("h2"), "mu", "hm"), F.col("lg_host").eqNullSafe(F.col("h2"))).drop("h2")
    k2 = q.agg(F.expr(strength("n", "s", "hm")).alias("k2"))
    return q.crossJoin(F.broadcast(k2)).select("lg_host", "lg_path", "n", "s", "mu", "hm", "k2")


def quality_classifier(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality",
                       threshold: float = 0.5, site_weight: float = 1.0, max_rows: int = MAX_TRAINING_ROWS, keep_all: bool = False) -> DataFrame:
    """df's documents with a posterior chance of being good of at least threshold (all of them with keep_all).

    Adds quality_evidence (the classifier's log odds), site_quality (the path's posterior without this document's own
    share), quality_posterior and quality_keep, with underscores in front where df has such names. The evidence is
    judged over whole texts. Defined cases: a null, empty or blank text has no evidence for it and is rejected (posterior
    0); null hosts and paths are sites of their own; keys may be null or repeated (each row is judged alone, equal rows
    alike); without labels, or with labels of one kind, the evidence is a constant and nothing but blank texts is
    rejected unless the labels are all bad; an empty table gives an empty table; other columns pass through.
    """
    model = train(df, labels, key, text, label, max_rows)
    if not len(model.weight) or not np.isfinite(model.weight).all():
        raise ValueError("the quality model did not converge")
    e, site, post, keep = (free_name(df, x) for x in ("quality_evidence", "site_quality", "quality_posterior", "quality_keep"))
    scored = _with(df, text, e, "double", lambda data, offset: model.logit(features(data, offset)))
    chance = 1 / (1 + F.exp(-F.col(e)))
    blank = ~F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))
    light = _with(df.select(host, path, text), text, "lg_e", "double", lambda data, offset: model.logit(features(data, offset)))
    sites = cut(site_posteriors(light.select(host, path, (1 / (1 + F.exp(-F.col("lg_e")))).alias("lg_p")), host, path, "lg_p"))
    own = {x: free_name(scored, f"lg_site_{x}") for x in sites.columns}
    of = {x: F.col(n) for x, n in own.items()}
    out = scored.join(small(sites.withColumnsRenamed(own), 160), F.col(host).eqNullSafe(of["lg_host"]) & F.col(path).eqNullSafe(of["lg_path"]), "left")
    others = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), (of["k2"] * of["hm"] + of["s"] - chance) / (of["k2"] + of["n"] - 1)))
    whole = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), of["mu"]))
    odds = F.col(e) + site_weight * (F.log(others / (1 - others)) - F.log(whole / (1 - whole)))
    out = out.withColumn(site, others).withColumn(post, F.when(blank, 0.0).otherwise(1 / (1 + F.exp(-odds)))).withColumn(keep, ~blank & (F.col(post) >= threshold))
    out = out.select(*df.columns, e, site, post, keep)
    return out if keep_all else out.where(F.col(keep))
