"""Language identification with interpolated Kneser-Ney character models.

One model per language, all in shared sorted arrays of n-gram hashes with a column per language. Models look at words
with spaces around them, so a text's score is the sum over its words, and each distinct word of a task is scored once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregrid.llm.common import Words, free_name, mix, text_slices

ORDER = 5
#: The models are fitted on at most so many texts of each language, those whose keys have the lowest hashes.
TEXTS_PER_LANGUAGE = 400
#: Chance of an unseen character is spread over so many.
ALPHABET = 4096
#: A text is rejected beyond so many deviations above the cross-entropy usual at its length, or below this posterior.
DEVIATIONS, POSTERIOR = 6.0, 0.5
UNKNOWN = "und"
_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
CACHED_WORDS = 300_000


def _codes(words: bytes | str) -> np.ndarray:
    text = words.decode("utf-8", "replace") if isinstance(words, bytes) else words
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)


def _positions(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is predicted (the characters of words and the space after each), and the word of each."""
    solid = c != 32
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    word = np.cumsum(start) - 1
    predicted = solid.copy()
    predicted[1:] |= solid[:-1]
    at = np.flatnonzero(predicted)
    return at, word[at]


def _ngram_hashes(c: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order, the hash of the n characters that end at each position."""
    g, out = np.zeros(len(at), dtype=np.uint64), []
    for n in range(order):
        g = g * _R + c[at - n].astype(np.uint64) + _U(1)
        out.append(mix(g + _U(n)))
    return out


def _padded(words: list[str]) -> str:
    pad = " " * (ORDER - 1)
    return pad + (" " + pad).join(words) + " "


@dataclass
class Model:
    languages: list[str]
    gram: list[np.ndarray] = field(default_factory=list)  # sorted hashes by order
    value: list[np.ndarray] = field(default_factory=list)  # discounted chance, a column per language
    context: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)  # what a context leaves to the lower order
    usual: np.ndarray | None = None  # per language: mean, a and b of the variance a + b / characters

    def word_scores(self, c: np.ndarray, words: int) -> np.ndarray:
        """Per word: negative log chance in each language, and at last the number of predictions."""
        at, word = _positions(c)
        out = np.zeros((words, len(self.languages) + 1))
        for s in range(0, len(at), 1 << 17):
            a, w = at[s : s + (1 << 17)], word[s : s + (1 << 17)]
            h = _ngram_hashes(c, a, ORDER)
            before = _ngram_hashes(c, a - 1, ORDER - 1)
            p = np.full((len(a), len(self.languages)), 1 / ALPHABET, dtype=np.float32)
            for n in range(ORDER):
                if n and len(self.context[n]):
                    i = np.minimum(np.searchsorted(self.context[n], before[n - 1]), len(self.context[n]) - 1)
                    hit = np.flatnonzero(self.context[n][i] == before[n - 1])
                    p[hit] *= self.rest[n][i[hit]]
                elif not n:
                    p *= self.rest[0]
                if len(self.gram[n]):
                    i = np.minimum(np.searchsorted(self.gram[n], h[n]), len(self.gram[n]) - 1)
                    hit = np.flatnonzero(self.gram[n][i] == h[n])
                    p[hit] += self.value[n][i[hit]]
            loss = -np.log(p)
            for j in range(len(self.languages)):
                out[:, j] += np.bincount(w, weights=loss[:, j], minlength=words)
            out[:, -1] += np.bincount(w, minlength=words)
        return out

    def judge(self, total: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, cross-entropy, posterior) of texts from their summed losses."""
        n = np.maximum(characters, 1)
        cross = total / n[:, None]
        best = np.argmin(cross, axis=1)
        low = cross[np.arange(len(n)), best]
        posterior = 1 / np.exp(np.minimum(total[np.arange(len(n)), best][:, None] - total, 0)).sum(axis=1)
        mean, a, b = self.usual[best].T
        out = (low > mean + DEVIATIONS * np.sqrt(a + b / n)) | (posterior < POSTERIOR) | (characters == 0)
        return np.where(out, -1, best), np.where(characters > 0, low, np.nan), np.where(characters > 0, posterior, 0.0)


def _counts(c: np.ndarray, weight: np.ndarray):
    """By order: n-gram hashes, their counts (continuation counts below the highest order), their context hashes."""
    at, word = _positions(c)
    h = _ngram_hashes(c, at, ORDER)
    before = _ngram_hashes(c, at - 1, ORDER - 1)
    out = []
    for n in range(ORDER):
        g, first, inverse = np.unique(h[n], return_index=True, return_inverse=True)
        if n == ORDER - 1:
            k = np.bincount(inverse, weights=weight[word])
        else:  # in how many ways the n-gram is continued to the left
            _, one = np.unique(h[n + 1], return_index=True)
            k = np.bincount(inverse[one], minlength=len(g)).astype(float)
        out.append((g, k, before[n - 1][first] if n else None))
    return out


def fit(samples: dict[str, list[str]]) -> Model:
    """Kneser-Ney models of texts by language; every fifth text is held out to calibrate rejection."""
    model = Model(sorted(samples))
    per = []
    for language in model.languages:
        words = Counter(w for i, t in enumerate(samples[language]) if i % 5 or len(samples[language]) < 5 for w in t.split())
        per.append(_counts(_codes(_padded(list(words))), np.array(list(words.values()), dtype=float)) if words else None)
    size = len(model.languages)
    for n in range(ORDER):
        grams = np.unique(np.concatenate([x[n][0] for x in per if x] or [np.zeros(0, np.uint64)]))
        contexts = np.unique(np.concatenate([x[n][2] for x in per if x] or [np.zeros(0, np.uint64)])) if n else np.zeros(1, np.uint64)
        value, rest = np.zeros((len(grams), size), dtype=np.float32), np.ones((len(contexts), size), dtype=np.float32)
        for j, x in enumerate(per):
            if not x:
                continue
            g, k, ctx = x[n]
            n1, n2 = (k == 1).sum(), (k == 2).sum()
            d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            where = np.searchsorted(contexts, ctx) if n else np.zeros(len(g), dtype=np.int64)
            whole = np.bincount(where, weights=k, minlength=len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            value[np.searchsorted(grams, g), j] = np.maximum(k - d, 0) / whole[where]
            seen = kinds > 0
            rest[seen, j] = (d * kinds[seen] / whole[seen]).clip(1e-4, 1)
        model.gram.append(grams)
        model.value.append(value)
        model.context.append(contexts)
        model.rest.append(rest)
    usual = []
    for j, language in enumerate(model.languages):
        ce, size_of = [], []
        for t in samples[language][::5]:
            lines = [x for x in map(str.split, t.split("\n")) if x]
            if not lines:
                continue
            words = [w for x in lines for w in x]
            s = model.word_scores(_codes(_padded(words)), len(words))
            first = np.cumsum([0] + [len(x) for x in lines[:-1]])
            for part in (s.sum(axis=0), *np.add.reduceat(s, first, axis=0)):
                ce.append(part[j] / part[-1])
                size_of.append(part[-1])
        if len(ce) < 3:
            usual.append((3.0, 1.0, 10.0))
            continue
        ce, size_of = np.array(ce), np.array(size_of)
        mean = np.median(ce)
        square = (ce - mean) ** 2
        short = size_of < np.median(size_of)
        a = max(1e-3, float(np.mean(square[~short])) if (~short).any() else 1e-3)
        b = max(1e-2, float(np.mean(square[short] * size_of[short])) if short.any() else 1.0)
        usual.append((float(mean), a, b))
    model.usual = np.array(usual).reshape(-1, 3)
    return model


def score_slice(model: Model, data: np.ndarray, offset: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(summed losses by language, predictions) of each text. cache keeps word scores from slice to slice."""
    n, size = len(offset) - 1, len(model.languages)
    w = Words(data, offset, lower=False)
    if not len(w.hash):
        return np.zeros((n, size)), np.zeros(n)
    values, one, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    scores = np.empty((len(values), size + 1))
    known, kept = cache.get("hash", np.zeros(0, np.uint64)), cache.get("score", np.zeros((0, size + 1)))
    new = np.ones(len(values), dtype=bool)
    if len(known):
        i = np.minimum(np.searchsorted(known, values), len(known) - 1)
        new = known[i] != values
        scores[~new] = kept[i[~new]]
    if new.any():
        start, length = w.start[one[new]], w.end[one[new]] - w.start[one[new]]
        block = length + ORDER
        first = np.cumsum(block) - block
        buffer = np.full(int(block.sum()), 32, dtype=np.uint8)
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        buffer[np.repeat(first + ORDER - 1, length) + at] = data[np.repeat(start, length) + at]
        scores[new] = model.word_scores(_codes(buffer.tobytes()), int(new.sum()))
        if len(known) < CACHED_WORDS:
            h = np.concatenate([known, values[new]])
            order = np.argsort(h)
            cache["hash"], cache["score"] = h[order], np.concatenate([kept, scores[new]])[order]
    each = scores[inverse]
    total = np.stack([np.bincount(w.doc, weights=each[:, j], minlength=n) for j in range(size)], axis=1) if size else np.zeros((n, 0))
    return total, np.bincount(w.doc, weights=each[:, -1], minlength=n)


def train(df: DataFrame, key: str, text: str, label: str, per_language: int) -> Model:
    order = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k", "t")
    labelled = df.where(F.col(label).isNotNull() & F.col(text).rlike(r"\S")).select(F.col(label).alias("l"), F.col(key).alias("k"), F.col(text).alias("t"))
    # rank keys first, without texts, then fetch the few texts chosen
    chosen = labelled.select("l", "k", F.lit("").alias("t")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("l", "k").distinct()
    rows = labelled.join(F.broadcast(chosen), [labelled["l"] == chosen["l"], labelled["k"].eqNullSafe(chosen["k"])], "left_semi").select("l", "t", F.xxhash64("k").alias("h")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["h"], r["t"])):
        samples.setdefault(r["l"], []).append(r["t"])
    return fit({k: v[:per_language] for k, v in samples.items()})


def language_id(df: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """df with the language of each whole text: lang_id, lang_cross_entropy (nats a character) and lang_posterior.

    Models are fitted on labelled (df, if none is given). The language with the lowest length-normalised cross-entropy
    wins; 'und' is given where that is far above what is usual for a text of such length, or where languages are as
    likely. New columns get underscores in front where df has such names. All rows come back. Defined cases: a null,
    empty or blank text is 'und' with a null cross-entropy and posterior 0; null labels are not learned from; without
    labels everything is 'und'; ties go to the first language by name; an empty table gives an empty table; keys and
    other columns may hold anything.
    """
    names = [free_name(df, x) for x in ("lang_id", "lang_cross_entropy", "lang_posterior")]
    model = train(df if labelled is None else labelled, key, text, label, per_language)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])

    def run(batches):
        m, cache = shared.value, {}
        choices = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            best, cross, posterior = [], [], []
            for a, b, data, offset in text_slices(batch.column(at)):
                if m.languages:
                    x, y, z = m.judge(*score_slice(m, data, offset, cache))
                else:
                    x, y, z = np.full(b - a, -1), np.full(b - a, np.nan), np.zeros(b - a)
                best.append(x)
                cross.append(y)
                posterior.append(z)
            ce = np.concatenate(cross)
            columns = [pa.array(choices[np.concatenate(best)], pa.string()), pa.array(ce, mask=np.isnan(ce)), pa.array(np.concatenate(posterior))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
