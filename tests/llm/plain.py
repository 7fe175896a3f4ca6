"""Plain versions of the operators, one row after the other, and small tables with everything awkward in them."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

SPACE = " \t\n\v\f\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = "k K t h n s e c p d f r o m mu hm k2 line words shard bucket block epoch rank base sk lg_k lg_k2 lg_s lg_e lg_all lg_bad lg_judged lg_host lg_path lg_site_n lg_drop lg_gone lg_key lg_y lg_t lg_e2 n_lines n_dropped n_failed lost pieces n_pieces lossless entities n_entities lang_id lang_posterior quality_keep site_quality n_repeated piece comp component node rep".split()


def words(text):
    return re.findall(rf"[^{SPACE}]+", text)


def awkward(spark, clash=True, long_words=30_000):
    rng = random.Random(5)
    long = " ".join(rng.choice(["region", "the", "of", "Ouen.", "retitioning", "x9", "für", "日本"]) + ("\n" if rng.random() < 0.05 else "") for _ in range(long_words))
    body = "The first line ends here.\nThe first line ends here.\nA second line, quite another, ends there.\n"
    rows = [(1, body, "en", "src1", 100), (1, body, "en", "src1", 100), (2, None, "en", "src1", 0), (3, "", "en", "src2", 0), (4, "  \n\t \n", None, "src2", 6), (None, "A text without a key.", "en", None, 22), (None, None, None, None, None), (5, long, "de", "src1", len(long)),
            (6, body, None, None, None), (7, "one", "fr", "src3", 3), (8, "A second line, quite another, ends there.\nMail a.b@example.com now.", "en", "", 60), (9, "\r\n\r\nÄÖ ß　x.\r\n", "de", "src1", 10), (-3, "The first line ends here.", "en", "src1", 25)]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        seen = set()
        names = [c for c in CLASHES if not (c.lower() in seen or seen.add(c.lower()))]
        df = df.select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    return df


def line_dedup(rows):
    """rows: (doc_id, text); gives (doc_id, text, n_lines, n_dropped)."""
    first = {}
    for k, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for p, line in enumerate(t.split("\n")):
            if re.search(r"\S", line, re.A):
                first[line] = min(first.get(line, (k, p)), (k, p))
    out = []
    for k, t in rows:
        if k is None or t is None:
            out.append((k, t, 0 if t is None else len(t.split("\n")), 0))
            continue
        lines = t.split("\n")
        keep = [x for p, x in enumerate(lines) if not re.search(r"\S", x, re.A) or first[x] == (k, p)]
        lost = len(lines) - len(keep)
        if not lost or re.search(r"\S", "\n".join(keep), re.A):
            out.append((k, "\n".join(keep), len(lines), lost))
    return out


def gram_set(text, n=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text or "")]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def classes(rows, threshold=0.4):
    """{key: (class, number of links)} of all keys: each different text of a key is a node of its own."""
    nodes = sorted({(k, gram_set(t)) for k, t in rows if k is not None}, key=lambda x: (x[0], sorted(x[1])))
    pairs, count = set(), Counter({k: 0 for k, _ in nodes})
    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[i + 1 :]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-12:
                count[a] += 1
                count[b] += 1
                if a != b:
                    pairs.add((a, b))
    group = components(pairs)
    return {k: (group.get(k, k), n) for k, n in count.items()}


def components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def sites(rows):
    """rows: (host, path, chance); gives {(host, path): (n, s, mu, hm, k2)}."""
    n, s, hn, hs = Counter(), Counter(), Counter(), Counter()
    for h, p, c in rows:
        n[h, p] += 1
        s[h, p] += c
        hn[h] += 1
        hs[h] += c
    total = sum(hn.values())
    mu = sum(hs.values()) / total

    def strength(groups):
        w = sum(x for x, _, _ in groups)
        within = sum(x * m * (1 - m) for x, _, m in groups) / w
        between = sum(x * (y / x - m) ** 2 for x, y, m in groups) / w - sum(m * (1 - m) for _, _, m in groups) / w
        return min(1e4, max(1.0, within / max(1e-6, between) - 1))

    k1 = strength([(hn[h], hs[h], mu) for h in hn])
    hm = {h: (k1 * mu + hs[h]) / (k1 + hn[h]) for h in hn}
    k2 = strength([(n[g], s[g], hm[g[0]]) for g in n])
    return {g: (n[g], s[g], mu, hm[g[0]], k2) for g in n}


def posterior(evidence, chance, site):
    n, s, mu, hm, k2 = site
    clip = lambda x: min(1 - 1e-4, max(1e-4, x))
    o, m = clip((k2 * hm + s - chance) / (k2 + n - 1)), clip(mu)
    return 1 / (1 + math.exp(-(evidence + math.log(o / (1 - o)) - math.log(m / (1 - m)))))


def packed(rows, size):
    """rows: (source, order, key, text, lang) with any text; gives {source: [blocks of (tokens with the space before, keys, lang of the first)]}."""
    streams = defaultdict(list)
    for source, _, k, t, lang in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        parts = re.findall(rf"[{SPACE}]*[^{SPACE}]+", t or "")
        streams[source].extend((x, i == 0, k, lang) for i, x in enumerate(parts))
    out = {}
    for source, tokens in streams.items():
        blocks = []
        for i in range(0, len(tokens), size):
            part = tokens[i : i + size]
            text = "".join(("\n" if first and j else "") + x for j, (x, first, _, _) in enumerate(part))
            keys = [part[0][2]] + [k for x, first, k, _ in part[1:] if first]
            blocks.append((text, keys, part[0][3], len(part)))
        out[source] = blocks
    return out


class KneserNey:
    """Interpolated Kneser-Ney over characters of words between spaces, with dictionaries."""

    def __init__(self, texts, order, alphabet):
        count = Counter(w for t in texts for w in t.split())
        self.order, self.alphabet, self.k = order, alphabet, []
        grams = [defaultdict(float) for _ in range(order)]
        left = [defaultdict(set) for _ in range(order)]
        for w, times in count.items():
            body = " " * (order - 1) + w.lower() + " "
            for i in range(order - 1, len(body)):
                for n in range(1, order + 1):
                    g = body[i - n + 1 : i + 1]
                    grams[n - 1][g] += times
                    if n < order:
                        left[n - 1][g].add(body[i - n : i + 1])
        self.k = [{g: float(len(x)) for g, x in left[n].items()} for n in range(order - 1)] + [dict(grams[-1])]
        self.d, self.whole, self.kinds = [], [], []
        for k in self.k:
            n1, n2 = sum(v == 1 for v in k.values()), sum(v == 2 for v in k.values())
            self.d.append(min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5)
            whole, kinds = Counter(), Counter()
            for g, v in k.items():
                whole[g[:-1]] += v
                kinds[g[:-1]] += 1
            self.whole.append(whole)
            self.kinds.append(kinds)

    def chance(self, context, c):
        p = 1 / self.alphabet
        for n in range(self.order):
            ctx = context[len(context) - n :]
            if self.kinds[n][ctx]:
                rest = min(1.0, max(1e-4, self.d[n] * self.kinds[n][ctx] / self.whole[n][ctx]))
                p = p * rest + max(self.k[n].get(ctx + c, 0) - self.d[n], 0) / self.whole[n][ctx]
        return p

    def loss(self, word):
        body = " " * (self.order - 1) + word.lower() + " "
        return -sum(math.log(self.chance(body[i - self.order + 1 : i], body[i])) for i in range(self.order - 1, len(body)))
