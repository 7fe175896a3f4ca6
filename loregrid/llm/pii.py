"""Personal data and secrets, found by a semi-Markov conditional random field.

Stretches of words that could hold an entity are picked out by character classes over whole texts. In each, every
segment of at most MAX_ATOMS atoms is a candidate, and so is every whole address or key, however long; features of
the whole segment (its shape, check digits, what stands before it, whether it breaks off in the middle of something)
score it for each type, and so does the type of the entity before it in the stretch. Dynamic programming over segments
of the whole stretch chooses boundaries and types together. Weights are fitted to generated examples by conditional
likelihood.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregrid.llm.common import Words, free_name, text_slices

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
MAX_ATOMS = 24
LONG = 15  # bytes of the shortest key
STEP = 1024  # atoms whose candidates are held at once
EXAMPLES, EPOCHS = 1200, 24

_ATOM = re.compile(r"[^\W_]+|\s+|.", re.S)
_EMAIL = re.compile(r"[^\W_][\w.+%-]*@[^\W_][\w-]*(\.[\w-]+)*\.[^\W\d_]{2,}")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_PHONE = re.compile(r"(\+\d{1,3}[ .-]?)?(\(\d{1,4}\)|\d{1,4})([ .-]?\d{2,4}){1,5}")
_PLAIN_PHONE = re.compile(r"(\+?\d{1,3}[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?\d?([ .-]?\d{2,4}){3,5}")
_CARD = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{13,19}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,4})?")
_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk[-_]\w{16,}(-\w+)*|xox[abp]-[\w-]{10,}|AIza[\w-]{30,}|eyJ[\w-]+\.[\w-]+\.[\w-]+")
_CONTEXT = (
    re.compile(r"token|secret|key|passw|credential|auth|bearer"),
    re.compile(r"phone|tel|call|mobile|fax|contact"),
    re.compile(r"card|visa|credit|payment|master"),
    re.compile(r"ssn|social|security"),
    re.compile(r"\bip\b|addr|host|server|from"),
    re.compile(r"iban|account|bank"),
)
_EDGE = "+("
_JOINERS = "_.+%-"
N_FEATURES = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_checks(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(s: str, before: str, left: bool, right: bool) -> np.ndarray:
    """Of a whole segment s: before is the lower-case text in front, left and right tell whether it breaks off in the middle of something."""
    f = np.zeros(N_FEATURES)
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, letters = len(digits), sum(c.isalpha() for c in s)
    ip = _IP.fullmatch(s)
    card = _CARD.fullmatch(s) is not None
    iban = _IBAN.fullmatch(s) is not None
    f[0] = 1
    f[1] = _EMAIL.fullmatch(s) is not None
    f[2] = "@" in s
    f[3] = ip is not None and all(int(x) < 256 for x in ip.groups())
    f[4] = ip is not None and not f[3]
    f[5] = _PHONE.fullmatch(s) is not None and 9 <= n <= 14
    f[6] = _PLAIN_PHONE.fullmatch(s) is not None
    f[7] = s[0] in _EDGE
    f[8] = card and luhn(digits)
    f[9] = card and not f[8]
    f[10] = _SSN.fullmatch(s) is not None
    f[11] = iban and iban_checks(s)
    f[12] = iban and not f[11]
    f[13] = _HEX.fullmatch(s) is not None
    f[14] = _KEY.fullmatch(s) is not None
    solid = not any(c.isspace() for c in s)
    f[15] = solid and len(s) >= 20 and letters > 0 and n > 0 and "@" not in s and "." not in s
    for i, pattern in enumerate(_CONTEXT):
        f[16 + i] = pattern.search(before) is not None
    f[22] = left
    f[23] = right
    f[24] = not solid
    f[25] = n == len(s)
    f[26] = n < 7
    f[27] = 7 <= n < 10
    f[28] = 10 <= n < 13
    f[29] = n >= 13
    f[30] = letters > 0
    f[31] = f[13] * f[16] + f[15] * f[16]
    return f


def candidates(text: str, before: str, step: int) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]]:
    """(all atoms as character ranges, candidate segments as atom ranges, their features), for step atoms of a stretch at a time."""
    atoms = [m.span() for m in _ATOM.finditer(text)]
    word = [text[a].isalnum() for a, _ in atoms]
    spaces = [text[a].isspace() for a, _ in atoms]
    spans, rows = [], []
    m = len(atoms)
    far, tried = 0, False  # end of the last address or key; whether an address was looked for in this run of letters, digits and joiners
    for i in range(m):
        if i and i % step == 0:
            yield atoms, spans, np.array(rows).reshape(len(rows), N_FEATURES)
            spans, rows = [], []
        a = atoms[i][0]
        tried &= word[i] or text[a] in _JOINERS
        if not (word[i] or text[a] in _EDGE):
            continue
        head = (before + " " if a < 24 else "") + text[max(0, a - 24) : a].lower()
        head = head[-24:]
        left = i > 0 and not spaces[i - 1] and (word[i - 1] or text[atoms[i - 1][0]] in "@._%+-" and (i > 1 and word[i - 2] or text[atoms[i - 1][0]] == "+"))
        ends = [j for j in range(i + 1, min(m, i + MAX_ATOMS) + 1) if word[j - 1]]
        if word[i] and a >= far:
            whole = _KEY.match(text, a) or (None if tried else _EMAIL.match(text, a))
            tried = True
            if whole:
                far = whole.end()
                j = bisect_left(atoms, (far, far))
                if atoms[j - 1][1] == far and j not in ends:  # longer than others, or with a joiner as its last character
                    ends.append(j)
        for j in ends:
            s = text[atoms[i][0] : atoms[j - 1][1]]
            if len(s) < 7 or s.count("(") != s.count(")") or not ("@" in s or len(s) >= LONG or sum("0" <= c <= "9" for c in s) >= 4):
                continue
            right = j < m and not spaces[j] and (word[j] or text[atoms[j][0]] in "@._%+-" and j + 1 < m and word[j + 1])
            spans.append((i, j))
            rows.append(features(s, head, left, right))
    yield atoms, spans, np.array(rows).reshape(len(rows), N_FEATURES)


def segments(text: str, before: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """(atoms as character ranges, candidate segments as atom ranges, their features) of a stretch of text."""
    return next(candidates(text, before, len(text) + 1))


#: Labels that the last entity may have: none yet, then TYPES.
LAST = len(TYPES) + 1


def decode(m: int, spans: list[tuple[int, int]], score: np.ndarray, follow: np.ndarray) -> list[tuple[int, int, int]]:
    """The best-scoring segmentation of m atoms: (from, to, type) of its entities. An atom outside scores 0 and keeps the last entity's label; follow scores a label and the type after it."""
    ending: dict[int, list[int]] = {}
    for x, (_, j) in enumerate(spans):
        ending.setdefault(j, []).append(x)
    starts = {i for i, _ in spans}
    now = np.full(LAST, -np.inf)
    now[0] = 0
    at = np.full(LAST, -1)  # the step that gave each label its score
    held, steps = {0: (now, at)}, []  # steps: (span, type, step before)
    kinds = np.arange(len(TYPES))
    for j in sorted(starts | set(ending) | {m}):
        for x in ending.get(j, ()):
            before, way = held[spans[x][0]]
            v = before[:, None] + follow
            s = v.argmax(axis=0)
            v = v[s, kinds] + score[x]
            better = np.flatnonzero(v > now[1:])
            if len(better):
                now, at = now.copy(), at.copy()
                now[1 + better] = v[better]
                for t in better.tolist():
                    at[1 + t] = len(steps)
                    steps.append((x, t, int(way[s[t]])))
        if j in starts:
            held[j] = now, at
    out, step = [], int(at[now.argmax()])
    while step >= 0:
        x, t, step = steps[step]
        out.append((*spans[x], t))
    return out[::-1]


def expectations(m: int, spans: list[tuple[int, int]], score: np.ndarray, follow: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log partition, chance of every segment and type, expected number of every label and type after it) by forward and backward sums."""
    a, b = np.full((m + 1, LAST), -np.inf), np.zeros((m + 1, LAST))
    a[0, 0] = 0
    ending: list[list[int]] = [[] for _ in range(m + 1)]
    starting: list[list[int]] = [[] for _ in range(m + 1)]
    for x, (i, j) in enumerate(spans):
        ending[j].append(x)
        starting[i].append(x)
    for j in range(1, m + 1):
        a[j] = a[j - 1]
        for x in ending[j]:
            a[j, 1:] = np.logaddexp(a[j, 1:], np.logaddexp.reduce(a[spans[x][0]][:, None] + follow, axis=0) + score[x])
    for i in range(m - 1, -1, -1):
        b[i] = b[i + 1]
        for x in starting[i]:
            b[i] = np.logaddexp(b[i], np.logaddexp.reduce(follow + score[x] + b[spans[x][1], 1:], axis=1))
    whole = float(np.logaddexp.reduce(a[m]))
    if not len(spans):
        return whole, np.zeros((0, len(TYPES))), np.zeros_like(follow)
    ends = np.array(spans)
    each = np.exp(np.minimum(a[ends[:, 0], :, None] + follow[None] + score[:, None, :] + b[ends[:, 1], None, 1:] - whole, 0))
    return whole, each.sum(axis=1), each.sum(axis=0)


def example(rng: np.random.Generator) -> tuple[str, str, list[tuple[int, int, str]]]:
    """(text before, stretch, entities in it as character ranges with types): generated, with things that only look alike."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"abdeghilmnorstu") for _ in range(rng.integers(2, 9)))
    octet = lambda: str(rng.integers(0, 256))

    def card():
        s = pick("4", "5", "37", "6") + d(13)
        s = next(s + str(x) for x in range(10) if luhn(s + str(x)))
        return s if rng.random() < 0.6 or len(s) != 16 else pick(" ", "-").join(s[i : i + 4] for i in range(0, 16, 4))

    def iban():
        capital = lambda n: "".join(pick(*"ABCDEFGHIKLMNOPRSTUVWZ") for _ in range(n))
        country, body = pick(("DE", d(18)), ("FR", d(23)), ("ES", d(20)), ("GB", capital(4) + d(14)), ("NL", capital(4) + d(10)), ("IE", capital(4) + d(14)), ("MT", capital(4) + d(13) + capital(7) + d(3) + capital(1)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def one(kind):
        if kind == "EMAIL":
            return word() + pick("", "." + word(), "." + d(2), "_" + word(), "+" + word(), d(3)) + "@" + word() + pick("", d(1), "-" + word()) + pick(".com", ".example.com", ".org", ".co.uk", ".example.org", ".fr")
        if kind == "PHONE":
            return pick(f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(11)}")
        if kind == "IP":
            return ".".join(octet() for _ in range(4))
        if kind == "CARD":
            return card()
        if kind == "SECRET":
            return pick("".join(pick(*"0123456789abcdef") for _ in range(pick(32, 40, 64))), "AKIA" + "".join(pick(*"ABCDEFGHIJ234567") for _ in range(16)), "ghp_" + "".join(pick(*"abcdefABCDEF0123456789") for _ in range(36)), "sk-" + "".join(pick(*"abcdefABCDEF0123456789") for _ in range(24)), pick("ghp_" + (word() * 20)[:36], "sk-" + (word() * 12)[:24], "xoxb-" + (word() * 12)[: rng.integers(10, 24)]))
        if kind == "SSN":
            return f"{d(3)}-{d(2)}-{d(4)}"
        return iban()

    def other():
        return pick(f"20{d(2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}", f"{d(1)}.{d(1)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(4)}", f"{d(3)},{d(3)}", f"{d(5)}.{d(2)}", f"#{d(6)}", f"{d(8)}", f"{d(4)}-{d(4)}", f"{300 + int(d(2))}.{d(3)}.999.{d(3)}", word() + "@" + word(), "v" + d(1) + "." + d(2) + "." + d(2), "ISBN 97" + d(1) + "-" + d(1) + "-" + d(2) + "-" + d(6) + "-" + d(1), word() * 3 + word() * 2, f"1{d(9)}"[:10], f"{d(2)}/{d(2)}/{d(4)}", f"{d(5)} {d(5)}", d(20))

    lead = {"SECRET": ("token =", "secret", "api key", ""), "PHONE": ("tel", "call", "", ""), "CARD": ("card", "", ""), "SSN": ("ssn", "social", "ssn:"), "IP": ("ip", "from", "", ""), "IBAN": ("iban", "account", "")}
    kinds = [pick(*TYPES, None, None, None) for _ in range(pick(1, 1, 1, 2, 3))]
    if rng.random() < 0.4:  # a list of one kind
        kinds = kinds[:1] * len(kinds)
    before = pick(*lead.get(kinds[0], ("",))) or word() + " " + word()
    text, marks = "", []
    for k in kinds:
        text += pick("", "", '"', "(", "=") if not text else pick(" ", ", ", "; ")
        s = one(k) if k else other()
        if k:
            marks.append((len(text), len(text) + len(s), k))
        text += s
    text += pick("", "", ".", ",", '"', "###", "$$$", ")", "&&&")
    return before, text, marks


def _prepared(rng: np.random.Generator, n: int) -> list:
    out = []
    while len(out) < n:
        before, text, marks = example(rng)
        atoms, spans, x = segments(text, before)
        where = {(atoms[i][0], atoms[j - 1][1]): r for r, (i, j) in enumerate(spans)}
        gold, after = np.zeros((len(spans), len(TYPES))), np.zeros((LAST, len(TYPES)))
        if all((a, b) in where for a, b, _ in marks):
            last = 0
            for a, b, k in marks:
                gold[where[a, b], TYPES.index(k)] = 1
                after[last, TYPES.index(k)] += 1
                last = 1 + TYPES.index(k)
            out.append((len(atoms), spans, x, gold, after))
    return out


@lru_cache(maxsize=4)
def fit(examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (types by features, and last label by type) that maximise the conditional likelihood of generated examples, by AdaGrad."""
    data = _prepared(np.random.default_rng(seed), examples)
    w = [np.zeros((len(TYPES), N_FEATURES)), np.zeros((LAST, len(TYPES)))]
    w[0][:, 0] = -2
    square = [np.full_like(x, 0.1) for x in w]
    for _ in range(epochs):
        for s in range(0, len(data), 20):
            g = [-1e-3 * w[0], -1e-2 * w[1]]
            for m, spans, x, gold, after in data[s : s + 20]:
                if len(spans):
                    _, segment, pair = expectations(m, spans, x @ w[0].T, w[1])
                    g[0] += (gold - segment).T @ x / 20
                    g[1] += (after - pair) / 20
            for i in range(2):
                square[i] += g[i] * g[i]
                w[i] = w[i] + 0.7 * g[i] / np.sqrt(square[i])
    return w[0], w[1]


def find(text: str, before: str, weights: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, str]]:
    """Entities of a stretch, as character ranges with types."""
    w, follow = weights
    # what an entity can gain by the label before it, and at most by changing what the next one follows
    most = follow.max(axis=0)
    least = -float((most - follow.min(axis=0)).max())
    chosen, scores = [], [np.zeros((0, len(TYPES)))]
    for atoms, spans, x in candidates(text, before, STEP):
        score = x @ w.T
        good = (score + most).max(axis=1, initial=-np.inf) > least  # no best segmentation has others
        chosen += [spans[r] for r in np.flatnonzero(good)]
        scores.append(score[good])
    return [(atoms[i][0], atoms[j - 1][1], TYPES[k]) for i, j, k in decode(len(atoms), chosen, np.concatenate(scores), follow)] if chosen else []


_KIND = np.zeros(256, dtype=np.uint8)  # 1 digit, 2 at sign, 3 letter or joiner
_KIND[48:58] = 1
_KIND[ord("@")] = 2
_KIND[65:91] = _KIND[97:123] = 3
for _c in b"_-+/=":
    _KIND[_c] = 3


def stretches(data: np.ndarray, offset: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(text, first byte, end byte, what stands before) of runs of words in which an entity is possible.

    Words with digits or an at sign, long words, and the capital groups that follow the head of an IBAN.
    """
    w = Words(data, offset, lower=False)
    if not len(w.start):
        return []
    kind = _KIND[data]
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    span = lambda c: c[w.end] - c[w.start]
    digits, at, letters = span(total(kind == 1)), span(total(kind == 2)), span(total(kind == 3))
    upper = (data >= 65) & (data <= 90)
    small = (data >= 97) & (data <= 122) | (data >= 128)
    long = (letters + digits >= LONG) & (span(total(upper | small)) > 0)
    use = (digits > 0) | (at > 0) | long
    if not use.any():
        return []
    begins = np.zeros(len(data), dtype=bool)  # two capitals and two digits
    begins[:-3] = upper[:-3] & upper[1:-2] & (kind[2:-1] == 1) & (kind[3:] == 1)
    begun = total(begins)
    at_head = begun[np.maximum(w.end - 3, w.start)] > begun[w.start]
    group = (span(total(upper | (kind == 1))) > 0) & (span(total(small)) == 0)
    place = np.flatnonzero(at_head)
    for _ in range(8):  # as many groups as an IBAN has behind its head
        place = place[place + 1 < len(use)] + 1
        place = place[group[place] & (w.doc[place] == w.doc[place - 1])]
        use[place] = True
    head = use.copy()
    head[1:] &= ~use[:-1] | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(head)
    member = np.cumsum(head)[use] - 1
    weight = np.bincount(member, weights=digits[use], minlength=len(first))
    other = np.bincount(member, weights=((at > 0) | long)[use], minlength=len(first))
    last = np.zeros(len(first), dtype=np.int64)
    np.maximum.at(last, member, np.flatnonzero(use))
    out = []
    size = w.end[last] - w.start[first]
    # no stricter than segments(): an address such as 8.8.8.8 has four digits
    for i in np.flatnonzero((other > 0) | (size >= LONG) | (weight >= 4) & (size >= 7)).tolist():
        a, b = int(first[i]), int(last[i])
        d = int(w.doc[a])
        start = int(w.start[max(int(w.first[d]), a - 2)])
        out.append((d, int(w.start[a]), int(w.end[b]), data[start : int(w.start[a])].tobytes().decode("utf-8", "replace").lower()))
    return out


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its texts redacted: each entity becomes its type in brackets, as in [EMAIL].

    Adds entities (array of start, end and type; characters of the original text, end exclusive, in order) and
    n_entities, with underscores in front where df has such names. All rows come back, and texts without entities
    unchanged. Defined cases: a null text stays null, with null entities and n_entities 0; an empty text has none; texts
    are read whole, whatever their length; equal rows are treated alike; an empty table gives an empty table; other
    columns may hold anything.
    """
    w = df.sparkSession.sparkContext.broadcast(fit())
    at = df.columns.index(text)
    names = [free_name(df, x) for x in ("entities", "n_entities")]
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T._parse_datatype_string("array<struct<start:int,end:int,type:string>>")), T.StructField(names[1], T.IntegerType())])
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())])

    def run(batches):
        weights = w.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(at)
            nulls = column.is_null().to_pylist()
            found: list = [None if x else [] for x in nulls]
            new: dict[int, str] = {}
            for a, b, data, offset in text_slices(column):
                places = stretches(data, offset)
                if not places:
                    continue
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                spots: dict[int, list] = {}
                for d, s, e, before in places:
                    part = data[s:e].tobytes().decode("utf-8", "replace")
                    base = int(lead[s] - lead[offset[d]])
                    spots.setdefault(d, []).extend((base + x, base + y, t) for x, y, t in find(part, before, weights))
                for d, hits in spots.items():
                    if hits:
                        body, out, p = data[offset[d] : offset[d + 1]].tobytes().decode("utf-8", "replace"), [], 0
                        for x, y, t in hits:
                            out += [body[p:x], f"[{t}]"]
                            p = y
                        new[a + d] = "".join(out) + body[p:]
                        found[a + d] = [{"start": x, "end": y, "type": t} for x, y, t in hits]
            columns = list(batch.columns)
            if new:
                values = column.to_pylist()
                for i, t in new.items():
                    values[i] = t
                columns[at] = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(kind)), pa.array([len(x or ()) for x in found], pa.int32())], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
