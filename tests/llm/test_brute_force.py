"""What SQL can't express, against plain versions, exact round trips and held-out data."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import plain
from pyspark.sql import functions as F

from loregrid.llm import ann, components, language_id, line_dedup, mixing, pii, quality_bayes, queries, suffix_dedup
from loregrid.llm import sentencepiece_sampling as sp

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").persist()


def test_bloom_filters_miss_no_repeat():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**62), 2**62, 20_000)
    h = np.concatenate([h, h[:500]])
    rng.shuffle(h)
    twice = line_dedup.two_filters(h, np.zeros(len(h), dtype=bool))
    values, counts = np.unique(h, return_counts=True)
    assert twice.has(values[counts > 1]).all()
    assert twice.has(values[counts == 1]).mean() < 0.05


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2)] * 12), max_size=40))
def test_deep_shallow_sorts(rows):
    groups = list(suffix_dedup.deep_shallow(rows, 3))
    assert [rows[i] for g in groups for i in g] == sorted(rows)
    assert sorted(i for g in groups for i in g) == list(range(len(rows)))
    assert all(len({rows[i] for i in g}) == 1 for g in groups)
    assert len(groups) == len(set(rows))


# --- SentencePiece


def toy():
    text = ("a", "b", "ab", "ba", "aba", " ", " a")
    score = tuple(-0.5 - 0.3 * i for i in range(len(text)))
    byte = tuple(range(len(text), len(text) + 256))
    return sp.Pieces(tuple(t.encode() for t in text) + tuple(bytes([i]) for i in range(256)), score + (-math.inf,) * 256, byte, -9.0)


def segmentations(body, pieces):
    if not body:
        yield (), 0.0
    for i, (t, s) in enumerate(zip(pieces.text, pieces.score)):
        if math.isfinite(s) and t and body.startswith(t):
            for rest, w in segmentations(body[len(t) :], pieces):
                yield (i, *rest), s + w


@pytest.mark.parametrize("alpha", [1.0, 0.3])
def test_samples_follow_the_lattice(alpha):
    pieces, n = toy(), 20_000
    body = b"abaab"
    data = np.frombuffer(body * n, dtype=np.uint8)
    ids, count = sp.encode_slice(data, np.arange(n + 1) * len(body), np.arange(n), pieces, alpha, 1)
    cut = np.concatenate([[0], np.cumsum(count)])
    got = Counter(tuple(ids[cut[i] : cut[i + 1]].tolist()) for i in range(n))
    want = {s: math.exp(alpha * w) for s, w in segmentations(b" " + body, pieces)}
    whole = sum(want.values())
    assert set(got) <= set(want)
    assert max(abs(got[s] / n - w / whole) for s, w in want.items()) < 0.015


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_round_trip(texts):
    pieces = sp.load()
    raw = [t.encode("utf-8", "ignore") for t in texts]
    offset = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, count = sp.encode_slice(np.frombuffer(b"".join(raw), dtype=np.uint8), offset, np.arange(len(raw)), pieces, 1.0, 3)
    data, size = sp.decode_ids(ids, count, pieces)
    assert data.tobytes() == b"".join(raw)
    assert size.tolist() == [len(r) for r in raw]


def test_pieces_decode_with_the_library_too(spark, docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    out = sp.sentencepiece_encode(docs, keep_text=True).collect()
    assert all(r["lossless"] for r in out)
    assert all(m.decode(r["pieces"]).strip() == r["text"].strip() for r in out[:40])
    again = {r["doc_id"]: r["pieces"] for r in sp.sentencepiece_encode(docs.repartition(3)).collect()}
    assert all(again[r["doc_id"]] == r["pieces"] for r in out)
    other = {r["doc_id"]: r["pieces"] for r in sp.sentencepiece_encode(docs, seed=7).collect()}
    assert sum(other[r["doc_id"]] != r["pieces"] for r in out) > 0.8 * len(out)


@pytest.mark.parametrize("text", ["a" * 3000, "abc" * 1500, "日本語のテキスト" * 300, "0x" + "9f3Ab_" * 700, "é" * 2000 + "the" * 500, "\x00\x01" * 900])
def test_long_runs_fall_apart_where_no_piece_crosses(text):
    """Cutting a long run changes no chance: the whole run's forward sums give the edges of its parts the same weights."""
    pieces = sp.load()
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    start, _ = sp.runs_of(data, np.array([0, len(data)]), pieces)
    first = np.append(start, len(data))
    whole, parts = sp.lattice(data, np.array([0, len(data)]), pieces, 1.0), sp.lattice(data, first, pieces, 1.0)
    node = np.arange(len(data)) + np.repeat(np.arange(len(start)), np.diff(first))  # of a byte, in the parts

    def edges(lat, place):
        at = {int(x): i for i, x in enumerate(place)}
        out = {}
        for t in range(len(lat.first) - 1):
            before = 0.0
            for e in range(lat.first[t], lat.first[t + 1]):
                chance = min(1.0, float(lat.chance[e]))
                out[at[int(lat.source[e])], int(lat.piece[e])] = chance - before
                before = chance
        return out

    one, two = edges(whole, np.arange(len(data))), edges(parts, node)
    assert set(one) == set(two) and all(abs(one[x] - two[x]) < 1e-4 for x in one)
    ids, count = sp.encode_slice(data, np.array([0, len(data)]), np.array([1]), pieces, 1.0, 42)
    assert sp.decode_ids(ids, count, pieces)[0].tobytes() == text.encode()


# --- components


@pytest.mark.parametrize("limit", [1 << 18, 20, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "EDGES_IN_A_TASK", limit)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(1900, 1950)] + [(5, None), (None, 5), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain.components([(a, b) for a, b in edges if a is not None and b is not None and a != b])


# --- neighbours


def recall_of(df, out, asked):
    """Share of the true neighbours that out holds; its distances and ranks are checked on the way."""
    rows = {r["vec_id"]: r["embedding"] for r in df.collect()}
    keys, x = np.array(list(rows)), np.array(list(rows.values()), dtype=np.float64)
    d = ann.squared(x, x)
    np.fill_diagonal(d, np.inf)
    place = {int(k): i for i, k in enumerate(keys)}
    got = defaultdict(dict)
    for r in out.collect():
        got[r["vec_id"]][r["rank"]] = r["neighbor_id"]
        assert abs(r["distance"] - math.sqrt(d[place[r["vec_id"]], place[r["neighbor_id"]]])) < 1e-4
    assert set(got) == asked and all(sorted(g) == list(range(1, ann.K + 1)) for g in got.values())
    hits = 0
    for q, g in got.items():
        row = d[place[q]]
        far = np.sort(row)[ann.K - 1] + 1e-9
        hits += sum(row[place[n]] <= far for n in g.values())
    return hits / (ann.K * len(got))


def test_recall(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert recall_of(df, ann.nearest_neighbours(df), {r["vec_id"] for r in df.collect()}) >= 0.9


def test_recall_of_the_registered_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out = queries.QUERIES["op4_nearest_neighbours"](spark, "/root/testdata/sf0.1")
    assert recall_of(df, out, {r["vec_id"] for r in df.where("vec_id % 50 = 0").collect()}) >= 0.9


@pytest.mark.parametrize(("cells", "entries"), [(1 << 20, 64), (4, 32), (1, 100)])
def test_recall_with_a_cell_that_holds_a_third(spark, monkeypatch, cells, entries):
    """Large cells go to several shards; few codewords and a fit on a sample lose no entry."""
    monkeypatch.setattr(ann, "MOST_CELLS", cells)
    monkeypatch.setattr(ann, "SHARD_ENTRIES", entries)
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    same = df.where("vec_id = 7").crossJoin(spark.range(1000, 1250)).select(F.col("id").alias("vec_id"), "embedding", "label")
    df = df.unionByName(same)
    out = ann.nearest_neighbours(df, queries=df.where("vec_id % 50 = 0"), fit_rows=200)
    assert recall_of(df, out, {r["vec_id"] for r in df.where("vec_id % 50 = 0").collect()}) >= 0.9


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(1)
    left, right, filled = rng.random(7), rng.random(9), rng.integers(0, 3, 63)
    total = (left[:, None] + right[None, :]).ravel()
    want = [c for c in np.argsort(total, kind="stable").tolist() if filled[c]]
    assert ann.traverse(left, right, filled, int(filled.sum())) == want
    some = ann.traverse(left, right, filled, 10)
    assert some == want[: len(some)] and filled[some].sum() >= 10 > filled[some[:-1]].sum()


# --- mixing


def test_mixture_equals_a_plain_one(spark, docs):
    size, slots, seed = 64, 32, 42
    weights = {"src0": 3.0, "src1": 1.0, "src2": 0.5}
    hashed = docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    rows = hashed.collect()
    from pyspark.sql import Row

    assert isinstance(rows[0], Row)
    out = mixing.mix_sources(docs, weights=weights, blocks=300, block_tokens=size, shard_slots=slots, seed=seed).collect()
    # the order within a source: by bucket, then by hash; 16 buckets while the table is small
    blocks = plain.packed([(r["source"], (r["h"] % 16, r["h"], r["doc_id"]), r["doc_id"], r["text"].rstrip(plain.SPACE), r["lang"]) for r in rows if r["text"] and r["text"].strip(plain.SPACE)], size)
    names = sorted(blocks, key=lambda s: f"s{s}")
    p = np.array([weights.get(s, 0.0) for s in names])
    p = p / p.sum()
    used, drawn = Counter(), []
    for shard in range(-(-300 // slots)):
        counts = mixing.shard_counts(shard, min(slots, 300 - shard * slots), p, seed)
        for s, c in zip(names, counts):
            drawn += [(shard, s, used[s] + i) for i in range(c)]
            used[s] += int(c)
    keys = spark.createDataFrame([(a, f"s{s}", d) for a, s, d in drawn], "shard long, sk string, d long").select("*", F.xxhash64("sk").alias("salt"), F.xxhash64(F.lit(seed), "shard", "sk", "d").alias("r")).collect()
    want = {}
    place = Counter()
    for k in sorted(keys, key=lambda k: (k["shard"], k["r"], k["sk"], k["d"])):
        s, n = k["sk"][1:], len(blocks[k["sk"][1:]])
        epoch = k["d"] // n
        salt = mixing.mix(np.array([k["salt"]], dtype=np.int64).view(np.uint64) ^ mixing.mix(np.array([epoch], dtype=np.int64).view(np.uint64) + np.uint64(seed)))
        block = int(mixing.permute(np.array([k["d"] % n]), np.array([n]), salt)[0])
        want[k["shard"] * slots + place[k["shard"]]] = (s, block, epoch, *blocks[s][block])
        place[k["shard"]] += 1
    got = {r["doc_id"]: (r["source"], r["block"], r["epoch"], r["text"], r["doc_ids"], r["lang"], r["n_tokens"]) for r in out}
    assert got == want


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        x = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 5, dtype=np.uint64))
        assert sorted(x.tolist()) == list(range(n))


# --- classifiers


def test_posteriors_equal_plain_ones(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = quality_bayes.quality_classifier(docs, labels, keep_all=True).collect()
    chance = lambda r: 1 / (1 + math.exp(-r["quality_evidence"]))
    sites = plain.sites([(r["source"], r["lang"], chance(r)) for r in out])
    for r in out:
        want = plain.posterior(r["quality_evidence"], chance(r), sites[r["source"], r["lang"]]) if r["text"].strip() else 0.0
        assert abs(r["quality_posterior"] - want) < 1e-6
        assert r["quality_keep"] == (want >= 0.5)


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = quality_bayes.quality_classifier(docs, labels.where(half), keep_all=True).join(labels.where(~half), "doc_id").select("quality", "quality_keep").collect()
    good = [r["quality_keep"] for r in out if r["quality"] == 1]
    bad = [r["quality_keep"] for r in out if r["quality"] == 0]
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = language_id.language_id(docs.where(~half & (F.length("text") >= 100)), docs.where(half), per_language=50).select("lang", "lang_id").collect()
    assert sum(r["lang"] == r["lang_id"] for r in out) >= 0.95 * len(out)
    noise = spark.createDataFrame([(1, "0x8f3a 77$$ zq9! " * 60, "en")], "doc_id long, text string, lang string")
    assert language_id.language_id(noise, docs.where(half), per_language=50).first()["lang_id"] == "und"


def test_kneser_ney_equals_a_plain_model():
    texts = {"a": ["the cat sat on the mat", "the dog", "a cat"], "b": ["der hund und die katze", "das ist gut"]}
    model = language_id.fit(texts)
    words = ["the", "hund", "zebra", "cat", "a"]
    got = model.word_scores(language_id._codes(language_id._padded(words)), len(words))
    for j, lang in enumerate(model.languages):
        slow = plain.KneserNey(texts[lang], language_id.ORDER, language_id.ALPHABET)
        for i, w in enumerate(words):
            assert abs(got[i, j] - slow.loss(w)) < 1e-3
    assert got[:, -1].tolist() == [len(w) + 1 for w in words]


# --- personal data


def test_pii_on_held_out_examples():
    w, rng = pii.fit(), np.random.default_rng(99)
    right = found = wanted = 0
    for _ in range(600):
        before, text, marks = pii.example(rng)
        got = set(pii.find(text, before, w))
        right += len(got & set(marks))
        found += len(got)
        wanted += len(marks)
    assert right / found > 0.95 and right / wanted > 0.95


def test_segments_equal_all_segmentations():
    """The dynamic programme, and the sums, against every way to choose segments that don't overlap and their types."""
    rng = random.Random(3)
    kinds = range(len(pii.TYPES))
    for _ in range(60):
        m = rng.randrange(1, 5)
        spans = [(i, j) for i in range(m) for j in range(i + 1, m + 1) if rng.random() < 0.5][:5]
        score = np.array([[rng.uniform(-2, 2) for _ in kinds] for _ in spans]).reshape(len(spans), len(pii.TYPES))
        follow = np.array([[rng.uniform(-2, 2) for _ in kinds] for _ in range(pii.LAST)])

        def every(at, last):
            yield 0.0, ()
            for x, (i, j) in enumerate(spans):
                if i >= at:
                    for t in kinds:
                        for rest, chosen in every(j, 1 + t):
                            yield score[x, t] + follow[last, t] + rest, ((x, last, t), *chosen)

        ways = list(every(0, 0))
        want = max(ways, key=lambda t: t[0])
        got = pii.decode(m, spans, score, follow)
        assert got == [(*spans[x], t) for x, _, t in want[1]]
        whole = sum(math.exp(v) for v, _ in ways)
        log_whole, segment, pair = pii.expectations(m, spans, score, follow)
        assert abs(log_whole - math.log(whole)) < 1e-9
        one, two = np.zeros_like(segment), np.zeros_like(pair)
        for v, chosen in ways:
            for x, last, t in chosen:
                one[x, t] += math.exp(v) / whole
                two[last, t] += math.exp(v) / whole
        assert np.allclose(segment, one) and np.allclose(pair, two)


def test_pii_at_every_offset_of_a_run_of_words(spark):
    entities = ("+33 1 22 33 44 55", "[PHONE]"), ("+44 20 7946 0958", "[PHONE]"), ("jo.doe@mail.example.com", "[EMAIL]")
    rows = [(n * 10 + e, " ".join(f"a{i}" for i in range(n)) + f" {x} " + " ".join(f"b{i}" for i in range(100 - n)), " ".join(f"a{i}" for i in range(n)) + f" {y} " + " ".join(f"b{i}" for i in range(100 - n))) for n in range(1, 100) for e, (x, y) in enumerate(entities)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, want string"))
    assert out.where("text <> want").select("doc_id", "text").take(3) == []


@pytest.mark.parametrize(("text", "want"), [
    ("write to jo.doe+x@mail.example.com, or", [("EMAIL", "jo.doe+x@mail.example.com")]),
    ("call +1 (415) 555-0132 now", [("PHONE", "+1 (415) 555-0132")]),
    ("from 10.0.200.7 today", [("IP", "10.0.200.7")]),
    ("at 999.1.2.3 today", []),
    ("card 4111 1111 1111 1111 ok", [("CARD", "4111 1111 1111 1111")]),
    ("on 2024-01-31 at 12:30:00", []),
])
def test_pii_by_hand(spark, text, want):
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(e["type"], text[e["start"] : e["end"]]) for e in r["entities"]] == want


@pytest.mark.parametrize("ip", ["8.8.8.8", "10.0.0.1", "127.0.0.1", "192.0.2.1", "10.0.0.12"])
def test_pii_short_addresses(spark, ip):
    """Of four to six digits, among ordinary words."""
    r = pii.find_pii(spark.createDataFrame([(1, f"they ask {ip}, or wait")], "doc_id long, text string")).first()
    assert r["text"] == "they ask [IP], or wait" and r["n_entities"] == 1


@pytest.mark.parametrize(("entity", "kind"), [
    ("GB29 NWBK 6016 1331 9268 19", "IBAN"),
    ("NL91 ABNA 0417 1643 00", "IBAN"),
    ("IE29 AIBK 9311 5212 3456 78", "IBAN"),
    ("MT84 MALT 0110 0001 2345 MTLC AST0 01S", "IBAN"),
    ("sk-abcdefghijklmnopqrstuvwx", "SECRET"),
    ("xoxb-abcdefghij", "SECRET"),
    ("ghp_abcdefghijklmnopqrstuvwxyzabcdefghij", "SECRET"),
])
def test_pii_with_words_of_letters(spark, entity, kind):
    """Bank codes and keys without a digit."""
    r = pii.find_pii(spark.createDataFrame([(1, f"pay it to {entity} NOW or wait")], "doc_id long, text string")).first()
    assert r["text"] == f"pay it to [{kind}] NOW or wait"


def test_pii_at_every_place_of_a_long_run(spark):
    """A number is found whole wherever it stands among a great many others."""
    rows = [(n, "12.5 " * n + "+33 1 23 45 67 89" + " 12.5" * 60) for n in range(30, 100)]
    got = {r["doc_id"]: r["text"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: "12.5 " * n + "[PHONE]" + " 12.5" * 60 for n, _ in rows}


@pytest.mark.parametrize(("entity", "kind"), [
    ("eyJhbGciOiJSUzI1NiJ9.eyJzdWIiOiIxIn0." + "aB3-x_Y9-" * 38, "SECRET"),
    ("sk-" + "a1B2c3D4e5F6g7H8i9" + "-x7" * 30, "SECRET"),
    ("a.b." * 10 + "jo@mail.example.com", "EMAIL"),
])
def test_pii_of_many_atoms(spark, entity, kind):
    r = pii.find_pii(spark.createDataFrame([(1, f"send {entity} today")], "doc_id long, text string")).first()
    assert r["text"] == f"send [{kind}] today"


def test_packed_cells():
    rng = np.random.default_rng(2)
    for n in (1, 2, 10, 500):
        for top in (n, 10 * n, 65_000):
            cells = rng.choice(max(n, top), n, replace=False).astype(np.int32)
            assert ann.unpack_cells(ann.pack_cells(cells)).tolist() == sorted(cells.tolist())
