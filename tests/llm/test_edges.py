"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names: every operator and stage."""

from __future__ import annotations

import random

import pytest
from llm import plain
from pyspark.sql import functions as F

import corpus_pipeline
from loregrid.llm import ann, language_id, line_dedup, mixing, ngram_join, pii, quality_bayes, quality_rules, sentencepiece_sampling, suffix_dedup


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 1, None), (5, 1, 0), (None, 1, 0), (9, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def rows(spark):
    return plain.awkward(spark).persist()


def unharmed(df, out, changed=("text",)):
    """Columns that an operator passes on are there, as they were, on every row that came back."""
    names = [c for c in df.columns if c not in (*changed, "n_chars", "text")]
    assert out.select(names).exceptAll(df.select(names)).count() == 0
    assert len({c.lower() for c in out.columns}) == len(out.columns)


def test_line_dedup(rows):
    out = line_dedup.line_dedup(rows)
    unharmed(rows, out)
    want = plain.line_dedup([(r["doc_id"], r["text"]) for r in rows.collect()])
    got = [(r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_LIMIT, -1])
def test_line_dedup_of_one_key_with_two_texts(spark, monkeypatch, limit):
    """Each row loses its own repeats, whether filters are broadcast or not."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LIMIT", limit)
    df = spark.createDataFrame([(1, "top\nsame"), (2, "one\nsame\nend"), (2, "two\nonly here"), (2, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(df).collect()}
    assert got == {(1, "top\nsame", 2, 0), (2, "one\nend", 3, 1), (2, "two\nonly here", 2, 0), (2, None, 0, 0)}


def test_line_dedup_with_filters_too_large_to_broadcast(rows, monkeypatch):
    want = line_dedup.line_dedup(rows).select("doc_id", "text", "_n_dropped").collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_LIMIT", -1)
    monkeypatch.setattr(line_dedup, "LINES_PER_SHARD", 64)
    got = line_dedup.line_dedup(rows).select("doc_id", "text", "_n_dropped").collect()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_quality_rules(rows):
    out = quality_rules.quality_rules(rows)
    unharmed(rows, out)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert not {2, 3, 4} & set(kept) and kept[1].startswith("The first line")
    assert quality_rules.quality_rules(rows.where("doc_id = 1")).count() == 2


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("The design in question was finished in the catalog in spring.", ""), ("We sat down to sign up, one after the other, for all of the long course.", ""), ("The cookie was sweet.", ""),
        ("Sign in", "boilerplate"), ("Sign up | Log in | Help", "navigation"), ("© 2021 Copyright Acme.", "boilerplate"), ("Read our Privacy Policy before you go on to any other page of ours.", "boilerplate"),
        ("Tous droits réservés.", "boilerplate"), ("Conditions d’utilisation du site.", "boilerplate"), ("Alle Rechte vorbehalten.", "boilerplate"), ("Zum Impressum.", "boilerplate"), ("Todos los derechos reservados.", "boilerplate"), ("Política de privacidad.", "boilerplate"),
        ("今天天气很好。", ""), ("A公司今天发布了新的产品和服务内容！", ""), ("今天天气很好", "punctuation"), ("BUY IT ALL NOW!", "shouting"), ("КУПИ ВСЁ СЕЙЧАС!", "shouting"), ("No end to it", "punctuation"),
    ],
)
def test_quality_rules_of_a_line(spark, line, rule):
    df = spark.createDataFrame([(line,)], "line string").select("line", F.lower("line").alias("low"), F.filter(F.split("line", " "), lambda w: w != "").alias("words"))
    assert df.select(quality_rules.line_fails(F.col("line"), F.col("low"), F.col("words"))).first()[0] == rule


def test_quality_classifier(rows, labels):
    out = quality_bayes.quality_classifier(rows, labels, keep_all=True)
    unharmed(rows, out)
    assert out.count() == rows.count()
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[k]["quality_posterior"] == 0 and not got[k]["_quality_keep"] for k in (2, 3, 4))
    assert len({r["quality_posterior"] for r in out.where("doc_id = 1").collect()}) == 1
    none = quality_bayes.quality_classifier(rows, labels.limit(0))
    assert {r["doc_id"] for r in none.collect()} == {1, 5, 6, 7, 8, 9, -3, None}


def classes_of(df):
    out = df.collect()
    assert len({r["doc_id"] for r in out}) == len(out)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out}


def test_ngram_join(rows):
    want = plain.classes([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert classes_of(ngram_join.ngram_join(rows)) == want
    kept = ngram_join.keep_one(rows)
    unharmed(rows, kept)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows.collect() if r["doc_id"] != 6)
    with pytest.raises(ValueError):
        ngram_join.ngram_join(rows, threshold=0)


@pytest.mark.parametrize(("hot", "block", "bytes_"), [(1 << 17, 2048, 64 << 20), (8, 4, 64 << 20), (2, 2048, 2000)])
def test_ngram_join_with_one_footer_in_every_text(spark, monkeypatch, hot, block, bytes_):
    """A third of the rows are one text, another third its near copies, and all end alike; hot n-grams, small blocks and small shards change nothing."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(ngram_join, "ENTRIES_PER_SHARD", 256)
    monkeypatch.setattr(ngram_join, "FLUSH", 512)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    body = [word() for _ in range(40)]
    footer = "all of this may be read and copied by everybody who asks"

    def text(i):
        own = body if i % 3 < 2 else [word() for _ in range(40)]
        if i % 3 == 1:
            own = [word() if rng.random() < 0.06 else w for w in own]
        return " ".join(own) + " " + footer

    table = [(i, text(i)) for i in range(120)] + [(500, None), (501, " "), (502, footer), (503, footer.upper()), (3, text(2) + " with two more words")]
    got = classes_of(ngram_join.ngram_join(spark.createDataFrame(table, "doc_id long, text string"), block=block, hot=hot))
    assert got == plain.classes(table)
    assert sum(n > 30 for _, n in got.values()) > 50


def test_mixing(rows):
    out = mixing.mix_sources(rows, block_tokens=100, shard_slots=16)
    got = out.collect()
    assert {r["source"] for r in got} <= {None, "", "src1", "src3"} and got
    assert sorted(r["doc_id"] for r in got) == list(range(len(got)))
    assert mixing.mix_sources(rows, weights={"none": 1.0}).count() == 0


def test_encoding(rows):
    out = sentencepiece_sampling.sentencepiece_encode(rows, keep_text=True)
    unharmed(rows, out)
    for r in out.collect():
        assert (r["_lossless"] is True and r["_n_pieces"] == len(r["_pieces"])) if r["text"] is not None else (r["_pieces"] is None and r["_lossless"] is None and r["_n_pieces"] == 0)
    back = sentencepiece_sampling.sentencepiece_decode(out, "_pieces")
    assert back.where(~F.col("text").eqNullSafe(F.col("_text"))).count() == 0
    assert len({tuple(r["_pieces"]) for r in out.where("doc_id = 1").collect()}) == 1


def test_suffix_dedup(rows):
    out = suffix_dedup.suffix_dedup(rows, length=4)
    unharmed(rows, out)
    assert out.count() == rows.count()
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["text"] is None and got[3]["text"] == "" and got[7]["text"] == "one"
    assert got[6]["text"] == "" and got[6]["_n_repeated"] == 17


def test_suffix_dedup_with_one_footer_in_every_text(spark):
    """Whether or not the anchors of a passage are too many for a bucket, the same words go."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst")
    footer, other = [word() for _ in range(12)], [word() for _ in range(9)]

    def text(i):
        parts = [[word() for _ in range(rng.randrange(3, 9))], footer if i % 3 else other + footer[:7], [word() for _ in range(2)], *([other, other] if i % 5 == 0 else [])]
        return " ".join(w for p in parts for w in p)

    df = spark.createDataFrame([(i, text(i)) for i in range(60)], "doc_id long, text string")
    want, got = ({r["doc_id"]: (r["text"], r["n_repeated"]) for r in suffix_dedup.suffix_dedup(df, length=6, hot=h).collect()} for h in (1000, 3))
    assert got == want and sum(n > 5 for _, n in got.values()) > 40


def test_pii(rows):
    out = pii.find_pii(rows)
    unharmed(rows, out)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == rows.count()
    assert got[2]["text"] is None and got[2]["_entities"] is None
    assert got[8]["text"].endswith("Mail [EMAIL] now.")
    assert got[3]["_n_entities"] == 0


def test_language_id(rows):
    out = language_id.language_id(rows)
    unharmed(rows, out)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[k]["_lang_id"] == "und" and got[k]["lang_cross_entropy"] is None for k in (2, 3, 4))
    none = language_id.language_id(rows, rows.limit(0))
    assert {r["_lang_id"] for r in none.collect()} == {"und"}


def test_nearest_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [5.0, 5.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [1.0]), (8, [None, 1.0]), (None, [0.0, 0.0]), (9, [inf, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in ("k", "v", "cell", "rank", "neighbor_id")))
    got = [tuple(r) for r in ann.nearest_neighbours(df, k=2).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 0.0), (2, 2, 1, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 1.0)]
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id = 1")).count() == 0


@pytest.mark.parametrize("f", [ngram_join.ngram_join, ngram_join.keep_one, mixing.mix_sources, sentencepiece_sampling.sentencepiece_encode, suffix_dedup.suffix_dedup])
def test_keys_that_are_no_numbers(rows, f):
    with pytest.raises(TypeError, match="whole number"):
        f(rows.withColumn("doc_id", F.lit("a")))


def test_empty_tables(spark, labels):
    none = plain.awkward(spark).limit(0)
    for f in (line_dedup.line_dedup, quality_rules.quality_rules, ngram_join.ngram_join, ngram_join.keep_one, mixing.mix_sources, sentencepiece_sampling.sentencepiece_encode, suffix_dedup.suffix_dedup, pii.find_pii, language_id.language_id):
        assert f(none).count() == 0
    assert quality_bayes.quality_classifier(none, labels).count() == 0


@pytest.mark.parametrize("some", [True, False])
@pytest.mark.parametrize("number", range(5))
def test_stages(spark, labels, rows, tmp_path, number, some):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = plain.awkward(spark)
    docs = docs if some else docs.limit(0)
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, str(tmp_path))
    assert (out.count() > 0) == some
    if number < 4:
        assert out.columns == docs.columns
