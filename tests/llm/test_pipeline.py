"""The pipeline's stages against plain versions, each on what the one before it kept."""

from __future__ import annotations

from llm import plain

import corpus_pipeline
from loregrid.llm import quality_bayes
from loregrid.llm import sentencepiece_sampling as sp

SMALL = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mix_sources", "sentencepiece"]
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    good = stages["quality_classifier"](spark, docs, SMALL).persist()
    judged = quality_bayes.quality_classifier(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), keep_all=True).collect()
    assert set(rows(good)) == {r["doc_id"] for r in judged if r["quality_posterior"] >= 0.5} and len(rows(good)) < docs.count()

    once = stages["line_dedup"](spark, good, SMALL).persist()
    want = {k: t for k, t, _, _ in plain.line_dedup([(r["doc_id"], r["text"]) for r in good.collect()])}
    assert {k: r["text"] for k, r in rows(once).items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in once.collect())

    apart = stages["ngram_jaccard_join"](spark, once, SMALL).persist()
    group = plain.classes([(r["doc_id"], r["text"]) for r in once.collect()])
    assert set(rows(apart)) == {k for k in want if group[k][0] == k}

    mixed = stages["mix_sources"](spark, apart, SMALL).persist()
    words = {w for r in apart.collect() for w in plain.words(r["text"])}
    assert all(set(plain.words(r["text"])) <= words for r in mixed.collect())

    coded = stages["sentencepiece"](spark, mixed, SMALL)
    back = {r["doc_id"]: r["text"] for r in sp.sentencepiece_decode(coded).collect()}
    assert back == {k: r["text"] for k, r in rows(mixed).items()}

    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, ((r["doc_id"], tuple(r["pieces"])) for r in whole.collect()))) == sorted((r["doc_id"], tuple(r["pieces"])) for r in coded.collect())
