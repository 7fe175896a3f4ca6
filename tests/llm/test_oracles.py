from __future__ import annotations

import pytest
from oracle import same

import __spark_entry__
from loregrid.llm import ngram_join, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), SMALL, queries.ORACLES[name])


def test_join_in_blocks_equals_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    same(ngram_join.ngram_join(docs, block=2), SMALL, queries.ORACLES["op3_ngram_jaccard_join"])


def test_eleven_queries():
    assert sorted({n.split("_")[0] for n in ("pipeline", *queries.QUERIES) if n in __spark_entry__.queries()}) == sorted(["pipeline", *(f"op{i}" for i in range(1, 11))])
