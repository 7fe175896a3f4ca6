from __future__ import annotations

import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from loregrid.functions import text as X
from loregrid.operators.chunking import batch_numbers, bounded, chunk_documents, chunks_of, heading_parts, pack, token_batches

LONG = "这是一段足够长的正文，" * 40


def test_sections_keep_their_headings():
    assert heading_parts("pre\n## A\nx\n## B\n\ny", 2) == [("", "pre"), ("A", "## A\n\nx"), ("B", "## B\n\ny")]
    assert heading_parts("", 2) == []


def test_overlap_is_whole_trailing_pieces():
    a, b, c = "a" * 700, "b" * 150, "c" * 700
    assert pack([a, b, c], 1500, "\n\n", 200) == [f"{a}\n\n{b}", f"{b}\n\n{c}"]
    assert pack([a, "b" * 199, c], 1500, "\n\n", 200) == [f"{a}\n\n{'b' * 199}", c]


def test_short_chunks_join_the_next_and_the_last_joins_the_one_before():
    body = f"# 甲\n\n## 一\n\n短\n\n## 二\n\n{LONG}\n\n## 三\n\n尾"
    got = chunks_of(body)
    assert len(got) == 1
    assert got[0][0] == "二"
    assert got[0][1] == "甲 > 二"
    assert got[0][2].startswith("# 甲") and got[0][2].endswith("尾")


def test_translation_tables_are_left_out():
    assert chunks_of(f"## 多语言表\n\n{LONG}\n\n## 一\n\n{LONG}")[0][0] == "一"
    assert chunks_of(f"## x\n\n| ID | CN（简体中文） |\n{LONG}") == []


def test_long_sections_go_by_third_headings():
    got = chunks_of(f"# T\n## A\n### a\n{LONG * 2}\n### b\n{LONG * 2}")
    assert [x[0] for x in got] == ["A > a", "A > b"]
    assert got[1][1] == "T > A > b"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=900), max_size=12).map("\n\n".join))
def test_pieces_are_bounded_and_nothing_is_lost(body):
    parts = list(bounded(body))
    assert all(len(p) <= X.MAX_CHUNK for p in parts)
    assert "".join(body.split()) in "".join("".join(parts).split()) or len(parts) > 1
    solid = sum(len("".join(p.split())) for p in parts)
    assert solid >= len("".join(body.split()))


def test_chunk_table(spark):
    docs = spark.createDataFrame([("模块/甲-需求.md", f"# 甲\r\n\r\n## 一\r\n\r\n{LONG}\r\n\r\n## 二\r\n\r\n{LONG}"), ("e.md", ""), ("n.md", None)], "source string, text string")
    rows = chunk_documents(docs).orderBy("chunk_index").collect()
    assert [(r["section"], r["chunk_index"], r["total_chunks"]) for r in rows] == [("一", 0, 2), ("二", 1, 2)]
    assert rows[0]["module"] == "甲" and rows[0]["tags"] == ["需求"] and "\r" not in rows[0]["text"]


def test_batches(spark):
    assert batch_numbers([10] * 17) == [0] * 16 + [1]
    assert batch_numbers([4000, 3000, 1, 7000, 7000]) == [0, 0, 1, 2, 3]
    assert batch_numbers([]) == []
    rows = [("a", i, "x" * n) for i, n in enumerate((5000, 5000, 20000, 10, 9000))] + [("b", 0, "y")]
    got = token_batches(spark.createDataFrame(rows, "g string, i int, text string"), "g", "i").orderBy("g", "i").collect()
    tokens = [r["tokens"] for r in got if r["g"] == "a"]
    assert [r["batch"] for r in got if r["g"] == "a"] == batch_numbers(tokens)


@pytest.mark.parametrize("block", [16, 20, 50, 1 << 16])
def test_token_batches_in_blocks(spark, block):
    rng = random.Random(block)
    sizes = {"a": 203, "b": 1, "c": 16, "d": 51, None: 40}
    rows = [(g, i, "x" * rng.choice([0, 3, 900, 4000, 9000])) for g, n in sizes.items() for i in range(n)] + [("e", 0, None)]
    got = token_batches(spark.createDataFrame(rows, "g string, i int, text string"), "g", "i", block=block).collect()
    assert len(got) == len(rows)
    for g in sizes:
        mine = sorted((r["i"], r["tokens"], r["batch"]) for r in got if r["g"] == g)
        assert [b for _, _, b in mine] == batch_numbers([t for _, t, _ in mine])
