"""What must not grow with repeats and small files: how many rows meet, how many tasks run, how much a task holds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from loregrid.operators import canon, chunking, facts, graph
from loregrid.plans import queries
from loregrid.sources import files
from loregrid.sources.tables import Tables


def test_facts_of_one_subject_are_compared_once(spark, monkeypatch):
    """a thousand statements of one name are one row when names are compared."""
    rows = [(i, "rule", ("甲乙", "甲乙丙", "书")[i % 3], "为", str(i), 1.0, "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "ordinal long, type string, subject string, predicate string, value string, confidence double, source string")
    met = []
    rounds = facts.greedy_survivors
    monkeypatch.setattr(facts, "greedy_survivors", lambda nodes, pairs: met.append((nodes.count(), pairs.count())) or rounds(nodes, pairs))
    got = facts.semantic_dedup(df, dedup="subject_predicate")
    assert sorted(r["ordinal"] for r in got.collect()) == [0, *range(2, 3000, 3)]  # a name of one character is alike to none
    assert met == [(2, 1)]


def test_repeated_facts_are_dropped_before_they_meet(spark):
    """both sides are reduced to what differs; the join is of two statements with three, not of 3000 with 3000."""
    rows = [("甲", "为", str(i % 2), f"s{i % 3 // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "subject string, predicate string, value string, source string")
    got = facts.consistency(df, df)
    assert sorted((r["new_value"], r["existing_value"], r["existing_source"]) for r in got.collect()) == [("0", "1", "s0"), ("0", "1", "s1"), ("1", "0", "s0"), ("1", "0", "s1")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join ") :].count("Aggregate") == 2


def test_lines_are_taken_apart_once(spark):
    """F6, and the index runs of F3, F4, F7 and F8: no filter further down makes the cleaned line again, and only lines that may say something are cleaned."""
    df = spark.createDataFrame([("a.md", "m", 0, "- 甲上限为：3。\n乙\n上限为4\n> 丙必须做|")], "source string, module string, chunk_index int, text string")
    got = facts.extract(df)
    assert [(r["subject"], r["predicate"], r["value"], r["ordinal"]) for r in got.orderBy("ordinal").collect()] == [("甲", "上限为", "3", 1), ("丙", "必须", "做", 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"^([-*#>|\d.、\s]+)") == 1


def test_a_small_file_is_read_by_all_cores(spark, tmp_path):
    """a file that one task would read is spread before its rows are worked on."""
    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.rdd.getNumPartitions() == 1
    assert graph.spread(table).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    many = spark.range(10, numPartitions=16)
    assert graph.spread(many) is many


def test_a_batch_is_cut_into_pieces_of_bounded_texts():
    """A worker holds the chunks of a few texts, not of the ten thousand in a batch."""
    texts = ["a" * 40, "b" * 40, None, "c" * 500, "", "d" * 100, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = [p.column("text").to_pylist() for p in chunking.sliced(batch, "text", 100)]
    assert parts == [["a" * 40, "b" * 40, None], ["c" * 500], ["", "d" * 100], ["e"]]
    assert list(chunking.sliced(batch.slice(0, 0), "text")) == []


def test_chunks_leave_a_worker_by_the_slice(spark, monkeypatch):
    """The result is the same, however a batch is cut; a text that is missing or empty has no chunk."""
    rows = [(f"d{i % 3}/m{i}.md", None if i == 5 else "" if i == 6 else f"# t\n\n## 一\n\n依赖背包系统。{'x' * 900 * (i % 5)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "source string, text string").coalesce(1)
    want = sorted(map(repr, chunking.chunk_documents(docs, now="2024-01-01 00:00:00").collect()))
    monkeypatch.setattr(chunking, "sliced", lambda batch, column, cut=chunking.sliced: cut(batch, column, 1))
    assert sorted(map(repr, chunking.chunk_documents(docs, now="2024-01-01 00:00:00").collect())) == want
    assert len(want) > 40


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """the number of tasks doesn't grow with the number of files, and a bucket of chunks is one file."""
    for i in range(600):
        (tmp_path / f"f{i}.md").write_text("x")
    found = files.scan(spark, str(tmp_path), "*.md")
    assert found.count() == 600
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert "content" not in found.drop("content")._jdf.queryExecution().executedPlan().toString()
    kept = Tables(spark, str(tmp_path / "tables"))
    kept.write("t", spark.range(1000, numPartitions=20).withColumn("source", F.col("id").cast("string")), "source", 4)
    assert len(list((tmp_path / "tables").rglob("*.parquet"))) == 4
    assert kept.read("t").count() == 1000


def test_passages_are_met_by_source(spark):
    """rules with a source meet its passages by an equal key; those without one meet all."""
    rules = spark.createDataFrame([("canon_0001", "甲", "为", "1", "a.md", "conflict", None), ("canon_0002", "甲", "为", "2", "unknown", "pending", "canon_0001")], "id string, subject string, predicate string, value string, source string, status string, conflict_with string")
    chunks = spark.createDataFrame([("a.md", 0, "x\n甲为1"), ("b.md", 0, "甲为2"), ("unknown", 0, "y")], "source string, chunk_index int, text string")
    got = canon.with_context(canon.conflict_pairs(rules), chunks)
    assert [(r["old_context"], r["new_context"]) for r in got.collect()] == [("甲为1", "甲为1")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert " OR s_source#" not in plan


def test_search_cuts_and_embeds_once(spark):
    """nothing that Python makes is made again for the vocabulary, the two recalls and the candidates."""
    found = queries.QUERIES["search"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and "ArrowEval" not in plan
    assert found.count() > 0
