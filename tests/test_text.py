"""Scalar functions, by cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loregrid.functions import text as X


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]




def test_ids(spark):
    import hashlib

    assert one(spark, X.chunk_id(F.col("s"), F.col("i")), s="模块/甲.md", i=3) == hashlib.md5("模块/甲.md".encode()).hexdigest()[:10] + "_3"
    assert one(spark, X.fact_id(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a="rule", b="甲", c=None, d="1") == "fact_" + hashlib.md5("rule|甲||1".encode()).hexdigest()[:12]
    assert one(spark, X.cache_key(F.col("t"), "v4", F.lit("其他")), t="x") == hashlib.sha256("v4:其他:x".encode()).hexdigest()[:16]


@pytest.mark.parametrize(("path", "module"), [
    ("甲系统/战斗 - 前端设计.md", "战斗"), ("商城—说明.md", "商城"), ("商城–说明.md", "商城"), ("活动/doc/需求.md", "活动"), ("doc/需求[xlsx转换].md", "需求"), ("a—b-c.md", "a—b"), ("需求.md", "需求"),
])
def test_module(spark, path, module):
    assert one(spark, X.module_name(F.col("p")), p=path) == module


def test_paths(spark):
    p = F.col("p")
    assert one(spark, X.indexable(p), p="a/b.md")
    assert not one(spark, X.indexable(p), p="a/build/b.md")
    assert not one(spark, X.indexable(p), p="a/动效需求x.md")
    assert not one(spark, X.indexable(p), p="参考方案/x.md")
    assert one(spark, X.doc_type(p), p="x/甲-前端设计.md") == "前端设计文档"
    assert one(spark, X.doc_type(p), p="x/甲.md") == "其他"
    assert one(spark, X.tags(p), p="甲-前端设计.md") == ["前端", "设计"]
    assert one(spark, X.short_path(p), p="/kb/md_file/a/b.md") == "a/b.md"
    assert one(spark, X.short_path(p), p="x/a/b.md") == "a/b.md"
    assert one(spark, X.remap_prefix(p, "/kb", "/new"), p="/kb/a") == "/new/a"
    assert one(spark, X.remap_prefix(p, "/kb", "/new"), p="/kb2/a") == "/kb2/a"
    assert one(spark, X.converted_path(p), p="d/表.xlsx") == "表/表[xlsx转换].md"
    assert one(spark, X.safe_name(p), p=' a/b:c* ') == "a_b_c"
    assert one(spark, X.relative(p, "/kb"), p="/kb\\a\\b.md") == "a/b.md"


def test_markdown(spark):
    t = F.col("t")
    assert one(spark, X.first_heading(t), t="x\n# # 甲 乙\n") == "甲 乙"
    assert one(spark, X.first_heading(t), t="x") == ""
    got = one(spark, X.sections(t), t="前言\n## 一\n内容\n### 细\nx\n## 二\n\n尾")
    assert [(r["title"], r["content"]) for r in got] == [("", "前言"), ("一", "## 一\n\n内容\n### 细\nx"), ("二", "## 二\n\n尾")]
    assert one(spark, X.cross_refs(t), t="战斗依赖「背包系统」，参考商城系统。") == ["参考商城系统", "商城系统", "背包系统"]
    assert one(spark, X.low_quality(t), t="# 标题\n---\n> 引用\n短") is True
    assert one(spark, X.unfenced(t), t='```json\n{"a": 1}\n```') == '{"a": 1}'


def test_queries(spark):
    t = F.col("t")
    assert one(spark, X.entities(t, ["商城"]), t='P01 和 SKL_001 在“背包”与"任务"的商城 P01') == ["P01", "SKL_001", "任务", "背包", "商城"]
    assert one(spark, X.query_type(t), t="商城依赖哪些模块") == "relation"
    assert one(spark, X.query_type(t), t="关于商城") == "explore"
    assert one(spark, X.query_type(t), t="VIP上限") == "precise"
    assert one(spark, X.sub_queries(t), t="月卡对比季卡") == ["月卡", "季卡"]
    assert one(spark, X.sub_queries(t), t="月卡") == ["月卡"]
    assert one(spark, X.sub_queries(t), t="商城的购买流程是什么样子的；另外背包容量的上限是多少呢") == ["商城的购买流程是什么样子的", "另外背包容量的上限是多少呢"]
    assert one(spark, X.highlight(t, F.lit("dragon of")), t="The dragon sleeps。Nothing here\nA Dragon") == "**The dragon sleeps**。Nothing here。**A Dragon**"
    assert one(spark, X.highlight(t, F.lit("x")), t="a\nb") == "a\nb"


def test_facts(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, X.mergeable_values(a, b), a="仅对新订单生效", b="仅对新订单生效，禁止修改")
    assert not one(spark, X.mergeable_values(a, b), a="10000", b="100000")
    assert not one(spark, X.mergeable_values(a, b), a="月卡", b="月卡年卡")
    assert one(spark, X.synonymous(a, b), a="上限为", b="不超过")
    assert one(spark, X.low_value(a), a="列表 默认显示 近7天")
    assert one(spark, X.fallback_priority(F.lit("constraint"), a, b), a="上限为", b="15") == "critical"
    assert one(spark, X.fallback_priority(F.lit("enum"), a, b), a="上限为", b="15") == "normal"
    assert [one(spark, X.is_numeric(a), a=x) for x in ("1,000", "50%", "¥3.5", "x", "", "1e3")] == [True, True, True, False, False, True]
    assert one(spark, X.dedup_predicate(a), a="上限 为：—-！") == "上限为"
    assert one(spark, X.rule_predicate(a), a="上限 为：！") == "上限为！"
    assert one(spark, X.humanized_age(F.lit(3700))) == "1小时"


@pytest.mark.parametrize(("data", "kind"), [(b"\x89PNG....", "png"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"GIF89a", "gif"), (b"BM1234", "bmp"), (b"RIFF0000WEBP", "webp"), (b"??", "png")])
def test_images(spark, data, kind):
    assert one(spark, X.image_kind(F.col("d")), d=bytearray(data)) == kind
