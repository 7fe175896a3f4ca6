"""The rule base: merging against a plain one-after-the-other version, and its changes."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.operators import canon, facts, graph

NOW = "2024-05-01 00:00:00"
FACT = "ordinal long, type string, priority string, subject string, predicate string, value string, module string, source string, confidence double"


def make(spark, rows):
    return spark.createDataFrame([(i, "rule", "normal", s, p, v, m, src, 1.0) for i, (s, p, v, m, src) in enumerate(rows)], FACT)


def plain(rules, rows, patterns=()):
    """Rules as [id, subject, predicate, value, status, conflict_with], merged one fact after the other."""
    rules = [list(r) for r in rules]
    for s, p, v, *_ in rows:
        if any(a and a in s and (not b or b in p) for a, b in patterns):
            continue
        like = None
        for r in rules:
            if r[4] not in canon.MATCHED:
                continue
            a, b = (re.sub(r"[\s，。、：:]+", "", x) for x in (r[2], p))
            syn = any((x in a and y in b) or (y in a and x in b) for x, y in X.pairs(X.SYNONYMS))
            if (r[1], r[2]) == (s, p) or ((s in r[1] or r[1] in s) and (a == b or syn)):
                like = r
                break
        number = max([int(r[0][6:]) for r in rules], default=0) + 1
        if like is None:
            rules.append([f"canon_{number:04d}", s, p, v, "active", None])
        elif like[3] == v:
            pass
        elif (v in like[3] or like[3] in v) and not re.fullmatch(r"[\d.,\s]+", v.strip()) and not re.fullmatch(r"[\d.,\s]+", like[3].strip()) and min(len(v), len(like[3])) >= 5:
            like[3] = max(like[3], v, key=len)
        else:
            like[4] = "conflict"
            rules.append([f"canon_{number:04d}", s, p, v, "pending", like[0]])
    return sorted(map(tuple, rules))


def seen(df):
    return sorted((r["id"], r["subject"], r["predicate"], r["value"], r["status"], r["conflict_with"]) for r in df.collect())


def test_merge_by_hand(spark):
    rows = [("VIP等级", "上限为", "15", "m", "a"), ("VIP等级", "上限为", "20", "m", "b"), ("VIP等级", "不超过", "15", "m", "c"), ("商品", "规则为", "仅对新订单生效", "", "a"), ("商品修改", "规则为", "仅对新订单生效，禁止修改", "m", "b")]
    rules, report = canon.merge(spark.createDataFrame([], canon.RULE), make(spark, rows), now=NOW)
    assert seen(rules) == [("canon_0001", "VIP等级", "上限为", "15", "conflict", None), ("canon_0002", "VIP等级", "上限为", "20", "pending", "canon_0001"), ("canon_0003", "商品", "规则为", "仅对新订单生效，禁止修改", "active", None)]
    assert canon.report_counts(report).first().asDict() == {"new_rules": 2, "skipped": 2, "conflicts_detected": 1, "suppressed": 0}
    assert rules.where("id = 'canon_0003'").first()["module"] == "商品"
    again, _ = canon.merge(rules, make(spark, rows[:1]), now=NOW)
    assert seen(again) == seen(rules)


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    words = ["甲", "甲乙", "乙", "丙丁", "丁", "戊己庚", "己", "庚辛"]
    rows = [(rng.choice(words), rng.choice(["上限为", "不超过", "上限 为", "分为", "包括"]), rng.choice(["1", "2", "abcde", "abcdef", "xabcdefx"]), "m", f"s{rng.randrange(3)}") for _ in range(60)]
    patterns = [("辛", "")]
    held = spark.createDataFrame(patterns, "subject string, predicate string")
    rules, _ = canon.merge(spark.createDataFrame([], canon.RULE), make(spark, rows[:30]), held, now=NOW)
    first = plain([], rows[:30], patterns)
    assert seen(rules) == first
    rules, _ = canon.merge(rules, make(spark, rows[30:]), held, now=NOW)
    assert seen(rules) == plain(first, rows[30:], patterns)


@pytest.fixture
def rules(spark):
    rows = [("战斗", "上限为", "背包系统的三倍", "a", "x"), ("背包系统", "分为", "三页", "a", "x"), ("背包系统", "分为", "五页", "b", "y")]
    return canon.merge(spark.createDataFrame([], canon.RULE), make(spark, rows), now=NOW)[0]


def test_dependencies_and_review(spark, rules):
    rules = canon.resolve(rules, "canon_0002", "keep_old", now=NOW)
    edges = canon.inferred_dependencies(rules)
    assert [tuple(r) for r in edges.collect()] == [("canon_0001", "canon_0002")]
    linked = canon.add_dependencies(rules, edges)
    assert canon.inferred_dependencies(linked).count() == 0
    got = {r["id"]: r for r in canon.set_value(linked, "canon_0002", "九页", "why", NOW).collect()}
    assert got["canon_0001"]["status"] == "needs_review"
    assert (got["canon_0002"]["value"], got["canon_0002"]["history"][0]["old_value"]) == ("九页", "三页")
    with pytest.raises(ValueError):
        canon.set_value(linked, "canon_0099", "x")


def test_resolve(rules):
    assert seen(canon.resolve(rules, "canon_0002", "accept_new", now=NOW))[1][3:] == ("五页", "active", None)
    assert seen(canon.resolve(rules, "canon_0002", "set_value", "七页", NOW))[1][3:] == ("七页", "active", None)
    assert len(seen(canon.resolve(rules, "canon_0002", "keep_old"))) == 2
    with pytest.raises(ValueError):
        canon.resolve(rules, "canon_0002", "set_value")
    with pytest.raises(ValueError):
        canon.resolve(rules, "canon_0001", "accept_new")


def test_conflicts_deprecation_and_log(spark, rules):
    pair = canon.conflict_pairs(rules).first()
    assert (pair["old_id"], pair["new_id"], pair["category"]) == ("canon_0002", "canon_0003", "cross_doc_contradiction")
    empty = spark.createDataFrame([], "subject string, predicate string, reason string, added_at timestamp")
    after, patterns = canon.deprecate(rules, "canon_0001", empty, NOW)
    assert {r["id"]: r["status"] for r in after.collect()}["canon_0001"] == "deprecated"
    assert patterns.count() == 1
    assert canon.add_suppressions(patterns, patterns.select("subject", "predicate", "reason"), NOW).count() == 1
    log = canon.log_rows(rules, after, "t", NOW).collect()
    assert [(r["action"], r["rule_id"]) for r in log] == [("deprecated", "canon_0001")]
    lines = [r["line"] for r in canon.export_lines(rules).collect()]
    assert lines[0] == "## a" and "### rule" in lines
    stored = spark.createDataFrame([("s", "x"), ("t", "y")], "subject string, source string")
    cut, left = canon.purge(rules, stored, spark.createDataFrame([("x",)], "source string"), NOW)
    assert left.count() == 1 and cut.where("status = 'deprecated'").count() == 1


def test_numbers_are_in_order_across_partitions(spark):
    df = spark.range(1000, numPartitions=7).withColumn("v", F.hash("id"))
    got = canon.numbered(df, ["v"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_greedy_dedup_equals_a_plain_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), "".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, 4))), rng.choice(["为", "上限为", "上限"]), str(i), 1.0, "s") for i in range(80)]
    kept = []
    for o, t, s, p, *_ in rows:
        def alike(k):
            _, t2, s2, p2 = k
            short = min(s, s2, key=len)
            if t != t2 or (s not in s2 and s2 not in s) or len(short) < 2:
                return False
            return p == p2 or (min(len(p), len(p2)) >= 2 and (p in p2 or p2 in p))
        if not any(map(alike, kept)):
            kept.append((o, t, s, p))
    df = spark.createDataFrame(rows, "ordinal long, type string, subject string, predicate string, value string, confidence double, source string")
    got = facts.semantic_dedup(df, dedup="subject_predicate")
    assert sorted(r["ordinal"] for r in got.collect()) == [k[0] for k in kept]


def test_suppressions_too_many_to_broadcast(spark, monkeypatch):
    f = spark.createDataFrame([(1, "VIP等级", "上限为"), (2, "背包", "分为"), (3, None, "x"), (4, "包", None), (5, "背包格", "上限为"), (6, "别的", "为")], "ordinal int, subject string, predicate string")
    p = spark.createDataFrame([("VIP", ""), ("包", "上限"), ("", "为"), (None, None), ("背", "分"), ("背", "分")], "subject string, predicate string")
    want = [sorted(r["ordinal"] for r in g(f, p).collect()) for g in (canon.suppressed, canon.unsuppressed)]
    assert want == [[1, 2, 5], [3, 4, 6]]
    monkeypatch.setattr(graph, "BROADCAST_LIMIT", 0)
    assert [sorted(r["ordinal"] for r in g(f, p).collect()) for g in (canon.suppressed, canon.unsuppressed)] == want


def test_long_folds_are_indexed(spark):
    """A thousand facts whose subjects all hold one short subject, against the plain fold over all rules."""
    rng = random.Random(2)
    rows = [{"kind": 1, "o": i, "subject": rng.choice(["包", "背包", "包裹", "大背包", "书"]) + rng.choice(["", "甲", "乙"]), "predicate": rng.choice(["上限为", "最高为", "分为", "包括", "为"]), "value": rng.choice(["1", "2", "很长的一个值", "很长的一个值和更多"]), "module": "m"} for i in range(400)]
    known, want = [], []
    for r in rows:
        like = next((k for k in known if canon.similar(k["subject"], k["predicate"], r["subject"], r["predicate"])), None)
        if like is None:
            known.append(dict(r))
            want.append("added")
        elif like["value"] == r["value"]:
            want.append("skipped")
        elif canon._mergeable(like["value"], r["value"]):
            like["value"] = max(like["value"], r["value"], key=len)
            want.append("skipped")
        else:
            want.append("conflict")
    got = [x for x in canon.fold(rows) if x["outcome"] != "rule"]
    assert [x["outcome"] for x in sorted(got, key=lambda x: x["born"])] == want
