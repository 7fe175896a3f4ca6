"""The whole: files to tables to answers, in a temporary folder."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_sheets import book, page

from loregrid.operators import canon, changes, facts, graph, search
from loregrid.plans import remap, render
from loregrid.plans.api import KnowledgeBase
from loregrid.sources import chunk_store, files
from loregrid.sources.tables import Tables
from loregrid.streaming.ingest import index_new

FILLER = "背景说明文字，没有什么特别之处，只是为了让段落足够长。" * 16


@pytest.fixture
def kb(spark, tmp_path):
    (tmp_path / "md_file/商城").mkdir(parents=True)
    (tmp_path / "original_file").mkdir()
    (tmp_path / "md_file/商城/商城 - 需求.md").write_text(f"# 商城\n\n## 规则\n\nVIP等级上限为15。\n依赖背包系统。\n{FILLER}\n\n## 流程\n\n购买流程 dragon。{FILLER}", encoding="utf-8")
    (tmp_path / "md_file/背包系统-设计.md").write_text(f"# 背包\n\n## 容量\n\nVIP等级上限为20。\n{FILLER}", encoding="utf-8")
    (tmp_path / "md_file/坏.md").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "original_file/表.xlsx").write_bytes(book({"配置": page([["名", "值"], ["甲", 1]])}))
    return KnowledgeBase(spark, files.Settings(str(tmp_path), str(tmp_path / "md_file"), str(tmp_path / "original_file"), str(tmp_path / "data")))


def test_life_of_a_knowledge_base(kb, tmp_path):
    report = kb.index()
    assert (report["files_new"], report["converted"]) == (4, 1)
    assert report["errors"] == [("坏.md", "not UTF-8")]
    assert (tmp_path / "md_file/表/表[xlsx转换].md").exists()
    assert {r["source"] for r in kb.chunks.select("source").collect()} == {"商城/商城 - 需求.md", "背包系统-设计.md", "表/表[xlsx转换].md"}
    assert kb.meta.count() == 3
    assert {r["status"]: r["value"] for r in kb.rules.where("subject = 'VIP等级'").collect()} == {"conflict": "15", "pending": "20"}

    best = kb.search("dragon", top_k=1, include_context=True, multi_hop=True).first()
    assert best["section"] == "流程" and best["context"]["prev"] and "**" in best["highlight"]
    assert kb.search("VIP等级", target="facts", fact_type="constraint").first()["subject"] == "VIP等级"
    assert [(r["from"], r["to"]) for r in kb.relations().collect()] == [("商城", "背包系统")]
    assert {r["module"]: r["hops"] for r in kb.related_designs("背包系统").collect()} == {"背包系统": 0, "商城": 1}
    assert kb.audit().first()["subject"] == "VIP等级"
    assert kb.check("# x\n\nVIP等级上限为99。", mode="full")["status"] == "conflicts_found"
    assert kb.check("无事。", mode="consistency")["status"] == "ok"
    assert kb.suggest("流")["suggestion"] is not None
    assert kb.overview("stats").first()["conflict_rules"] == 1
    assert kb.overview("changes").count() == 3
    assert kb.document("md_file/背包系统-设计.md").count() == 1
    assert kb.preview_facts("背包系统-设计.md")[0].count() == 1

    for text in (render.search_results("q", kb.search("dragon", include_context=True)), render.modules(kb.modules()), render.rules(kb.canon("get")), render.conflicts(kb.canon("classify")), render.canon_status(kb.canon("status"), kb.canon("classify")),
                 render.audit(kb.audit()), render.relations(kb.relations()), render.related("x", kb.related_designs("背包系统")), render.check(kb.check("VIP等级上限为99。")), render.overview_stats(kb.overview("stats").first().asDict()), render.changes(kb.overview("changes")),
                 render.gaps(changes.status_counts(kb.status()), kb.overview("gaps")), render.index_result("full", report), render.facts("f", kb.facts), render.draft("t", kb.draft_assist("VIP")["guidance"], "r")):
        assert text.startswith("## ")

    assert kb.index()["chunks"] == 0
    rules = kb.canon("resolve_conflict", rule_id=kb.rules.where("status = 'conflict'").first()["id"], new_value="18")
    assert {r["status"]: r["value"] for r in rules.where("subject = 'VIP等级'").collect()} == {"active": "18"}

    (tmp_path / "md_file/背包系统-设计.md").unlink()
    again = kb.index()
    assert again["files_removed"] == 1
    assert kb.chunks.where("source = '背包系统-设计.md'").count() == 0
    gaps = {r["dst"]: r["status"] for r in kb.overview("gaps").collect()}
    assert gaps["商城/商城 - 需求.md"] == "orphan_md"
    assert kb.cleanup()["dry_run"] and (tmp_path / "md_file/商城/商城 - 需求.md").exists()
    kb.index("cleanup", confirm=True)
    assert not (tmp_path / "md_file/商城/商城 - 需求.md").exists()
    assert {r["source"] for r in kb.chunks.select("source").collect()} == {"表/表[xlsx转换].md"}
    assert kb.log.count() > 3 and kb.canon("log", days=1).count() == kb.log.count()


def test_tables_swap_versions(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read("a")
    assert t.read("a", "x int").count() == 0
    t.write("a", spark.range(3))
    held = t.read("a")
    t.write("a", held.where("id > 0"))
    assert (held.count(), t.read("a").count()) == (3, 2)
    t.append("a", spark.range(5))
    assert t.read("a").count() == 7
    rows = lambda *x: spark.createDataFrame(list(x), "source string, v int")
    t.write("b", rows(("a", 1), ("b", 2)))
    assert sorted(map(tuple, t.replace_sources("b", rows(("a", 3)), rows(("a", 0))).collect())) == [("a", 3), ("b", 2)]


def test_a_write_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    t = Tables(spark, str(tmp_path / "t"))
    t.write("a", spark.range(3))
    for step in ("_put", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(Tables, step, lambda *x: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                t.write("a", spark.range(9))
        assert t.read("a").count() == 3
    with monkeypatch.context() as m:  # the manifest is there, the old folders are not yet gone
        m.setattr(Tables, "_clear", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            t.write("a", spark.range(5))
    assert t.read("a").count() == 5
    t.write("a", spark.range(7))
    assert t.restore("a", t.version("a") - 1).count() == 5
    with pytest.raises(OSError, match="another job"):
        t._commit("a", 1, {})
    assert t.read("a").count() == 5


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    rows = lambda pairs: spark.createDataFrame(list(pairs), "source string, v int")
    t.replace_sources("c", rows((f"s{i}", i) for i in range(200)), rows([]), buckets=16)
    before = t._manifest("c", t.version("c"))["parts"]
    assert len(before) == 16
    after = t.replace_sources("c", rows([("s7", 700), ("s7", 701)]), rows([("s7", 0), ("s9", 0)]))
    parts = t._manifest("c", t.version("c"))["parts"]
    assert 14 <= sum(parts[b] == before[b] for b in before) < 16
    want = sorted([(f"s{i}", i) for i in range(200) if i not in (7, 9)] + [("s7", 700), ("s7", 701)])
    assert sorted(map(tuple, after.collect())) == want
    assert sorted(map(tuple, t.of_sources("c", rows([("s7", 0), ("s1", 0), ("none", 0)])).collect())) == [("s1", 1), ("s7", 700), ("s7", 701)]
    t.append("c", rows([("s7", 5), ("new", 6)]))
    t.replace_sources("c", rows([]), rows([("s7", 0)]))
    assert sorted(map(tuple, t.read("c").collect())) == sorted([x for x in want if x[0] != "s7"] + [("new", 6)])


def test_the_vocabulary_follows_the_chunks(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame([(s, b) for s, b in x], "source string, text string")
    whole = lambda df: sorted(map(tuple, df.collect()), key=str)
    for made in (rows(("a", "one two two"), ("b", "two three"), ("c", "four")), rows(("a", "one five")), rows(("d", "six six"), ("b", "")), rows(("e", "x"))):
        chunk_store.replace_chunks(t, made, made.select("source").union(spark.createDataFrame([("c",)], "source string")) if made.count() < 3 else made.select("source"))
        assert whole(chunk_store.vocabulary_of(t)) == whole(search.vocabulary(t.read("chunks")))
    t.append("chunks", rows(("z", "late")))
    assert chunk_store.vocabulary_of(t) is None


def test_models_see_what_is_new_only(spark, tmp_path):
    (tmp_path / "md_file").mkdir()
    asked, formatted = [], []

    def extract(chunks):
        asked.append(sorted(r["text"][:9] for r in chunks.collect()))
        return facts.extract(chunks)

    settings = files.Settings(str(tmp_path), str(tmp_path / "md_file"), str(tmp_path / "original_file"), str(tmp_path / "data"))
    kb = KnowledgeBase(spark, lambda: settings, extract=extract, formatter=lambda *x: formatted.append(x) or "| made |")
    write = lambda name, value: (tmp_path / "md_file" / name).write_text(f"# {name}\n\n## 规则\n\n等级上限为{value}。\n{FILLER}", encoding="utf-8")
    write("a.md", 1), write("b.md", 2)
    kb.index()
    assert len(asked[0]) == 2 and kb.facts.where("embedding IS NULL").count() == 0
    write("b.md", 33)
    assert kb.index()["chunks"] == 1
    assert asked[1] == ["# b.md\n\n#"] and sorted(r["value"] for r in kb.facts.collect()) == ["1", "33"]
    write("b.md", 2)
    kb.index()
    assert asked[2] == [] and sorted(r["value"] for r in kb.facts.collect()) == ["1", "2"]
    assert kb.tables.read("embedding_cache").count() == 3
    assert kb.search("等级", target="facts").first()["subject"] == "等级"
    assert "embedding" not in kb.search("等级", target="facts").columns

    for path in ("a.md", "md_file/a.md", "md_file\\a.md", str(tmp_path / "md_file/a.md")):
        assert [r["source"] for r in kb.document(path).collect()] == ["a.md"]
    (tmp_path / "else.md").write_text("elsewhere", encoding="utf-8")
    assert kb.document(str(tmp_path / "else.md")).first()["text"] == "elsewhere"
    assert kb.document(str(tmp_path / "none.md")).count() == 0

    (tmp_path / "original_file/x/resources").mkdir(parents=True)
    (tmp_path / "original_file/x/resources/p.png").write_bytes(b"\x89PNG")
    (tmp_path / "original_file/表.xlsx").write_bytes(book({"配置": page([["名", "值"], ["甲", 1]])}))
    report = kb.index()
    assert report["resources"] == 1 and (tmp_path / "md_file/x/resources/p.png").read_bytes() == b"\x89PNG"
    assert "| made |" in (tmp_path / "md_file/表/表[xlsx转换].md").read_text(encoding="utf-8")
    assert kb.index()["resources"] == 0

    before = {r["path"] for r in kb.meta.collect()}
    assert remap.main(["--config", str(tmp_path / "none.json"), "--from", "表", "--to", "新", "--dry-run"], spark) == 0
    kb.remap("新", "表", dry_run=False)
    assert {r["path"] for r in kb.meta.collect()} == {p.replace("表/", "新/") for p in before}
    held = {r["source"] for r in kb.facts.collect()}
    with pytest.MonkeyPatch.context() as m:
        real = Tables.write
        m.setattr(Tables, "write", lambda self, name, *x, **y: (_ for _ in ()).throw(OSError("full")) if name == "facts" else real(self, name, *x, **y))
        with pytest.raises(OSError, match="full"):
            kb.remap("旧", "新", dry_run=False)
    assert {r["path"] for r in kb.meta.collect()} == {p.replace("表/", "新/") for p in before} and {r["source"] for r in kb.facts.collect()} == held


def test_what_another_installation_left(spark, tmp_path):
    (tmp_path / "index_meta.json").write_text('{"a.md": {"mtime": 1.5, "size": 3, "indexed_at": "2024-01-02T03:04:05"}}')
    (tmp_path / "canon.json").write_text('{"rules": [{"id": "canon_0001", "type": "rule", "subject": "s", "predicate": "p", "value": "1", "status": "active", "added_at": "2024-01-02T00:00:00", "history": [{"old_value": "0", "new_value": "1", "changed_at": "bad", "reason": "r"}]}]}')
    (tmp_path / "canon_changelog.json").write_text('{"entries": [{"timestamp": "2024-01-02T00:00:00", "action": "added", "rule_id": "canon_0001"}]}')
    (tmp_path / "canon_suppressions.json").write_text("{broken")
    kb = KnowledgeBase(spark, files.Settings(str(tmp_path), str(tmp_path / "md"), str(tmp_path / "o"), str(tmp_path / "data")))
    assert kb.import_json(str(tmp_path)) == {"index_meta": 1, "rules": 1, "changelog": 1, "suppressions": 0}
    r = kb.rules.first()
    assert (r["confidence"], r["dependents"], r["history"][0]["old_value"], str(r["added_at"])[:10]) == (0.5, [], "0", "2024-01-02")
    assert kb.canon("update_value", rule_id="canon_0001", new_value="2").first()["value"] == "2"
    assert kb.log.count() == 2


def test_conflicts_show_their_passages(spark):
    chunks = spark.createDataFrame([("a.md", 0, "start\nmore"), ("a.md", 1, "no\n  VIP is 15 here  \nVIP again"), ("b.md", 0, "nothing to see"), ("c.md", 0, "x" * 300)], "source string, chunk_index int, text string")
    pairs = spark.createDataFrame([("n1", "VIP", "15", "a.md", "VIP", "20", "b.md", 1), ("n2", "q", "z", "c.md", "VIP", "again", "unknown", 2)], "new_id string, old_subject string, old_value string, old_source string, new_subject string, new_value string, new_source string, rank int")
    got = {r["new_id"]: (r["old_context"], r["new_context"]) for r in canon.with_context(pairs, chunks).collect()}
    assert got == {"n1": ("VIP is 15 here", "nothing to see"), "n2": ("x" * 200 + "...", "VIP is 15 here")}


def test_streamed_files_are_indexed_once(spark, tmp_path):
    root, t = tmp_path / "md", Tables(spark, str(tmp_path / "t"))
    root.mkdir()
    (root / "a.md").write_text(f"# A\n\n{FILLER}", encoding="utf-8")
    run = lambda: index_new(spark, str(root), t, str(tmp_path / "c")).awaitTermination()
    run()
    assert t.read("chunks").count() == 1
    (root / "b.md").write_text(f"# B\n\n{FILLER}", encoding="utf-8")
    run()
    run()
    assert sorted(r["source"] for r in t.read("chunks").collect()) == ["a.md", "b.md"]
    words = {r["term"]: r["df"] for r in chunk_store.vocabulary_of(t).collect()}
    assert (words[None], words["a"], words["b"]) == (2, 1, 1)


def test_json_sources(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"a.md": {"mtime": 1.5, "size": 3}}')
    assert [tuple(r) for r in files.json_map(spark, str(p), "mtime double, size long").collect()] == [("a.md", 1.5, 3)]
    p.write_text("{broken")
    assert files.json_map(spark, str(p), "mtime double, size long").count() == 0
    assert files.json_map(spark, str(tmp_path / "none"), "mtime double").count() == 0
    for text in ('[{"id": "x"}]', '{"entries": [{"id": "x"}]}'):
        p.write_text(text)
        assert [r["id"] for r in files.json_rows(spark, str(p), "id string", "entries").collect()] == ["x"]
    p.write_text('{"aliases": {"任务": ["任务系统"], "_note": []}}', encoding="utf-8")
    assert sorted(tuple(r) for r in files.aliases(spark, str(p)).collect()) == [("任务", "任务"), ("任务", "任务系统")]


def test_settings(tmp_path):
    p = tmp_path / "config.json"
    p.write_text('{"kb_root": "kb", "md_dir": "docs"}')
    s = files.Settings.load(str(p), {})
    assert (s.kb_root, s.md_dir) == (str(tmp_path / "kb"), f"{tmp_path}/kb/docs")
    assert files.Settings.load(str(p), {"KB_ROOT": "/x"}).data_dir == "/x/data"
    (tmp_path / ".env").write_text("# no\nKB_ROOT = '/env'\nMD_DIR=\nnothing\n")
    assert files.Settings.load(str(p), {}).data_dir == "/env/data"
    assert files.Settings.load(str(p), {"KB_ROOT": "/x"}).data_dir == "/x/data"
    (tmp_path / ".env").unlink()
    p.write_text("{")
    assert files.Settings.load(str(p), {}).kb_root == os.path.normpath(tmp_path)


def test_changes(spark):
    now, old = F.lit("2024-01-10").cast("timestamp"), "2024-01-01"
    meta = spark.createDataFrame([("a", 1.0, 1, old), ("b", 1.0, 1, old), ("c", 1.0, 1, "bad"), ("n", None, 1, old)], "path string, mtime double, size long, indexed_at string")
    current = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("d", 1.0, 1), ("n", None, 1)], "path string, mtime double, size long")
    assert {r["path"]: r["change"] for r in changes.diff(current, meta).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "new", "n": "unchanged"}
    timed = meta.withColumn("indexed_at", F.try_to_timestamp("indexed_at"))
    after = {r["path"]: str(r["indexed_at"])[:10] for r in changes.next_meta(current, timed, current.where("path = 'd'"), now).collect()}
    assert after == {"a": "2024-01-01", "b": "2024-01-10", "n": "2024-01-01"}
    assert [r["path"] for r in changes.recent(meta, 10, now).collect()] == ["a", "b", "n"]
    assert changes.common_prefix(spark.createDataFrame([("/x/md_file/a.md",), ("/x/md_file/b/c.md",)], "path string")) == "/x"
    assert changes.common_prefix(spark.createDataFrame([("k/a/x.md",), ("k/ab/y.md",)], "path string")) == "k"
    moved, n = changes.remapped(spark.createDataFrame([("/kb/a",), ("/kb2/a",)], "path string"), "/kb", "/n")
    assert sorted(r["path"] for r in moved.collect()) == ["/kb2/a", "/n/a"]
    assert n.first().asDict() == {"changed": 1, "unchanged": 1}


def test_blocked_substring_join_equals_the_broadcast_one(spark):
    long = spark.createDataFrame([(w,) for w in ("abc", "b", "", "xaby", "aab")], "body string")
    short = spark.createDataFrame([(w,) for w in ("ab", "b", "", "xab")], "part string")
    got = [sorted(map(tuple, graph.contains_join(long, short, "body", "part", small).collect())) for small in (True, False)]
    assert got[0] == got[1]


def test_merge_and_rerank(spark):
    a, b = (spark.createDataFrame(x, "id string, score double") for x in ([("x", 0.5), ("y", 0.4)], [("y", 0.6)]))
    assert {r["id"]: round(r["score"], 6) for r in search.merge_parts([a, b]).collect()} == {"x": 0.5, "y": 0.7}
    assert [r["id"] for r in search.rerank(a, b.withColumnRenamed("score", "reranker_score"), 2).collect()] == ["y", "x"]
