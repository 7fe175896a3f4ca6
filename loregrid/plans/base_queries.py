"""Registered queries of the knowledge base as a whole: every supplier writes a Markdown document, which is synchronised, indexed and asked about.

One knowledge base is built for a session and a folder of tables, and all these queries ask it.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.operators import graph
from loregrid.plans.api import KnowledgeBase
from loregrid.plans.catalogue import query
from loregrid.plans.text_queries import bare, made
from loregrid.sources import files

#: A document for each supplier: subjects have two digits, so that none is part of another.
DOCUMENTS = """
SELECT s_suppkey AS k, 'd' || s_suppkey % 3 || '/m' || s_suppkey % 10 || '-需求' || s_suppkey || '.md' AS source, 'm' || s_suppkey % 10 AS module, 'm' || s_suppkey % 7 || '系统' AS ref, '供应商' || (10 + s_suppkey % 20) AS subject, '' || s_nationkey AS value,
  '# 供应商' || s_suppkey || chr(10) || chr(10) || '## 规则' || chr(10) || chr(10) || '供应商' || (10 + s_suppkey % 20) || '上限为' || s_nationkey || '。' || chr(10) || '依赖m' || s_suppkey % 7 || '系统。' || chr(10) || repeat('背景说明文字没有什么特别之处。', 30) AS text FROM {supplier}"""
_D = f"d AS ({bare(DOCUMENTS)})"
#: Facts in order of their sources, the first of each subject and value.
_F = f"{_D}, f AS (SELECT subject, value, min(source) AS source FROM d GROUP BY subject, value)"
#: The first fact of a subject makes a rule, the others contradict it.
_R = f"{_F}, o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY source) AS r, count(*) OVER (PARTITION BY subject) AS n FROM f), r AS (SELECT *, CASE WHEN r > 1 THEN 'pending' WHEN n > 1 THEN 'conflict' ELSE 'active' END AS status FROM o)"


@lru_cache(maxsize=4)
def _built(app: str, spark: SparkSession, sf_dir: str) -> tuple[KnowledgeBase, dict]:
    folder = f"{graph.shared_dir(spark)}/base-{uuid.uuid4().hex}"
    kb = KnowledgeBase(spark, files.Settings(folder, f"{folder}/md_file", f"{folder}/original_file", f"{folder}/data"))
    files.write_files(made(spark, sf_dir, DOCUMENTS, graph.spread).select(F.col("source").alias("path"), F.col("text").alias("data")), kb.settings.original_dir)
    return kb, kb.index()


def base(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    return _built(spark.sparkContext.applicationId, spark, sf_dir)[0]


@query("kb_index", f"WITH {_R} SELECT (SELECT count(*) FROM d) AS copied, (SELECT count(*) FROM d) AS files_new, (SELECT count(*) FROM d) AS chunks, (SELECT count(*) FROM f) AS facts, count(*) FILTER (WHERE r = 1) AS new_rules, count(*) FILTER (WHERE r > 1) AS conflicts_detected, 0 AS errors FROM r")
def kb_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_index, T1, T2, C11: what an index run reports."""
    report = _built(spark.sparkContext.applicationId, spark, sf_dir)[1]
    names = ("copied", "files_new", "chunks", "facts", "new_rules", "conflicts_detected")
    return spark.createDataFrame([(*(int(report[n]) for n in names), len(report["errors"]))], ", ".join(f"{n} long" for n in (*names, "errors")))


@query("kb_index_again", "SELECT count(*) AS files_unchanged, 0 AS chunks, 0 AS copied FROM supplier")
def kb_index_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run finds nothing to do."""
    report = base(spark, sf_dir).index()
    return spark.createDataFrame([(int(report["files_unchanged"]), int(report["chunks"]), int(report["copied"]))], "files_unchanged long, chunks long, copied long")


@query("kb_chunks", f"WITH {_D} SELECT substr(md5(source), 1, 10) || '_0' AS id, source, module, text, '规则' AS section, '供应商' || k || ' > 规则' AS heading_chain, substr(sha256(text), 1, 8) AS doc_version, ref AS cross_refs, '需求' AS tags, '其他' AS doc_type FROM d")
def kb_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC2, SC6, SK1, SK2, P1."""
    return base(spark, sf_dir).chunks.select("id", "source", "module", "text", "section", "heading_chain", "doc_version", F.array_join("cross_refs", ",").alias("cross_refs"), F.array_join("tags", ",").alias("tags"), "doc_type")


@query("kb_vocabulary", f"""
WITH {_D}, w AS (SELECT k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM d)
SELECT term, count(*) AS df, 0 AS dl FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term UNION ALL SELECT NULL, count(*), CAST(sum(len(w)) AS BIGINT) FROM w""")
def kb_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: kept with the chunks."""
    return base(spark, sf_dir).vocabulary


@query("kb_facts", f"WITH {_F} SELECT 'fact_' || substr(md5('constraint|' || subject || '|上限为|' || value), 1, 12) AS id, subject, value, source, 1.0 AS confidence, string_split(string_split(source, '/')[2], '-')[1] AS module FROM f")
def kb_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3, J17, M5."""
    return base(spark, sf_dir).facts.select("id", "subject", "value", "source", "confidence", "module")


@query("kb_facts_by_content", f"WITH {_F} SELECT subject, value FROM f")
def kb_facts_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11, P2: the stored facts as a view."""
    from loregrid.sources.tables import view

    view(base(spark, sf_dir).facts, "lg_facts")
    return spark.sql("SELECT subject, value FROM lg_facts")


@query("kb_rules", f"WITH {_R} SELECT subject, value, status, source FROM r")
def kb_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_canon get, T4, C4, J5."""
    return base(spark, sf_dir).canon("get").select("subject", "value", "status", "source")


@query("kb_rules_of_status", f"WITH {_R} SELECT subject, value FROM r WHERE status = 'pending' AND string_split(string_split(source, '/')[2], '-')[1] = 'm3'")
def kb_rules_of_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_canon get with a module and a status."""
    return base(spark, sf_dir).canon("get", module="m3", status="pending").select("subject", "value")


@query("kb_canon_status", f"WITH {_R} SELECT status AS name, count(*) AS n FROM r GROUP BY status")
def kb_canon_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_canon status, C9."""
    return base(spark, sf_dir).canon("status").where("dimension = 'status'").select("name", "n")


def _passage(side: str) -> str:
    """The first line of a fact's document that holds its subject or value: its title, or the statement."""
    title = rf"'# 供应商' || regexp_extract({side}.source, '需求(\d+)', 1)"
    return f"CASE WHEN contains({title}, subject) OR contains({title}, {side}.value) THEN {title} ELSE subject || '上限为' || {side}.value || '。' END"


@query("kb_conflicts", f"WITH {_R} SELECT subject, a.value AS new_value, b.value AS old_value, {_passage('a')} AS new_context, {_passage('b')} AS old_context FROM r a JOIN r b USING (subject) WHERE a.r > 1 AND b.r = 1")
def kb_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_canon classify, J8, J19: open contradictions with their passages."""
    kb = base(spark, sf_dir)
    found = kb.canon("classify", top_k=int(kb.rules.count()))
    return found.select(F.col("old_subject").alias("subject"), "new_value", "old_value", "new_context", "old_context")


@query("kb_changelog", f"WITH {_R} SELECT CASE WHEN status = 'pending' THEN 'conflict_detected' ELSE 'added' END AS action, subject, value AS new_value FROM r")
def kb_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first index run wrote to the log."""
    return base(spark, sf_dir).canon("log", days=300).where("trigger = 'index'").select("action", "subject", "new_value")


@query("kb_list_modules", f"WITH {_D} SELECT module, CAST(count(*) AS INTEGER) AS n FROM d GROUP BY module")
def kb_list_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).modules().select("module", "n")


@query("kb_get_document", f"WITH {_D} SELECT source, text FROM d WHERE k IN (1, 2)")
def kb_get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5: by a path below the folder of the base, and by an absolute one."""
    kb = base(spark, sf_dir)
    return kb.document("md_file/d1/m1-需求1.md").unionByName(kb.document(f"{kb.settings.md_dir}/d2/m2-需求2.md")).select("source", "text")


@query("kb_search_module", f"WITH {_D} SELECT source FROM d WHERE module = 'm4' AND k < 0")
def kb_search_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_search: nothing of another module or type is given."""
    found = base(spark, sf_dir).search("供应商 规则", top_k=20, module="m4")
    return found.where("module <> 'm4'").select("source")


@query("kb_search_exact", f"WITH {_D} SELECT source, '规则' AS section, module FROM d WHERE k = (SELECT max(s_suppkey) FROM supplier)")
def kb_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_search, J3, A18: the one document that holds a term is the first."""
    kb = base(spark, sf_dir)
    last = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.max("s_suppkey")).first()[0]
    return kb.search(f"供应商{last}", top_k=1, include_context=True).select("source", "section", "module")


@query("kb_search_facts", f"WITH {_F} SELECT subject, value FROM f WHERE subject = '供应商15' ORDER BY value LIMIT 1")
def kb_search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_search for facts, O10: the statement itself is the nearest to it."""
    kb = base(spark, sf_dir)
    least = kb.facts.where("subject = '供应商15'").agg(F.min("value")).first()[0]
    return kb.search(f"供应商15 上限为 {least}", target="facts", top_k=1, fact_type="constraint").select("subject", "value")


@query("kb_relations", f'WITH {_D} SELECT DISTINCT module AS "from", left(ref, 2) AS "to", ref FROM d WHERE module <> left(ref, 2)')
def kb_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_get_module_relations."""
    return base(spark, sf_dir).relations()


@query("kb_related_designs", f"""
WITH {_F}, e AS (SELECT DISTINCT module AS a, left(ref, 2) AS b FROM d WHERE module <> left(ref, 2)), n AS (SELECT b AS module FROM e WHERE a = 'm9' UNION SELECT a FROM e WHERE b = 'm9'),
c AS (SELECT string_split(string_split(source, '/')[2], '-')[1] AS module, count(*) AS facts_count FROM f GROUP BY 1)
SELECT module, CAST(hops AS INTEGER) AS hops, coalesce(facts_count, 0) AS facts_count FROM (SELECT 'm9' AS module, 0 AS hops UNION ALL SELECT module, 1 FROM n) LEFT JOIN c USING (module)""")
def kb_related_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).related_designs("m9", 1).select("module", F.col("hops").cast("int").alias("hops"), F.col("facts_count").cast("long").alias("facts_count"))


_DRAFT = "# 草稿\n\n供应商12上限为999。\n供应商99上限为1。"


@query("kb_check", f"WITH {_F} SELECT DISTINCT subject, '999' AS new_value, value AS existing_value FROM f WHERE subject = '供应商12'")
def kb_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_check, J18, M8: what a draft says otherwise than the stored facts."""
    return base(spark, sf_dir).check(_DRAFT)["conflicts"].select("subject", "new_value", "existing_value")


@query("kb_audit", f"WITH {_F}, d2 AS (SELECT subject, count(DISTINCT source) AS sources, count(DISTINCT value) AS v FROM f GROUP BY subject) SELECT subject, '上限为' AS predicate, CAST(v AS INTEGER) AS statements FROM d2 WHERE sources > 1 AND v > 1 ORDER BY subject LIMIT 20")
def kb_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).audit(top_k=20).select("subject", "predicate", F.size("statements").alias("statements"))


@query("kb_preview_facts", f"WITH {_D} SELECT subject, value FROM d WHERE k = 5")
def kb_preview_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).preview_facts("d2/m5-需求5.md")[0].select("subject", "value")


@query("kb_overview_stats", f"WITH {_R} SELECT (SELECT count(*) FROM d) AS chunks, (SELECT count(*) FROM d) AS documents, (SELECT count(DISTINCT module) FROM d) AS modules, (SELECT count(*) FROM f) AS facts, count(*) FILTER (WHERE status = 'active') AS active_rules, count(*) FILTER (WHERE status = 'conflict') AS conflict_rules FROM r")
def kb_overview_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).overview("stats").select("chunks", "documents", "modules", "facts", "active_rules", "conflict_rules")


@query("kb_overview_changes", f"WITH {_D} SELECT source AS path FROM d")
def kb_overview_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).overview("changes", days=1).select("path")


@query("kb_status", f"WITH {_D} SELECT source AS dst, 'ok' AS status FROM d")
def kb_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, SC4, kb_overview gaps: originals, documents and records agree."""
    return base(spark, sf_dir).status().select("dst", "status")


@query("kb_draft_assist", f"WITH {_R} SELECT subject, value FROM r WHERE status = 'active'")
def kb_draft_assist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).draft_assist("供应商")["rules"].select("subject", "value")


@query("kb_suggest", f"WITH {_D} SELECT DISTINCT module AS suggestion FROM d WHERE contains(module, 'm1') LIMIT 10")
def kb_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).suggest("M1").select("suggestion")


@query("kb_remap_counts", f"WITH {_D} SELECT count(*) FILTER (WHERE starts_with(source, 'd1/')) AS records, count(*) FILTER (WHERE starts_with(source, 'd1/')) AS chunks, (SELECT count(*) FROM (SELECT subject, value, min(source) AS s FROM d GROUP BY subject, value) WHERE starts_with(s, 'd1/')) AS facts FROM d")
def kb_remap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remap_paths, as a trial."""
    counts = base(spark, sf_dir).remap("e1", "d1")
    return spark.createDataFrame([tuple(counts[n]["changed"] for n in ("index_meta", "chunks", "facts"))], "records long, chunks long, facts long")
