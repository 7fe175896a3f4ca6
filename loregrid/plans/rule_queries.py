"""Registered queries of the rule base, facts, chunks and sheets. Their inputs are made from the driver's tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.operators import canon, changes, facts, search, sheets
from loregrid.operators.chunking import chunk_documents
from loregrid.operators.graph import once, spread
from loregrid.plans.catalogue import query
from loregrid.plans.text_queries import bare, made
from loregrid.sources.workbooks import Sheet

NOW = "2024-06-01 00:00:00"


def rule_id(n: str) -> str:
    return f"('canon_' || repeat('0', CASE WHEN {n} < 10 THEN 3 WHEN {n} < 100 THEN 2 WHEN {n} < 1000 THEN 1 ELSE 0 END) || ({n}))"


RULES = f"""
SELECT p_partkey + 1 AS n, {rule_id('p_partkey + 1')} AS id, CASE p_partkey % 3 WHEN 0 THEN 'constraint' WHEN 1 THEN 'rule' ELSE 'enum' END AS type, CASE WHEN p_partkey % 4 = 0 THEN 'critical' ELSE 'normal' END AS priority, p_name AS subject, '品牌为' AS predicate, p_brand AS value,
  p_type AS module, 's' || p_partkey % 13 AS source, p_size / 100.0 AS confidence, CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'conflict' WHEN 2 THEN 'deprecated' ELSE 'active' END AS status,
  CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'canon_0002' ELSE 'canon_0007' END END AS conflict_with FROM {{part}}"""
_R = f"r AS ({bare(RULES)})"
#: The rules that depend on rule 4, in every query of changes.
_DEPENDENT = "n IN (5, 9, 10)"


def rules_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = made(spark, sf_dir, RULES)
    none, then = F.array().cast("array<string>"), F.lit("2024-01-01").cast("timestamp")
    ids = F.array(*(canon.rule_id(F.lit(n)) for n in (5, 9, 10)))
    return r.withColumns({"depends_on": none, "dependents": F.when(F.col("n") == 4, ids).otherwise(none), "added_at": then, "updated_at": then, "history": F.array().cast(canon.HISTORY), "confidence": F.col("confidence").cast("double")}).drop("n").select(*(c.split()[0] for c in canon.RULE.replace("struct<old_value:string,new_value:string,changed_at:timestamp,reason:string>", "").split(", ")))


def shown(rules: DataFrame) -> DataFrame:
    """What a change may have touched, in plain columns."""
    last = F.get("history", F.size("history") - 1)
    return rules.select("id", "status", "value", "source", F.date_format("updated_at", "yyyy-MM-dd").alias("day"), F.size("history").alias("changes"), last["old_value"].alias("old"), last["reason"].alias("reason"))


def _shown_sql(status="status", value="value", source="source", day="'2024-01-01'", changes="0", old="CAST(NULL AS VARCHAR)", reason="CAST(NULL AS VARCHAR)", where="true") -> str:
    return f"WITH {_R} SELECT id, {status} AS status, {value} AS value, {source} AS source, {day} AS day, CAST({changes} AS INTEGER) AS changes, {old} AS old, {reason} AS reason FROM r WHERE {where}"


@query("rules_selected", f"WITH {_R} SELECT id FROM r WHERE module IN ('ECONOMY', 'STANDARD') AND type = 'rule' AND priority = 'normal' AND status = 'active'")
def rules_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    return canon.select_rules(rules_of(spark, sf_dir), ["ECONOMY", "STANDARD"], "rule", "normal", "active").select("id")


@query("rules_added", f"WITH {_R} SELECT id, subject, status FROM r UNION ALL SELECT {rule_id('max(n) + 1')}, '新规则', 'active' FROM r")
def rules_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, C1."""
    one = spark.createDataFrame([("rule", "normal", "新规则", "为", "1", "m", "s", 1.0)], "type string, priority string, subject string, predicate string, value string, module string, source string, confidence double")
    return canon.add_rule(rules_of(spark, sf_dir), one, NOW).select("id", "subject", "status")


_REVIEW = {"status": f"CASE WHEN {_DEPENDENT} AND status = 'active' THEN 'needs_review' ELSE status END"}


@query("rules_updated", _shown_sql(**_REVIEW, value="CASE WHEN n = 4 THEN '更新' ELSE value END", day=f"CASE WHEN n = 4 OR {_DEPENDENT} AND status = 'active' THEN '2024-06-01' ELSE '2024-01-01' END", changes="CASE WHEN n = 4 THEN 1 ELSE 0 END", old="CASE WHEN n = 4 THEN value END", reason="CASE WHEN n = 4 THEN '因为' END"))
def rules_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, J20."""
    return shown(canon.set_value(rules_of(spark, sf_dir), "canon_0004", "更新", "因为", NOW))


@query("rules_deprecated", _shown_sql(status="CASE WHEN n = 4 THEN 'deprecated' ELSE status END", day="CASE WHEN n = 4 THEN '2024-06-01' ELSE '2024-01-01' END"))
def rules_deprecated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3."""
    return shown(canon.deprecate(rules_of(spark, sf_dir), "canon_0004", spark.createDataFrame([], "subject string, predicate string, reason string, added_at timestamp"), NOW)[0])


@query("suppressions_added", f"WITH {_R} SELECT subject, '品牌为' AS predicate, CASE WHEN bool_or(n % 2 = 0) THEN 'old' ELSE 'new' END AS reason FROM r GROUP BY subject")
def suppressions_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that are there stay as they were."""
    r = made(spark, sf_dir, RULES)
    there = r.where("n % 2 = 0").select("subject", "predicate").distinct().select("*", F.lit("old").alias("reason"), F.lit(NOW).cast("timestamp").alias("added_at"))
    return canon.add_suppressions(there, r.select("subject", "predicate", F.lit("new").alias("reason")), NOW).select("subject", "predicate", "reason")


_AGAINST = "NOT (conflict_with IS NOT DISTINCT FROM 'canon_0002' AND status = 'pending')"


@query("conflict_kept", _shown_sql(status="CASE WHEN n = 2 THEN 'active' ELSE status END", day="CASE WHEN n = 2 THEN '2024-06-01' ELSE '2024-01-01' END", where=_AGAINST))
def conflict_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, the old value stays."""
    return shown(canon.resolve(rules_of(spark, sf_dir), "canon_0002", "keep_old", now=NOW))


@query("conflict_settled", _shown_sql(status="CASE WHEN n = 2 THEN 'active' ELSE status END", value="CASE WHEN n = 2 THEN '定为' ELSE value END", day="CASE WHEN n = 2 THEN '2024-06-01' ELSE '2024-01-01' END", changes="CASE WHEN n = 2 THEN 1 ELSE 0 END", old="CASE WHEN n = 2 THEN value END", reason="CASE WHEN n = 2 THEN 'conflict resolved: new value' END", where=_AGAINST))
def conflict_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, with a new value."""
    return shown(canon.resolve(rules_of(spark, sf_dir), "canon_0002", "set_value", "定为", NOW))


_PENDING = "(SELECT {c} FROM r WHERE conflict_with = 'canon_0002' AND status = 'pending' ORDER BY n DESC LIMIT 1)"


@query("conflict_accepted", _shown_sql(status="CASE WHEN n = 2 THEN 'active' ELSE status END", value=f"CASE WHEN n = 2 THEN {_PENDING.format(c='value')} ELSE value END", source=f"CASE WHEN n = 2 THEN {_PENDING.format(c='source')} ELSE source END", day="CASE WHEN n = 2 THEN '2024-06-01' ELSE '2024-01-01' END", changes="CASE WHEN n = 2 THEN 1 ELSE 0 END", old="CASE WHEN n = 2 THEN value END", reason="CASE WHEN n = 2 THEN 'conflict resolved: accepted' END", where=_AGAINST))
def conflict_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, the value of the last pending rule."""
    return shown(canon.resolve(rules_of(spark, sf_dir), "canon_0002", "accept_new", now=NOW))


_EDGES = "SELECT n AS child, n - n % 10 + 1 AS parent FROM r WHERE n % 10 <> 1"


@query("dependencies_set", f"WITH {_R}, e AS ({_EDGES}) SELECT id, coalesce((SELECT {rule_id('parent')} FROM e WHERE child = n), '') AS depends_on, CASE WHEN n = 4 THEN 'canon_0005,canon_0009,canon_0010' ELSE coalesce(d.l, '') END AS dependents FROM r LEFT JOIN (SELECT parent, string_agg({rule_id('child')}, ',' ORDER BY {rule_id('child')}) AS l FROM e GROUP BY parent) d ON d.parent = n")
def dependencies_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6."""
    rules = rules_of(spark, sf_dir)
    n = canon.ordinal(F.col("id"))
    edges = rules.where(n % 10 != 1).select(F.col("id").alias("child"), canon.rule_id(n - n % 10 + 1).alias("parent"))
    return canon.add_dependencies(rules, edges).select("id", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("dependents", ",").alias("dependents"))


@query("sources_purged", _shown_sql(status="CASE WHEN source IN ('s3', 's7') AND status = 'active' THEN 'deprecated' ELSE status END", day="CASE WHEN source IN ('s3', 's7') AND status = 'active' THEN '2024-06-01' ELSE '2024-01-01' END"))
def sources_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, the rules."""
    gone = spark.createDataFrame([("s3",), ("s7",), ("s7",), ("none",)], "source string")
    return shown(canon.purge(rules_of(spark, sf_dir), made(spark, sf_dir, RULES), gone, NOW)[0])


@query("facts_purged", f"WITH {_R} SELECT id, source NOT IN ('s3', 's7') AS stays FROM r")
def facts_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, the facts; SK4."""
    gone = spark.createDataFrame([("s3",), ("s7",), ("s7",), ("none",)], "source string")
    r = made(spark, sf_dir, RULES)
    kept = canon.purge(rules_of(spark, sf_dir), r, gone, NOW)[1].select("id", F.lit(True).alias("stays"))
    return kept.unionByName(facts.of_sources(r, gone).select("id", F.lit(False).alias("stays"))).join(facts.without_sources(r, gone).select("id", F.lit(True).alias("s2")), "id", "left").select("id", (F.col("stays") & F.coalesce("s2", F.lit(False))).alias("stays"))


@query("changes_logged", f"""
WITH {_R} SELECT CASE WHEN n = 4 THEN 'updated' ELSE 'needs_review' END AS action, id AS rule_id, subject, 'test' AS trigger, value AS old_value, CASE WHEN n = 4 THEN '更新' ELSE value END AS new_value,
  subject || ' ' || value || ' -> ' || CASE WHEN n = 4 THEN '更新' ELSE value END AS detail FROM r WHERE n = 4 OR {_DEPENDENT} AND status = 'active'""")
def changes_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9, the log of a change."""
    before = rules_of(spark, sf_dir)
    return canon.log_rows(before, canon.set_value(before, "canon_0004", "更新", "", NOW), "test", NOW).drop("timestamp")


@query("log_recent", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def log_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "timestamp")
    return canon.recent_log(e, 7, F.lit("2024-01-27").cast("timestamp")).select("event_id")


# --- facts


@query("facts_related", f"WITH {_R} SELECT DISTINCT subject, predicate, value FROM r WHERE subject IN (SELECT subject FROM r WHERE n % 17 = 0) OR id IN (SELECT id FROM r WHERE n % 19 = 0)")
def facts_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6."""
    r = made(spark, sf_dir, RULES)
    return facts.related_facts(r.where("n % 17 = 0"), r, r.where("n % 19 = 0")).select("subject", "predicate", "value")


@query("rules_of_results", f"WITH {_R} SELECT r.id AS rule, p_partkey AS result FROM r JOIN part ON contains(lower(p_name || ' ' || p_type), lower(subject)) WHERE p_partkey < 50")
def rules_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results are a page of fifty."""
    page = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 50").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.lit(None).cast("string").alias("section"))
    met = search.with_rules(page, rules_of(spark, sf_dir))
    return met.select(F.explode("canon_refs").alias("r"), F.col("id").alias("result")).select("r.id", "result").toDF("rule", "result")


@query("reranked", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars % 97 AS DOUBLE) ELSE 0.0 END AS score FROM documents ORDER BY score DESC, doc_id LIMIT 50")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reranker left out counts as 0."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    scores = d.where("id % 3 = 0").select("id", (F.col("score") % 97).alias("reranker_score"))
    return search.rerank(d, scores, 50).select("id", "score")


@query("cleanup_planned", """
WITH s AS (SELECT 'c' || c_custkey || '.md' AS path, CASE c_custkey % 3 WHEN 0 THEN 'orphan_md' WHEN 1 THEN 'orphan_index' ELSE 'ok' END AS status FROM customer),
o AS (SELECT 'c' || o_custkey || '.md' AS source, o_orderkey, o_orderstatus FROM orders)
SELECT path, status, status = 'orphan_md' AS delete_file, count(o_orderkey) AS chunks, count(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS facts, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS rules FROM s LEFT JOIN o ON source = path WHERE status <> 'ok' GROUP BY ALL""")
def cleanup_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    status = made(spark, sf_dir, "SELECT 'c' || c_custkey || '.md' AS dst, CASE c_custkey % 3 WHEN 0 THEN 'orphan_md' WHEN 1 THEN 'orphan_index' ELSE 'ok' END AS status FROM {customer}")
    o = made(spark, sf_dir, "SELECT 'c' || o_custkey || '.md' AS source, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'pending' END AS status FROM {orders}")
    return changes.cleanup_plan(status, o, o.where("o_orderkey % 2 = 0"), o)


# --- chunks

#: Documents of a source each conversation: a preface, sections of 400 to 1300 characters, one line of 4000, and a short end.
SECTIONED = """
SELECT conv_id, turn, 'talk/' || (conv_id % 7) || '-需求分析/c' || conv_id || '.md' AS source, '## ' || role || ' ' || turn || chr(10) || chr(10) || CASE WHEN turn = 0 THEN repeat('x', 4000 - conv_id % 9) ELSE rpad(replace(replace(text, chr(10), ' '), '  ', ' '), CAST(400 + conv_id * 7 % 900 AS INT), 'y') || '.' END AS part FROM {conversations}"""


@query("sections_chunked", f"""
WITH s AS ({bare(SECTIONED)})
SELECT source, CAST(count(*) AS BIGINT) AS sections, CAST(sum(length(part)) AS BIGINT) AS characters, substr(sha256('# Talk' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY turn)), 1, 8) AS version, (conv_id % 7) || '-需求分析' AS module FROM s GROUP BY source, conv_id""")
def sections_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section is found in the chunks, with the document's version and module."""
    s = made(spark, sf_dir, SECTIONED)
    docs = s.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "part")))["part"], "\n\n").alias("body")).select("source", F.concat(F.lit("# Talk\n\n"), F.col("body")).alias("text"))
    made_of = chunk_documents(docs, now=NOW)
    # chunks of a document, one after the other, hold its sections in order: the long one in pieces without its heading's line
    whole = made_of.groupBy("source", "doc_version", "module").agg(F.array_join(F.sort_array(F.collect_list(F.struct("chunk_index", "text")))["text"], "").alias("t"))
    found = s.join(whole, "source").where(F.col("t").contains(F.element_at(F.split("part", "\n\n"), -1)) | (F.col("turn") == 0))
    return found.groupBy("source", F.col("doc_version").alias("version"), "module").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("part")).alias("characters"))


@query("chunks_projected", f"""
WITH s AS (SELECT source, conv_id, turn, part, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM ({bare(SECTIONED)}) WHERE turn > 0)
SELECT substr(md5(source), 1, 10) || '_' || i AS id, CASE WHEN i = 0 THEN '# Talk' || chr(10) || chr(10) ELSE '' END || part AS text, substr(part, 4, instr(part, chr(10)) - 4) AS section, 'Talk > ' || substr(part, 4, instr(part, chr(10)) - 4) AS heading_chain, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS total_chunks, '其他' AS doc_type, (conv_id % 7) || '-需求分析' AS module, source AS doc_id FROM s""")
def chunks_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that are neither short nor long are a chunk each; the preface joins the first."""
    s = made(spark, sf_dir, SECTIONED).where("turn > 0")
    docs = s.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "part")))["part"], "\n\n").alias("body")).select("source", F.concat(F.lit("# Talk\n\n"), F.col("body")).alias("text"))
    return chunk_documents(docs, now=NOW).select("id", "text", "section", "heading_chain", "chunk_index", "total_chunks", "doc_type", "module", "doc_id")


LINES = "SELECT p_partkey AS id, 'a' || p_partkey || '.md' AS source, '## h' || chr(10) || repeat('k', 3200 + p_partkey % 500) AS text FROM {part}"


@query("lines_cut", f"""
SELECT source, CAST(3200 + id % 500 AS BIGINT) AS characters, CAST(1500 + CASE WHEN 200 + id % 500 < 350 THEN 200 + id % 500 ELSE 0 END AS INTEGER) AS longest FROM ({bare(LINES)})""")
def lines_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line that is too long is cut at 1500 characters, and no character of it is lost; a short rest joins the piece before it."""
    c = chunk_documents(made(spark, sf_dir, LINES, spread), now=NOW)
    held = c.select("source", once(F.length(F.regexp_replace("text", "[^k]", ""))).alias("n"))
    return held.groupBy("source").agg(F.sum("n").alias("characters"), F.max("n").alias("longest"))


# --- sheets

CELLS = "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS STRING) AS a, l_returnflag AS b, CAST(l_suppkey AS STRING) AS c, CAST(l_linenumber * 10 AS STRING) AS d FROM {lineitem}"
_ORDER = "ORDER BY l_linenumber, a, b, c, d"


def _sheets(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Every order as a sheet with a head, an empty column, blank rows and a line each, processed."""
    rows = made(spark, sf_dir, CELLS).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "a", "b", "c", "d"))).alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, lines in zip(frame["l_orderkey"], frame["rows"]):
                grid = [["", "", "", "", ""], ["part", "", "flag", "supplier", "line"], [""] * 5, [""] * 5, *([r["a"], "", r["b"], r["c"], r["d"]] for r in lines), ["", ""]]
                p = sheets.processed(Sheet(name, grid))
                out.append((key, p["type"], p["markdown"], p["row_count"], p["estimated_tokens"]))
            yield pd.DataFrame(out, columns=["l_orderkey", "type", "markdown", "row_count", "estimated_tokens"])

    return rows.mapInPandas(run, "l_orderkey long, type string, markdown string, row_count int, estimated_tokens int")


_TABLE = f"'| part | flag | supplier | line |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || a || ' | ' || b || ' | ' || c || ' | ' || d || ' |', chr(10) {_ORDER})"


@query("sheet_tables", f"""
WITH l AS ({bare(CELLS)}), t AS (SELECT l_orderkey, count(*) AS n, {_TABLE} AS body FROM l GROUP BY l_orderkey)
SELECT l_orderkey, 'config_table' AS type, '## 配置' || chr(10) || chr(10) || body AS markdown, CAST(n + 1 AS INTEGER) AS row_count, CAST(length(body) // 2 AS INTEGER) AS estimated_tokens FROM t""")
def sheet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet named as a table."""
    return _sheets(spark, sf_dir, "配置")


@query("sheet_types", f"""
WITH l AS ({bare(CELLS)}), t AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n >= 2 THEN 'enum_table' ELSE 'data_table' END AS type, CAST(n + 1 AS INTEGER) AS row_count FROM t""")
def sheet_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the shape of the rows, a text head over numbers being an enumeration from three rows on."""
    return _sheets(spark, sf_dir, "数据").select("l_orderkey", "type", "row_count")


@query("sheet_outlines", f"""
WITH l AS ({bare(CELLS)}), t AS (SELECT l_orderkey, string_agg(a || ' | ' || b || ' | ' || c || ' | ' || d, chr(10) {_ORDER}) AS body FROM l GROUP BY l_orderkey)
SELECT l_orderkey, '## 更新记录' || chr(10) || chr(10) || '*版本记录*' || chr(10) || chr(10) || 'part | flag | supplier | line' || chr(10) || chr(10) || body AS markdown FROM t""")
def sheet_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of versions as an outline."""
    return _sheets(spark, sf_dir, "更新记录").select("l_orderkey", "markdown")


@query("sheets_converted", """
WITH p AS (SELECT p_brand, p_partkey, p_name FROM part)
SELECT p_brand || '.xlsx' AS source, p_brand || '/' || p_brand || '[xlsx转换].md' AS target, '# ' || p_brand || chr(10) || chr(10) || string_agg('## ' || p_name || chr(10) || '![' || p_name || '](images/' || replace(p_name, ' ', '_') || '_1.png)', chr(10) || chr(10) ORDER BY p_partkey) AS text FROM p GROUP BY p_brand""")
def sheets_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture marks become links."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    picture = F.array(F.struct(F.lit(1).alias("index"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.unhex(F.lit("89504E47")).alias("data")))
    mark = F.concat(F.lit("## "), F.col("p_name"), F.lit("\n{{IMG:"), F.col("p_name"), F.lit(":1}}"))
    rows = p.select(F.concat("p_brand", F.lit(".xlsx")).alias("source"), F.col("p_partkey").cast("int").alias("sheet_index"), F.col("p_name").alias("name"), mark.alias("markdown"), picture.alias("images"), F.lit(None).cast("string").alias("error"))
    return sheets.converted(rows)

