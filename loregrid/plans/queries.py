"""The registered queries of the knowledge base's operators, over the driver's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid import models
from loregrid.functions import text as X
from loregrid.operators import canon, changes, facts, graph, overview, search
from loregrid.operators.chunking import chunk_documents, token_batches
from loregrid.plans import base_queries, rule_queries, text_queries  # noqa: F401  (they register their own)
from loregrid.plans.catalogue import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

ASKED, ASKED_TOO = "the retitioning of ouen", "region and the thent"
TOP = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked_vector(vectors: DataFrame) -> list[float]:
    """The vector with the lowest id, to ask with."""
    return vectors.orderBy("vec_id").select("embedding").first()["embedding"]


def _bm25_sql(asked: str, name: str = "s") -> str:
    """CTEs that end in {name}(id, score), normalised over all documents."""
    return f"""
{name}_w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
{name}_c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_w),
{name}_t AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM {name}_w),
{name}_p AS (SELECT id, dl, term, count(*) AS tf FROM {name}_t GROUP BY ALL),
{name}_r AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {name}_p, {name}_c GROUP BY term, n),
{name}_i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_r) ELSE raw END AS idf FROM {name}_r),
{name}_q AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all('{asked}', '[\\p{{L}}\\p{{N}}]+')) AS term) GROUP BY term),
{name}_s AS (SELECT id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM {name}_p JOIN {name}_q USING (term) JOIN {name}_i USING (term), {name}_c GROUP BY id),
{name} AS (SELECT id, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE raw END AS score FROM {name}_s)"""


_VECTOR_SQL = "SELECT vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1))) / 2, 4) AS score FROM embeddings"


# --- search


@query("bm25_topk", f"WITH {_bm25_sql(ASKED)} SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT {TOP}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_top(table(spark, sf_dir, "documents"), ASKED, TOP, key="doc_id").select("id", F.round("score", 6).alias("score"))


@query("bm25_scores", f"WITH {_bm25_sql(ASKED)} SELECT id, round(score, 6) AS score FROM s")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), ASKED, "doc_id").select("id", F.round("score", 6).alias("score"))


@query("postings", "SELECT doc_id AS id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)) GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents"), "doc_id").select("id", F.col("dl").cast("long").alias("dl"), "term", "tf")


@query("vector_topk", f"{_VECTOR_SQL} ORDER BY score DESC, id LIMIT {TOP}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.vector_top(e, asked_vector(e), TOP, key="vec_id")


@query("vector_topk_filtered", f"{_VECTOR_SQL} WHERE label IN (1, 3) ORDER BY score DESC, id LIMIT {TOP}")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.vector_top(e, asked_vector(e), TOP, F.col("label").isin(1, 3), key="vec_id")


@query("hybrid_fusion", f"WITH {_bm25_sql(ASKED)}, b AS (SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 60), v AS ({_VECTOR_SQL} ORDER BY score DESC, id LIMIT 60) SELECT id, round(0.8 * coalesce(v.score, 0) + 0.2 * coalesce(b.score, 0), 6) AS score FROM v FULL JOIN b USING (id)")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    out = search.fuse(search.vector_top(e, asked_vector(e), 3 * TOP, key="vec_id"), search.bm25_top(d, ASKED, 3 * TOP, key="doc_id"), 0.8, 0.2)
    return out.select("id", F.round("score", 6).alias("score"))


@query("filter_after_limit", f"WITH {_bm25_sql(ASKED)}, best AS (SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 60) SELECT id, round(score, 6) AS score FROM best JOIN documents ON doc_id = id WHERE source = 'src1'")
def filter_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.bm25_top(table(spark, sf_dir, "documents"), ASKED, 3 * TOP, F.col("source") == "src1", key="doc_id")
    return out.select("id", F.round("score", 6).alias("score"))


@query("sub_query_merge", f"WITH {_bm25_sql(ASKED)}, {_bm25_sql(ASKED_TOO, 't')}, u AS (FROM (SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 60) UNION ALL FROM (SELECT id, score FROM t WHERE score > 0 ORDER BY score DESC, id LIMIT 60)) SELECT id, round(max(score) + 0.1 * (count(*) - 1), 6) AS score FROM u GROUP BY id")
def sub_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    out = search.merge_parts([search.bm25_top(d, q, 3 * TOP, key="doc_id") for q in (ASKED, ASKED_TOO)])
    return out.select("id", F.round("score", 6).alias("score"))


@query("entity_boost", "SELECT doc_id, CASE WHEN source = 'src3' OR contains(text, 'retitioning') OR doc_id::VARCHAR = 'src3' OR doc_id::VARCHAR = 'retitioning' OR source = 'retitioning' OR contains(lang, 'src3') OR contains(lang, 'retitioning') OR contains(text, 'src3') THEN 0.15 ELSE 0.0 END::DOUBLE AS boost FROM documents")
def entity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("module"), F.col("lang").alias("section"), "text", F.lit(0.0).alias("score"))
    return search.boosted(d, F.array(F.lit("src3"), F.lit("retitioning"))).select(F.col("number").alias("doc_id"), F.col("score").alias("boost"))


@query("classify_query", """
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '依赖|调用|关联|关系|哪些模块|什么模块|影响|被调用') THEN 'relation' WHEN regexp_matches(text, '相关|关于|涉及|有关|包含|有哪些|哪些文档') THEN 'explore' WHEN length(text) < 10 THEN 'precise' ELSE 'explore' END AS kind,
  regexp_matches(text, '对比|区别|vs|VS|比较|还是|和|与') OR (length(text) >= 20 AND regexp_matches(text, '；|;|另外|还有|另一个|以及')) AS splits FROM conversations""")  # fmt: skip
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.query_type(c).alias("kind"), X.splits(c).alias("splits"))


@query("neighbours", """
SELECT conv_id, turn,
  CASE WHEN lag(turn) OVER w = turn - 1 AND lag(text) OVER w <> '' THEN left(lag(text) OVER w, 300) END AS prev,
  CASE WHEN lead(turn) OVER w = turn + 1 AND lead(text) OVER w <> '' THEN left(lead(text) OVER w, 300) END AS next
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.neighbours(table(spark, sf_dir, "conversations"), group="conv_id", index="turn")
    return out.select("conv_id", "turn", F.get("prev", F.lit(0)).alias("prev"), F.get("next", F.lit(0)).alias("next"))


@query("highlight", """
WITH parts AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), '。'), '。'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288))), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, coalesce(array_to_string(list_transform(p, lambda s: CASE WHEN list_has_any(regexp_extract_all(lower(s), '[\\p{L}\\p{N}]+'), ['the', 'retitioning', 'of', 'ouen']) THEN '**' || s || '**' ELSE s END), '。'), '') AS marked FROM parts""")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.highlight(F.col("text"), F.lit(ASKED)).alias("marked"))


@query("citation", "SELECT page_id, '[参考自: ' || CASE WHEN url = '' THEN '未知来源' ELSE string_split(url, '/')[-1] END || ' > ' || md5(html) || ' (2024-01-02)]' AS cited FROM pages")
def citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cite = X.citation(F.col("url"), F.md5("html"), F.lit("m"), F.lit("v"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return table(spark, sf_dir, "pages").select("page_id", cite["formatted"].alias("cited"))


def conversation_chunks(spark: SparkSession, sf_dir: str, embed=None) -> DataFrame:
    """Every conversation as a Markdown document with a section for each turn, cut into chunks, with vectors if embed is given."""
    turn = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("text"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t"))))["t"], "\n\n").alias("body"))
    docs = c.select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit("-talk.md")).alias("source"), F.concat(F.lit("# Talk\n\n"), F.col("body")).alias("text"))
    return chunk_documents(docs, embed, now="2024-01-01 00:00:00")


@query("chunk_documents")
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_chunks(spark, sf_dir).drop("embedding")


@query("search")
def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graph.cut(conversation_chunks(spark, sf_dir))  # chunks and vectors once, one after the other: a task has one Python worker at a time
    made = graph.cut(made.withColumn("embedding", models.embedder()(F.col("text"))))
    return search.search(made, ASKED, models.query_embedder(), 10, include_context=True)


# --- overview


@query("list_modules", "SELECT source AS module, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS documents, CAST(count(DISTINCT doc_id) AS INTEGER) AS n FROM documents GROUP BY source")
def list_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), F.col("doc_id").cast("string").alias("source"))
    return overview.modules(d).select("module", F.array_join("documents", ",").alias("documents"), "n")


@query("total_documents", "SELECT CAST(sum(n) AS BIGINT) AS total_docs FROM (SELECT count(DISTINCT doc_id) AS n FROM documents GROUP BY source)")
def total_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.total_documents(overview.modules(table(spark, sf_dir, "documents"), "source", "doc_id"))


@query("stats", "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(DISTINCT CASE WHEN source <> '' THEN source END) AS modules FROM documents")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.stats(table(spark, sf_dir, "documents"), module="source")


@query("counts_grouping_sets", """
SELECT CASE WHEN GROUPING(status) = 0 THEN 'status' WHEN GROUPING(type) = 0 THEN 'type' WHEN GROUPING(module) = 0 THEN 'module' WHEN GROUPING(priority) = 0 THEN 'priority' ELSE 'total' END AS dimension,
  coalesce(status, type, module, priority) AS name, count(*) AS n
FROM (SELECT o_orderstatus AS status, o_orderpriority AS type, o_custkey::VARCHAR AS module, CASE WHEN o_totalprice > 250000 THEN 'critical' ELSE 'normal' END AS priority FROM orders)
GROUP BY GROUPING SETS ((status), (type), (module), (priority), ())""")
def counts_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("o_totalprice") > 250000, "critical").otherwise("normal")
    return canon.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").cast("string").alias("module"), priority.alias("priority")))


@query("type_counts", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.type_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "type"))


@query("suggest", "WITH n AS (SELECT 0 AS g, p_name AS s FROM part UNION ALL SELECT 1, p_type FROM part), h AS (SELECT s, min(g) AS g FROM n WHERE s <> '' AND contains(lower(s), 'ri') GROUP BY s) SELECT CAST(row_number() OVER (ORDER BY g, s) AS INTEGER) AS rank, s AS suggestion FROM h ORDER BY g, s LIMIT 10")
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.suggest(table(spark, sf_dir, "part"), "Ri", 10, "p_name", "p_type")


@query("recent_changes", "SELECT event_id AS path, ts AS indexed_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("ts").alias("indexed_at"))
    last = e.agg(F.max("indexed_at").alias("m")).first()["m"]
    return changes.recent(e, 7, F.lit(last))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as canonical names, their nations as aliases."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("canonical"), F.col("n_name").alias("alias"))


def _named_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.col("n_name").alias("module"))


@query("alias_normalise", "SELECT c_custkey, r_name AS module FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def alias_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.normalized(_named_customers(spark, sf_dir), _places(spark, sf_dir))


@query("alias_expand", """
WITH a AS (SELECT r_name AS canonical, n_name AS alias FROM nation JOIN region ON n_regionkey = r_regionkey), m AS (SELECT DISTINCT n_name AS module FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT module, coalesce(canonical, module) AS canonical FROM m LEFT JOIN a ON alias = module)
SELECT module, module AS name FROM c UNION SELECT module, canonical FROM c UNION SELECT module, alias FROM c JOIN a USING (canonical)""")
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.expanded(_named_customers(spark, sf_dir), _places(spark, sf_dir))


# --- relations


def _part_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of parts as references of their brands, and the words in them as modules."""
    p = table(spark, sf_dir, "part")
    refs = p.select(F.col("p_brand").alias("module"), F.col("p_name").alias("ref")).distinct()
    return refs, p.select(F.explode(F.split("p_name", " ")).alias("module")).distinct()


@query("module_relations", """
WITH r AS (SELECT DISTINCT p_brand AS module, p_name AS ref FROM part), m AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part)
SELECT r.module AS "from", m.name AS "to", min(ref) AS ref FROM r JOIN m ON contains(ref, m.name) WHERE m.name <> '' AND r.module <> m.name GROUP BY ALL""")
def module_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relations(*_part_refs(spark, sf_dir))


@query("module_relations_blocked", ORACLES["module_relations"])
def module_relations_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the join on character pairs, for tables too large to broadcast."""
    return graph.relations(*_part_refs(spark, sf_dir), small=False)


@query("bfs", """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS x, 's' || l_suppkey AS y FROM lineitem), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
walk(node, hops) AS (SELECT 'p0', 0 UNION SELECT y, hops + 1 FROM walk JOIN b ON x = node WHERE hops < 2)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY node HAVING min(hops) > 0""")
def bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, sf_dir, "lineitem").select(name("p", "l_partkey").alias("from"), name("s", "l_suppkey").alias("to"))
    return graph.bfs(e, spark.createDataFrame([("p0",)], "node string"), 2)


@query("related_top_n", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 10")
def related_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return graph.top_n(o, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("components", """
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, 100 + n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
walk(node, c) AS (SELECT x, x FROM u UNION SELECT y, c FROM walk JOIN u ON x = node)
SELECT node, min(c) AS component FROM walk GROUP BY node""")
def component_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    e = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_nationkey").alias("a"), (F.col("n_regionkey") + 100).alias("b")).distinct()
    return graph.components(e)


# --- facts


def _text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as statements of their sources."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("type"), F.col("source").alias("subject"), F.lit("says").alias("predicate"), F.col("text").alias("value"), F.lit(1.0).alias("confidence"), F.col("doc_id").alias("source"), F.lit(0).cast("long").alias("ordinal"))


@query("facts_by_content", "SELECT 'fact_' || substr(md5(lang || '|' || source || '|says|' || text), 1, 12) AS id, min(doc_id) AS source FROM documents GROUP BY 1")
def facts_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.by_content(_text_facts(spark, sf_dir)).select("id", "source")


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    string = lambda c, name: F.col(c).cast("string").alias(name)
    return table(spark, sf_dir, "lineitem").select(string("l_returnflag", "type"), string("l_partkey", "subject"), string("l_linestatus", "predicate"), string("l_suppkey", "value"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("source"), F.col("l_linenumber").cast("long").alias("ordinal"))


@query("facts_surest", """
SELECT source, ordinal, type, subject, predicate, value, confidence FROM (SELECT l_orderkey AS source, CAST(l_linenumber AS BIGINT) AS ordinal, l_returnflag AS type, l_partkey::VARCHAR AS subject, l_linestatus AS predicate, l_suppkey::VARCHAR AS value, l_discount AS confidence,
  row_number() OVER (PARTITION BY l_returnflag, l_partkey, l_linestatus, l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def facts_surest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.distinct_facts(_line_facts(spark, sf_dir))


@query("facts_upsert", """
WITH new AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS value FROM supplier)
SELECT id, name, value FROM new UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT id FROM new)""")
def facts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"), F.lit(0).alias("ordinal"))
    return facts.upsert(old, new).select("id", "name", "value")


def _part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parts say: that a name has a brand, by type."""
    return table(spark, sf_dir, "part").select(F.lit("rule").alias("type"), F.col("p_name").alias("subject"), F.lit("brand").alias("predicate"), F.col("p_brand").alias("value"), (F.col("p_size") / 100).alias("confidence"), F.col("p_type").alias("source"), F.col("p_type").alias("module"), F.col("p_partkey").alias("ordinal"))


@query("audit_conflicts", """
WITH k AS (SELECT *, regexp_replace(lower(p_name), '\\s+', '', 'g') AS sk, lower(p_brand) AS vk FROM part),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sk, vk ORDER BY p_size / 100 DESC, p_type, p_partkey) AS r FROM k) WHERE r = 1)
SELECT min(p_name) AS subject, 'brand' AS predicate, CAST(count(*) AS INTEGER) AS statements, string_agg(p_brand, ',' ORDER BY p_brand) AS said
FROM o GROUP BY sk HAVING count(DISTINCT p_type) > 1 AND count(DISTINCT vk) > 1 ORDER BY sk LIMIT 20""")
def audit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts.audit_conflicts(_part_facts(spark, sf_dir), 20)
    return out.select("subject", "predicate", F.size("statements").alias("statements"), F.array_join("statements.value", ",").alias("said"))


@query("compliance", """
SELECT l_orderkey, l_linenumber, 'r' || p_partkey AS rule_id, CASE WHEN l_linestatus = CASE WHEN p_size > 25 THEN 'F' ELSE 'O' END THEN 'passed' ELSE 'violation' END AS result
FROM lineitem JOIN part ON l_partkey = p_partkey AND l_returnflag = 'R'""")
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("l_linestatus").alias("value"))
    rules = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("subject"), F.lit("R").alias("predicate"), F.when(F.col("p_size") > 25, "F").otherwise("O").alias("value"), F.lit("normal").alias("priority"), F.lit("active").alias("status"))
    return facts.compliance(new, rules).select("l_orderkey", "l_linenumber", "rule_id", "result")


@query("consistency", """
SELECT DISTINCT a.p_name AS subject, 'brand' AS predicate, a.p_brand AS new_value, b.p_brand AS existing_value, b.p_type AS existing_source
FROM part a JOIN part b ON regexp_replace(lower(a.p_name), '\\s+', '', 'g') = regexp_replace(lower(b.p_name), '\\s+', '', 'g') AND lower(a.p_brand) <> lower(b.p_brand)""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.consistency(_part_facts(spark, sf_dir), _part_facts(spark, sf_dir))


@query("facts_greedy", """
WITH RECURSIVE f AS (SELECT p_partkey AS n, p_type AS t, p_name || ' ' || p_brand AS s, p_retailprice AS v FROM part),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, s, v ORDER BY n) AS r FROM f) WHERE r = 1),
e AS (SELECT b.n, list(a.n) AS early FROM u a JOIN u b ON a.t = b.t AND a.n < b.n AND (contains(a.s, b.s) OR contains(b.s, a.s)) GROUP BY b.n),
o AS (SELECT u.n, coalesce(early, []) AS early, row_number() OVER (ORDER BY u.n) AS i FROM u LEFT JOIN e ON e.n = u.n),
g(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.i, CASE WHEN list_has_any(g.kept, o.early) THEN g.kept ELSE list_append(g.kept, o.n) END FROM g JOIN o ON o.i = g.i + 1)
SELECT n AS ordinal, t AS type, s AS subject, CAST(v AS VARCHAR) AS value FROM u WHERE n IN (SELECT unnest(kept) FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))""")
def facts_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stay when names that hold each other, of one type, count as one statement."""
    f = table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.concat_ws(" ", "p_name", F.col("p_brand")).alias("subject"), F.lit("costs").alias("predicate"), F.col("p_retailprice").cast("string").alias("value"), F.lit(1.0).alias("confidence"), F.lit("part").alias("source"), F.col("p_partkey").alias("ordinal"))
    return facts.semantic_dedup(f, dedup="subject_predicate").select("ordinal", "type", "subject", "value")


@query("facts_extract", """
SELECT p_partkey::VARCHAR AS source, 'part' AS module, 'constraint' AS type, p_name AS subject, '上限为' AS predicate, p_size::VARCHAR AS value, 1.0::DOUBLE AS confidence, 1::BIGINT AS ordinal FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'part', 'enum', p_brand, '分为', p_type, CASE WHEN regexp_matches(p_type, '\\d') THEN 1.0 ELSE 0.9 END, 2 FROM part""")
def facts_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that parts state in a line each."""
    p = graph.spread(table(spark, sf_dir, "part"))
    body = F.concat(F.lit("- "), F.col("p_name"), F.lit("上限为"), F.col("p_size").cast("string"), F.lit("。\n"), F.col("p_brand"), F.lit("分为"), F.col("p_type"))
    return facts.extract(p.select(F.col("p_partkey").cast("string").alias("source"), F.lit("part").alias("module"), F.lit(0).alias("chunk_index"), body.alias("text")))


# --- rules

_PATTERNS = "(VALUES ('small', ''), ('red', 'STANDARD'), ('', 'ECONOMY')) p(s, t)"


@query("suppression", f"SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM {_PATTERNS} WHERE s <> '' AND contains(p_name, s) AND (t = '' OR contains(p_type, t)))")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([("small", ""), ("red", "STANDARD"), ("", "ECONOMY")], "subject string, predicate string")
    f = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("subject"), F.col("p_type").alias("predicate"))
    return canon.unsuppressed(f, patterns).select("p_partkey")


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "part").select(canon.rule_id(F.col("p_partkey") + 1).alias("id"), F.element_at(F.split("p_name", " "), -1).alias("subject"), F.col("p_name").alias("value"), F.lit("active").alias("status"), none.alias("depends_on"))


@query("infer_dependencies", """
WITH r AS (SELECT 'canon_' || lpad((p_partkey + 1)::VARCHAR, greatest(4, length((p_partkey + 1)::VARCHAR))::INTEGER, '0') AS id, p_partkey AS o, string_split(p_name, ' ')[-1] AS subject, p_name AS value FROM part),
s AS (SELECT subject, arg_max(id, o) AS parent FROM r WHERE length(subject) >= 3 GROUP BY subject)
SELECT id AS child, parent FROM r JOIN s ON contains(value, s.subject) WHERE id <> parent""")
def infer_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.inferred_dependencies(_part_rules(spark, sf_dir), small=True)


@query("conflict_pairs", """
WITH p AS (SELECT o_orderkey + 1 AS n, o_custkey, o_orderpriority AS v, o_orderstatus AS s FROM orders), old AS (SELECT o_custkey, min(n) AS n FROM p WHERE s = 'O' GROUP BY o_custkey),
k AS (SELECT a.n AS new_n, b.n AS old_n, b.v AS old_value, a.v AS new_value FROM p a JOIN old o ON a.o_custkey = o.o_custkey JOIN p b ON b.n = o.n WHERE a.s = 'P' ORDER BY a.n LIMIT 50)
SELECT 'canon_' || lpad(new_n::VARCHAR, greatest(4, length(new_n::VARCHAR))::INTEGER, '0') AS new_id, 'canon_' || lpad(old_n::VARCHAR, greatest(4, length(old_n::VARCHAR))::INTEGER, '0') AS old_id, old_value, new_value,
  CASE WHEN old_value = new_value THEN 'format_variant' ELSE 'cross_doc_contradiction' END AS category FROM k""")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("n"), "o_custkey", F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("s"))
    old = o.where("s = 'O'").groupBy("o_custkey").agg(F.min("n").alias("first"))
    status = F.when(F.col("s") == "P", "pending").otherwise("active")
    rules = o.join(old, "o_custkey", "left").select(canon.rule_id(F.col("n")).alias("id"), F.lit("customer").alias("subject"), F.lit("priority").alias("predicate"), "value", F.col("n").cast("string").alias("source"), status.alias("status"), F.when(F.col("s") == "P", canon.rule_id(F.col("first"))).alias("conflict_with"))
    return canon.conflict_pairs(rules, 50).select("new_id", "old_id", "old_value", "new_value", "category")


@query("canon_merge", r"""
WITH RECURSIVE f AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS o, p_name AS s, p_brand AS v FROM part),
g(i, o, s, v, known, h, outcome) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', '', CAST([] AS STRUCT(s VARCHAR, v VARCHAR, st VARCHAR, o BIGINT)[]), CAST(0 AS BIGINT), ''
  UNION ALL SELECT i, o, s, v, CASE outcome WHEN 'added' THEN list_append(known, {'s': s, 'v': v, 'st': 'active', 'o': o})
    WHEN 'conflict' THEN list_transform(known, lambda k, n: CASE WHEN n = h THEN {'s': k.s, 'v': k.v, 'st': 'conflict', 'o': k.o} ELSE k END)
    WHEN 'longer' THEN list_transform(known, lambda k, n: CASE WHEN n = h THEN {'s': k.s, 'v': v, 'st': k.st, 'o': k.o} ELSE k END) ELSE known END, h, outcome
  FROM (SELECT *, CASE WHEN h = 0 THEN 'added' WHEN known[h].v = v THEN 'skipped' WHEN NOT ((contains(known[h].v, v) OR contains(v, known[h].v)) AND least(length(v), length(known[h].v)) >= 5 AND NOT regexp_matches(trim(v), '^[\d.,\s]+$')) THEN 'conflict' WHEN length(v) > length(known[h].v) THEN 'longer' ELSE 'skipped' END AS outcome
    FROM (SELECT f.i, f.o, f.s, f.v, g.known, CAST(coalesce(list_position(list_transform(g.known, lambda k: contains(k.s, f.s) OR contains(f.s, k.s)), true), 0) AS BIGINT) AS h FROM g JOIN f ON f.i = g.i + 1))),
r AS (SELECT unnest(known) AS k FROM (SELECT known FROM g ORDER BY i DESC LIMIT 1)),
b AS (SELECT k.o AS o, k.s AS subject, k.v AS value, k.st AS status, CAST(NULL AS BIGINT) AS against FROM r UNION ALL SELECT o, s, v, 'pending', known[h].o FROM g WHERE outcome = 'conflict'),
n AS (SELECT *, row_number() OVER (ORDER BY o) AS n FROM b), d AS (SELECT *, 'canon_' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') AS id FROM n)
SELECT d.id, d.subject, 'brand' AS predicate, d.value, d.status, t.id AS conflict_with FROM d LEFT JOIN d t ON t.o = d.against""")
def canon_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that parts make when each states its brand under its name, in order of their keys."""
    f = _part_facts(spark, sf_dir).withColumn("priority", F.lit("normal"))
    rules, _ = canon.merge(spark.createDataFrame([], canon.RULE), f, now="2024-01-01 00:00:00")
    return rules.select("id", "subject", "predicate", "value", "status", "conflict_with")


@query("canon_export", """
WITH r AS (SELECT p_partkey + 1 AS o, 'canon_' || lpad((p_partkey + 1)::VARCHAR, greatest(4, length((p_partkey + 1)::VARCHAR))::INTEGER, '0') AS id, p_brand AS module, p_type AS type, p_name AS subject, p_retailprice::VARCHAR AS value FROM part),
l AS (SELECT DISTINCT module, '' AS type, 0 AS kind, 0 AS o, '## ' || module AS line FROM r UNION ALL SELECT DISTINCT module, type, 1, 0, '### ' || type FROM r UNION ALL SELECT module, type, 2, o, '- **' || subject || '** costs ' || value || ' (' || id || ', normal)' FROM r)
SELECT '1' || module AS part, CAST(row_number() OVER (PARTITION BY module ORDER BY type, kind, o) - 1 AS INTEGER) AS line_no, line FROM l""")
def canon_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(canon.rule_id(F.col("p_partkey") + 1).alias("id"), F.col("p_brand").alias("module"), F.col("p_type").alias("type"), F.col("p_name").alias("subject"), F.lit("costs").alias("predicate"), F.col("p_retailprice").cast("string").alias("value"), F.lit("active").alias("status"), F.lit("normal").alias("priority"))
    return canon.export_lines(p)


# --- changes


def _signed(df: DataFrame, key: str, mtime: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("path"), F.col(mtime).cast("double").alias("mtime"), F.lit(0).cast("long").alias("size"))


_DIFF = """
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'removed' WHEN a.mtime IS NOT DISTINCT FROM b.mtime THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT o_orderkey::VARCHAR AS path, o_custkey AS mtime FROM orders) a FULL JOIN (SELECT c_custkey::VARCHAR AS path, c_custkey AS mtime FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier) b ON a.path = b.path"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").withColumn("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    before = _signed(table(spark, sf_dir, "customer"), "c_custkey", "c_custkey").unionByName(_signed(supplier, "s_suppkey", "s_nationkey"))
    return changes.diff(_signed(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"), before)


@query("cdc_diff", _DIFF)
def cdc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query("cdc_counts", f"SELECT count_if(change = 'new') AS new, count_if(change = 'changed') AS changed, count_if(change = 'unchanged') AS unchanged, count_if(change = 'removed') AS removed FROM ({_DIFF})")
def cdc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_counts(_diff(spark, sf_dir))


_STATUS = """
WITH s AS (SELECT 'd' || doc_id || '.md' AS src, n_chars::DOUBLE AS m FROM documents), d AS (SELECT 'd' || doc_id || '.md' AS dst, 500.0 + 1000 * quality AS m FROM labels UNION ALL SELECT 'c' || conv_id || '.md', 1.0 FROM (SELECT DISTINCT conv_id FROM conversations)),
x AS (SELECT 'd' || vec_id || '.md' AS p, 100.0 * vec_id AS m FROM embeddings UNION ALL SELECT 'p' || page_id || '.md', 1.0 FROM pages)
SELECT src AS dst, CASE WHEN d.dst IS NULL THEN 'unprocessed' WHEN s.m > d.m + 1 THEN 'outdated_src' WHEN x.m IS NULL OR x.m + 1 < d.m THEN 'outdated_index' ELSE 'ok' END AS status FROM s LEFT JOIN d ON d.dst = src LEFT JOIN x ON x.p = src
UNION ALL SELECT dst, 'orphan_md' FROM d WHERE dst NOT IN (SELECT src FROM s) UNION ALL SELECT p, 'orphan_index' FROM x WHERE p NOT IN (SELECT src FROM s) AND p NOT IN (SELECT dst FROM d)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"), F.lit(".md")).alias("path")
    s = table(spark, sf_dir, "documents").select(path("d", "doc_id"), F.col("n_chars").cast("double").alias("mtime"))
    d = table(spark, sf_dir, "labels").select(path("d", "doc_id"), (500.0 + 1000 * F.col("quality")).alias("mtime")).unionByName(table(spark, sf_dir, "conversations").select(path("c", "conv_id"), F.lit(1.0).alias("mtime")).distinct())
    x = table(spark, sf_dir, "embeddings").select(path("d", "vec_id"), (100.0 * F.col("vec_id")).alias("mtime")).unionByName(table(spark, sf_dir, "pages").select(path("p", "page_id"), F.lit(1.0).alias("mtime")))
    return changes.processing_status(s, d, x)


@query("processing_status", _STATUS)
def processing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.by_urgency(_status(spark, sf_dir)).select("dst", "status")


@query("processing_counts", f"WITH g AS ({_STATUS}) SELECT n.status, count(g.status) AS n FROM (VALUES ('unprocessed'), ('outdated_src'), ('outdated_index'), ('orphan_index'), ('orphan_md'), ('ok')) n(status) LEFT JOIN g ON g.status = n.status GROUP BY n.status")
def processing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.status_counts(_status(spark, sf_dir))


@query("paths", """
SELECT page_id, substr(md5(url), 1, 10) || '_' || page_id AS id, CASE WHEN len(string_split(url, '/')) >= 2 THEN array_to_string(string_split(url, '/')[-2:], '/') ELSE url END AS short,
  CASE WHEN url = 'https://m.ththth.example.net' OR starts_with(url, 'https://m.ththth.example.net/') THEN 'kb' || substr(url, 29) ELSE url END AS moved,
  substr(sha256('v2:' || html), 1, 16) AS cache_key, substr(sha256(html), 1, 8) AS version FROM pages""")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.chunk_id(u, F.col("page_id")).alias("id"), X.short_path(u).alias("short"), X.remap_prefix(u, "https://m.ththth.example.net", "kb").alias("moved"), X.cache_key(F.col("html"), "v2").alias("cache_key"), X.doc_version(F.col("html")).alias("version"))


@query("token_batches", """
WITH RECURSIVE r AS (SELECT source, doc_id, CAST(floor(length(left(text, 10000)) * 0.7::DOUBLE) AS INTEGER) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, tokens, i, 0 AS batch, 1 AS held, tokens AS used FROM r WHERE i = 1
  UNION ALL SELECT r.source, r.doc_id, r.tokens, r.i, CASE WHEN f.held >= 16 OR f.used + r.tokens > 7000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.held >= 16 OR f.used + r.tokens > 7000 THEN 1 ELSE f.held + 1 END, CASE WHEN f.held >= 16 OR f.used + r.tokens > 7000 THEN r.tokens ELSE f.used + r.tokens END
  FROM f JOIN r ON r.source = f.source AND r.i = f.i + 1)
SELECT source, doc_id, tokens, batch FROM f""")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_batches(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("embed_documents")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", models.embedder()(F.col("text")).alias("embedding"))
