"""Registered queries of the scalar functions and filters. Their inputs are made from the driver's tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.operators import changes, facts, graph
from loregrid.plans.catalogue import query


def made(spark: SparkSession, sf_dir: str, sql: str, read: Callable[[DataFrame], DataFrame] = lambda table: table) -> DataFrame:
    """The rows of sql, in which {part} and so on are the driver's tables, as read gives them."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: read(spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in names})


def bare(sql: str) -> str:
    """sql for DuckDB, where the tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def words(table: str) -> str:
    """A list of SQL strings."""
    return ", ".join(f"'{w}'" for w in table.split())


def first_of(table: str, of: str, otherwise: str) -> str:
    """SQL for the result of the first keyword>result of a table that a string holds."""
    return "CASE " + " ".join(f"WHEN contains({of}, '{k}') THEN '{v}'" for k, v in X.pairs(table)) + f" ELSE {otherwise} END"


def any_of(table: str, of: str) -> str:
    return "(" + " OR ".join(f"contains({of}, '{w}')" for w in table.split()) + ")"


# --- paths

PATHS = """
SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'doc' WHEN 1 THEN 'md_file/' || p_brand WHEN 2 THEN 'docs/' || p_brand || '/resources' WHEN 3 THEN 'images' WHEN 4 THEN p_brand || '/美术需求' WHEN 5 THEN 'a/md_file' ELSE p_brand || '/Tools' END || '/' ||
  CASE p_partkey % 8 WHEN 0 THEN p_name || '-需求分析' WHEN 1 THEN p_name || ' — 前端设计[v' || p_size || ']' WHEN 2 THEN p_name || '–后台配置' WHEN 3 THEN '初稿' || p_name WHEN 4 THEN p_name || '.PRD' WHEN 5 THEN '[v2]' WHEN 6 THEN p_type || '功能概述规范 a-b—c' ELSE p_name END ||
  CASE p_partkey % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.XLSM' WHEN 3 THEN '.v1.md' ELSE '' END AS path FROM {part}"""
_STEM = r"regexp_replace(string_split(path, '/')[-1], '(?s)^(.+)\.[^.]*$', '\1')"
_NAMED = f"p AS (SELECT *, {_STEM} AS stem, string_split(path, '/') AS parts FROM ({bare(PATHS)})), c AS (SELECT *, trim(regexp_replace(stem, '(?s)\\[.*?\\]$', '')) AS clean, list_slice(parts, 1, -2) AS folders FROM p)"


@query("path_names", f"""
WITH {_NAMED}
SELECT id, stem, CASE WHEN contains(clean, '-') THEN trim(string_split(clean, '-')[1]) WHEN contains(clean, '—') THEN trim(string_split(clean, '—')[1]) WHEN contains(clean, '–') THEN trim(string_split(clean, '–')[1])
    ELSE coalesce(list_filter(list_reverse(folders), lambda d: d <> '' AND d <> '.' AND lower(d) NOT IN ({words(X.GENERIC_DIRS)}))[1], clean) END AS module,
  {first_of(X.DOC_TYPES, 'stem', f"'{X.OTHER}'")} AS doc_type,
  array_to_string(list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN contains(stem, '{k}') THEN '{v}' END" for k, v in X.pairs(X.TAGS))}], lambda t: t IS NOT NULL))), ',') AS tags
FROM c""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6, X7, X8."""
    p = F.col("path")
    return made(spark, sf_dir, PATHS).select("id", X.stem(p).alias("stem"), X.module_name(p).alias("module"), X.doc_type(p).alias("doc_type"), F.array_join(X.tags(p), ",").alias("tags"))


@query("path_filter", f"WITH {_NAMED} SELECT id, path FROM c WHERE NOT list_has_any(parts, [{words(X.EXCLUDED_DIRS)}]) AND NOT {any_of(X.EXCLUDED_PARTS, 'stem')} AND len(list_filter(folders, lambda d: {any_of(X.EXCLUDED_PARTS, 'd')})) = 0")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return made(spark, sf_dir, PATHS).where(X.indexable(F.col("path")))


_MARKED = "string_split(replace(path, chr(92), '/'), 'md_file/')"


@query("path_rewrites", f"""
WITH {_NAMED}, s AS (SELECT *, CASE WHEN id % 3 = 0 THEN replace(path, '/', chr(92)) ELSE path END AS q FROM c)
SELECT id, CASE WHEN starts_with(replace(q, chr(92), '/'), 'docs/') THEN substr(replace(q, chr(92), '/'), 6) ELSE replace(q, chr(92), '/') END AS relative,
  CASE WHEN list_contains(parts, 'md_file') THEN array_to_string(list_slice(parts, list_position(parts, 'md_file') + 1, len(parts)), '/') ELSE array_to_string(list_slice(parts, -2, -1), '/') END AS short,
  CASE WHEN regexp_matches(lower(path), '\\.xls[xm]$') THEN stem || '/' || stem || '[xlsx转换].md' ELSE path END AS converted,
  regexp_replace(regexp_replace(q, '[\\s|<>"?*:/\\\\]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe,
  CASE WHEN path = 'images' OR starts_with(path, 'images/') THEN 'kb' || substr(path, 7) ELSE path END AS moved
FROM s""")
def path_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK6, X18, X20, X22, X23, D16."""
    p = made(spark, sf_dir, PATHS).withColumn("q", F.expr("CASE WHEN id % 3 = 0 THEN replace(path, '/', chr(92)) ELSE path END"))
    path, q = F.col("path"), F.col("q")
    return p.select("id", X.relative(q, "docs/").alias("relative"), X.short_path(path).alias("short"), X.converted_path(path).alias("converted"), X.safe_name(q).alias("safe"), X.remap_prefix(path, "images/", "kb").alias("moved"))


@query("remap_counts", f"SELECT count_if(starts_with(path, 'docs/')) AS changed, count_if(NOT starts_with(path, 'docs/')) AS unchanged, 'https:' AS common, 'a' AS marked FROM ({bare(PATHS)})")
def remap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21 and the counts of a remapping."""
    p = made(spark, sf_dir, PATHS)
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("https://"), F.col("page_id").cast("string"), F.lit("/a.md")).alias("path"))
    _, counts = changes.remapped(p, "docs", "kb")
    return counts.select("*", F.lit(changes.common_prefix(urls).split("/")[0]).alias("common"), F.lit(changes.common_prefix(p.where("path LIKE 'a/%'"))).alias("marked"))


# --- strings

STRINGS = "SELECT doc_id AS id, replace(replace(replace(text, '. ', '。 '), ', ', '，—'), ' the ', ' ：?') AS t FROM {documents}"
_ASCII = r"' \t\r\n\v\f'"


@query("normalisers", rf"""
WITH s AS (SELECT id, replace(t, chr(10), chr(13) || CASE WHEN id % 2 = 0 THEN chr(10) ELSE '' END) AS r, t FROM ({bare(STRINGS)}))
SELECT id, md5(regexp_replace(t, '[-—?？!！;；:：、。，\s]+', '', 'g')) AS dedup, md5(regexp_replace(t, '[\s，。、：:]+', '', 'g')) AS rule, md5(lower(regexp_replace(t, '[\s，。、：:]+', '', 'g'))) AS audit, md5(regexp_replace(r, '\r\n?', chr(10), 'g')) AS lines FROM s""")
def normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, X4, X5."""
    s = made(spark, sf_dir, STRINGS).withColumn("r", F.expr("replace(t, chr(10), chr(13) || CASE WHEN id % 2 = 0 THEN chr(10) ELSE '' END)"))
    t = F.col("t")
    return s.select("id", F.md5(X.dedup_predicate(t)).alias("dedup"), F.md5(X.rule_predicate(t)).alias("rule"), F.md5(X.audit_key(t)).alias("audit"), F.md5(X.normalize_newlines(F.col("r"))).alias("lines"))


REFERRING = """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '调用「' || p_name || '系统」，再参考 ' || p_brand || '模块。' WHEN 1 THEN '本文依赖背包系统，也对接任务模块、商城系统。' || p_name WHEN 2 THEN '详见' || p_name || p_type || p_brand || p_name || '服务'
  WHEN 3 THEN '普通说明' || p_name ELSE '参见“' || p_brand || '功能”;关联 ' || p_brand || '功能' END AS t FROM {part}"""


@query("cross_refs", rf"""
WITH s AS (SELECT id, list_concat(regexp_extract_all(t, '(?:{X.REFERRING.replace(" ", "|")})\s*[「"]*(.+?(?:{X.REFERRED.replace(" ", "|")}))', 1), regexp_extract_all(t, '([一-龥]{{2,8}}(?:系统|模块))[的，。、）)]', 1)) AS r FROM ({bare(REFERRING)}))
SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_transform(r, lambda x: trim(x))), lambda x: length(x) <= 20)), '|') AS refs FROM s""")
def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9."""
    return made(spark, sf_dir, REFERRING).select("id", F.array_join(X.cross_refs(F.col("t")), "|").alias("refs"))


@query("module_refs", rf"""
WITH s AS (SELECT CASE id % 3 WHEN 0 THEN '' ELSE 'm' || id % 11 END AS module, t FROM ({bare(REFERRING)})), e AS (SELECT module, unnest(list_concat(regexp_extract_all(t, '(?:{X.REFERRING.replace(" ", "|")})\s*[「"]*(.+?(?:{X.REFERRED.replace(" ", "|")}))', 1), regexp_extract_all(t, '([一-龥]{{2,8}}(?:系统|模块))[的，。、）)]', 1))) AS r FROM s)
SELECT DISTINCT CASE WHEN module = '' THEN '未知' ELSE module END AS module, trim(r) AS ref FROM e WHERE length(trim(r)) <= 20""")
def module_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    s = made(spark, sf_dir, REFERRING).select(F.expr("CASE id % 3 WHEN 0 THEN '' ELSE 'm' || id % 11 END").alias("module"), X.cross_refs(F.col("t")).alias("cross_refs"))
    return graph.module_refs(s)


MARKDOWN = """
SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN '  # Talk ' || conv_id || chr(10) || 'preface' || chr(10) WHEN conv_id % 3 = 1 THEN chr(10) || chr(10) ELSE '##no heading' || chr(10) || '# # Talk' || chr(10) END AS head,
  '## ' || CASE WHEN turn % 4 = 3 THEN '多语言 ' ELSE '' END || role || ' ' || turn || chr(10) || CASE WHEN turn % 3 = 0 THEN chr(10) || '  ' WHEN turn % 3 = 1 THEN '| ID | CN（简体中文） |' || chr(10) ELSE '' END || CASE WHEN turn % 2 = 0 THEN text ELSE '> ' || text || chr(10) || '---' || chr(10) || '# x' END || chr(10) AS part, turn FROM {conversations}"""
_BODY = f"b AS (SELECT id, any_value(head) || string_agg(part, '' ORDER BY turn) AS body FROM ({bare(MARKDOWN)}) GROUP BY id)"


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = made(spark, sf_dir, MARKDOWN).groupBy("id", "head").agg(F.sort_array(F.collect_list(F.struct("turn", "part")))["part"].alias("parts"))
    return parts.select("id", F.concat("head", F.array_join("parts", "")).alias("body"))


_SECTIONS = rf"""
{_BODY}, l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM b),
h AS (SELECT *, regexp_matches(line, '^##\s+.+$') AS is_head FROM l), g AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY id ORDER BY n) AS part FROM h),
a AS (SELECT id, part, any_value(line) FILTER (WHERE is_head) AS head, trim(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT is_head), {_ASCII}) AS body FROM g GROUP BY id, part),
t AS (SELECT id, part, coalesce(trim(ltrim(head, '#'), {_ASCII}), '') AS title, trim(CASE WHEN head IS NULL THEN coalesce(body, '') ELSE head || chr(10) || chr(10) || coalesce(body, '') END, {_ASCII}) AS content FROM a)""".replace("' \\t\\r\\n\\v\\f'", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")


@query("headings", rf"""
WITH {_BODY}, l AS (SELECT id, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '# '))[1] AS line FROM b)
SELECT id, coalesce(trim(regexp_replace(line, '^[# ]+', '')), '') AS heading FROM l""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10."""
    return _bodies(spark, sf_dir).select("id", X.first_heading(F.col("body")).alias("heading"))


@query("sections", f"WITH {_SECTIONS} SELECT id, title, md5(content) AS content, CAST(count(*) AS INTEGER) AS n FROM t WHERE content <> '' GROUP BY ALL")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11."""
    s = _bodies(spark, sf_dir).select("id", F.inline(X.sections(F.col("body"))))
    return s.groupBy("id", "title", F.md5("content").alias("content")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("section_filters", rf"""
WITH {_SECTIONS}, k AS (SELECT id, part, title, string_split(content, chr(10)) AS lines FROM t WHERE content <> '')
SELECT id, title, regexp_matches(title, '(?i)多语言|i18n|国际化') OR len(list_filter(lines[1:10], lambda x: regexp_matches(x, '\|\s*ID\s*\|.*CN（简体中文）'))) > 0 AS translated,
  length(trim(array_to_string(list_filter(lines, lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(#|---|> )')), ''))) < {X.LEAST_TEXT} AS thin, CAST(count(*) AS INTEGER) AS n FROM k GROUP BY ALL""")
def section_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F14."""
    s = _bodies(spark, sf_dir).select("id", F.inline(X.sections(F.col("body"))))
    return s.groupBy("id", "title", X.translated_section(F.col("title"), F.col("content")).alias("translated"), X.low_quality(F.col("content")).alias("thin")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("unfenced", "SELECT doc_id AS id, md5(trim(text, ' ' || chr(10))) AS body FROM documents WHERE text <> ''")
def unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts in a fence with a language, a third in a bare one."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''")
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  ```\n"), F.col("text"), F.lit("```"))).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("id"), F.md5(X.unfenced(wrapped)).alias("body"))


# --- queries

ASKED = """
SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'P' || (10 + p_size) || '  是什么' WHEN 1 THEN '背包和' || p_name || '的区别' WHEN 2 THEN '哪些模块依赖' || p_brand WHEN 3 THEN '关于' || p_name WHEN 4 THEN '"' || p_name || '"  SKL_0' || p_size || '  “' || p_brand || '”'
  WHEN 5 THEN p_name || '另外还有' || p_brand || '；以及其他的所有说明文档' WHEN 6 THEN '任务' || ' vs ' || p_name || '对比背包' WHEN 7 THEN '和与' ELSE p_name END AS q FROM {part}"""


@query("asked_entities", r"""
WITH s AS (SELECT id, q, ['背包', 'Brand#1', '任务'] AS known FROM (""" + bare(ASKED) + r""")),
f AS (SELECT id, list_concat(regexp_extract_all(q, '(?:^|[^A-Za-z])([A-Z]\d{2,4})(?:$|[^A-Za-z0-9])', 1), regexp_extract_all(q, '(?:^|[^A-Za-z])([A-Z]{2,5}_\d{2,5})(?:$|\W)', 1), regexp_extract_all(q, '"([^"]+)"', 1), regexp_extract_all(q, '“([^”]+)”', 1), list_filter(known, lambda m: contains(q, m))) AS e FROM s)
SELECT id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), '|') AS entities FROM f""")
def asked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12."""
    return made(spark, sf_dir, ASKED).select("id", F.array_join(X.entities(F.col("q"), ["背包", "Brand#1", "任务"]), "|").alias("entities"))


@query("sub_queries", f"""
WITH s AS (SELECT id, q, list_transform([{words(X.COMPARISONS)}], lambda w: CASE WHEN contains(q, w) THEN [trim(left(q, instr(q, w) - 1)), trim(substr(q, instr(q, w) + length(w)))] END) AS c,
  list_transform([{words(X.SEPARATORS)}], lambda w: CASE WHEN contains(q, w) THEN list_filter(list_transform(string_split(q, w), lambda x: trim(x)), lambda x: length(x) > 1) END) AS p FROM ({bare(ASKED)})),
o AS (SELECT id, q, list_concat(list_filter(c, lambda x: x IS NOT NULL AND length(x[1]) > 1 AND length(x[2]) > 1), list_filter(p, lambda x: x IS NOT NULL AND len(x) >= 2)) AS o FROM s)
SELECT id, array_to_string(CASE WHEN {any_of(X.COMPARISONS, 'q')} OR length(q) >= 20 AND {any_of(X.SEPARATORS, 'q')} THEN coalesce(o[1], [q]) ELSE [q] END, '|') AS parts FROM o""")
def sub_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15."""
    return made(spark, sf_dir, ASKED).select("id", F.array_join(X.sub_queries(F.col("q")), "|").alias("parts"))


# --- facts

STATED = """
SELECT l_orderkey AS source, CAST(l_linenumber AS BIGINT) AS ordinal, CASE l_linenumber % 4 WHEN 0 THEN 'constraint' WHEN 1 THEN 'rule' WHEN 2 THEN 'enum' ELSE 'dependency' END AS type, CASE WHEN l_suppkey % 9 = 0 THEN ' ' ELSE 's' || l_partkey END AS subject,
  CASE l_partkey % 6 WHEN 0 THEN '上限为' WHEN 1 THEN '必须' WHEN 2 THEN '支持语言' WHEN 3 THEN '默认显示' ELSE '规则为' END AS predicate, CASE l_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN '近7天' WHEN 2 THEN '不允许 X' ELSE 'v' || l_suppkey END AS value, l_discount * 10 AS confidence FROM {lineitem}"""
_VALID = "trim(subject) <> '' AND trim(value) <> '' AND confidence >= 0.7 AND NOT regexp_matches(subject || ' ' || predicate || ' ' || value, '" + X.LOW_VALUE.replace("\\\\", "\\") + "')"
_PRIORITY = f"CASE WHEN type = 'constraint' AND ({any_of(X.BOUNDARY_WORDS, 'predicate')} OR {any_of(X.BOUNDARY_WORDS, 'value')}) OR type = 'rule' AND ({any_of(X.MANDATORY_WORDS, 'predicate')} OR {any_of(X.MANDATORY_WORDS, 'value')}) THEN 'critical' ELSE 'normal' END"


@query("facts_valid", f"SELECT source, ordinal FROM ({bare(STATED)}) WHERE {_VALID}")
def facts_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, F8, X27."""
    return facts.valid(made(spark, sf_dir, STATED)).select("source", "ordinal")


_NEAR = f"n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY ordinal) - 1) / 30) AS INTEGER) AS batch FROM ({bare(STATED)}) WHERE confidence >= 0.8 AND type <> 'dependency')"


@query("canon_candidates", f"WITH {_NEAR} SELECT source, ordinal, batch, {_PRIORITY} AS priority FROM n WHERE confidence >= 0.9 AND type IN ('constraint', 'rule')")
def canon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F11, W8, M6 without a model."""
    return facts.canon_candidates(made(spark, sf_dir, STATED)).select("source", "ordinal", "batch", "priority")


@query("canon_verdicts", f"WITH {_NEAR} SELECT source, ordinal, batch, CASE WHEN source % 3 = 0 THEN 'normal' ELSE 'critical' END AS priority FROM n WHERE ordinal % 2 = 0 AND source % 5 <> 0")
def canon_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same with a model's verdicts."""
    s = made(spark, sf_dir, STATED)
    verdicts = s.select("source", "ordinal", (F.col("ordinal") % 2 == 0).alias("worthy"), F.when(F.col("source") % 5 == 0, "low").when(F.col("source") % 3 == 0, "normal").otherwise("critical").alias("priority")).distinct()
    return facts.canon_candidates(s, verdicts).select("source", "ordinal", "batch", "priority")


@query("value_guards", r"""
WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '1,000.5' WHEN 1 THEN '12%' WHEN 2 THEN '¥' || p_size WHEN 3 THEN p_name WHEN 4 THEN ' 7 ' ELSE '' END AS a, CASE p_partkey % 4 WHEN 0 THEN p_name || ' and more' WHEN 1 THEN '1,000.5 ' WHEN 2 THEN 'x' ELSE p_brand END AS b FROM part)
SELECT id, try_cast(translate(trim(a), ',%¥$', '') AS DOUBLE) IS NOT NULL AS number, (contains(a, b) OR contains(b, a)) AND NOT regexp_matches(trim(a), '^[\d.,\s]+$') AND NOT regexp_matches(trim(b), '^[\d.,\s]+$') AND least(length(a), length(b)) >= 5 AS merges FROM v""")
def value_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X24, X26."""
    v = made(spark, sf_dir, "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '1,000.5' WHEN 1 THEN '12%' WHEN 2 THEN '¥' || p_size WHEN 3 THEN p_name WHEN 4 THEN ' 7 ' ELSE '' END AS a, CASE p_partkey % 4 WHEN 0 THEN p_name || ' and more' WHEN 1 THEN '1,000.5 ' WHEN 2 THEN 'x' ELSE p_brand END AS b FROM {part}")
    return v.select("id", X.is_numeric(F.col("a")).alias("number"), X.mergeable_values(F.col("a"), F.col("b")).alias("merges"))


# --- times and images

_AGES = [(60, "秒", 1), (3600, "分钟", 60), (86400, "小时", 3600)]
_AGE = "CASE " + " ".join(f"WHEN abs(s) < {limit} THEN CAST(floor(abs(s) / {unit}) AS BIGINT) || '{name}'" for limit, name, unit in _AGES) + " ELSE CAST(floor(abs(s) / 86400) AS BIGINT) || '天' END"
LATE = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'outdated_src' WHEN 1 THEN 'outdated_index' WHEN 2 THEN 'ok' ELSE 'orphan_md' END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS src, o_custkey * 1.0 AS dst, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey * 40.0 END AS indexed, 'o' || o_orderkey || '.md' AS path FROM {orders}"


@query("drift", f"""
WITH l AS (SELECT *, CASE status WHEN 'outdated_src' THEN src - dst WHEN 'outdated_index' THEN dst - indexed END AS s FROM ({bare(LATE)}))
SELECT id, CASE WHEN status = 'outdated_src' AND s IS NOT NULL THEN '源文件新于转换结果 ' || {_AGE} WHEN status = 'outdated_index' AND indexed IS NULL THEN '未索引' WHEN status = 'outdated_index' THEN '索引落后 ' || {_AGE} ELSE '' END AS drift FROM l""")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19."""
    return made(spark, sf_dir, LATE).select("id", X.drift(F.col("status"), F.col("src"), F.col("dst"), F.col("indexed")).alias("drift"))


@query("gaps", f"SELECT path AS dst, status FROM ({bare(LATE)}) WHERE status <> 'ok' AND contains(path, '7')")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    late = made(spark, sf_dir, LATE).select(F.lit(None).cast("string").alias("src"), F.col("path").alias("dst"), "status", F.col("src").cast("double").alias("src_mtime"), F.col("dst").cast("double").alias("dst_mtime"), F.col("indexed").cast("double").alias("indexed_mtime"))
    return changes.gaps(late, "7").select("dst", "status")


@query("image_kinds", "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'webp' ELSE 'png' END AS kind FROM part")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds, a RIFF file that is no picture, and bytes that are nothing."""
    heads = "CASE p_partkey % 7 WHEN 0 THEN '89504E470D0A' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383961' WHEN 3 THEN '424D0000' WHEN 4 THEN '52494646000000005745425020' WHEN 5 THEN '52494646000000005741564520' ELSE '00' END"
    return made(spark, sf_dir, f"SELECT p_partkey AS id, unhex({heads}) AS data FROM {{part}}").select("id", X.image_kind(F.col("data")).alias("kind"))


@query("to_convert", f"""
WITH {_NAMED}, w AS (SELECT id, path, id % 50 AS mtime, stem || '/' || stem || '[xlsx转换].md' AS target FROM c WHERE regexp_matches(lower(path), '\\.xls[xm]$')),
t AS (SELECT target, max(25) AS m FROM w WHERE id % 3 <> 0 GROUP BY target)
SELECT id FROM w LEFT JOIN t USING (target) WHERE t.m IS NULL OR t.m < w.mtime""")
def to_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18."""
    w = made(spark, sf_dir, PATHS).where(F.lower("path").rlike(r"\.xls[xm]$")).withColumn("mtime", F.col("id") % 50)
    t = w.where("id % 3 <> 0").select(X.converted_path(F.col("path")).alias("path"), F.lit(25).cast("long").alias("mtime"))
    return changes.to_convert(w, t).select("id")


@query("next_meta", """
WITH now AS (SELECT o_orderkey AS path, CAST(o_custkey AS DOUBLE) AS mtime, CAST(o_orderkey % 9 AS BIGINT) AS size FROM orders), old AS (SELECT c_custkey AS path, CAST(CASE WHEN c_custkey % 2 = 0 THEN o_custkey ELSE 0 END AS DOUBLE) AS mtime, CAST(c_custkey % 9 AS BIGINT) AS size, TIMESTAMP '2024-01-01' AS t FROM customer LEFT JOIN orders ON o_orderkey = c_custkey),
bad AS (SELECT path FROM now WHERE path % 10 = 3)
SELECT n.path, n.mtime, n.size, CASE WHEN o.path IS NOT NULL AND n.mtime = o.mtime AND n.size = o.size THEN o.t ELSE TIMESTAMP '2024-06-01' END AS indexed_at FROM now n LEFT JOIN old o USING (path) WHERE n.path NOT IN (SELECT path FROM bad)
UNION ALL SELECT * FROM old WHERE path IN (SELECT path FROM bad)""")
def next_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U7."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    now = o.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").cast("double").alias("mtime"), (F.col("o_orderkey") % 9).cast("long").alias("size"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(o.select("o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_orderkey"), "left")
    old = c.select(F.col("c_custkey").alias("path"), F.when(F.col("c_custkey") % 2 == 0, F.col("o_custkey")).otherwise(0).cast("double").alias("mtime"), (F.col("c_custkey") % 9).cast("long").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("indexed_at"))
    return changes.next_meta(now, old, now.where("path % 10 = 3"), F.lit("2024-06-01").cast("timestamp"))
