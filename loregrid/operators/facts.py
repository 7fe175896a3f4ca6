"""Facts (type, subject, predicate, value, confidence, source, module, ordinal): extraction, filters, deduplication, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.models import cached
from loregrid.operators.graph import contains_join, cut, numbered, once

CONFIDENCE, CANON_CONFIDENCE, FALLBACK_CONFIDENCE = 0.7, 0.8, 0.9
#: What the built-in extractor looks for in a line: type>predicate.
PATTERNS = "constraint>上限为 constraint>下限为 constraint>不超过 constraint>最多 constraint>最少 enum>分为 enum>包括 enum>类型包括 rule>规则为 rule>必须 rule>禁止 dependency>依赖"


#: What a model is told to look for, by type of document.
HINTS = "需求分析文档>找业务规则、数值的上下限和流程要求 后端设计文档>找数据约束、接口规则和配置结构 前端设计文档>找交互规则和显示约束 后台设计文档>找权限规则和校验规则 功能概述>找核心规则、分类和流程约束"


def hint(doc_type: Column) -> Column:
    return F.coalesce(*(F.when(doc_type == k, v) for k, v in X.pairs(HINTS)), F.lit(""))


def extract(chunks: DataFrame) -> DataFrame:
    """Facts stated in a line as 'subject predicate value', by the first predicate in it; the stand-in for a model.

    chunks: source, module, chunk_index, text, and for a model's use heading_chain and hint. ordinal follows source, chunk
    and line.
    """
    lines = chunks.select("source", "module", "chunk_index", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line"))
    lines = lines.where(X.has_any(F.col("line"), " ".join(p for _, p in X.pairs(PATTERNS))))  # what is taken off below makes no predicate
    clean = F.regexp_replace(X.strip(F.col("line")), r"^([-*#>|\d.、\s]+)", "")
    place = ["source", "module", "chunk_index", "line_no"]
    lines = lines.select(*place, once(F.regexp_replace(clean, "[。；;|]+$", "")).alias("line"))
    found = None
    for kind, predicate in X.pairs(PATTERNS):
        at = F.instr("line", predicate)
        hit = F.struct(at.alias("at"), F.lit(-len(predicate)).alias("size"), F.lit(kind).alias("type"), F.lit(predicate).alias("predicate"))
        hit = F.when(at > 1, hit)
        found = [hit] if found is None else [*found, hit]
    lines = lines.select(*place, "line", once(F.array_min(F.array_compact(F.array(*found)))).alias("f")).where("f IS NOT NULL")
    subject = X.strip(F.substr("line", F.lit(1), F.col("f.at") - 1))
    value = X.strip(F.regexp_replace(F.substr("line", F.col("f.at") - F.col("f.size")), "^[：:为是]", ""))
    lines = lines.select(*place, "f", once(F.struct(subject.alias("subject"), value.alias("value"))).alias("said"))
    confidence = F.when(F.col("said.value").rlike(r"\d"), 1.0).otherwise(0.9)
    ordinal = F.row_number().over(Window.partitionBy("source").orderBy("chunk_index", "line_no"))
    out = lines.select("f.type", "said.subject", "f.predicate", "said.value", confidence.alias("confidence"), "source", "module", ordinal.cast("long").alias("ordinal"))
    return distinct_facts(valid(out), ["source"])


def extract_cached(chunks: DataFrame, cache: DataFrame | None, extract, model: str = "default") -> tuple[DataFrame, DataFrame]:
    """(facts of chunks, new cache entries): extract sees each heading and text once; that nothing was found is remembered too.

    cache: (cache_key, facts). Facts of a document are numbered in order of its chunks and their own order there.
    """
    one = "array<struct<ordinal:bigint,type:string,subject:string,predicate:string,value:string,confidence:double>>"

    def compute(missing: DataFrame) -> DataFrame:
        asked = missing.select(F.col("cache_key").alias("source"), F.lit("").alias("module"), F.lit(0).alias("chunk_index"), "text", "heading_chain", "hint")
        found = extract(asked).groupBy(F.col("source").alias("cache_key")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "type", "subject", "predicate", "value", "confidence"))).cast(one).alias("facts"))
        return missing.select("cache_key").join(found, "cache_key", "left").withColumn("facts", F.coalesce("facts", F.array().cast(one)))

    told = chunks.select("source", "module", "chunk_index", "text", X.text(F.col("heading_chain")).alias("heading_chain"), hint(F.col("doc_type")).alias("hint"))
    key = X.cache_key(F.concat_ws("\n", "hint", "heading_chain", "text"), "facts", model)
    known, new = cached(told, cache, key, compute, ["facts"])
    rows = known.select("source", "module", "chunk_index", F.inline("facts"))
    order = F.row_number().over(Window.partitionBy("source").orderBy("chunk_index", "ordinal"))
    rows = rows.withColumn("ordinal", order.cast("long")).drop("chunk_index")
    return distinct_facts(valid(rows), ["source"]), new


def valid(facts: DataFrame) -> DataFrame:
    """With subject and value, confident, and not of the kinds that are worth nothing."""
    filled = (X.strip(X.text(F.col("subject"))) != "") & (X.strip(X.text(F.col("value"))) != "")
    return facts.where(filled & (F.col("confidence") >= CONFIDENCE) & ~X.low_value(X.fact_text(F.col("subject"), F.col("predicate"), F.col("value"))))


def distinct_facts(facts: DataFrame, within: list[str] | None = None) -> DataFrame:
    """One of each (type, subject, predicate, value): the most confident, then the first."""
    w = Window.partitionBy(*(within or []), "type", "subject", "predicate", "value").orderBy(F.desc("confidence"), "source", "ordinal")
    return facts.withColumn("lg_r", F.row_number().over(w)).where("lg_r = 1").drop("lg_r")


def by_content(facts: DataFrame) -> DataFrame:
    """With its content id, the first fact of each."""
    w = Window.partitionBy("id").orderBy("source", "ordinal")
    named = facts.withColumn("id", X.fact_id(F.col("type"), F.col("subject"), F.col("predicate"), F.col("value")))
    return named.withColumn("lg_r", F.row_number().over(w)).where("lg_r = 1").drop("lg_r")


def canon_candidates(facts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Facts worth a rule, with a priority: by verdicts (ordinal, source, worthy, priority) where given, by rule otherwise. W8: batch numbers of 30 for a model."""
    near = facts.where((F.col("confidence") >= CANON_CONFIDENCE) & (F.col("type") != "dependency"))
    near = near.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("source").orderBy("ordinal")) - 1) / 30).cast("int"))
    if verdicts is not None:
        return near.join(verdicts, ["source", "ordinal"]).where(F.col("worthy") & (F.col("priority") != "low")).drop("worthy")
    sure = near.where((F.col("confidence") >= FALLBACK_CONFIDENCE) & F.col("type").isin("constraint", "rule"))
    return sure.withColumn("priority", X.fallback_priority(F.col("type"), F.col("predicate"), F.col("value")))


def greedy_survivors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes (column n, in an order) that no kept earlier node is alike to; pairs: (early, late).

    The result of looking at one after the other, found in rounds: a node with no undecided or kept earlier one is kept,
    and one with a kept earlier one goes.
    """
    pairs = cut(pairs.select("early", "late").distinct())
    undecided = cut(nodes.select("n").distinct())
    kept = undecided.limit(0)
    while undecided.limit(1).count():
        blocked = pairs.join(undecided.select(F.col("n").alias("early")), "early").select(F.col("late").alias("n")).distinct()
        free = cut(undecided.join(blocked, "n", "left_anti"))
        gone = pairs.join(free.select(F.col("n").alias("early")), "early").select(F.col("late").alias("n")).distinct()
        kept = kept.unionByName(free)
        undecided = cut(undecided.join(free, "n", "left_anti").join(gone, "n", "left_anti"))
    return kept


def alike_pairs(facts: DataFrame, small: bool | None = None) -> DataFrame:
    """(early, late) ordinals of facts of one type with nested subjects (two characters at least) and equal or nested predicates; values don't matter."""
    f = facts.where((X.text(F.col("subject")) != "") & (X.text(F.col("predicate")) != "")).withColumn("p", X.dedup_predicate(F.col("predicate"))).where("p <> ''")
    long = f.select(F.col("ordinal").alias("o1"), F.col("type").alias("t1"), F.col("subject").alias("s1"), F.col("p").alias("p1"))
    short = f.where(F.length("subject") >= 2).select(F.col("ordinal").alias("o2"), F.col("type").alias("t2"), F.col("subject").alias("s2"), F.col("p").alias("p2"))
    nested = (F.least(F.length("p1"), F.length("p2")) >= 2) & (F.col("p1").contains(F.col("p2")) | F.col("p2").contains(F.col("p1")))
    met = contains_join(long, short, "s1", "s2", small).where((F.col("t1") == F.col("t2")) & (F.col("o1") != F.col("o2")) & ((F.col("p1") == F.col("p2")) | nested))
    return met.select(F.least("o1", "o2").alias("early"), F.greatest("o1", "o2").alias("late")).distinct()


def greedy_facts(pool: DataFrame, small: bool | None = None) -> DataFrame:
    """The survivors (column n) of facts (ordinal, type, subject, predicate), by greedy_survivors over alike_pairs.

    Facts of one type and subject (of two characters at least) whose predicates are spelt alike are alike to each other
    and to the same others: whether the first of them stays or goes, the rest go. So only the first ones are compared.
    What is alike to nothing stays.
    """
    predicate = X.dedup_predicate(X.text(F.col("predicate")))
    meets = (F.length(X.text(F.col("subject"))) >= 2) & (predicate != "") & F.col("type").isNotNull()
    keyed = pool.withColumn("lg_p", predicate).withColumn("lg_meets", meets)
    first = cut(keyed.where("lg_meets").groupBy("type", "subject", "lg_p").agg(F.min("ordinal").alias("ordinal")).withColumnRenamed("lg_p", "predicate"))
    kept = greedy_survivors(first.select(F.col("ordinal").alias("n")), alike_pairs(first, small))
    return kept.unionByName(keyed.where("NOT lg_meets").select(F.col("ordinal").alias("n")))


def semantic_dedup(facts: DataFrame, existing: DataFrame | None = None, dedup: str = "content", small: bool | None = None) -> DataFrame:
    """New facts that stay, in order of ordinal: by content, or with dedup='subject_predicate' also without those alike to an earlier or stored one."""
    new = by_content(facts)
    if dedup != "subject_predicate":
        return new
    pool = new.select("ordinal", "type", "subject", "predicate")
    if existing is not None:  # stored facts come before all new ones
        old = numbered(existing.select("id", "type", "subject", "predicate"), ["id"], "n").select((-1 - F.col("n")).alias("ordinal"), "type", "subject", "predicate")
        pool = pool.unionByName(old)
    kept = greedy_facts(pool, small)
    return new.join(kept.withColumnRenamed("n", "ordinal"), "ordinal", "left_semi")


def upsert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """table with new rows in place of those with their key; of several new rows with a key, the last by ordinal."""
    w = Window.partitionBy(key).orderBy(F.desc("ordinal"))
    last = new.withColumn("lg_r", F.row_number().over(w)).where("lg_r = 1").drop("lg_r")
    return table.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def without_sources(table: DataFrame, sources: DataFrame, column: str = "source") -> DataFrame:
    return table.join(sources.select(F.col(column)), column, "left_anti")


def of_sources(table: DataFrame, sources: DataFrame, column: str = "source") -> DataFrame:
    return table.join(sources.select(F.col(column)), column, "left_semi")


def audit_groups(facts: DataFrame) -> DataFrame:
    """Facts of subjects that several sources speak of, after dropping all but the surest of equal statements; with subject_key, predicate_key and value_key."""
    keyed = facts.withColumns({f"{c}_key": X.audit_key(F.col(c)) for c in ("subject", "predicate", "value")})
    best = Window.partitionBy("subject_key", "predicate_key", "value_key").orderBy(F.desc("confidence"), "source", "ordinal")
    one = keyed.withColumn("lg_r", F.row_number().over(best)).where("lg_r = 1").drop("lg_r")
    several = one.groupBy("subject_key").agg(F.countDistinct("source").alias("sources")).where("sources > 1")
    return one.join(several, "subject_key")


def audit_conflicts(facts: DataFrame, top_k: int = 20) -> DataFrame:
    """The first top_k subjects with one predicate and several values: (subject, predicate, statements)."""
    g = audit_groups(facts)
    statement = F.struct("value", "source", "confidence")
    found = g.groupBy("subject_key", "predicate_key").agg(F.min("subject").alias("subject"), F.min("predicate").alias("predicate"), F.countDistinct("value_key").alias("n"), F.sort_array(F.collect_list(statement)).alias("statements"))
    return found.where("n > 1").orderBy("subject_key", "predicate_key").limit(min(max(top_k, 1), 50)).select("subject", "predicate", "statements")


def compliance(new: DataFrame, rules: DataFrame) -> DataFrame:
    """New facts against active rules with their subject and predicate: passed or violation."""
    r = rules.where("status = 'active'").select("subject", "predicate", F.col("id").alias("rule_id"), F.col("value").alias("rule_value"), "priority")
    return new.join(r, ["subject", "predicate"]).withColumn("result", F.when(F.col("value") == F.col("rule_value"), "passed").otherwise("violation"))


def related_facts(new: DataFrame, facts: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Stored facts on the same subjects, and those that near (id) gives; without repeats."""
    same = facts.join(new.select("subject").distinct(), "subject", "left_semi")
    if near is not None:
        same = same.unionByName(facts.join(near.select("id").distinct(), "id", "left_semi"))
    return same.dropDuplicates(["subject", "predicate", "value"])


def consistency(new: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs of a new and a stored fact with one subject and predicate (spelling aside) and different values. What is said again is dropped before the two sides meet."""
    k = lambda c: X.audit_key(F.col(c))
    old = facts.select(k("subject").alias("sk"), k("predicate").alias("pk"), k("value").alias("vk"), F.col("value").alias("existing_value"), F.col("source").alias("existing_source")).distinct()
    mine = new.select("subject", "predicate", F.col("value").alias("new_value"), k("subject").alias("sk"), k("predicate").alias("pk"), k("value").alias("nk")).distinct()
    return mine.join(old, ["sk", "pk"]).where("vk <> nk").select("subject", "predicate", "new_value", "existing_value", "existing_source").distinct()


def check_status(compliance_rows: Column, conflict_rows: Column, checked: Column) -> Column:
    """One status from numbers of violations and conflicts."""
    return F.when((compliance_rows > 0) | (conflict_rows > 0), "conflicts_found").when(~checked, "check_skipped").otherwise("ok")


def type_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
