"""The rule base: ordered merging of facts, conflicts, dependencies, suppressions, status and export.

Every operation takes tables and gives tables. Rules have an id, canon_0001 and so on; `ordinal` is the number in it.
"""

from __future__ import annotations

from collections.abc import Iterator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.operators.graph import canonical, components, contains_join, cut, fits, numbered

HISTORY = "array<struct<old_value:string,new_value:string,changed_at:timestamp,reason:string>>"
RULE = (
    "id string, type string, priority string, subject string, predicate string, value string, module string, source string, confidence double, status string, "
    f"depends_on array<string>, dependents array<string>, conflict_with string, added_at timestamp, updated_at timestamp, history {HISTORY}"
)
STATUSES = ("active", "conflict", "pending", "needs_review", "deprecated")
#: Statuses of rules that a new fact is held against. A pending rule never is.
MATCHED = ("active", "conflict", "needs_review")
CATEGORIES = ("deprecated_old", "cross_doc_contradiction", "semantic_overlap", "format_variant", "uncategorized")
_STRIP = re.compile(r"[\s，。、：:]+")
_NUMBER = re.compile(r"[\d.,\s]+")

Name = str | None


def ordinal(c: Column) -> Column:
    return F.regexp_extract(c, r"canon_(\d+)$", 1).try_cast("long")


def rule_id(number: Column) -> Column:
    return F.concat(F.lit("canon_"), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit("0")))


def last_number(rules: DataFrame) -> DataFrame:
    """One row, last: the highest number of an id, 0 if there is none."""
    return rules.agg(F.coalesce(F.max(ordinal(F.col("id"))), F.lit(0)).cast("long").alias("last"))


def suppressed(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Facts that a pattern (subject, predicate) holds back: its subject, not empty, stands in theirs, and its predicate is empty or in theirs."""
    return _by_patterns(facts, patterns, "left_semi")


def unsuppressed(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    return _by_patterns(facts, patterns, "left_anti")


def _by_patterns(facts: DataFrame, patterns: DataFrame, how: str) -> DataFrame:
    p = patterns.where(X.text(F.col("subject")) != "").select(F.col("subject").alias("p_subject"), X.text(F.col("predicate")).alias("p_predicate")).distinct()
    by_predicate = (F.col("p_predicate") == "") | X.text(F.col("predicate")).contains(F.col("p_predicate"))
    if fits(p):
        return facts.join(F.broadcast(p), X.text(F.col("subject")).contains(F.col("p_subject")) & by_predicate, how)
    subjects = facts.select(X.text(F.col("subject")).alias("lg_subject")).distinct()
    met = contains_join(subjects, p, "lg_subject", "p_subject", False)
    return facts.join(met, (X.text(F.col("subject")) == F.col("lg_subject")) & by_predicate, how)


def similar(old_subject: str, old_predicate: str, subject: str, predicate) -> bool:
    """Whether a fact is about what a rule is about: the same words, or nested subjects with equal or synonymous predicates."""
    if (old_subject, old_predicate) == (subject, predicate):
        return True
    if subject not in old_subject and old_subject not in subject:
        return False
    a, b = _STRIP.sub("", old_predicate), _STRIP.sub("", predicate)
    return a == b or any((x in a and y in b) or (y in a and x in b) for x, y in X.pairs(X.SYNONYMS))


def _mergeable(a: str, b: str) -> bool:
    return (a in b or b in a) and not _NUMBER.fullmatch(a.strip()) and not _NUMBER.fullmatch(b.strip()) and min(len(a), len(b)) >= 5


FOLDED = (
    "key string, born long, outcome string, status string, value string, touched boolean, conflict_key string, conflict_born long, "
    "type string, priority string, subject string, predicate string, module string, source string, confidence double"
)


def fold(rows: list[dict]) -> Iterator[dict]:
    """One cluster of rules (kind 0, in order of number) and facts (kind 1, in order): how each fact fares, and the rules after it.

    A fact without a similar rule becomes one. An equal value is skipped, of nested values the longer one stays, and any
    other value makes the rule a conflict and the fact a pending rule that names it.
    """
    known: list[dict] = []
    of_subject: dict[str, list[int]] = {}  # numbers in known
    nested: dict[str, list[str]] = {}  # a subject's nested ones among those of known

    def alike(r: dict) -> dict | None:
        if r["subject"] not in nested:
            nested[r["subject"]] = [s for s in of_subject if s in r["subject"] or r["subject"] in s]
        near = sorted(i for s in nested[r["subject"]] for i in of_subject[s])
        return next((known[i] for i in near if similar(known[i]["subject"], known[i]["predicate"], r["subject"], r["predicate"])), None)

    def add(k: dict) -> None:
        if k["subject"] not in of_subject:
            of_subject[k["subject"]] = []
            for s, found in nested.items():
                if s in k["subject"] or k["subject"] in s:
                    found.append(k["subject"])
        of_subject[k["subject"]].append(len(known))
        known.append(k)

    for r in sorted(rows, key=lambda r: (r["kind"], r["o"])):
        if r["kind"] == 0:
            add(dict(r, born=None, touched=False))
            continue
        like = alike(r)
        outcome, made = "skipped", None
        if like is None:
            outcome, made = "added", dict(r, key=None, born=r["o"], status="active", touched=False)
            add(made)
        elif like["value"] != r["value"]:
            if _mergeable(like["value"], r["value"]):
                if len(r["value"]) > len(like["value"]):
                    like.update(value=r["value"], touched=True)
            else:
                outcome = "conflict"
                like.update(status="conflict", touched=True)
                yield dict(r, key=None, born=r["o"], status="pending", touched=False, outcome=outcome, conflict_key=like["key"], conflict_born=like["born"], module=r["module"] or like["module"])
        if outcome != "conflict":
            yield dict(r, key=None, born=r["o"], outcome=outcome, status=None, touched=False, conflict_key=None, conflict_born=None)
    for k in known:
        yield dict(k, outcome="rule", conflict_key=None, conflict_born=None)


def merge(rules: DataFrame, facts: DataFrame, suppressions: DataFrame | None = None, aliases: DataFrame | None = None, now: Name = None, small: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(the rules after merging, report rows: ordinal, outcome) of facts in order of their ordinal (unique, with priority).

    Facts meet rules only if one subject holds the other and their predicates are equal or synonymous, so clusters of
    nested subjects, and in them the predicates that have no synonyms, are folded apart from each other; ids of new rules go by the order of the facts that made them. Outcomes: added, skipped, conflict, suppressed.
    Facts without a subject are left out.
    """
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    facts = facts.where(X.text(F.col("subject")) != "")
    held = suppressed(facts, suppressions) if suppressions is not None else facts.limit(0)
    open_ = unsuppressed(facts, suppressions) if suppressions is not None else facts
    open_ = canonical(X.text(F.col("module")), aliases, open_)
    columns = ["type", "priority", "subject", "predicate", "value", "module", "source", "confidence"]
    text = lambda c: X.text(F.col(c)).alias(c) if c != "confidence" else F.col(c)
    new = open_.select(F.lit(1).alias("kind"), F.col("ordinal").cast("long").alias("o"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("status"), *map(text, columns))
    old = rules.where(F.col("status").isin(*MATCHED) & (X.text(F.col("subject")) != "")).select(F.lit(0).alias("kind"), ordinal(F.col("id")).alias("o"), F.col("id").alias("key"), "status", *map(text, columns))
    rows = cut(old.unionByName(new))
    subjects = rows.select("subject").distinct()
    nested = contains_join(subjects.select(F.col("subject").alias("a")), subjects.select(F.col("subject").alias("b")), "a", "b", small).where("a <> b")
    cluster = components(nested)
    kind = F.when(X.has_any(X.rule_predicate(F.col("predicate")), " ".join(w for pair in X.pairs(X.SYNONYMS) for w in pair)), "").otherwise(F.concat(F.lit("="), X.rule_predicate(F.col("predicate"))))
    placed = rows.join(cluster.withColumnRenamed("node", "subject"), "subject", "left").withColumn("cluster", F.coalesce("component", "subject")).withColumn("class", kind).drop("component")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in FOLDED.split(", ")]
        clean = frame.astype(object).where(frame.notna(), None)
        out = pd.DataFrame(list(fold(clean.to_dict("records"))), columns=names)
        return out.astype({"born": "Int64", "conflict_born": "Int64"})

    folded = cut(placed.groupBy("cluster", "class").applyInPandas(run, FOLDED))
    born = numbered(folded.where("outcome IN ('rule', 'conflict') AND born IS NOT NULL"), ["born"], "n").crossJoin(F.broadcast(last_number(rules))).withColumn("id", rule_id(F.col("n") + F.col("last")))
    born = cut(born)
    names = born.select(F.col("born").alias("b2"), F.col("id").alias("conflict_id"))
    none = F.array().cast("array<string>")
    made = born.join(names, F.col("conflict_born") == F.col("b2"), "left").select(
        "id", "type", "priority", "subject", "predicate", "value", F.when(F.col("module") == "", F.col("subject")).otherwise(F.col("module")).alias("module"), "source", "confidence", "status",
        none.alias("depends_on"), none.alias("dependents"), F.coalesce("conflict_key", "conflict_id").alias("conflict_with"), stamp.alias("added_at"), stamp.alias("updated_at"), F.array().cast(HISTORY).alias("history"),
    )
    changed = folded.where("outcome = 'rule' AND key IS NOT NULL AND touched").select(F.col("key").alias("id"), F.col("status").alias("s2"), F.col("value").alias("v2"))
    kept = rules.join(changed, "id", "left").withColumn("status", F.coalesce("s2", "status")).withColumn("value", F.coalesce("v2", "value")).withColumn("updated_at", F.when(F.col("s2").isNotNull(), stamp).otherwise(F.col("updated_at"))).drop("s2", "v2")
    report = folded.where("outcome <> 'rule'").select(F.col("born").alias("ordinal"), "outcome").unionByName(held.select(F.col("ordinal").cast("long"), F.lit("suppressed").alias("outcome")))
    return kept.unionByName(made), report


def report_counts(report: DataFrame) -> DataFrame:
    """One row: new_rules, skipped, conflicts_detected, suppressed."""
    n = lambda o, name: F.count_if(F.col("outcome") == o).alias(name)
    return report.agg(n("added", "new_rules"), n("skipped", "skipped"), n("conflict", "conflicts_detected"), n("suppressed", "suppressed"))


# --- reading


def select_rules(rules: DataFrame, modules: list[str] | None = None, kind: Name = None, priority: Name = None, status: Name = None) -> DataFrame:
    want = [F.col("module").isin(*modules)] if modules else []
    want += [F.col(c) == v for c, v in (("type", kind), ("priority", priority), ("status", status)) if v]
    return rules.where(X.all_of(*want))


def status_counts(rules: DataFrame) -> DataFrame:
    """(dimension, name, n): all rules, and those of each status, type, module and priority, in one pass."""
    sets = rules.groupingSets([["status"], ["type"], ["module"], ["priority"], []], "status", "type", "module", "priority")
    which = F.grouping_id()
    g = sets.agg(which.alias("g"), F.count(F.lit(1)).alias("n"))
    named = [(7, "status"), (11, "type"), (13, "module"), (14, "priority")]
    dimension = F.coalesce(*(F.when(F.col("g") == k, c) for k, c in named), F.lit("total"))
    return g.select(dimension.alias("dimension"), F.coalesce(*(F.when(F.col("g") == k, F.col(c)) for k, c in named)).alias("name"), "n")


def recent_log(log: DataFrame, days: int, now: Column) -> DataFrame:
    return log.where(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days)))


def conflict_pairs(rules: DataFrame, top_k: int = 50) -> DataFrame:
    """The first top_k pending rules, by number, with the rule that each contradicts, and a category with its rank.

    By rule: values that differ in white space, punctuation or case only are format_variant; nested ones
    semantic_overlap; the same source twice deprecated_old (it was changed); different sources cross_doc_contradiction.
    """
    old = rules.select(F.col("id").alias("old_id"), *(F.col(c).alias(f"old_{c}") for c in ("subject", "predicate", "value", "source", "status")))
    new = rules.where("status = 'pending' AND conflict_with IS NOT NULL").select(F.col("id").alias("new_id"), F.col("conflict_with"), *(F.col(c).alias(f"new_{c}") for c in ("subject", "predicate", "value", "source")))
    pairs = new.join(old, F.col("conflict_with") == F.col("old_id")).drop("conflict_with").orderBy(ordinal(F.col("new_id")), "new_id").limit(top_k)
    a, b = X.audit_key(F.col("old_value")), X.audit_key(F.col("new_value"))
    category = F.when(a == b, "format_variant").when(a.contains(b) | b.contains(a), "semantic_overlap").when(F.col("old_source") == F.col("new_source"), "deprecated_old").when(X.text(F.col("old_source")) != X.text(F.col("new_source")), "cross_doc_contradiction").otherwise("uncategorized")
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), category).cast("int")
    return pairs.withColumn("category", category).withColumn("rank", rank).orderBy("rank", "new_id")


def with_context(pairs: DataFrame, chunks: DataFrame, most: int = 200) -> DataFrame:
    """conflict_pairs with old_context and new_context: the first passage of a rule's source that holds its subject or value, cut to `most` characters; else how the source begins.

    Rules without a source of their own (none, unknown, manual_sync) are looked for in all sources. pairs is as short as conflict_pairs makes it.
    """
    sides = [pairs.select("new_id", F.lit(side).alias("side"), *(X.text(F.col(f"{side}_{c}")).alias(f"s_{c}") for c in ("source", "subject", "value"))) for side in ("old", "new")]
    asked, anywhere = sides[0].unionByName(sides[1]), F.col("s_source").isin("", "unknown", "manual_sync")
    told = chunks.select("source", "chunk_index", "text")
    met = told.join(F.broadcast(asked.where(~anywhere)), F.col("source") == F.col("s_source")).unionByName(told.crossJoin(F.broadcast(asked.where(anywhere))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains(F.col("s_subject")) & (F.col("s_subject") != "") | (F.col("s_value") != "") & x.contains(F.col("s_value")))
    near = X.strip(F.coalesce(F.get(lines, F.lit(0)), F.when(F.col("source") == F.col("s_source"), F.col("text"))))
    best = met.withColumn("p", near).where("p IS NOT NULL").groupBy("new_id", "side").agg(F.min(F.struct(F.size(lines) == 0, "source", "chunk_index", "p")).alias("b"))
    short = F.when(F.length("b.p") > most, F.concat(F.substring("b.p", 1, most), F.lit("..."))).otherwise(F.col("b.p"))
    out = pairs
    for side in ("old", "new"):
        out = out.join(best.where(F.col("side") == side).select("new_id", short.alias(f"{side}_context")), "new_id", "left")
    return out.orderBy("rank", "new_id")


# --- changing


def _history(old: Column, new: Column, reason: str, stamp: Column) -> Column:
    return F.struct(old.alias("old_value"), new.alias("new_value"), stamp.alias("changed_at"), F.lit(reason).alias("reason"))


def _stamp(now: str | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def _must_have(rules: DataFrame, id: str) -> None:
    if not rules.where(F.col("id") == id).limit(1).count():
        raise ValueError(f"there is no rule {id}")


def propagate(rules: DataFrame, changed: str, now: Name = None) -> DataFrame:
    """Active dependents of a rule want review; one step only."""
    near = rules.where(F.col("id") == changed).select(F.explode("dependents").alias("id")).distinct()
    hit = rules.join(near.withColumn("lg_hit", F.lit(True)), "id", "left")
    due = F.col("lg_hit").isNotNull() & (F.col("status") == "active")
    return hit.withColumn("updated_at", F.when(due, _stamp(now)).otherwise(F.col("updated_at"))).withColumn("status", F.when(due, "needs_review").otherwise(F.col("status"))).drop("lg_hit")


def add_rule(rules: DataFrame, rule: DataFrame, now: Name = None) -> DataFrame:
    """rules with one more row (a table of the columns from type to confidence), under the next id."""
    none = F.array().cast("array<string>")
    new = rule.crossJoin(F.broadcast(last_number(rules))).select(rule_id(F.col("last") + 1).alias("id"), *rule.columns, F.lit("active").alias("status"), none.alias("depends_on"), none.alias("dependents"),
                                                                 F.lit(None).cast("string").alias("conflict_with"), _stamp(now).alias("added_at"), _stamp(now).alias("updated_at"), F.array().cast(HISTORY).alias("history"))
    return rules.unionByName(new)


def set_value(rules: DataFrame, id: str, value: Column | str, reason="", now: Name = None, status: Name = None) -> DataFrame:
    """rules with a new value for one, its old one in its history, and its dependents to be reviewed."""
    _must_have(rules, id)
    new = F.lit(value) if isinstance(value, str) else value
    at, stamp = F.col("id") == id, _stamp(now)
    out = rules.withColumn("history", F.when(at, F.concat("history", F.array(_history(F.col("value"), new, reason, stamp)))).otherwise(F.col("history")))
    out = out.withColumn("value", F.when(at, new).otherwise(F.col("value"))).withColumn("updated_at", F.when(at, stamp).otherwise(F.col("updated_at")))
    if status:
        out = out.withColumn("status", F.when(at, status).otherwise(F.col("status")))
    return propagate(out, id, now)


def deprecate(rules: DataFrame, id: str, suppressions: DataFrame, now: Name = None, suppress=True) -> tuple[DataFrame, DataFrame]:
    """(rules with one deprecated, suppressions with its subject and predicate)."""
    _must_have(rules, id)
    at = F.col("id") == id
    out = rules.withColumn("status", F.when(at, "deprecated").otherwise(F.col("status"))).withColumn("updated_at", F.when(at, _stamp(now)).otherwise(F.col("updated_at")))
    return out, add_suppressions(suppressions, rules.where(at).select("subject", "predicate", F.lit("deprecated").alias("reason")), now) if suppress else suppressions


def add_suppressions(suppressions: DataFrame, new: DataFrame, now: Name = None) -> DataFrame:
    """suppressions with new patterns (subject, predicate, reason); one that is there stays as it was."""
    fresh = new.dropDuplicates(["subject", "predicate"]).join(suppressions.select("subject", "predicate"), ["subject", "predicate"], "left_anti")
    return suppressions.unionByName(fresh.withColumn("added_at", _stamp(now)))


def resolve(rules: DataFrame, id: str, action: str, value: Name = None, now: Name = None) -> DataFrame:
    """A conflict settled: keep_old, accept_new (the value of the last pending rule) or set_value. All pending rules against it go."""
    _must_have(rules, id)
    pending = rules.where((F.col("conflict_with") == id) & (F.col("status") == "pending"))
    rest = rules.where(~((F.col("conflict_with").eqNullSafe(F.lit(id))) & (F.col("status") == "pending")))
    if action == "keep_old":
        at = F.col("id") == id
        return rest.withColumn("status", F.when(at, "active").otherwise(F.col("status"))).withColumn("updated_at", F.when(at, _stamp(now)).otherwise(F.col("updated_at")))
    if action == "set_value":
        if value is None:
            raise ValueError("set_value needs a value")
        return set_value(rest, id, value, "conflict resolved: new value", now, "active")
    if action != "accept_new":
        raise ValueError(f"unknown action {action}")
    last = pending.orderBy(F.desc(ordinal(F.col("id")))).select("value", "source").first()
    if last is None:
        raise ValueError(f"nothing pending against {id}")
    moved = rest.withColumn("source", F.when(F.col("id") == id, F.lit(last["source"])).otherwise(F.col("source")))
    return set_value(moved, id, last["value"], "conflict resolved: accepted", now, "active")


def add_dependencies(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """rules with edges (child depends on parent) in depends_on and dependents, each once, after those that are there."""
    for column, at, other in (("depends_on", "child", "parent"), ("dependents", "parent", "child")):
        lists = edges.groupBy(F.col(at).alias("lg_id")).agg(F.array_sort(F.collect_set(other)).alias("lg_new"))
        rules = rules.join(lists, F.col("id") == F.col("lg_id"), "left").withColumn(column, F.array_union(column, F.coalesce("lg_new", F.array().cast("array<string>")))).drop("lg_id", "lg_new")
    return rules


def inferred_dependencies(rules: DataFrame, small: bool | None = None) -> DataFrame:
    """(child, parent) of active rules: the child's value holds the parent's subject, of three characters or more. Of rules with one subject the last stands for it; edges that are there are left out."""
    active = rules.where("status = 'active'")
    subject = active.where(F.length("subject") >= 3).groupBy("subject").agg(F.max_by("id", ordinal(F.col("id"))).alias("parent"))
    child = active.where(X.text(F.col("value")) != "").select(F.col("id").alias("child"), "value", "depends_on")
    met = contains_join(child, subject, "value", "subject", small).where("child <> parent")
    return met.where(~F.array_contains("depends_on", F.col("parent"))).select("child", "parent").distinct()


def purge(rules: DataFrame, facts: DataFrame, sources: DataFrame, now: Name = None) -> tuple[DataFrame, DataFrame]:
    """(rules, facts) without what changed sources said: their facts go, their active rules are deprecated. Nothing is suppressed."""
    hit = rules.join(sources.select(F.col("source").alias("lg_s")).distinct(), F.col("source") == F.col("lg_s"), "left")
    due = F.col("lg_s").isNotNull() & (F.col("status") == "active")
    out = hit.withColumn("updated_at", F.when(due, _stamp(now)).otherwise(F.col("updated_at"))).withColumn("status", F.when(due, "deprecated").otherwise(F.col("status"))).drop("lg_s")
    return out, facts.join(sources.select("source").distinct(), "source", "left_anti")


def log_rows(before: DataFrame, after: DataFrame, trigger: str, now: Name = None) -> DataFrame:
    """Changelog rows (timestamp, action, rule_id, subject, detail, trigger, old_value, new_value) of what differs between two states."""
    b = before.select(F.col("id").alias("b_id"), F.col("status").alias("b_status"), F.col("value").alias("b_value"), F.col("subject").alias("b_subject"))
    j = after.join(b, F.col("id") == F.col("b_id"), "full_outer")
    action = (
        F.when(F.col("b_id").isNull(), F.when(F.col("status") == "pending", "conflict_detected").otherwise("added"))
        .when(F.col("id").isNull(), "removed")
        .when(~F.col("status").eqNullSafe(F.col("b_status")), F.when(F.col("b_status") == "conflict", "resolved").otherwise(F.col("status")))
        .when(~F.col("value").eqNullSafe(F.col("b_value")), "updated")
    )
    j = j.withColumn("action", action).where("action IS NOT NULL")
    detail = F.concat_ws(" ", X.text(F.coalesce("subject", "b_subject")), X.text(F.col("b_value")), F.lit("->"), X.text(F.col("value")))
    return j.select(_stamp(now).alias("timestamp"), "action", F.coalesce("id", "b_id").alias("rule_id"), F.coalesce("subject", "b_subject").alias("subject"), detail.alias("detail"), F.lit(trigger).alias("trigger"), F.col("b_value").alias("old_value"), F.col("value").alias("new_value"))


def export_lines(rules: DataFrame, log: DataFrame | None = None, module: Name = None, entries=20) -> DataFrame:
    """(part, line_no, line): the rule base as Markdown: modules, types in them, rules by number; then the last log entries."""
    shown = rules if module is None else rules.where(F.col("module") == module)
    mark = F.when(F.col("status") == "active", "").otherwise(F.concat(F.lit(" ["), F.col("status"), F.lit("]")))
    line = F.concat(F.lit("- **"), F.col("subject"), F.lit("** "), F.col("predicate"), F.lit(" "), F.col("value"), mark, F.lit(" ("), F.col("id"), F.lit(", "), F.col("priority"), F.lit(")"))
    kinds = shown.groupBy("module", "type").agg(F.transform(F.sort_array(F.collect_list(F.struct(ordinal(F.col("id")).alias("o"), line.alias("line")))), lambda x: x["line"]).alias("lines"))
    kinds = kinds.select("module", "type", F.concat(F.array(F.concat(F.lit("### "), F.col("type"))), F.col("lines")).alias("lines"))
    modules = kinds.groupBy("module").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("type", "lines"))), lambda x: x["lines"])).alias("lines"))
    body = modules.select(F.concat(F.lit("1"), F.col("module")).alias("part"), F.posexplode(F.concat(F.array(F.concat(F.lit("## "), F.col("module"))), F.col("lines"))).alias("line_no", "line"))
    if log is not None:
        last = log.orderBy(F.desc("timestamp"), "rule_id").limit(entries).select(F.lit("2").alias("part"), (F.row_number().over(Window.orderBy(F.desc("timestamp"), "rule_id")) - 1).alias("line_no"), F.concat_ws(" ", F.lit("-"), F.col("timestamp").cast("string"), "action", "rule_id", "detail").alias("line"))
        body = body.unionByName(last)
    return body.orderBy("part", "line_no")
