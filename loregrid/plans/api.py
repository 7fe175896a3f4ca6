"""The knowledge base as a whole: its twelve entry points, each a plan over tables, with text on request from render."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid import models
from loregrid.functions import text as X
from loregrid.operators import canon, changes, facts as fact_ops, graph, overview, search as searching, sheets
from loregrid.operators.chunking import chunk_documents
from loregrid.sources import chunk_store, files
from loregrid.sources.tables import Tables

CHUNKS = (
    "id string, text string, embedding array<float>, module string, doc_type string, source string, section string, heading_chain string, cross_refs array<string>, tags array<string>, "
    "doc_id string, chunk_index int, total_chunks int, doc_version string, doc_mtime timestamp, indexed_at timestamp"
)
FACTS = "id string, type string, subject string, predicate string, value string, confidence double, source string, module string, ordinal long, embedding array<float>"
META = "path string, mtime double, size long, indexed_at timestamp"
SUPPRESSIONS = "subject string, predicate string, reason string, added_at timestamp"
LOG = "timestamp timestamp, action string, rule_id string, subject string, detail string, trigger string, old_value string, new_value string"

RULES_AS_TOLD = canon.RULE.replace("timestamp", "string")

Name = str | None


class KnowledgeBase:
    """Documents below settings.md_dir, tables below settings.data_dir.

    embed (Column to Column), embed_query, rewrite, reranker, extract and formatter (of sheets) stand for models; all but
    reranker, rewrite and formatter have deterministic defaults. What embed and extract give is kept by content, under
    the name `model`. One job writes at a time; readers may be many. settings may be a function that loads them: then
    they are loaded again before each index run.
    """

    def __init__(self, spark: SparkSession, settings: files.Settings | Callable[[], files.Settings], embed=None, embed_query: Callable[[str], list[float]] | None = None, rewrite=None, reranker=None,
                 extract: Callable[[DataFrame], DataFrame] = fact_ops.extract, dedup="content", alias_file: Name = None, formatter: Callable[[str, str, str], str] | None = None, model: str = "default") -> None:
        self.spark, self._load, self._alias_file = spark, settings if callable(settings) else lambda: settings, alias_file
        self.formatter, self.model = formatter, model
        self.reload()
        self.embed, self.embed_query = embed or models.embedder(), embed_query or models.query_embedder()
        self.rewrite, self.reranker, self.extract, self.dedup = rewrite, reranker, extract, dedup
        self.timings: dict[str, float] = {}

    def reload(self) -> None:
        """The settings as they are now."""
        self.settings = self._load()
        self.tables = Tables(self.spark, self.settings.data_dir)
        self.alias_file = self._alias_file or f"{self.settings.data_dir}/module_aliases.json"

    @contextmanager
    def _timed(self, name: str):
        began = time.monotonic()
        yield
        self.timings[name] = self.timings.get(name, 0.0) + time.monotonic() - began

    # --- tables

    @property
    def chunks(self) -> DataFrame:
        return self.tables.read("chunks", CHUNKS)

    @property
    def vocabulary(self) -> DataFrame | None:
        """Kept with the chunks, so that a search only scores."""
        return chunk_store.vocabulary_of(self.tables)

    @property
    def facts(self) -> DataFrame:
        return self.tables.read("facts", FACTS)

    @property
    def rules(self) -> DataFrame:
        return self.tables.read("rules", canon.RULE)

    @property
    def suppressions(self) -> DataFrame:
        return self.tables.read("suppressions", SUPPRESSIONS)

    @property
    def meta(self) -> DataFrame:
        return self.tables.read("index_meta", META)

    @property
    def log(self) -> DataFrame:
        return self.tables.read("changelog", LOG)

    @property
    def aliases(self) -> DataFrame:
        return files.aliases(self.spark, self.alias_file)

    def names_of(self, module: str) -> list[str]:
        one = self.spark.createDataFrame([(module,)], "module string")
        return sorted(r["name"] for r in overview.expanded(one, self.aliases).collect())

    def _write_rules(self, after: DataFrame, trigger: str) -> None:
        before = graph.cut(self.rules)
        after = graph.cut(after)
        self.tables.write("rules", after)
        self.tables.append("changelog", canon.log_rows(before, after, trigger))

    # --- search, lists

    def search(self, query: str, target="docs", top_k=5, include_context=False, module: Name = None, doc_type: Name = None, fact_type: Name = None, rewrite=False, multi_hop=False) -> DataFrame:
        top_k = min(max(top_k, 1), 20)
        names = self.names_of(module) if module else None
        if target == "facts":
            table = self.facts
            where = X.all_of(*([F.col("module").isin(*names)] if names else []), *([F.col("type") == fact_type] if fact_type else []))
            best = searching.vector_top(table, self.embed_query(query), top_k, where)
            return table.drop("embedding").join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")
        alias = {module: names} if module else None
        return searching.search(self.chunks, query, self.embed_query, top_k, include_context, module, doc_type, alias, self.rules.where(F.col("status").isin("active", "conflict")), self.rewrite if rewrite else None, self.reranker, multi_hop, words=self.vocabulary)

    def modules(self) -> DataFrame:
        return overview.modules(self.chunks)

    def suggest(self, partial: str, most=10) -> DataFrame:
        return overview.suggest(self.chunks, partial, most)

    def document(self, path: str) -> DataFrame:
        """By a path relative to the documents or to the folder above them, or an absolute one, wherever it points."""
        below = path.replace("\\", "/").startswith(self.settings.md_dir.rstrip("/") + "/")
        if (path.startswith("/") or "://" in path) and not below:
            return files.one_file(self.spark, path)
        return files.document(files.markdown(self.spark, self.settings.md_dir), path, self.settings.md_dir)

    # --- index

    def index(self, mode="incremental", path: Name = None, skip_facts=False, clear_canon=False, confirm=False) -> dict:
        """incremental: what changed; full: everything anew; single: one path; cleanup: orphans (removed only with confirm)."""
        self.timings = {}
        self.reload()
        if mode == "cleanup":
            return self.cleanup(dry_run=not confirm)
        if mode not in ("incremental", "full", "single"):
            raise ValueError(f"unknown mode {mode}")
        with self._timed("md_sync"):
            synced = self.sync()
            docs = graph.cut(files.markdown(self.spark, self.settings.md_dir).withColumnRenamed("mtime", "seconds"))
        current = docs.select(F.col("source").alias("path"), F.col("seconds").alias("mtime"), "size")
        before = graph.cut(self.meta)
        diff = changes.diff(current, before)
        if mode == "full":
            if clear_canon:
                self.tables.drop("rules")
            diff = diff.withColumn("change", F.when(F.col("change") == "removed", "removed").otherwise("changed"))
        if mode == "single":
            only = path.replace("\\", "/").lstrip("/").removeprefix("md_file/")
            diff = diff.where(F.col("path") == only).withColumn("change", F.when(F.col("change") == "removed", "removed").otherwise("changed"))
        diff = graph.cut(diff)
        due = docs.join(diff.where("change IN ('new', 'changed')").select(F.col("path").alias("source")), "source", "left_semi")
        good, bad = due.where("error IS NULL"), due.where("error IS NOT NULL")
        gone = diff.where("change = 'removed'").select(F.col("path").alias("source"))
        touched = graph.cut(good.select("source").unionByName(gone))
        with self._timed("parse"):
            made = graph.cut(chunk_documents(good.withColumn("mtime", F.col("seconds").cast("timestamp"))))
        with self._timed("embedding"):
            made = graph.cut(self._embedded(made))
        with self._timed("batch_index"):
            chunk_store.replace_chunks(self.tables, made, touched)
        report = {f"files_{r['change']}": r["n"] for r in diff.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()} | {"chunks": made.count()}
        if not skip_facts:
            with self._timed("fact_extraction"):
                report |= self._facts_of(made, touched)
        with self._timed("meta"):
            kept = before if mode == "single" else before.join(gone.withColumnRenamed("source", "path"), "path", "left_anti")
            done = current if mode != "single" else current.join(diff.select("path"), "path", "left_semi")
            after = changes.next_meta(done, kept, bad.select(F.col("source").alias("path")))
            if mode == "single":
                after = after.unionByName(kept.join(diff.select("path"), "path", "left_anti"))
            self.tables.write("index_meta", after)
        report |= {k: v for k, v in synced.items() if k != "errors"}
        report["errors"] = synced["errors"] + [(r["source"], r["error"]) for r in bad.select("source", "error").orderBy("source").limit(100).collect()]
        report["timings"] = dict(self.timings)
        return report

    def sync(self, force: bool = False) -> dict:
        """Originals into md_dir: newer Markdown as it is, newer workbooks (all with force) as Markdown with their pictures beside it."""
        found = files.originals(self.spark, self.settings.original_dir)
        there = files.scan(self.spark, self.settings.md_dir, "*.md").select("path", "mtime")
        due = graph.cut(changes.to_convert(found, there, force).select("path", "suffix"))
        raw = files.scan(self.spark, self.settings.original_dir, "*.{xlsx,xlsm,md}").join(due.select("path"), "path", "left_semi")
        there = files.scan(self.spark, self.settings.md_dir, "*").select(F.col("path").alias("there"), F.col("mtime").alias("there_mtime"))
        found = files.resources(self.spark, self.settings.original_dir)
        stale = F.col("there").isNull() | (F.col("there_mtime") < F.col("mtime"))
        beside = files.write_files(found.join(there, F.col("path") == F.col("there"), "left").where(stale).select("path", F.col("content").alias("data")), self.settings.md_dir)
        copied = files.write_files(raw.where("suffix = 'md'").select("path", F.col("content").alias("data")), self.settings.md_dir)
        rows = graph.cut(sheets.sheets(raw.where("suffix <> 'md'").select(F.col("path").alias("source"), "content")))
        if self.formatter:
            rows = graph.cut(sheets.formatted(rows, self.formatter))
        folder = F.regexp_replace(X.converted_path(F.col("source")), "/[^/]*$", "")
        pictures = files.write_files(sheets.images(rows).select(F.concat(folder, F.lit("/"), F.col("path")).alias("path"), "data"), self.settings.md_dir)
        made = files.write_files(sheets.converted(rows).select(F.col("target").alias("path"), F.col("text").alias("data")), self.settings.md_dir)
        bad = rows.where("error IS NOT NULL").select("source", "error").orderBy("source").limit(100).collect()
        return {"copied": copied, "resources": beside, "converted": made, "pictures": pictures, "errors": [(r["source"], r["error"]) for r in bad]}

    def _cache(self, name: str, new: DataFrame | None = None) -> DataFrame | None:
        """A cache as a table, after new entries were added."""
        if new is not None and not new.isEmpty():
            self.tables.append(name, new)
        return self.tables.read(name) if self.tables.version(name) is not None else None

    def _embedded(self, made: DataFrame) -> DataFrame:
        key = X.cache_key(F.col("text"), "embedding", self.model)
        out, new = models.cached(made.drop("embedding"), self._cache("embedding_cache"), key, lambda df: df.withColumn("embedding", self.embed(F.col("text"))), ["embedding"])
        out = out.select(*made.columns)
        self._cache("embedding_cache", new)
        return out

    def _facts_of(self, made: DataFrame, touched: DataFrame) -> dict:
        rules, stored = canon.purge(self.rules, self.facts, touched)
        rules, stored = graph.cut(rules), graph.cut(stored)
        found, new = fact_ops.extract_cached(made, self._cache("facts_cache"), self.extract, self.model)
        found = graph.cut(found)
        self._cache("facts_cache", new)
        found = graph.cut(graph.numbered(found, ["source", "ordinal"], "ordinal"))
        said = X.fact_text(F.col("subject"), F.col("predicate"), F.col("value"))
        fresh = graph.cut(fact_ops.semantic_dedup(found, stored, self.dedup).withColumn("embedding", self.embed(said)))
        self.tables.write("facts", fact_ops.upsert(stored, fresh.select(*[c.split()[0] for c in FACTS.split(", ")])))
        worthy = fact_ops.canon_candidates(overview.normalized(fresh, self.aliases))
        merged, report = canon.merge(rules, worthy, self.suppressions, self.aliases)
        merged = graph.cut(merged)
        merged = graph.cut(canon.add_dependencies(merged, canon.inferred_dependencies(merged)))
        self._write_rules(merged, "index")
        return {"facts": fresh.count()} | canon.report_counts(report).first().asDict()

    def cleanup(self, dry_run: bool = True) -> dict:
        """Orphans: what removing them takes away, and, unless dry_run, the removal itself (of their files too)."""
        plan = graph.cut(changes.cleanup_plan(self.status(), self.chunks, self.facts, self.rules))
        out = plan.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.coalesce(F.sum("rules"), F.lit(0)).alias("rules")).first().asDict()
        if not dry_run:
            gone = graph.cut(plan.select(F.col("path").alias("source")))
            rules, facts = canon.purge(self.rules, self.facts, gone)
            rules, facts = graph.cut(rules), graph.cut(facts)
            chunk_store.replace_chunks(self.tables, self.chunks.limit(0), gone)
            self.tables.write("facts", facts)
            self._write_rules(rules, "cleanup")
            self.tables.write("index_meta", self.meta.join(gone.withColumnRenamed("source", "path"), "path", "left_anti"))
            fs = self.spark._jvm.org.apache.hadoop.fs
            conf = self.spark._jsc.hadoopConfiguration()
            for r in plan.where("delete_file").select("path").toLocalIterator():
                p = fs.Path(f"{self.settings.md_dir}/{r['path']}")
                p.getFileSystem(conf).delete(p, False)
        return out | {"dry_run": dry_run, "plan": plan}

    def preview_facts(self, path: str) -> tuple[DataFrame, DataFrame]:
        """(facts of one document, counts by type); nothing is stored."""
        found = self.extract(chunk_documents(self.document(path).where("error IS NULL").drop("mtime")))
        return found, fact_ops.type_counts(found)

    # --- relations

    def relations(self) -> DataFrame:
        named = overview.normalized(self.chunks.select("module"), self.aliases)
        return graph.relations(graph.module_refs(self.chunks, self.aliases), named)

    def related_designs(self, module: str, depth=1) -> DataFrame:
        one = overview.normalized(self.spark.createDataFrame([(module,)], "module string"), self.aliases).first()["module"]
        return graph.related_designs(self.relations(), overview.normalized(self.facts, self.aliases), one, depth)

    # --- checks

    def check(self, content: str, module: Name = None, mode="full") -> dict:
        """full: compliance and consistency; or one of them; quick: related facts only."""
        if mode not in ("full", "compliance", "consistency", "quick"):
            raise ValueError(f"unknown mode {mode}")
        made = chunk_documents(self.spark.createDataFrame([("draft.md", content)], "source string, text string"))
        new = graph.cut(self.extract(made))
        stored = self.facts
        if module:
            stored = stored.where(F.col("module").isin(*self.names_of(module)))
        near = self.search(content[:500], "facts", 5, module=module)
        related = fact_ops.related_facts(new, stored, near)
        if mode == "quick":
            return {"status": "check_skipped", "related": related}
        out, bad = {"related": related}, 0
        if mode in ("full", "compliance"):
            judged = graph.cut(fact_ops.compliance(new, self.rules))
            out |= {"violations": judged.where("result = 'violation'"), "passed": judged.where("result = 'passed'")}
            bad += out["violations"].count()
        if mode in ("full", "consistency"):
            out["conflicts"] = graph.cut(fact_ops.consistency(new, stored))
            bad += out["conflicts"].count()
        return out | {"status": "conflicts_found" if bad else "ok"}

    def audit(self, module: Name = None, top_k=20) -> DataFrame:
        table = self.facts.where(F.col("module").isin(*self.names_of(module))) if module else self.facts
        return fact_ops.audit_conflicts(table, top_k)

    # --- rules

    def canon(self, action="get", module: Name = None, status: Name = None, priority: Name = None, rule_id: Name = None, new_value: Name = None, reason="", top_k=50, days=7) -> DataFrame:
        """get, status, export, classify, log (of the last days) give tables; sync, resolve_conflict, update_value and deprecate change the rule base and give it."""
        names = self.names_of(module) if module else None
        if action == "get":
            return canon.select_rules(self.rules, names, None, priority, status)
        if action == "status":
            return canon.status_counts(self.rules)
        if action == "export":
            return canon.export_lines(self.rules, self.log, module)
        if action == "log":
            return canon.recent_log(self.log, days, F.current_timestamp()).orderBy(F.desc("timestamp"), "rule_id")
        if action == "classify":
            return canon.with_context(canon.conflict_pairs(self.rules, top_k), self.chunks)
        if action == "sync":
            table = overview.normalized(self.facts, self.aliases)
            table = table.where(F.col("module").isin(*names)) if names else table
            merged, _ = canon.merge(self.rules, fact_ops.canon_candidates(table), self.suppressions, self.aliases)
            self._write_rules(merged, "sync")
            return self.rules
        if rule_id is None:
            raise ValueError(f"{action} needs a rule_id")
        if action == "resolve_conflict":
            self._write_rules(canon.resolve(self.rules, rule_id, "set_value" if new_value is not None else "keep_old", new_value), "resolve_conflict")
        elif action == "accept_new":
            self._write_rules(canon.resolve(self.rules, rule_id, "accept_new"), "resolve_conflict")
        elif action == "update_value":
            if new_value is None:
                raise ValueError("update_value needs a new_value")
            self._write_rules(canon.set_value(self.rules, rule_id, new_value, reason), "update_value")
        elif action == "deprecate":
            rules, patterns = canon.deprecate(self.rules, rule_id, self.suppressions)
            patterns = graph.cut(patterns)
            self._write_rules(rules, "deprecate")
            self.tables.write("suppressions", patterns)
        else:
            raise ValueError(f"unknown action {action}")
        return self.rules

    # --- overview, drafts

    def status(self) -> DataFrame:
        """Originals, documents and index entries against each other; a Markdown original stands for itself."""
        sources = files.originals(self.spark, self.settings.original_dir).select("path", "mtime")
        md = files.markdown(self.spark, self.settings.md_dir).select(F.col("source").alias("path"), "mtime")
        return changes.processing_status(sources, md, self.meta.select("path", "mtime"))

    def overview(self, view="stats", module: Name = None, days=7) -> DataFrame:
        if view == "stats":
            return overview.stats(self.chunks).crossJoin(self.facts.agg(F.count(F.lit(1)).alias("facts"))).crossJoin(self.rules.agg(F.count_if(F.col("status") == "active").alias("active_rules"), F.count_if(F.col("status") == "conflict").alias("conflict_rules"), F.count_if(F.col("status") == "deprecated").alias("deprecated_rules")))
        if view == "changes":
            return changes.recent(self.meta, days, F.current_timestamp())
        if view == "gaps":
            return changes.gaps(self.status(), module)
        raise ValueError(f"unknown view {view}")

    def draft_assist(self, topic: str, style: Name = None, module: Name = None) -> dict:
        """Ten results on a topic, the rules that bind it, and guidance (the first ten critical rules)."""
        rules = canon.select_rules(self.rules, self.names_of(module) if module else None, status="active")
        first = rules.where("priority = 'critical'").orderBy("id").limit(10).collect()
        lines = [f"Topic: {topic}", *([f"Style: {style}"] if style else []), *("Keep to: " + " ".join((r["subject"], r["predicate"], r["value"])) for r in first)]
        return {"results": self.search(topic, top_k=10, module=module), "rules": rules, "guidance": "\n".join(lines)}

    def remap(self, new: str, old: Name = None, dry_run=True) -> dict:
        """Another path prefix in the index's records, chunks and facts: counts only with dry_run. All new versions are staged before any is written."""
        old = old if old is not None else changes.common_prefix(self.meta.select("path"))
        plan = {name: changes.remapped(table, old, new, column) for name, table, column in (("index_meta", self.meta, "path"), ("chunks", self.chunks, "source"), ("facts", self.facts, "source"))}
        counts = {name: n.first().asDict() for name, (_, n) in plan.items()}
        if not dry_run:
            staged, before = {name: graph.cut(df) for name, (df, _) in plan.items()}, {name: self.tables.version(name) for name in plan}
            try:
                for name, df in staged.items():
                    if name == "chunks":
                        self.tables.write(name, df, "source")
                    else:
                        self.tables.write(name, df)
            except Exception:
                for name, version in before.items():
                    if version is not None and self.tables.version(name) != version:
                        self.tables.restore(name, version)
                raise
        return {"old": old, "new": new, "dry_run": dry_run, **counts}

    # --- what another installation left

    def import_json(self, folder: str) -> dict:
        """Records, rules, changelog and suppressions from index_meta.json, canon.json, canon_changelog.json and canon_suppressions.json in a folder, in place of those that are here; files that are missing or broken change nothing. Gives the numbers of rows."""
        at = lambda name: f"{folder.rstrip('/')}/{name}.json"
        told = RULES_AS_TOLD
        meta = files.json_map(self.spark, at("index_meta"), "mtime double, size long, indexed_at string").withColumn("indexed_at", F.try_to_timestamp("indexed_at"))
        rules = files.json_rows(self.spark, at("canon"), told, "rules")
        times = {c: F.try_to_timestamp(c) for c in ("added_at", "updated_at")}
        rules = rules.withColumns(times).withColumn("history", F.transform(F.coalesce("history", F.array().cast("array<struct<old_value:string,new_value:string,changed_at:string,reason:string>>")), lambda h: h.withField("changed_at", F.try_to_timestamp(h["changed_at"]))))
        rules = rules.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("depends_on", "dependents")}).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
        log = files.json_rows(self.spark, at("canon_changelog"), LOG.replace("timestamp timestamp", "timestamp string"), "entries").withColumn("timestamp", F.try_to_timestamp("timestamp"))
        held = files.json_rows(self.spark, at("canon_suppressions"), SUPPRESSIONS.replace("added_at timestamp", "added_at string"), "suppressions").withColumn("added_at", F.try_to_timestamp("added_at"))
        out = {}
        for name, df in (("index_meta", meta), ("rules", rules), ("changelog", log), ("suppressions", held)):
            df = graph.cut(df)
            out[name] = df.count()
            if out[name]:
                self.tables.write(name, df)
        return out
