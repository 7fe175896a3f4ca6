"""What changed between files, converted documents and the index; what follows from it; and moving path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.functions import text as X

#: In order of urgency.
STATUSES = ("unprocessed", "outdated_src", "outdated_index", "orphan_index", "orphan_md", "ok")
TOLERANCE = 1.0


def diff(current: DataFrame, before: DataFrame, key: str = "path", signature: tuple[str, ...] = ("mtime", "size")) -> DataFrame:
    """(path, change): new, changed, unchanged or removed, by a full outer join on path and null-safe signatures."""
    old = before.select(F.col(key).alias("lg_key"), *(F.col(c).alias(f"lg_{c}") for c in signature))
    same = X.all_of(*(F.col(c).eqNullSafe(F.col(f"lg_{c}")) for c in signature))
    change = F.when(F.col("lg_key").isNull(), "new").when(F.col(key).isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return current.select(key, *signature).join(old, F.col(key) == F.col("lg_key"), "full_outer").select(F.coalesce(key, "lg_key").alias(key), change.alias("change"))


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: new, changed, unchanged, removed."""
    return changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("new", "changed", "unchanged", "removed")))


def next_meta(current: DataFrame, before: DataFrame, failed: DataFrame | None = None, now: Column | None = None, key: str = "path") -> DataFrame:
    """The index's record after a run: unchanged files keep their time, files that failed keep their old record (none, if new) and so are tried again."""
    stamp = F.current_timestamp() if now is None else now
    old = before.select(F.col(key).alias("lg_key"), F.col("mtime").alias("lg_mtime"), F.col("size").alias("lg_size"), F.col("indexed_at").alias("lg_at"))
    j = current.select(key, "mtime", "size").join(old, F.col(key) == F.col("lg_key"), "left")
    same = F.col("mtime").eqNullSafe(F.col("lg_mtime")) & F.col("size").eqNullSafe(F.col("lg_size")) & F.col("lg_key").isNotNull()
    good = j.withColumn("indexed_at", F.when(same, F.col("lg_at")).otherwise(stamp)).drop("lg_key", "lg_mtime", "lg_size", "lg_at")
    if failed is None:
        return good
    bad = failed.select(key).distinct()
    return good.join(bad, key, "left_anti").unionByName(before.select(key, "mtime", "size", "indexed_at").join(bad, key, "left_semi"))


def processing_status(sources: DataFrame, documents: DataFrame, meta: DataFrame) -> DataFrame:
    """(src, src_type, dst, status, src_mtime, dst_mtime, indexed_mtime) of every original, document and index entry.

    sources: path, mtime (seconds); documents and meta: path, mtime. A second of difference doesn't count.
    """
    md = documents.select(F.col("path").alias("md"), F.col("mtime").cast("double").alias("dst_mtime"))
    ix = meta.select(F.col("path").alias("ix"), F.col("mtime").cast("double").alias("indexed_mtime"))
    src = sources.select(F.col("path").alias("src"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("src_type"), X.converted_path(F.col("path")).alias("dst"), F.col("mtime").cast("double").alias("src_mtime"))
    j = src.join(md, F.col("dst") == F.col("md"), "left").join(ix, F.col("dst") == F.col("ix"), "left")
    late = F.col("indexed_mtime").isNull() | (F.col("indexed_mtime") + TOLERANCE < F.col("dst_mtime"))
    status = F.when(F.col("md").isNull(), "unprocessed").when(F.col("src_mtime") > F.col("dst_mtime") + TOLERANCE, "outdated_src").when(late, "outdated_index").otherwise("ok")
    known = j.select("src", "src_type", "dst", status.alias("status"), "src_mtime", "dst_mtime", F.when(F.col("md").isNotNull(), F.col("indexed_mtime")).alias("indexed_mtime"))
    none = F.lit(None).cast("string")
    meant = src.select("dst").distinct()
    loose = md.join(meant, F.col("md") == F.col("dst"), "left_anti").join(ix, F.col("md") == F.col("ix"), "left")
    loose = loose.select(none.alias("src"), none.alias("src_type"), F.col("md").alias("dst"), F.lit("orphan_md").alias("status"), F.lit(None).cast("double").alias("src_mtime"), "dst_mtime", "indexed_mtime")
    lost = ix.join(meant, F.col("ix") == F.col("dst"), "left_anti").join(md, F.col("ix") == F.col("md"), "left_anti")
    lost = lost.select(none.alias("src"), none.alias("src_type"), F.col("ix").alias("dst"), F.lit("orphan_index").alias("status"), F.lit(None).cast("double").alias("src_mtime"), F.lit(None).cast("double").alias("dst_mtime"), "indexed_mtime")
    return known.unionByName(loose).unionByName(lost)


def by_urgency(status: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return status.orderBy(rank, F.coalesce("dst", F.lit("")))


def status_counts(status: DataFrame) -> DataFrame:
    """(status, n) for all statuses, zeros included."""
    names = status.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(status.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def gaps(status: DataFrame, word: str | None = None) -> DataFrame:
    """What isn't ok, most urgent first, with how far it is behind; with word, only paths that hold it."""
    open_ = status.where("status <> 'ok'")
    if word:
        open_ = open_.where(X.text(F.col("src")).contains(word) | X.text(F.col("dst")).contains(word))
    late = X.drift(F.col("status"), F.col("src_mtime"), F.col("dst_mtime"), F.col("indexed_mtime"))
    return by_urgency(open_.withColumn("drift", late))


def cleanup_plan(status: DataFrame, chunks: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, status, delete_file, chunks, facts, rules): what removing orphans would take away. Nothing is removed here."""
    orphans = status.where("status IN ('orphan_md', 'orphan_index')").select(F.col("dst").alias("path"), "status")
    count = lambda df, name: df.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias(name))
    out = orphans.withColumn("delete_file", F.col("status") == "orphan_md")
    for df, name in ((chunks, "chunks"), (facts, "facts"), (rules.where("status = 'active'"), "rules")):
        out = out.join(count(df, name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def to_convert(workbooks: DataFrame, targets: DataFrame, force: bool = False) -> DataFrame:
    """Workbooks (path, mtime) whose Markdown is missing or older; all of them with force. Targets that two workbooks share count for either."""
    t = targets.groupBy(F.col("path").alias("lg_t")).agg(F.max("mtime").alias("lg_m"))
    j = workbooks.join(t, X.converted_path(F.col("path")) == F.col("lg_t"), "left")
    stale = F.lit(True) if force else F.col("lg_m").isNull() | (F.col("lg_m") < F.col("mtime"))
    return j.where(stale).drop("lg_t", "lg_m")


def recent(meta: DataFrame, days: int, now: Column) -> DataFrame:
    """Records indexed within the last days (1 to 365), newest first; times that can't be read are left out."""
    at = F.col("indexed_at") if dict(meta.dtypes)["indexed_at"] == "timestamp" else F.try_to_timestamp("indexed_at")
    dated = meta.withColumn("indexed_at", at)
    return dated.where(F.col("indexed_at") >= now - F.make_dt_interval(F.lit(min(max(days, 1), 365)))).orderBy(F.desc("indexed_at"), "path")


def common_prefix(paths: DataFrame, column: str = "path") -> str:
    """The folder to be replaced: what leads to md_file, if a path has it, else the longest whole leading parts of all folders."""
    p = paths.select(F.regexp_replace(column, r"\\", "/").alias("p")).where("p <> ''")
    marked = p.where(F.array_contains(X.parts_of(F.col("p")), "md_file")).select(F.min(F.regexp_extract("p", r"^(.*?)/?(?:^|(?<=/))md_file(?:/|$)", 1)).alias("m")).first()["m"]
    if marked:
        return marked
    ends = p.select(F.regexp_replace("p", "/[^/]*$", "").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b")).first()  # those two share what all share
    if ends["a"] is None:
        return ""
    same = []
    for x, y in zip(ends["a"].split("/"), ends["b"].split("/")):
        if x != y:
            break
        same.append(x)
    return "/".join(same)


def remapped(df: DataFrame, old: str, new: str, column: str = "path") -> tuple[DataFrame, DataFrame]:
    """(df with a path prefix replaced, counts: changed, unchanged)."""
    out = df.withColumn(column, X.remap_prefix(F.col(column), old, new))
    hit = (F.col(column) == old.rstrip("/")) | F.col(column).startswith(old.rstrip("/") + "/")
    return out, df.agg(F.count_if(hit).alias("changed"), F.count_if(~hit).alias("unchanged"))
