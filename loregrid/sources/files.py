"""Files as tables: Markdown, workbooks and originals, JSON maps, with paths relative to a root and errors as rows."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.operators.graph import once

#: A task reads about so many bytes of files, or more files than that if there would be very many tasks.
PART = 32 << 20
FILE = "path string, suffix string, mtime double, size long"


def qualified(spark: SparkSession, path: str) -> str:
    """path as the file system itself names it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, suffix, mtime, size, content) of the files below root; path is relative. content is read only if it is asked for."""
    if not exists(spark, root):
        return spark.createDataFrame([], f"{FILE}, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, size // PART + 1))  # a task would take 32 files at most, as each counts for 4 MB
    path = X.relative(F.col("path"), qualified(spark, root))
    return files.select(once(path).alias("path"), "modificationTime", "length", "content").select("path", F.lower(F.element_at(F.split(X.file_name(path), r"\."), -1)).alias("suffix"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(source, text, mtime, size, error) of the Markdown below root that is to be indexed; a file that isn't UTF-8 has an error and no text."""
    md = scan(spark, root, "*.md").where(X.indexable(F.col("path")))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = X.normalize_newlines(F.when(good, F.col("content").cast("string")))
    return md.select(F.col("path").alias("source"), text.alias("text"), "mtime", "size", F.when(~good, "not UTF-8").alias("error"))


def originals(spark: SparkSession, root: str) -> DataFrame:
    """(path, suffix, mtime, size) of workbooks and Markdown below root, without what lies in excluded folders."""
    inside = ~F.arrays_overlap(X.parts_of(F.col("path")), F.array(*map(F.lit, X.EXCLUDED_DIRS.split())))
    return scan(spark, root, "*.{xlsx,xlsm,md}").drop("content").where(inside & X.indexable(X.converted_path(F.col("path"))))


def workbooks(spark: SparkSession, root: str) -> DataFrame:
    """(source, mtime, content) of workbooks below root."""
    return scan(spark, root, "*.{xlsx,xlsm}").select(F.col("path").alias("source"), "mtime", "content")


def write_files(df: DataFrame, root: str) -> int:
    """Writes rows (path, data: string or binary) as files below root, from the tasks that hold them; gives their number. root must be a folder that all executors share."""
    at = qualified(df.sparkSession, root)

    def run(batches):
        from pyarrow import fs

        folders: set[str] = set()
        system, base = fs.FileSystem.from_uri(at.replace("file:/", "file:///", 1) if at.startswith("file:/") and not at.startswith("file://") else at)
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{base}/{path}"
                if (folder := target.rpartition("/")[0]) not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                with system.open_output_stream(f"{target}.part") as out:
                    out.write(data)
                system.move(f"{target}.part", target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select("path", F.col("data").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def document(docs: DataFrame, path: str, root: str = "") -> DataFrame:
    """The document of a path: absolute and below root, or relative to root or to the folder that root is in; a backslash counts as a slash."""
    p, r = path.replace("\\", "/"), root.replace("\\", "/").rstrip("/")
    if r and p.startswith(r + "/"):
        p = p[len(r) + 1 :]
    folder = r.rpartition("/")[2] or "md_file"
    return docs.where(F.col("source").isin(p, p.removeprefix(f"{folder}/")))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """A Markdown file anywhere, as markdown() gives those below a root; source is its path."""
    if not exists(spark, path):
        return spark.createDataFrame([], "source string, text string, mtime double, size long, error string")
    f = spark.read.format("binaryFile").load(path)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return f.select(F.lit(path).alias("source"), X.normalize_newlines(F.when(good, F.col("content").cast("string"))).alias("text"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), F.when(~good, "not UTF-8").alias("error"))


def resources(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, content) of what lies below root in folders named resources: the pictures that Markdown shows."""
    inside = F.array_contains(F.slice(X.parts_of(F.col("path")), F.lit(1), F.size(X.parts_of(F.col("path"))) - 1), "resources")
    return scan(spark, root, "*").where(inside).select("path", "mtime", "content")


def json_map(spark: SparkSession, path: str, value: str, key: str = "path") -> DataFrame:
    """(path, value's columns) of a JSON object of objects; a missing or broken file is an empty table."""
    schema = f"map<string, struct<{', '.join(': '.join(c.strip().split(' ', 1)) for c in value.split(','))}>>"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string, {value}")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).where("m IS NOT NULL")
    return whole.select(F.explode("m").alias(key, "lg_v")).select(key, "lg_v.*")


def json_rows(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Rows of a JSON array of objects, or of one such array under a field (either layout is read); empty where missing or broken."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    row = spark.createDataFrame([], schema).schema.simpleString()
    whole = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<{row}>", {"mode": "PERMISSIVE"})
    rows = F.when(F.ltrim("value").startswith("["), bare)
    if field:
        rows = F.coalesce(rows, F.from_json("value", f"struct<{field}:array<{row}>>")[field])
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, alias) of a JSON object of lists, which may sit under 'aliases'. A name is always its own alias."""
    empty = spark.createDataFrame([], "canonical string, alias string")
    if not exists(spark, path):
        return empty
    kind = "map<string, array<string>>"
    whole = spark.read.text(path, wholetext=True)
    lists = F.coalesce(F.from_json("value", f"struct<aliases:{kind}>")["aliases"], F.from_json("value", kind))
    pairs = whole.select(F.explode(lists).alias("canonical", "names")).where("names IS NOT NULL AND canonical NOT LIKE '\\_%'")
    return pairs.select("canonical", F.explode(F.array_union(F.array("canonical"), "names")).alias("alias")).distinct()


def dotenv(path: str) -> dict[str, str]:
    """NAME=value lines of a file; blank lines, # lines and lines without = don't count, quotes around a value go."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        lines = (x.strip() for x in f)
        parts = (x.split("=", 1) for x in lines if "=" in x and not x.startswith("#"))
        return {k.strip(): v.strip().strip("\"'") for k, v in parts}


@dataclass(frozen=True)
class Settings:
    """Where a knowledge base is. Environment variables (KB_ROOT and so on) win over those of a .env file beside the settings file, these over the file, the file over defaults."""

    kb_root: str = "."
    md_dir: str = "md_file"
    original_dir: str = "original_file"
    data_dir: str = "data"

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Settings:
        given_env = dict(os.environ) if env is None else env
        env = dotenv(os.path.join(os.path.dirname(os.path.abspath(path)), ".env")) if path else {}
        env |= {k: v for k, v in given_env.items() if v}
        out = cls()
        if path and os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    given = json.load(f)
            except (OSError, ValueError):
                given = {}
            known = {f.name for f in fields(cls)}
            out = replace(out, **{k: str(v) for k, v in given.items() if k in known and v})
        out = replace(out, **{f.name: env[f.name.upper()] for f in fields(cls) if env.get(f.name.upper())})
        base = os.path.dirname(os.path.abspath(path)) if path else os.getcwd()
        root = out.kb_root if "://" in out.kb_root or os.path.isabs(out.kb_root) else os.path.normpath(os.path.join(base, out.kb_root))
        under = lambda d: d if "://" in d or os.path.isabs(d) else f"{root.rstrip('/')}/{d}"
        return cls(root, under(out.md_dir), under(out.original_dir), under(out.data_dir))
