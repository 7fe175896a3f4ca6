"""Tables kept as versions: a write adds folders, and then a numbered manifest that names the folders which make up the table.

The manifest with the highest number counts. Nothing that it or the one before it names is ever removed, and none is
removed before there is a higher one: a job that dies in between leaves the table as it was, and readers see one whole
version or the other. A table may be kept in buckets by the hash of a column; a replacement then rewrites only the
buckets that it touches.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_MANIFEST = re.compile(r"_manifest-(\d{12})")


class Tables:
    """Tables of Parquet below a root that all executors share. One job at a time may write a table; a second one that comes in between fails."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self, name: str) -> int | None:
        """The number of the table's current manifest, None if there is no such table."""
        return max((int(m[1]) for m in map(_MANIFEST.fullmatch, self._names(f"{self.root}/{name}")) if m), default=None)

    def _manifest(self, name: str, number: int) -> dict:
        stream = self.spark._jvm.java.util.Scanner(self._fs.open(self._path(f"{self.root}/{name}/_manifest-{number:012d}")), "UTF-8").useDelimiter("\\A")
        try:
            return json.loads(stream.next())
        finally:
            stream.close()

    def _commit(self, name: str, before: int | None, manifest: dict) -> None:
        """The manifest becomes visible as a whole, by a rename; afterwards what the last two don't name goes."""
        if self.version(name) != before:
            raise OSError(f"{name} was written by another job meanwhile")
        number = 1 if before is None else before + 1
        fresh = self._path(f"{self.root}/{name}/_next-{uuid.uuid4().hex}")
        out = self.spark._jvm.java.io.OutputStreamWriter(self._fs.create(fresh, False), "UTF-8")
        out.write(json.dumps(manifest))
        out.close()
        to = self._path(f"{self.root}/{name}/_manifest-{number:012d}")
        if self._fs.exists(to) or not self._fs.rename(fresh, to):
            raise OSError(f"the manifest of {name} could not be put in place")
        if before is not None:
            self._clear(name, before, manifest)

    def _clear(self, name: str, before: int, manifest: dict) -> None:
        named = {p for m in (manifest, self._manifest(name, before)) for paths in m["parts"].values() for p in paths}
        folders = {p.split("/")[0] for p in named}
        for entry in self._names(f"{self.root}/{name}"):
            m = _MANIFEST.fullmatch(entry)
            if m and int(m[1]) < before or entry.startswith("v-") and entry not in folders:
                self._fs.delete(self._path(f"{self.root}/{name}/{entry}"), True)
            elif entry.startswith("v-") and entry not in named:
                for bucket in self._names(f"{self.root}/{name}/{entry}"):
                    if bucket.startswith("lg_bucket=") and f"{entry}/{bucket}" not in named:
                        self._fs.delete(self._path(f"{self.root}/{name}/{entry}/{bucket}"), True)

    # --- reading

    def _rows(self, name: str, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.root}/{name}/{p}" for b, parts in manifest["parts"].items() if buckets is None or b in buckets for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The table's current version; without one, an empty table of the schema. A table is never removed because it can't be read."""
        number = self.version(name)
        if number is None:
            if schema is None:
                raise ValueError(f"there is no table {name}")
            return self.spark.createDataFrame([], schema)
        return self._rows(name, self._manifest(name, number))

    def note(self, name: str) -> str:
        """What the current version was written with as its note."""
        number = self.version(name)
        return "" if number is None else self._manifest(name, number)["note"]

    def of_sources(self, name: str, sources: DataFrame) -> DataFrame:
        """The rows of a bucketed table whose bucket column is in sources (first column), by reading their buckets only."""
        manifest = self._manifest(name, self.version(name))
        column = manifest["bucket_by"] or sources.columns[0]
        gone = sources.select(F.col(sources.columns[0]).alias(column)).distinct()
        return self._rows(name, manifest, self._touched(gone, manifest)).join(gone, column, "left_semi")

    # --- writing

    def _bucket(self, column: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int")

    def _touched(self, sources: DataFrame, manifest: dict) -> list[str] | None:
        """Buckets of some sources; None where the table has none."""
        if not manifest["bucket_by"]:
            return None
        return [str(r["b"]) for r in sources.select(self._bucket(sources.columns[0], manifest["buckets"]).alias("b")).distinct().collect()]  # at most as many as there are buckets

    def _put(self, name: str, df: DataFrame, by: str | None, buckets: int) -> dict[str, list[str]]:
        """df in a new folder: its parts by bucket."""
        at = f"v-{uuid.uuid4().hex}"
        if by is None:
            df.write.mode("errorifexists").parquet(f"{self.root}/{name}/{at}")
            return {"0": [at]}
        df.withColumn("lg_bucket", self._bucket(by, buckets)).hint("rebalance", "lg_bucket").write.mode("errorifexists").partitionBy("lg_bucket").parquet(f"{self.root}/{name}/{at}")
        return {x.removeprefix("lg_bucket="): [f"{at}/{x}"] for x in self._names(f"{self.root}/{name}/{at}") if x.startswith("lg_bucket=")}

    def write(self, name: str, df: DataFrame, bucket_by: str | None = None, buckets: int = BUCKETS, note: str = "") -> DataFrame:
        """A new version, which counts once it is whole."""
        before = self.version(name)
        parts = self._put(name, df, bucket_by, buckets)
        self._commit(name, before, {"schema": df.schema.json(), "bucket_by": bucket_by, "buckets": buckets, "note": note, "parts": parts})
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Rows added to the current version, of whose columns df may lack some."""
        before = self.version(name)
        if before is None:
            return self.write(name, df)
        manifest = self._manifest(name, before)
        empty = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(manifest["schema"])))
        for bucket, paths in self._put(name, empty.unionByName(df, allowMissingColumns=True), manifest["bucket_by"], manifest["buckets"]).items():
            manifest["parts"].setdefault(bucket, []).extend(paths)
        self._commit(name, before, manifest)
        return self.read(name)

    def replace_sources(self, name: str, new: DataFrame, sources: DataFrame, column: str = "source", buckets: int = BUCKETS) -> DataFrame:
        """The table without rows of these sources, and with new ones (of these sources too): only the buckets of the sources are written."""
        before = self.version(name)
        if before is None:
            return self.write(name, new, column, buckets)
        manifest = self._manifest(name, before)
        gone = sources.select(F.col(column)).distinct()
        if manifest["bucket_by"] not in (None, column):
            raise ValueError(f"{name} is kept in buckets by {manifest['bucket_by']}, not {column}")
        touched = self._touched(gone, manifest)
        old = self._rows(name, manifest, touched).join(gone, column, "left_anti")
        after = old.unionByName(new, allowMissingColumns=True)
        parts = self._put(name, after, manifest["bucket_by"], manifest["buckets"])
        if touched is not None:
            parts = {b: p for b, p in manifest["parts"].items() if b not in touched} | parts
        self._commit(name, before, manifest | {"schema": after.schema.json(), "parts": parts})
        return self.read(name)

    def restore(self, name: str, number: int) -> DataFrame:
        """The table as it was in the version before the last write, as a new version."""
        self._commit(name, self.version(name), self._manifest(name, number))
        return self.read(name)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def view(df: DataFrame, name: str) -> DataFrame:
    """df as a temporary view: a table that lasts as long as the session."""
    df.createOrReplaceTempView(name)
    return df
