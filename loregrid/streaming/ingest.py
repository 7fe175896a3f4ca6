"""New documents as a stream, for files that are only ever added; edits and deletions need the batch diff."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loregrid.functions import text as X
from loregrid.operators.chunking import chunk_documents
from loregrid.operators.graph import cut
from loregrid.sources.chunk_store import replace_chunks
from loregrid.sources.files import qualified

_BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def new_documents(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (source, text, mtime) of the Markdown below root."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    source = X.relative(F.col("path"), qualified(spark, root))
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select(source.alias("source"), X.normalize_newlines(body).alias("text"), F.col("modificationTime").alias("mtime")).where(X.indexable(F.col("source")) & F.col("text").isNotNull())


def index_new(spark: SparkSession, root: str, tables, checkpoint: str, embed=None, name: str = "chunks", done: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Chunks of the files that are there and not yet indexed, into a table of `tables`; ends when all are done.

    A batch replaces its own sources, so that one that is run again after a failure leaves no row twice, and changes the
    vocabulary by what is new in it.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        replace_chunks(tables, cut(chunk_documents(batch, embed)), batch.select("source"), name)
        if done:
            done(batch, number)
        batch.unpersist()

    return new_documents(spark, root).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
