"""Counts and lists over chunks: modules, statistics, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.operators.graph import canonical


def modules(chunks: DataFrame, module: str = "module", source: str = "source") -> DataFrame:
    """(module, documents, n): each module's documents, sorted."""
    return chunks.groupBy(module).agg(F.sort_array(F.collect_set(source)).alias("documents")).withColumn("n", F.size("documents"))


def total_documents(per_module: DataFrame) -> DataFrame:
    """A document in two modules counts twice."""
    return per_module.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_docs"))


def stats(chunks: DataFrame, doc: str = "doc_id", module: str = "module") -> DataFrame:
    """One row: chunks, documents, modules (without '')."""
    named = F.when(X.text(F.col(module)) != "", F.col(module))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(doc).alias("documents"), F.countDistinct(named).alias("modules"))


def suggest(chunks: DataFrame, partial: str, most: int = 10, section: str = "section", module: str = "module") -> DataFrame:
    """(rank, suggestion): sections that hold the words in any case, sorted, then modules, without those already there."""
    names = chunks.select(F.inline(F.array(F.struct(F.lit(0).alias("g"), F.col(section).cast("string").alias("s")), F.struct(F.lit(1).alias("g"), F.col(module).cast("string").alias("s")))))
    held = names.where((X.text(F.col("s")) != "") & F.lower("s").contains(F.lower(F.lit(partial)))).groupBy("s").agg(F.min("g").alias("g"))
    best = held.orderBy("g", "s").limit(most)
    return best.select(F.row_number().over(Window.orderBy("g", "s")).alias("rank"), F.col("s").alias("suggestion"))


def normalized(df: DataFrame, aliases: DataFrame, column: str = "module") -> DataFrame:
    """df with canonical module names."""
    out = canonical(F.col(column), aliases, df, "lg_name")
    return out.withColumn(column, F.col("lg_name")).drop("lg_name")


def expanded(names: DataFrame, aliases: DataFrame, column: str = "module") -> DataFrame:
    """(module, name): every name of each module, its own and the canonical one always among them."""
    both = F.array_distinct(F.array(F.col(column), F.col("lg_name")))
    c = canonical(F.col(column), aliases, names.select(column).distinct(), "lg_name")
    own = c.select(column, F.explode(both).alias("name"))
    other = c.join(aliases.select("canonical", "alias"), F.col("lg_name") == F.col("canonical")).select(column, F.col("alias").alias("name"))
    return own.unionByName(other).distinct()


