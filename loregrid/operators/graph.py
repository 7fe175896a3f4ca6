"""Module relations, breadth-first search and components over edge tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregrid.functions import text as X


#: A side of a join that has no equal keys is broadcast only if its measured size is below this.
BROADCAST_LIMIT = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the session names none, a temporary one, in local mode only: executors elsewhere couldn't read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loregrid-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once(c: Column) -> Column:
    """c as a generator of one row: it is computed once, and neither filters nor uses further up make it again."""
    return F.explode(F.array(c))


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, in as many parts as there are cores at least: a small file is read by one or two tasks, however much work its rows are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.queryExecution().toRdd().getNumPartitions() >= cores else table.repartition(2 * cores)


def fits(df: DataFrame, row_bytes: int = 256) -> bool:
    """Whether df, counted, is small enough to be sent to every executor."""
    most = BROADCAST_LIMIT // row_bytes
    return df.limit(most + 1).count() <= most


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with 1, 2, ... by order, without moving all rows to one task: range-partitioned, counted, offset."""
    parts = cut(df.orderBy(*order).withColumn("lg_part", F.spark_partition_id()).withColumn("lg_row", F.monotonically_increasing_id()))
    sizes = parts.groupBy("lg_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("lg_part", (F.sum("n").over(Window.orderBy("lg_part")) - F.col("n")).alias("lg_before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("lg_part").orderBy("lg_row"))
    return parts.withColumn(name, within).join(F.broadcast(before), "lg_part").withColumn(name, (F.col(name) + F.col("lg_before")).cast("long")).drop("lg_part", "lg_row", "lg_before")


def canonical(name: Column, aliases: DataFrame | None, df: DataFrame, out: str = "module") -> DataFrame:
    """df with `out`: the canonical name of `name`, by a table (canonical, alias); a name without an entry is its own."""
    if aliases is None:
        return df.withColumn(out, name)
    look = aliases.groupBy(F.col("alias").alias("lg_alias")).agg(F.min("canonical").alias("lg_canonical"))
    joined = df.join(look, name == F.col("lg_alias"), "left")
    return joined.withColumn(out, F.coalesce("lg_canonical", name)).drop("lg_alias", "lg_canonical")


def contains_join(long: DataFrame, short: DataFrame, body: str, part: str, small: bool | None = None) -> DataFrame:
    """Rows of long and short where `body` holds `part`, which isn't empty, as a substring.

    A second table that is small, as counted, is broadcast. Otherwise both meet on the first two characters of part,
    which must stand in body, and on the one that it has; that part stands there as a whole is checked afterwards.
    """
    short = short.where(F.col(part) != "")
    if fits(short) if small is None else small:
        return long.join(F.broadcast(short), F.col(body).contains(F.col(part)))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length(body) - (n - 1)), lambda i: F.substr(F.col(body), i, F.lit(n)))
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(*(F.when(F.length(body) >= n, grams(n)).otherwise(none) for n in (1, 2))))
    left = long.withColumn("lg_gram", F.explode(both))
    right = short.withColumn("lg_head", F.substring(part, 1, 2))
    return left.join(right, F.col("lg_gram") == F.col("lg_head")).where(F.col(body).contains(F.col(part))).drop("lg_gram", "lg_head")


def module_refs(chunks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(module, ref): the distinct cross references of each module."""
    named = canonical(F.when(X.text(F.col("module")) == "", "未知").otherwise(F.col("module")), aliases, chunks.select("module", "cross_refs"))
    return named.select("module", F.explode("cross_refs").alias("ref")).distinct()


def relations(refs: DataFrame, modules: DataFrame, small: bool | None = None) -> DataFrame:
    """(from, to, ref): module `from` has a reference that holds the name of `to`; of several, the first by name."""
    names = modules.where(X.text(F.col("module")) != "").select(F.col("module").alias("to")).distinct()
    met = contains_join(refs.select(F.col("module").alias("from"), "ref"), names, "ref", "to", small)
    return met.where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.min("ref").alias("ref"))


def bfs(edges: DataFrame, seed: DataFrame, depth: int, a: str = "from", b: str = "to") -> DataFrame:
    """(node, hops): nodes within `depth` (1 to 3) steps of the seeds (column node) either way, without the seeds themselves."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x IS NOT NULL AND y IS NOT NULL").distinct()
    start = seed.select("node").distinct()
    frontier, found = start, start.select("node", F.lit(0).alias("hops"))
    for step in range(1, min(max(depth, 1), 3) + 1):
        reached = both.join(frontier.select(F.col("node").alias("x")), "x").select(F.col("y").alias("node")).distinct()
        frontier = reached.join(found, "node", "left_anti")
        found = found.unionByName(frontier.select("node", F.lit(step).alias("hops")))
    return found.where("hops > 0")


def top_n(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of every group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("lg_r", F.row_number().over(w)).where(F.col("lg_r") <= n).drop("lg_r")


def related_designs(edges: DataFrame, facts: DataFrame, module: str, depth: int = 1, n: int = 10) -> DataFrame:
    """(module, facts_count, key_facts) of the modules around one, and of itself (hops 0)."""
    spark = edges.sparkSession
    seed = spark.createDataFrame([(module,)], "node string")
    near = bfs(edges, seed, depth).unionByName(seed.withColumn("hops", F.lit(0)))
    own = near.join(facts, near["node"] == facts["module"], "left")
    fact = F.when(F.col("subject").isNotNull(), F.struct("ordinal", "type", "subject", "predicate", "value"))
    return own.groupBy("node", "hops").agg(F.count("subject").alias("facts_count"), F.slice(F.sort_array(F.collect_list(fact)), 1, n).alias("key_facts")).withColumnRenamed("node", "module")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): components named by their least node; for moderate tables, by passing on the least name and jumping over it."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct()
    both = cut(both)
    label = cut(both.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("c")))
    while True:
        near = both.join(label.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("c2"))
        best = label.join(near, "x").select("x", F.least("c", "c2").alias("c"))
        jump = best.alias("p").join(best.select(F.col("x").alias("c"), F.col("c").alias("cc")), "c").select("x", F.least("c", "cc").alias("c"))
        after = cut(jump)
        moved = after.join(label.withColumnRenamed("c", "was"), "x").where("c <> was").limit(1).count()
        label = after
        if not moved:
            return label.select(F.col("x").alias("node"), F.col("c").alias("component"))
