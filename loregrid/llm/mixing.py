"""Mixing sources to target weights.

Each source's texts are packed, in a scattered order, into blocks of a fixed number of tokens. Every shard of the output
draws its number of blocks from each source (multinomial). The d-th draw from a source takes block perm(d), by a
pseudorandom permutation of the source's block numbers (a new one for every time through), so no list of blocks is ever
shuffled or collected: blocks and draws meet in one join by number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.llm.common import cut, mix, small, whole_key

BLOCK_TOKENS, SHARD_SLOTS, SHARDS_PER_SUM = 1024, 256, 1 << 12
#: Texts of a source are spread over buckets of about so many characters, whose tokens are then numbered.
BUCKET_CHARS = 32 << 20
_SPACE = " \t\n\v\f\r"
_U = np.uint64


def permute(x: np.ndarray, n: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each salt, at x: a four-round Feistel network, walked until it lands below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (_U(1) << half) - _U(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        v, h, m, s = out[todo], half[todo], mask[todo], salt[todo]
        left, right = v >> h, v & m
        for r in range(4):
            left, right = right, left ^ (mix(right + s + _U((r * 0x9E3779B97F4A7C15) & (2**64 - 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(shard: int, slots: int, p: np.ndarray, seed: int) -> np.ndarray:
    """How many of a shard's slots each source gets; depends on seed and shard alone."""
    return np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), shard])).multinomial(slots, p)


def _rounded(tokens: Column, size: int) -> Column:
    return F.ceil(tokens / F.lit(size)).cast("long")


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.7, blocks: int | None = None,
                block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 42, lang: str = "lang", detail: bool = True) -> DataFrame:
    """Blocks of the table's tokens, drawn from the sources by target weights.

    A token is a run of anything but ASCII white space, with the white space before it. Result: doc_id (the slot), text,
    lang (of the block's first text), source and n_chars; with detail also shard, block, epoch, n_tokens and doc_ids (the keys of
    the texts in the block, in order). weights: by source, those left out get none; by default a source's tokens to the
    power alpha. blocks: how many are drawn, by default as many as there are. A source whose share asks for more than it
    has begins again in another order. A source's last block may be short. Defined cases: null and blank texts hold no
    tokens; a null source is a source of its own, named None in weights; null and repeated keys are texts like others,
    equal rows are all packed; without any tokens, or with no weight on what is there, the result is empty; other
    columns are not carried. A text longer than a block goes on in the next one, however long it is. Keys are whole
    numbers, else a TypeError is raised. The driver holds one row for each source, as it does the weights.
    """
    spark = df.sparkSession
    sk = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    body = F.rtrim(F.col(text), F.lit(_SPACE))
    docs = df.where(F.col(text).rlike(r"[^ \t\n\x0B\f\r]")).select(sk.alias("sk"), whole_key(df, key).alias("k"), body.alias("t"), F.col(lang).alias("lang") if lang in df.columns else F.lit(None).cast("string").alias("lang"))
    docs = docs.withColumn("n", F.regexp_count("t", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long"))
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = 1 << max(4, math.ceil(math.log2(max(1, chars / BUCKET_CHARS))))
    order = F.xxhash64(F.lit(seed), "k")
    docs = docs.withColumn("bucket", F.pmod(order, F.lit(buckets)))
    totals = cut(docs.groupBy("sk", "bucket").agg(F.sum("n").alias("n")))
    whole = totals.groupBy("sk").agg(F.sum("n").alias("tokens"))
    before = totals.select("sk", "bucket", (F.sum("n").over(Window.partitionBy("sk").orderBy("bucket")) - F.col("n")).alias("base"))
    before = small(before, 64, totals.count())

    # where each text's tokens lie in its source
    run = Window.partitionBy("sk", "bucket").orderBy(order, "k", "t", "lang")
    placed = docs.withColumn("o", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    placed = placed.join(before, ["sk", "bucket"]).withColumn("o", F.col("o") + F.col("base"))
    size = F.lit(block_tokens)
    first, last = F.floor(F.col("o") / size), F.floor((F.col("o") + F.col("n") - 1) / size)
    words = F.regexp_extract_all("t", F.lit(r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+"), F.lit(0))
    begin = lambda b: F.greatest(b * size - F.col("o"), F.lit(0))
    end = lambda b: F.least((b + 1) * size - F.col("o"), F.col("n"))
    part = lambda w, b: F.array_join(F.slice(w, (begin(b) + 1).cast("int"), (end(b) - begin(b)).cast("int")), "")
    pieces = F.when(first == last, F.array(F.struct(first.alias("block"), F.col("t").alias("piece"), F.col("n").alias("m")))).otherwise(
        F.transform(F.array(words), lambda w: F.transform(F.sequence(first, last), lambda b: F.struct(b.alias("block"), part(w, b).alias("piece"), (end(b) - begin(b)).alias("m"))))[0]
    )
    cutup = placed.select("sk", "k", "lang", "o", F.inline(pieces))
    packed = cutup.groupBy("sk", "block").agg(F.sort_array(F.collect_list(F.struct("o", "k", "lang", "piece", "m"))).alias("parts"))
    packed = packed.select("sk", "block", F.array_join(F.col("parts.piece"), "\n").alias("text"), F.col("parts.lang")[0].alias("lang"), F.col("parts.k").alias("doc_ids"), F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["m"]).alias("n_tokens"))

    # which block every slot of the output takes
    named = [(r["sk"], int(r["tokens"])) for r in whole.orderBy("sk").collect()]  # as many rows as sources
    share = np.array([float(t) ** alpha if weights is None else float(weights.get(None if s == "n" else s[1:], 0.0)) for s, t in named])
    have = {s: -(-t // block_tokens) for s, t in named}
    slots = (sum(have.values()) if blocks is None else blocks) if share.sum() > 0 else 0
    p = share / share.sum() if slots else share
    sources = [s for s, _ in named]

    def draw(frames):
        for f in frames:
            rows = []
            for k in f["shard"]:
                counts = shard_counts(int(k), int(min(shard_slots, slots - k * shard_slots)), p, seed)
                rows.extend((int(k), s, int(c)) for s, c in zip(sources, counts) if c)
            yield pd.DataFrame(rows, columns=["shard", "sk", "c"])

    @F.pandas_udf("long")
    def perm(x: pd.Series, n: pd.Series, epoch: pd.Series, s: pd.Series) -> pd.Series:
        salt = mix(s.to_numpy().astype(np.int64).view(np.uint64) ^ mix(epoch.to_numpy().astype(np.int64).view(np.uint64) + _U(seed & (2**64 - 1))))
        return pd.Series(permute(x.to_numpy(), n.to_numpy(), salt))

    shards = -(-slots // shard_slots) if slots else 0
    drawn = spark.range(shards).select(F.col("id").alias("shard")).mapInPandas(draw, "shard long, sk string, c long")
    # running sums by groups of shards, then within each group, so that no task sorts all shards of a source
    drawn = drawn.withColumn("part", F.floor(F.col("shard") / SHARDS_PER_SUM))
    parts = drawn.groupBy("sk", "part").agg(F.sum("c").alias("n"))
    parts = parts.select("sk", "part", (F.sum("n").over(Window.partitionBy("sk").orderBy("part")) - F.col("n")).alias("start"))
    parts = small(parts, 64, len(sources) * -(-shards // SHARDS_PER_SUM))
    drawn = drawn.withColumn("base", F.sum("c").over(Window.partitionBy("sk", "part").orderBy("shard")) - F.col("c"))
    drawn = drawn.join(parts, ["sk", "part"]).withColumn("base", F.col("base") + F.col("start")).drop("part", "start")
    slot = drawn.select("shard", "sk", F.posexplode(F.sequence(F.col("base"), F.col("base") + F.col("c") - 1)).alias("j", "d"))
    sizes = spark.createDataFrame(list(have.items()) or [("", 1)], "sk string, size long")
    slot = slot.join(small(sizes, 64, len(have)), "sk").withColumn("epoch", F.floor(F.col("d") / F.col("size")))
    slot = slot.withColumn("block", perm(F.col("d") % F.col("size"), "size", "epoch", F.xxhash64("sk")))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "sk", "d"), "sk", "d"))
    slot = slot.select("sk", "shard", "block", "epoch", (F.col("shard") * shard_slots + rank - 1).alias("doc_id"))
    out = packed.join(slot, ["sk", "block"])
    columns = ["doc_id", "text", "lang", F.when(F.col("sk") == "n", None).otherwise(F.substr("sk", F.lit(2))).alias("source"), F.length("text").cast("long").alias("n_chars")]
    return out.select(*columns, *(["shard", "block", "epoch", "n_tokens", "doc_ids"] if detail else []))
