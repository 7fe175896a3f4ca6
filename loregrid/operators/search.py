"""Hybrid search over a chunk table: lexical and vector recall, fusion, boosts, enrichment."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.operators.graph import cut

K1, B, FLOOR = 1.5, 0.75, 0.25
OVERSAMPLE, ENTITY_BOOST, HIT_BOOST = 3, 0.15, 0.1

Name = str | None


# --- lexical


def postings(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf, dl): one row for each distinct term of a chunk, for an index table."""
    words = chunks.select(F.col(key).alias("id"), X.tokens(F.col(text)).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, dl): in how many chunks a term is. The row with a null term counts the chunks, and dl their tokens. One scan, combined before the shuffle."""
    mark = "\0"  # no term begins so: a chunk's length in tokens goes along as a term
    words = chunks.select(F.explode(F.array(X.tokens(F.col(text)))).alias("w"))
    terms = words.select(F.explode(F.concat(F.array(F.concat(F.lit(mark), F.size("w").cast("string"))), F.array_distinct("w"))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    length = F.substring("term", 2, 20).try_cast("long")
    whole = counts.where(F.col("term").startswith(mark)).agg(F.sum("df").alias("df"), F.sum(F.col("df") * length).alias("dl")).where("df > 0")
    return counts.where(~F.col("term").startswith(mark)).select("term", "df", F.lit(0).cast("long").alias("dl")).unionByName(whole.select(F.lit(None).cast("string").alias("term"), "df", "dl"))


def changed_vocabulary(words: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """A vocabulary after some chunks went and others came, by theirs."""
    signed = lambda v, n: v.select("term", (n * F.col("df")).alias("df"), (n * F.col("dl")).alias("dl"))
    return signed(words, 1).unionByName(signed(gone, -1)).unionByName(signed(new, 1)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).where("df > 0")


def corpus_stats(words: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in tokens."""
    return words.where("term IS NULL").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))


def idf(words: DataFrame) -> DataFrame:
    """(term, idf), negative values replaced by FLOOR times the mean over the vocabulary."""
    raw = words.where("term IS NOT NULL").crossJoin(F.broadcast(corpus_stats(words)))
    raw = raw.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, FLOOR * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


def raw_scores(chunks: DataFrame, query: str, words: DataFrame, key: str, text: str) -> DataFrame:
    """(id, raw): BM25 of the chunks that hold a query term. They are scored where they are read, with the query's few weights."""
    q = X.tokens(F.lit(query))
    asked = chunks.sparkSession.range(1).select(F.explode(F.array_distinct(q)).alias("term"))
    weights = idf(words).join(F.broadcast(asked), "term", "left_semi").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("weights"))
    held = chunks.select(F.col(key).alias("id"), F.explode(F.array(X.tokens(F.col(text)))).alias("w"))  # a generator, so that words are not made again for each use
    held = held.select("id", F.size("w").alias("dl"), F.filter("w", lambda t: F.array_contains(q, t)).alias("w")).where(F.size("w") > 0)
    held = held.crossJoin(F.broadcast(corpus_stats(words).crossJoin(weights)))
    length = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t)).cast("double")
    part = lambda t, tf: times(q, t) * F.coalesce(F.col("weights")[t], F.lit(0.0)) * tf * (K1 + 1) / (tf + length)
    return held.select("id", F.aggregate(F.array_distinct(q), F.lit(0.0), lambda s, t: s + part(t, times(F.col("w"), t))).alias("raw"))


def bm25(chunks: DataFrame, query: str, key="id", text="text", words: DataFrame | None = None) -> DataFrame:
    """(id, score) of all chunks that hold a query term, divided by the corpus maximum if that is positive.

    words: the chunks' vocabulary, where it is kept as a table; else it is counted first. Two scans of the texts in all.
    """
    scores = cut(raw_scores(chunks, query, cut(vocabulary(chunks, text)) if words is None else words, key, text))
    most = scores.agg(F.max("raw").alias("top"))
    return scores.crossJoin(F.broadcast(most)).select("id", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.col("raw")).alias("score"))


def top(scores: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    return scores.orderBy(F.desc(score), key).limit(k)


def bm25_top(chunks: DataFrame, query: str, k: int, where: Column | None = None, key="id", text="text", words: DataFrame | None = None) -> DataFrame:
    """The k best chunks with a positive score; `where` is applied after that choice, so fewer may be left.

    The corpus maximum is the first of the k, so nothing but these is needed to divide by it.
    """
    raw = raw_scores(chunks, query, cut(vocabulary(chunks, text)) if words is None else words, key, text)
    best = top(raw.where("raw > 0"), k, "raw")
    best = best.select("id", (F.col("raw") / F.max("raw").over(Window.partitionBy(F.lit(0)))).alias("score"))
    if where is None:
        return best
    return chunks.where(where).join(F.broadcast(best), chunks[key] == best["id"]).select(best["id"], "score")


# --- vectors


def vector_top(chunks: DataFrame, query: list[float], k: int, where: Column | None = None, key="id", vector="embedding") -> DataFrame:
    """The k chunks nearest by cosine among those that pass `where`, scored (1 + cosine) / 2 to 4 places."""
    q = F.array(*(F.lit(float(x)) for x in query))
    source = chunks if where is None else chunks.where(where)
    scored = source.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.round((1 + X.cosine(F.col(vector), q)) / 2, 4).alias("score"))
    return top(scored, k)


def fuse(vectors: DataFrame, lexical: DataFrame, v: float, b: float) -> DataFrame:
    """(id, score): weighted sum; a side that misses a chunk counts 0 there."""
    joined = vectors.select("id", F.col("score").alias("v")).join(lexical.select("id", F.col("score").alias("b")), "id", "full_outer")
    return joined.select("id", (v * F.coalesce("v", F.lit(0.0)) + b * F.coalesce("b", F.lit(0.0))).alias("score"))


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """Scores of sub-queries in one: the highest, and HIT_BOOST for every further part that found the chunk. A single part is left alone."""
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg((F.max("score") + HIT_BOOST * (F.count(F.lit(1)) - 1)).alias("score"))


def entity_match(entities: Column, doc_id: Column, module: Column, section: Column, text: Column) -> Column:
    """Whether an entity is the document or module, or stands in the section or text."""
    return F.exists(entities, lambda e: X.text(doc_id).eqNullSafe(e) | X.text(module).eqNullSafe(e) | X.text(section).contains(e) | X.text(text).contains(e))


def boosted(candidates: DataFrame, entities: Column) -> DataFrame:
    hit = entity_match(entities, F.col("doc_id"), F.col("module"), F.col("section"), F.col("text"))
    return candidates.withColumn("score", F.col("score") + F.when(hit, ENTITY_BOOST).otherwise(0.0))


def rerank(candidates: DataFrame, scores: DataFrame | None, k: int) -> DataFrame:
    """The k best by reranker_score (0 where that is missing), or by fused score without a reranker."""
    if scores is None:
        return top(candidates, k)
    joined = candidates.join(scores.select("id", "reranker_score"), "id", "left").withColumn("reranker_score", F.coalesce("reranker_score", F.lit(0.0)))
    return top(joined.withColumn("score", F.col("reranker_score")), k)


# --- enrichment


def neighbours(chunks: DataFrame, window: int = 1, group: str = "source", index: str = "chunk_index", text: str = "text", limit: int = 300) -> DataFrame:
    """chunks with prev and next: arrays of up to `window` texts on either side, cut to `limit` characters, by exact index."""
    w = Window.partitionBy(group).orderBy(index)
    near = lambda f, n: F.when(f(index, n).over(w) == F.col(index) + (n if f is F.lead else -n), F.substring(f(text, n).over(w), 1, limit))
    nonempty = lambda a: F.filter(F.array_compact(a), lambda t: t != "")
    return chunks.withColumn("prev", nonempty(F.array(*(near(F.lag, n) for n in range(window, 0, -1))))).withColumn("next", nonempty(F.array(*(near(F.lead, n) for n in range(1, window + 1)))))


def result_neighbours(results: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Neighbours of a few results: the chunk table is met by (source, index), not sorted as a whole."""
    offsets = F.explode(F.array(*(F.lit(o) for o in range(-window, window + 1) if o)))
    wanted = results.select("id", "source", "chunk_index", offsets.alias("o")).withColumn("i", F.col("chunk_index") + F.col("o"))
    found = F.broadcast(wanted).join(chunks.select(F.col("source").alias("s2"), F.col("chunk_index").alias("i2"), F.substring("text", 1, 300).alias("t")), (F.col("source") == F.col("s2")) & (F.col("i") == F.col("i2")))
    side = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond & (F.col("t") != ""), F.struct("o", "t")))), lambda x: x["t"])
    lists = found.groupBy("id").agg(side(F.col("o") < 0).alias("prev"), side(F.col("o") > 0).alias("next"))
    none = F.array().cast("array<string>")
    return results.join(F.broadcast(lists), "id", "left").withColumn("context", F.struct(F.coalesce("prev", none).alias("prev"), F.coalesce("next", none).alias("next"))).drop("prev", "next")


def with_rules(results: DataFrame, rules: DataFrame) -> DataFrame:
    """results with canon_refs: rules whose subject stands in the text (any case) or section."""
    r = rules.where(F.col("subject") != "").select(F.col("id").alias("r_id"), F.col("subject").alias("r_subject"), F.struct("id", "subject", "predicate", "value", "status").alias("ref"))
    met = F.lower("text").contains(F.lower("r_subject")) | X.text(F.col("section")).contains(F.col("r_subject"))
    refs = r.join(F.broadcast(results.select(F.col("id").alias("c_id"), "text", "section")), met).groupBy("c_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_id", "ref"))), lambda x: x["ref"]).alias("canon_refs"))
    return results.join(refs, results["id"] == refs["c_id"], "left").drop("c_id")


def related_modules(results: DataFrame, exclude: Name = None) -> DataFrame:
    """One row, related_modules: the sorted cross references of results, without the module asked for."""
    refs = F.array_sort(F.array_distinct(F.flatten(F.collect_list("cross_refs"))))
    return results.agg((F.array_remove(refs, exclude) if exclude else refs).alias("related_modules"))


def aliases_of(module: str, aliases: dict[str, list[str]]) -> list[str]:
    """All names of a module, its own always among them."""
    for canonical, names in aliases.items():
        if module == canonical or module in names:
            return sorted({canonical, module, *names})
    return [module]


def search(chunks: DataFrame, query: str, embed: Callable[[str], list[float]], top_k=5, include_context=False, module: Name = None, doc_type: Name = None,
           aliases: dict[str, list[str]] | None = None, rules: DataFrame | None = None, rewrite: Callable[[str], str] | None = None, reranker: Callable[[str, DataFrame], DataFrame] | None = None,
           multi_hop=False, modules: list[str] | None = None, words: DataFrame | None = None) -> DataFrame:
    """The top_k chunks for a query.

    Vector recall honours module and doc_type before its limit, lexical recall after it. embed turns a text into a
    vector, rewrite changes the query for recall, and reranker gives (id, reranker_score) of candidates; words is the
    chunks' vocabulary, where it is kept as a table.
    """
    spark: SparkSession = chunks.sparkSession
    plan = spark.range(1).select(X.sub_queries(F.lit(query)).alias("parts"), X.entities(F.lit(query), modules).alias("entities"), X.weights(X.query_type(F.lit(query))).alias("w")).first()
    where = F.lit(True)
    if module:
        where = where & F.col("module").isin(*aliases_of(module, aliases or {}))
    if doc_type:
        where = where & (F.col("doc_type") == doc_type)
    k = OVERSAMPLE * top_k
    parts, words = [], cut(vocabulary(chunks)) if words is None else words
    for part in plan["parts"]:
        asked = rewrite(part) if rewrite else part
        parts.append(fuse(vector_top(chunks, embed(asked), k, where), bm25_top(chunks, asked, k, where, words=words), plan["w"]["v"], plan["w"]["b"]))
    candidates = chunks.join(F.broadcast(merge_parts(parts)), "id")
    candidates = boosted(candidates, F.array(*map(F.lit, plan["entities"])).cast("array<string>"))
    best = rerank(candidates, reranker(query, candidates) if reranker else None, top_k)
    if include_context:
        best = result_neighbours(best, chunks)
    if rules is not None:
        best = with_rules(best, rules)
    if multi_hop:
        best = best.crossJoin(F.broadcast(related_modules(best, module)))
    cite = X.citation(F.col("source"), F.col("section"), F.col("module"), F.col("doc_version"), F.col("doc_mtime"))
    extra = [c for c in ("reranker_score", "context", "canon_refs", "related_modules") if c in best.columns]
    return best.select("id", F.substring("text", 1, 500).alias("text"), "module", "doc_type", "source", "section", F.round("score", 4).alias("score"), "heading_chain", X.highlight(F.substring("text", 1, 500), F.lit(query)).alias("highlight"), cite.alias("citation"), *extra).orderBy(F.desc("score"), "id")
