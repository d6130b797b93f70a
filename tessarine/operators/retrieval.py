"""Hybrid retrieval over batches of queries: vector and keyword candidates, fusion, labels, reranking, sources and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import fold, lookup_terms, normalize_spaces
from .keyword_index import KeywordIndex, scan_scores, scan_topk
from .vector_index import nearest

#: Rank constant, weights of the vector and keyword lists, factor by which the vector side looks further than asked.
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT, PROBE = 60, 1.0, 1.2, 4
#: Queries that are sent to every task at once, on average; more are answered round by round.
QUERY_BLOCK = 1000


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few files that can't be split are dealt to all cores; a table of many splits is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def probe_size(top_k: int, factor: int = PROBE) -> int:
    return max(top_k * max(1, factor), top_k)


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts each partition to k before it sorts them together."""
    w = W.Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def vector_topk(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, child_type, similarity: the k nearest points of each query, by cosine, ties by point.

    points: point_id, chunk_id, child_type, vector. queries: query_id, query_vector, answered in rounds of QUERY_BLOCK. Without an index all points are
    looked at; VectorIndex keeps one that leaves most of them out.
    """
    near = nearest(spread(points), queries, k, QUERY_BLOCK)
    return near.select("query_id", "rank", *[F.col(c).cast(points.schema[c].dataType).alias(c) for c in ("point_id", "chunk_id")], "child_type", "similarity")


def vector_parents(hits: DataFrame, document_ids: list[int] | None = None) -> DataFrame:
    """Hits collapsed to parents: query_id, chunk_id, rank (place among the parents), child_type of the first. The filter comes after the top k."""
    kept = hits if document_ids is None else hits.where(F.col("chunk_id").isin(document_ids))
    firsts = kept.groupBy("query_id", "chunk_id").agg(F.min_by("child_type", "rank").alias("child_type"), F.min("rank").alias("hit_rank"))
    w = W.Window.partitionBy("query_id").orderBy("hit_rank")
    return firsts.withColumn("rank", F.row_number().over(w)).drop("hit_rank")


def keyword_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score > 0. chunks: chunk_id, content (the blob), chunk_codes. queries: query_id, message.

    12 for each query code among the chunk's, 6 for one in its text, 1 for each query term that its folded text contains. Queries go to all tasks in rounds.
    """
    return scan_scores(spread(chunks), queries)


def keyword_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best chunks of each query, ties by chunk. Without an index every text is looked through; KeywordIndex keeps one."""
    found = scan_topk(spread(chunks), queries, k)
    return found.withColumn("chunk_id", F.col("chunk_id").cast(chunks.schema["chunk_id"].dataType))


def rrf_merge(vector: DataFrame, keyword: DataFrame, k: int, c: int = RRF_K, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """Weighted reciprocal ranks added up over both lists, with the mode: hybrid, vector or keyword. Ties: vector order, then keyword order."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("keyword_rank"), "child_type")
    w = keyword.select("query_id", "chunk_id", F.lit(None).cast("int").alias("vector_rank"), F.col("rank").alias("keyword_rank"), F.lit(None).cast("string").alias("child_type"))
    both = v.unionByName(w).groupBy("query_id", "chunk_id").agg(F.min("vector_rank").alias("vector_rank"), F.min("keyword_rank").alias("keyword_rank"), F.max("child_type").alias("child_type"))
    part = lambda name, weight: F.coalesce(F.lit(weight) / (F.lit(c) + F.col(name)), F.lit(0.0))
    scored = both.withColumn("score", part("vector_rank", vector_weight) + part("keyword_rank", keyword_weight))
    mode = F.when(F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull(), "hybrid").when(F.col("keyword_rank").isNotNull(), "keyword").otherwise("vector")
    return ranked(scored.withColumn("retrieval_mode", mode), ["query_id"], [F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()], k)


def rrf_multi(lists: DataFrame, k: int, c: int = RRF_K) -> DataFrame:
    """Unweighted fusion of any number of lists (query_id, variant, chunk_id, rank, child_type); the first variant's child type stays, ties by first variant and rank."""
    first = F.struct("variant", "rank")
    s = lists.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("score"), F.min(first).alias("_first"), F.min_by("child_type", first).alias("child_type"))
    return ranked(s, ["query_id"], [F.round("score", 12).desc(), F.col("_first"), F.col("chunk_id")], k).drop("_first")


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text contains: the reranker when no model is given."""
    terms = F.array_distinct(lookup_terms(query))
    hit = F.size(F.filter(terms, lambda t: F.contains(fold(text), t)))
    return hit / F.greatest(F.size(terms), F.lit(1))


def rerank(results: DataFrame, top_k: int, query: str = "message", text: str = "content") -> DataFrame:
    scored = results.withColumnRenamed("rank", "in_rank").withColumn("reranker_score", F.round(lexical_score(F.col(query), F.col(text)), 4))
    return ranked(scored, ["query_id"], [F.col("reranker_score").desc(), F.col("in_rank")], top_k)


def excerpt(text: Column, n: int = 280) -> Column:
    return F.substring(F.replace(F.trim(text), F.lit("\n"), F.lit(" ")), 1, n)


NO_CONTEXT = "No retrieved context available."  # fixed value


def context_block(results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, context: per chunk a line of what is known of it, then its text; blocks are parted by blank lines. Queries without results get a notice.

    Results may have file_name, page, doc_type, h2, h3, chunk_codes (the first three are named) and retrieval_mode.
    """
    labels = [("file", "file_name"), ("page", "page"), ("doc_type", "doc_type"), ("h2", "h2"), ("h3", "h3"), ("document_codes", "chunk_codes"), ("retrieval", "retrieval_mode")]
    known = lambda c: F.nullif(F.array_join(F.slice(c, 1, 3), ", "), F.lit("")) if c == "chunk_codes" else F.nullif(F.col(c).cast("string"), F.lit(""))
    head = F.concat_ws(" | ", *[F.concat(F.lit(f"{name}="), known(c)) for name, c in labels if c in results.columns])
    line = F.concat(F.format_string("[Chunk %d]", F.col("rank")), F.when(head != "", F.concat(F.lit(" "), head)).otherwise(""), F.lit("\n\n"), F.col("content"))
    blocks = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    made = blocks.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))
    return made if queries is None else queries.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def prompts(contexts: DataFrame, queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """query_id, prompt: the history (query_id, history), the context and the question (message), parted by blank lines."""
    q = queries.select("query_id", "message").join(contexts, "query_id")
    q = q.withColumn("history", F.lit(None).cast("string")) if history is None else q.join(history.select("query_id", "history"), "query_id", "left")
    return q.select("query_id", F.concat_ws("\n\n", F.nullif("history", F.lit("")), "context", F.concat(F.lit("Q: "), F.col("message"))).alias("prompt"))


def search(chunks: DataFrame, points: DataFrame, queries: DataFrame, top_k: int, document_ids: list[int] | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """The hybrid search: rows (query_id, rank, chunk_id, retrieval_mode, score, child_type, content) of chunks that exist.

    index is one of all chunks; where there is none, or only some documents are searched, the texts are looked through.
    """
    v = vector_parents(vector_topk(points, queries, probe_size(top_k)), document_ids)
    pool = chunks if document_ids is None else chunks.where(F.col("chunk_id").isin(document_ids))
    by_word = index.topk(queries, probe_size(top_k)) if index and document_ids is None else keyword_topk(pool, queries, probe_size(top_k))
    merged = rrf_merge(v, by_word, top_k)
    return merged.join(chunks.select("chunk_id", "content"), "chunk_id").select("query_id", "rank", "chunk_id", "retrieval_mode", "score", "child_type", normalize_spaces("content").alias("content"))
