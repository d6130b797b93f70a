"""Queries of retrieval: vector and keyword search, fusion, labels, context, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags
from ..functions.text import document_codes
from ..operators import retrieval as r
from ..operators.embedding import hash_embed
from ..operators.keyword_index import KeywordIndex
from ..operators.vector_index import VectorIndex
from ..sources.scratch import checkpointed, scratch_folder, settled
from . import tables as t
from .catalog_queries import chat_history
from .registry import query

TOP_K = 20


def points(spark, d):
    e = t.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, "summary").otherwise("question").alias("child_type"), F.col("embedding").alias("vector"))


def asked_vectors(spark, d):
    """Every vector whose id is divisible by 20."""
    return t.read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def asked(spark, d):
    """Every benchmark item whose id is divisible by 20, behind the code of a document, with the vector of the same number as its embedding."""
    message = F.concat(F.col("item_id").cast("string"), F.lit("/QD-EN "), F.col("text"))
    return t.read(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), message.alias("message")).join(asked_vectors(spark, d), "query_id")


def chunks(spark, d):
    """Documents as chunks with their codes, which only even ones have in their metadata, and what else is known of them."""
    c = t.coded(spark, d)
    codes = F.when(F.col("doc_id") % 2 == 0, document_codes("text")).otherwise(F.array().cast("array<string>"))
    page = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 9 + 1)
    return c.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), codes.alias("chunk_codes"), F.col("source").alias("file_name"), page.alias("page"), tags.doc_type("source").alias("doc_type"))


CTE = f"""{t.CODED}, qv AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
q AS (SELECT item_id AS query_id, item_id || '/QD-EN ' || b.text AS message FROM benchmark b JOIN qv ON query_id = b.item_id WHERE item_id % 20 = 0),
sims AS (SELECT query_id, vec_id AS chunk_id, CASE WHEN label % 2 = 0 THEN 'summary' ELSE 'question' END AS child_type, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS similarity FROM embeddings, qv),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims) WHERE rank <= {TOP_K * r.PROBE}),
qt AS (SELECT query_id, unnest({t.terms('message')}) AS term FROM q), qc AS (SELECT query_id, unnest({t.sql_codes('message')}) AS code FROM q),
blobs AS (SELECT doc_id AS chunk_id, {t.folded('text')} AS blob, CASE WHEN doc_id % 2 = 0 THEN {t.sql_codes('text')} ELSE [] END AS codes FROM coded),
points AS (SELECT query_id, chunk_id, contains(blob, term)::INTEGER::DOUBLE AS p FROM blobs, qt UNION ALL SELECT query_id, chunk_id, CASE WHEN list_contains(codes, code) THEN 12.0 WHEN contains(blob, {t.folded('code')}) THEN 6.0 ELSE 0.0 END FROM blobs, qc),
kw AS (SELECT query_id, chunk_id, sum(p)::DOUBLE AS score FROM points GROUP BY ALL HAVING sum(p) > 0),
kwk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kw) WHERE rank <= {TOP_K * r.PROBE}),
fused AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.rank AS vr, k.rank AS kr, child_type, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.2::DOUBLE / (60 + k.rank), 0) AS score,
  CASE WHEN v.rank IS NOT NULL AND k.rank IS NOT NULL THEN 'hybrid' WHEN k.rank IS NOT NULL THEN 'keyword' ELSE 'vector' END AS retrieval_mode FROM (SELECT * FROM hits SEMI JOIN q USING (query_id)) v FULL JOIN kwk k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST) AS rank FROM fused) WHERE rank <= {TOP_K}),
found AS (SELECT m.*, d.text AS content, d.source, CASE WHEN doc_id % 3 > 0 THEN doc_id % 9 + 1 END AS page, b.codes FROM merged m JOIN coded d ON d.doc_id = m.chunk_id JOIN blobs b USING (chunk_id))"""  # fmt: skip


def hits(spark, d):
    return r.vector_topk(points(spark, d), asked_vectors(spark, d), r.probe_size(TOP_K))


def merged(spark, d):
    near = r.vector_topk(points(spark, d), asked(spark, d), r.probe_size(TOP_K))
    return r.rrf_merge(r.vector_parents(near), keyword(spark, d), TOP_K)


def keyword(spark, d):
    return r.keyword_topk(chunks(spark, d), asked(spark, d), r.probe_size(TOP_K))


def found(spark, d):
    return merged(spark, d).join(chunks(spark, d), "chunk_id")


@query(f"WITH {CTE} SELECT query_id, rank, chunk_id, round(similarity, 6) AS similarity FROM hits WHERE rank <= {TOP_K}")
def vector_topk(spark, d):
    return r.vector_topk(points(spark, d), asked_vectors(spark, d), TOP_K).select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {CTE} SELECT query_id, rank, chunk_id, child_type, round(similarity, 6) AS similarity FROM hits WHERE rank <= {TOP_K}")
def vector_cells(spark, d):
    """The nearest vectors by an index of cells."""
    folder = scratch_folder(spark)
    found, _ = VectorIndex.build(points(spark, d), folder).topk(asked_vectors(spark, d), TOP_K)
    return settled(found.select("query_id", "rank", "chunk_id", "child_type", F.round("similarity", 6).alias("similarity")), folder)


@query(f"WITH {CTE} SELECT query_id, rank, chunk_id, child_type FROM hits WHERE rank <= 4")
def vector_only(spark, d):
    """Children without collapse and fusion, as when there is no table of chunks."""
    return r.vector_topk(points(spark, d), asked_vectors(spark, d), 4).select("query_id", "rank", "chunk_id", "child_type")


@query(f"WITH {CTE}, p AS (SELECT query_id, chunk_id // 3 AS chunk_id, min(rank) AS first, arg_min(child_type, rank) AS child_type FROM hits GROUP BY ALL) SELECT query_id, chunk_id, child_type, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM p")
def vector_parents(spark, d):
    """Three vectors make up one parent."""
    h = hits(spark, d).withColumn("chunk_id", F.floor(F.col("chunk_id") / 3).cast("long"))
    return r.vector_parents(h)


@query(f"WITH {CTE} SELECT query_id, chunk_id, child_type, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits WHERE chunk_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233)")
def vector_post_filter(spark, d):
    return r.vector_parents(hits(spark, d), [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233])


@query(f"WITH {CTE} SELECT query_id, chunk_id, score FROM kw")
def keyword_score(spark, d):
    return r.keyword_scores(chunks(spark, d), asked(spark, d))


@query(f"WITH {CTE} SELECT query_id, chunk_id, score, rank FROM kwk")
def keyword_topk(spark, d):
    return keyword(spark, d)


@query(f"WITH {CTE} SELECT query_id, chunk_id, score, rank FROM kwk")
def keyword_index(spark, d):
    """The best chunks by a stored index, which is written and read again."""
    folder = scratch_folder(spark)
    KeywordIndex.build(r.spread(chunks(spark, d)), folder)
    return settled(KeywordIndex(spark, folder).topk(asked(spark, d), r.probe_size(TOP_K)), folder)


@query(f"WITH {CTE} SELECT query_id, chunk_id, score FROM kw WHERE chunk_id IN (2, 4, 6, 8, 10, 100)")
def keyword_doc_filter(spark, d):
    return r.keyword_scores(chunks(spark, d).where(F.col("chunk_id").isin(2, 4, 6, 8, 10, 100)), asked(spark, d))


@query(f"WITH {CTE} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM merged")
def rrf_merge(spark, d):
    return merged(spark, d).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {CTE}, s AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((query_id, rank)) AS f FROM hits GROUP BY chunk_id) SELECT * FROM (SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, f, chunk_id) AS rank FROM s) WHERE rank <= {TOP_K}")
def rrf_multi(spark, d):
    """The queries serve as variants of one."""
    lists = r.vector_parents(hits(spark, d)).select(F.lit(0).alias("query_id"), F.col("query_id").alias("variant"), "chunk_id", "rank", "child_type")
    return r.rrf_multi(lists, TOP_K).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {CTE} SELECT query_id, chunk_id, retrieval_mode FROM merged")
def retrieval_mode(spark, d):
    return merged(spark, d).select("query_id", "chunk_id", "retrieval_mode")


@query(f"WITH {CTE} SELECT query_id, retrieval_mode, count(*) AS n FROM merged GROUP BY ALL")
def mode_counts(spark, d):
    return merged(spark, d).groupBy("query_id", "retrieval_mode").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CTE} SELECT query_id, rank, chunk_id, retrieval_mode, round(score, 6) AS score, chunk_id // 4 AS document_id, chunk_id % 4 AS chunk_index, page, 'text_chunk' AS source_kind, source AS file_name, replace(trim(content), chr(10), ' ')[1:280] AS excerpt FROM found")
def build_sources(spark, d):
    """Four chunks make up a document."""
    kind = tags.source_kind(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(".md"))
    return found(spark, d).select("query_id", "rank", "chunk_id", "retrieval_mode", F.round("score", 6).alias("score"), F.floor(F.col("chunk_id") / 4).cast("long").alias("document_id"), (F.col("chunk_id") % 4).alias("chunk_index"), "page", kind.alias("source_kind"), "file_name", r.excerpt(F.col("content")).alias("excerpt"))


_CONTEXT = """contexts AS (SELECT query_id, string_agg('[Chunk ' || rank || '] file=' || source || coalesce(' | page=' || page, '') || ' | doc_type=Tài_liệu_nội_bộ' || CASE WHEN len(codes) > 0 THEN ' | document_codes=' || array_to_string(codes[1:3], ', ') ELSE '' END
  || ' | retrieval=' || retrieval_mode || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM found GROUP BY query_id)"""


@query(f"WITH {CTE}, {_CONTEXT} SELECT query_id, context FROM contexts")
def context_block(spark, d):
    return r.context_block(found(spark, d), asked(spark, d))


@query(f"WITH {CTE}, {_CONTEXT}, h AS (SELECT conv_id AS query_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 8 GROUP BY conv_id) SELECT query_id, coalesce(history || chr(10) || chr(10), '') || context || chr(10) || chr(10) || 'Q: ' || message AS prompt FROM contexts JOIN q USING (query_id) LEFT JOIN h USING (query_id)")
def chat_prompt(spark, d):
    """The conversation of the query's number is its history."""
    history = chat_history(spark, d).withColumnRenamed("session_id", "query_id")
    return r.prompts(r.context_block(found(spark, d), asked(spark, d)), asked(spark, d), history)


@query(f"WITH {CTE} SELECT query_id, rank, chunk_id, retrieval_mode, round(score, 6) AS score FROM found")
def hybrid_search(spark, d):
    return r.search(chunks(spark, d), points(spark, d), asked(spark, d), TOP_K).select("query_id", "rank", "chunk_id", "retrieval_mode", F.round("score", 6).alias("score"))


@query(f"WITH {CTE}, dt AS (SELECT DISTINCT query_id, term FROM qt), s AS (SELECT f.query_id, f.chunk_id, f.rank, round(sum(contains({t.folded('content')}, term)::INTEGER) / count(*)::DOUBLE, 4) AS reranker_score FROM found f JOIN dt ON dt.query_id = f.query_id GROUP BY ALL) SELECT * FROM (SELECT query_id, chunk_id, reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, rank) AS rank FROM s) WHERE rank <= 4")
def rerank(spark, d):
    f = found(spark, d).join(asked(spark, d).select("query_id", "message"), "query_id")
    return r.rerank(f, 4).select("query_id", "chunk_id", "reranker_score", "rank")


@query(None)
def embed_hash(spark, d):
    return hash_embed(t.docs(spark, d), "doc_id", "text", 64)


@query("SELECT 'legacy' AS parser, 'text' AS kind, text, length(text) AS n_chars FROM documents")
def scan_text(spark, d):
    """Each text written as a file of its own and read again as a whole record, many files a task. Texts end as they are: no line is added."""
    from ..sources.folder import read_folder
    from ..sources.text_files import drop_texts, write_texts

    path = scratch_folder(spark)
    write_texts(r.spread(t.docs(spark, d).select(F.format_string("doc-%d.md", "doc_id").alias("name"), "text")), path)
    pages = checkpointed(read_folder(spark, path).select(F.lit("legacy").alias("parser"), F.lit("text").alias("kind"), "text", F.length("text").alias("n_chars")))
    drop_texts(spark, path)
    return pages
