"""The queries of the operators over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, katz, near_dup_text, near_dup_vectors, quality, ranked_search, sharding, substring_dedup, suffix_dedup, token_count, url_filter, whitening
from .common import read, shared_folder


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_vectors.link_vectors(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT a AS vec_id, b AS reached FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(reached) FROM r WHERE r.vec_id = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id <= coalesce((SELECT min(reached) FROM r WHERE r.vec_id = v.vec_id), v.vec_id) AS kept FROM v"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_text.near_duplicates(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.c + nb.c - shared)),
r AS (SELECT a AS doc_id, a AS reached FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, coalesce((SELECT min(reached) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""


SHARDS = 16


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are written to the shared folder in shards; the digests are those of the texts that are read there."""
    docs = read(spark, sf_dir, "documents")
    placed = sharding.write_shards(docs, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}", SHARDS)
    size, crc32 = sharding.size_of(F.col("text")), sharding.crc32_of(F.col("text"))
    return placed.select("doc_id", size.alias("size"), crc32.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT k, id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT k, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS c FROM s WHERE k = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.c) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(n.c)::DOUBLE AS containment
FROM s d JOIN s i ON d.k = 'd' AND i.k = 'i' AND d.g = i.g JOIN n ON n.id = i.id GROUP BY d.id, i.id HAVING 4 * count(*) >= 3 * any_value(n.c)"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False, with_text=False, digests=True)


#: The list of the query, since the tables hold none: entries of hosts, of domains and of paths, by rule from the pages' own addresses.
_ENTRIES = """
WITH p AS (SELECT DISTINCT h, regexp_extract(h, '[^.]+[.][^.]+$', 0) AS d, concat(h, '/', split_part(concat(a, '/'), '/', 2)) AS q FROM addresses)
SELECT DISTINCT 'hosts' AS list, h AS pattern, 10 + (length(h) * 7) % 60 AS n, true AS listed FROM p WHERE md5(h) < '8'
UNION ALL SELECT DISTINCT 'hosts', h, 100 + (length(h) * 7) % 60, false FROM p WHERE md5(h) < '4'
UNION ALL SELECT DISTINCT 'hosts', h, 210 + (length(h) * 7) % 60, true FROM p WHERE md5(h) < '2'
UNION ALL SELECT DISTINCT 'domains', d, 150, true FROM p WHERE md5(d) < 'a'
UNION ALL SELECT DISTINCT 'domains', d, 300, false FROM p WHERE md5(d) < 'a'
UNION ALL SELECT DISTINCT 'paths', q, length(q) % 90, true FROM p WHERE md5(q) < '5'
UNION ALL SELECT DISTINCT 'paths', q, 180 + length(q) % 90, false FROM p WHERE md5(q) < '3'"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time: page_id days after 1 January 2024, modulo a year, serve as one."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    addresses = pages.select(url_filter.address(F.col("url")).alias("a")).select("a", F.substring_index("a", "/", 1).alias("h"))
    rules = spark.sql(_ENTRIES.replace("FROM addresses", "FROM {addresses}"), addresses=addresses)
    entries = rules.select("list", "pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n").cast("int")).alias("dated"), "listed")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    hit = url_filter.filter_urls(captures, entries)
    return hit.select("page_id", "blocked", "n_entries", "rule", F.array_join("lists", ",").alias("lists"))


OP7_SQL = (
    r"""WITH bare AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '[?#].*$', '') AS b FROM pages),
parts AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part(b, '/', 1)), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', ''), '^www[.]', '') AS h,
  regexp_replace(regexp_replace(b, '^[^/]*', ''), '/+$', '') AS path FROM bare),
addresses AS (SELECT h || path AS a, h FROM parts),
rules AS ("""
    + _ENTRIES
    + r"""),
settled AS (SELECT list, pattern, DATE '2024-01-01' + n::INTEGER AS dated, min(listed) AS listed FROM rules GROUP BY ALL),
iv AS (SELECT * FROM (SELECT list, pattern, listed, dated AS f, lead(dated) OVER (PARTITION BY list, pattern ORDER BY dated) AS t FROM settled) WHERE listed),
labels_of AS (SELECT page_id, h, path, string_split(h, '.') AS l, string_split(h || path, '/') AS s, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched FROM parts),
keys AS (SELECT DISTINCT page_id, fetched, k FROM (
  SELECT page_id, fetched, unnest(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(list_slice(l, i, len(l)), '.'))) AS k FROM labels_of
  UNION ALL SELECT page_id, fetched, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(list_slice(s, 1, i), '/'))) FROM labels_of) WHERE k <> '')
SELECT p.page_id, count(i.pattern) > 0 AS blocked, count(i.pattern) AS n_entries, arg_min(i.pattern, (-length(i.pattern), i.pattern)) AS rule,
  coalesce(string_agg(DISTINCT i.list, ',' ORDER BY i.list), '') AS lists
FROM parts p LEFT JOIN keys k ON p.page_id = k.page_id LEFT JOIN iv i ON k.k = i.pattern AND k.fetched >= i.f AND (i.t IS NULL OR k.fetched < i.t) GROUP BY p.page_id"""
)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM t) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM e ANTI JOIN x USING (doc_id, j) GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scored = katz.score(read(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def learnable(id_col: str = "doc_id"):
    """Rows from which quality is learnt: crc32 of the id's text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), learnable())
    return quality.scored(docs.select("doc_id", "text"), model).select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM s),
p AS (SELECT doc_id, term, count(*) AS tf FROM d SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, a GROUP BY term),
i AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_words)))) AS impact FROM p JOIN w USING (term) JOIN s USING (doc_id), a),
f AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(times * impact) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f) WHERE rank <= 10"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cut_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_embedding_dedup, op3_ngram_jaccard, op4_sharding, op5_decontamination, op6_bpe, op7_url_filter, op8_substring_dedup, op9_lm_scoring, op10_quality, op11_whitening, op12_ranked_search, op13_suffix_dedup)}
ORACLE = {"op2_embedding_dedup": OP2_SQL, "op3_ngram_jaccard": OP3_SQL, "op5_decontamination": OP5_SQL, "op7_url_filter": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op12_ranked_search": OP12_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


