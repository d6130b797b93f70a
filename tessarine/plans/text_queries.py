"""Queries of text functions, extraction, tags and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload, tags, text
from . import tables as t
from .registry import query

JOIN = lambda c: F.array_join(c, "|")


@query(f"SELECT doc_id, {t.norm('text')} AS value FROM documents")
def normalize_spaces(spark, d):
    return t.docs(spark, d).select("doc_id", text.normalize_spaces("text").alias("value"))


@query(f"SELECT doc_id, {t.folded('text')} AS value FROM documents")
def fold_text(spark, d):
    return t.docs(spark, d).select("doc_id", text.fold("text").alias("value"))


@query(f"SELECT doc_id, array_to_string({t.terms('text')}, '|') AS terms FROM documents")
def lookup_terms(spark, d):
    return t.docs(spark, d).select("doc_id", JOIN(text.lookup_terms("text")).alias("terms"))


@query(f"SELECT doc_id, CASE WHEN length({t.norm('text')}) > 120 THEN {t.norm('text')}[1:117] || '...' ELSE {t.norm('text')} END AS preview FROM documents")
def preview_text(spark, d):
    return t.docs(spark, d).select("doc_id", text.preview("text").alias("preview"))


@query(f"SELECT doc_id, array_to_string(list_slice({t.sql_words('text')}, 1, 40), ' ') AS summary FROM documents")
def summary(spark, d):
    return t.docs(spark, d).select("doc_id", text.first_words("text", 40).alias("summary"))


@query(f"SELECT doc_id, array_to_string({t.dedupe("string_split(text, ' ')", 20)}, '|') AS items FROM documents")
def dedupe_list(spark, d):
    return t.docs(spark, d).select("doc_id", JOIN(text.dedupe(F.split("text", " "), 20)).alias("items"))


@query(f"SELECT doc_id, array_to_string({t.dedupe("list_concat(string_split(lower(source), ' '), string_split(text, ' '))", 8)}, '|') AS items FROM documents")
def merge_lists(spark, d):
    return t.docs(spark, d).select("doc_id", JOIN(text.dedupe(F.concat(F.split(F.lower("source"), " "), F.split("text", " ")), 8)).alias("items"))


@query("SELECT event_id, props AS body FROM events")
def json_extract(spark, d):
    e = t.read(spark, d, "events")
    return e.select("event_id", text.json_object(F.concat(F.lit("Answer: ```json "), F.col("props"), F.lit(" ``` end"))).alias("body"))


@query(r"SELECT doc_id, array_to_string(list_distinct_kept, '|') AS ids FROM (SELECT doc_id, (list_transform([list_concat(list_concat(regexp_extract_all(text, '(?i)\d{1,3}/[A-ZĐÂĂÊÔƠƯÀÁẢÃẠ][A-ZĐÂĂÊÔƠƯÀÁẢÃẠ\-]+'), regexp_extract_all(text, '\d{1,2}/\d{1,2}/\d{4}')), regexp_extract_all(text, '\b\d{4}\b'))], lambda l: list_filter(l, lambda x, i: list_position(l, x) = i)))[1] AS list_distinct_kept FROM coded)".replace("FROM coded)", "FROM (SELECT doc_id, (doc_id % 1000) || '/QD-' || upper(lang) || ' ' || text AS text FROM documents))"))
def protected_ids(spark, d):
    return t.coded(spark, d).select("doc_id", JOIN(text.protected_identifiers("text")).alias("ids"))


@query(f"SELECT session_id, id, CASE WHEN n < 4 THEN 'too_short' WHEN n >= 8 THEN 'already_specific' ELSE 'rewrite_window' END AS gate FROM (SELECT conv_id AS session_id, turn AS id, len({t.terms('text')}) AS n FROM conversations)")
def rewrite_gate(spark, d):
    m = t.messages(spark, d)
    return m.select("session_id", "id", text.rewrite_gate("content").alias("gate"))


@query(f"SELECT conv_id AS session_id, array_to_string((list_transform([list_filter({t.dedupe('list(text ORDER BY turn, text)', 4)}, lambda v: {t.key('v')} <> {t.key(t.norm('min_by(text, turn)'))})], lambda l: list_slice(l, 1, 3)))[1], '|') AS variants FROM conversations GROUP BY conv_id")
def variant_dedupe(spark, d):
    """Variants of a question (here the turns of a conversation): distinct ones, without the question itself, three at most."""
    g = t.messages(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("m"), F.min_by("content", "id").alias("q"))
    kept = F.filter(text.dedupe(F.transform("m", lambda x: x["content"]), 4), lambda v: text.casefold(v) != text.casefold(text.normalize_spaces("q")))
    return g.select("session_id", JOIN(F.slice(kept, 1, 3)).alias("variants"))


for _name, _spark, _sql in (
    ("extract_codes", text.document_codes, t.sql_codes), ("extract_dates", text.dates, t.sql_dates), ("extract_entities", text.entities, t.sql_entities),
    ("extract_orgs", text.organisations, t.sql_orgs), ("extract_keywords", text.keywords, t.sql_keywords)):
    query(f"WITH {t.CODED} SELECT doc_id, array_to_string({_sql('text')}, '|') AS items FROM coded", _name)(lambda spark, d, f=_spark: t.coded(spark, d).select("doc_id", JOIN(f("text")).alias("items")))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN trim(h1) ELSE 'Sub ' || page_id END AS h2, CASE WHEN page_id % 2 = 0 THEN 'Part ' || page_id END AS h3 FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages) WHERE h1 <> ''")
def context(spark, d):
    p = t.read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1")).where("h1 != ''")
    headers = F.struct(F.col("h1"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Sub "), F.col("page_id").cast("string"))).alias("h2"), F.lit(None).cast("string").alias("h3"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" Part  "), F.col("page_id").cast("string"))).alias("h4"))
    p = p.withColumn("headers", headers)
    return p.select("page_id", tags.context_h2("headers").alias("h2"), tags.context_h3("headers").alias("h3"))


_FILE = "CASE doc_id % 6 WHEN 0 THEN 'Lịch sử quy trình.pdf' WHEN 1 THEN 'quy trình.md' WHEN 2 THEN 'HƯỚNG DẪN.txt' WHEN 3 THEN 'format.txt' WHEN 4 THEN 'public quy định.md' ELSE source END"


def _files(spark, d):
    return t.docs(spark, d).withColumn("file", F.expr(_FILE))


@query(f"SELECT doc_id, CASE WHEN contains(lower(f), 'lịch sử') THEN 'Quy_trình_Lịch_sử' WHEN contains(lower(f), 'quy trình') THEN 'Quy_trình' WHEN contains(lower(f), 'hướng dẫn') THEN 'Hướng_dẫn' WHEN contains(lower(f), 'quy định') THEN 'Quy_định' ELSE 'Tài_liệu_nội_bộ' END AS doc_type FROM (SELECT doc_id, {_FILE} AS f FROM documents)")
def doc_type(spark, d):
    return _files(spark, d).select("doc_id", tags.doc_type("file").alias("doc_type"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Công_khai' WHEN contains(lower(f), 'mat') THEN 'Mật' WHEN contains(lower(f), 'public') THEN 'Công_khai' ELSE 'Nội_bộ' END AS level FROM (SELECT doc_id, {_FILE} AS f FROM documents)")
def security_level(spark, d):
    return _files(spark, d).select("doc_id", tags.security_level("file", F.when(F.col("doc_id") % 5 == 0, F.lit(" Công  khai"))).alias("level"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Kỹ_thuật' WHEN 1 THEN 'Nhân_sự' WHEN 2 THEN 'Own dept' ELSE 'Tổng_hợp' END AS department FROM documents")
def department(spark, d):
    k = F.col("doc_id") % 4
    h2 = F.when(k == 0, F.lit("Phòng KỸ THUẬT")).when(k == 1, F.lit("Ban")).otherwise(F.lit("Other"))
    h3 = F.when(k == 1, F.lit("nhan su"))
    return t.docs(spark, d).select("doc_id", tags.department(h2, h3, F.when(k == 2, F.lit("Own  dept"))).alias("department"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf_marker_page' WHEN 1 THEN 'pdf_page' WHEN 2 THEN 'text_chunk' ELSE 'html' END AS kind FROM documents")
def source_kind(spark, d):
    k = F.col("doc_id") % 4
    return t.docs(spark, d).select("doc_id", tags.source_kind(F.when(k == 0, F.lit("Marker")), F.when(k == 0, F.lit("PDF")).when(k == 3, F.lit("html")), F.when(k == 1, F.lit(".pdf")).otherwise(F.lit(".md"))).alias("kind"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 10 END AS page FROM documents")
def page_resolve(spark, d):
    k = F.col("doc_id") % 5
    at = lambda i, v: F.when(k == i, F.lit(v))
    return t.docs(spark, d).select("doc_id", tags.resolve_page(F.coalesce(at(0, 7), F.lit(0)), at(1, 3), at(2, 0), at(3, 9)).alias("page"))


@query(f"WITH {t.LINES} SELECT doc_id, chunk_index, printf('doc_%02d_chunk_%04d', doc_id, chunk_index) AS chunk_id FROM lines")
def chunk_ids(spark, d):
    return t.lines(spark, d).select("doc_id", "chunk_index", tags.chunk_name("doc_id", "chunk_index").alias("chunk_id"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(spark, d):
    return t.docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("""SELECT doc_id, sha256('{"chunk_text":' || to_json(text) || ',"source_page":' || (doc_id % 9) || ',"source_kind":"text_chunk","raw_metadata":"' || source || '"}') AS print FROM documents""")
def fingerprint(spark, d):
    return t.docs(spark, d).select("doc_id", tags.fingerprint(F.col("text"), F.col("doc_id") % 9, F.lit("text_chunk"), F.col("source")).alias("print"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunks|parent:' || doc_id || '|type:summary|index:' || (doc_id % 7))) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8','9','a','b'])[(CAST('0x' || h[17:17] AS INTEGER) % 4) + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def point_ids(spark, d):
    return t.docs(spark, d).select("doc_id", tags.point_id("chunks", F.col("doc_id"), F.lit("summary"), F.col("doc_id") % 7).alias("point_id"))


def enriched(spark, d):
    """Metadata of each chunk, all of it in one projection."""
    c = t.coded(spark, d)
    return c.withColumn("kinds", text.phrase_kinds("text")).select(
        "doc_id", "text", text.document_codes("text").alias("codes"), F.col("kinds.organisations").alias("orgs"), F.col("kinds.entities").alias("ents"),
        text.dates("text").alias("days"), text.first_words("text", 40).alias("summary"))


_META = f"meta AS (SELECT doc_id, text, {t.sql_codes('text')} AS codes, {t.sql_orgs('text')} AS orgs, {t.sql_entities('text')} AS ents, {t.sql_dates('text')} AS days, array_to_string(list_slice({t.sql_words('text')}, 1, 40), ' ') AS summary FROM coded)"
_ASKED = f"""asked AS (SELECT doc_id, text, summary, {t.dedupe("list_filter([CASE WHEN len(codes) > 0 THEN 'Văn bản ' || codes[1] || ' nói về nội dung gì?' END, CASE WHEN doc_id % 2 = 0 THEN 'Nội dung trong mục Phần ' || doc_id || ' là gì?' END, CASE WHEN len(orgs) > 0 THEN orgs[1] || ' có vai trò gì trong đoạn này?' END, CASE WHEN len(ents) > 0 THEN ents[1] || ' được nhắc đến trong bối cảnh nào?' END, CASE WHEN len(days) > 0 THEN 'Sự kiện nào xảy ra vào mốc ' || days[1] || '?' END, 'Đoạn này trả lời câu hỏi trong hoàn cảnh nào?'], lambda q: q IS NOT NULL)", 5)} AS kept FROM meta),
hyq AS (SELECT doc_id, text, summary, list_concat(kept, list_transform(range(len(kept) + 1, 6), lambda k: 'Thông tin chính của đoạn này là gì? (' || k || ')?')) AS questions FROM asked)"""


@query(f"WITH {t.CODED}, {_META} SELECT doc_id, array_to_string(codes[1:15], '|') AS codes, array_to_string(orgs[1:15], '|') AS orgs, array_to_string(ents[1:15], '|') AS ents, array_to_string(days[1:15], '|') AS days, summary FROM meta")
def chunk_metadata(spark, d):
    e = enriched(spark, d)
    return e.select("doc_id", *[JOIN(F.slice(c, 1, 15)).alias(c) for c in ("codes", "orgs", "ents", "days")], "summary")


def asked(spark, d):
    e = enriched(spark, d)
    h2 = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Phần "), F.col("doc_id").cast("string")))
    return e.withColumn("questions", tags.hyq_questions(F.col("codes"), h2, F.lit(None).cast("string"), F.col("orgs"), F.col("ents"), F.col("days"), 5))


@query(f"WITH {t.CODED}, {_META}, {_ASKED} SELECT doc_id, array_to_string(questions, '|') AS questions FROM hyq")
def hyq_questions(spark, d):
    return asked(spark, d).select("doc_id", JOIN("questions").alias("questions"))


@query(f"""WITH {t.CODED}, {_META}, {_ASKED}, c AS (SELECT doc_id, list_concat([{{'k': 'summary', 'x': 'Tóm tắt: ' || summary}}], list_transform({t.dedupe('questions', 12)}, lambda q: {{'k': 'question', 'x': q}})) AS c FROM hyq)
SELECT doc_id, i AS child_index, c[i + 1].k AS child_type, c[i + 1].x AS child_text FROM (SELECT doc_id, c, unnest(range(0, len(c))) AS i FROM c)""")
def child_expand(spark, d):
    c = asked(spark, d).select("doc_id", F.posexplode(tags.children(F.col("summary"), F.col("questions"), F.col("text"))).alias("child_index", "c"))
    return c.select("doc_id", "child_index", "c.child_type", "c.child_text")


@query(f"WITH {t.CODED}, {_META} SELECT doc_id, {t.norm("concat_ws(' ', 'doc.md', 'Tài_liệu_nội_bộ', array_to_string(codes, ' '), array_to_string(orgs, ' '), text)")} AS blob FROM meta")
def keyword_blob(spark, d):
    return enriched(spark, d).select("doc_id", tags.keyword_blob(F.lit("doc.md"), F.lit("Tài_liệu_nội_bộ"), F.array_join("codes", " "), F.array_join("orgs", " "), F.col("text")).alias("blob"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value::BIGINT END AS whole, CASE WHEN event_id % 3 < 2 THEN value::DOUBLE END AS real FROM (SELECT event_id, event_id * 7 AS value FROM events)")
def safe_casts(spark, d):
    e = t.read(spark, d, "events").select("event_id", (F.col("event_id") * 7).cast("string").alias("v"))
    e = e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "v")).when(F.col("event_id") % 3 == 1, F.concat("v", F.lit(".0"))).otherwise(F.lit("none")).alias("v"))
    return e.select("event_id", payload.safe_int("v").alias("whole"), payload.safe_float("v").alias("real"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0 WHEN turn % 3 = 1 THEN 2 ELSE 0 END AS n, CASE WHEN turn % 3 = 1 THEN conv_id::VARCHAR END AS first_id FROM conversations")
def sources_parse(spark, d):
    """Lists of sources: broken, with objects among other items, and an object that is no list."""
    c = t.read(spark, d, "conversations")
    raw = F.when(F.col("turn") % 3 == 0, F.lit("[{broken")).when(F.col("turn") % 3 == 1, F.format_string('[{"chunk_id": %d}, 3, "x", {"chunk_id": null}]', "conv_id")).otherwise(F.lit('{"a": 1}'))
    got = payload.parse_sources(raw)
    return c.select("conv_id", "turn", F.size(got).alias("n"), F.get_json_object(F.get(got, 0), "$.chunk_id").alias("first_id"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'other' ELSE '' END AS keys FROM documents")
def compact_metadata(spark, d):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.lit('{"context": {"h2": "A"}, "hyq": null, "x": 1}')).when(k == 1, F.lit('{"other": 1}')).otherwise(F.lit("broken"))
    return t.docs(spark, d).select("doc_id", F.array_join(F.array_sort(F.map_keys(payload.compact_metadata(raw))), ",").alias("keys"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'About ' || doc_id || '|Why?|What?|Thông tin chính của đoạn này là gì? (3)?' END AS hyq FROM documents")
def hyq_validate(spark, d):
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('{"summary": " About  '), i, F.lit('", "questions": ["Why?", "why?", "What", " "]}'))).when(k == 1, F.lit('{"summary": "", "questions": ["a"]}')).otherwise(F.lit('{"summary": "x", "questions": "a"}'))
    h = payload.hyq_payload(raw)
    return t.docs(spark, d).select("doc_id", F.when(h.isNotNull(), F.concat_ws("|", h["summary"], JOIN(h["questions"]))).alias("hyq"))


@query("SELECT doc_id, (doc_id % 1000) || '/QD-AB|Bộ X' || CASE WHEN doc_id % 2 = 0 THEN '|Lan' ELSE '' END AS keywords, (doc_id % 1000) || '/QD-AB|9/QD-B' AS codes FROM documents")
def search_payload(spark, d):
    """Two payloads merged: one with a code inside a text and no keywords, one with another code."""
    i = (F.col("doc_id") % 1000).cast("string")
    one = F.concat(F.lit('{"entities": ['), F.when(F.col("doc_id") % 2 == 0, F.lit('"Lan", " lan"')).otherwise(""), F.lit('], "organizations": ["Bộ X"], "document_codes": ["see '), i, F.lit('/qd-ab now"]}'))
    two = F.lit('{"keywords": ["bộ x"], "document_codes": ["9/QD-B", "none"]}')
    both = payload.merge_payloads(payload.search_payload(one), payload.search_payload(two))
    return t.docs(spark, d).select("doc_id", JOIN(both["keywords"]).alias("keywords"), JOIN(both["document_codes"]).alias("codes"))


@query("SELECT doc_id, regexp_replace(source || '/' || lang || ' ' || doc_id, '[^A-Za-z0-9._-]+', '_', 'g') AS stem FROM documents")
def log_stem(spark, d):
    return t.docs(spark, d).select("doc_id", text.log_stem(F.concat("source", F.lit("/"), "lang", F.lit(" "), F.col("doc_id").cast("string"))).alias("stem"))
