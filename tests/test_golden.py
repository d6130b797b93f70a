"""Hand-computed rows, invariants, and the queries against SQL on the smallest tables."""

import math
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessarine.functions import tags, text
from tessarine.operators import indexing, retrieval, splitting

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalars(spark):
    assert one(spark, text.fold(F.lit("Đội  HÀ é"))) == "đoi ha e"
    assert one(spark, text.lookup_terms(F.lit("đội a-1 b"))) == ["oi", "a-1"]
    assert one(spark, text.document_codes(F.lit("123/QD-TT bao cao 123/qd-tt"))) == ["123/QD-TT"]
    assert one(spark, text.dedupe(F.array(F.lit("Straße"), F.lit(" STRASSE "), F.lit(""), F.lit("b")), 5)) == ["Straße", "b"]
    assert one(spark, text.preview(F.lit("x" * 130))) == "x" * 117 + "..."
    assert one(spark, text.normalize_spaces(F.lit(None).cast("string"))) == ""
    assert one(spark, text.json_object(F.lit('x {"a": 1} y'))) == '{"a": 1}'
    assert one(spark, tags.security_level(F.lit("format.txt"))) == "Mật"
    assert one(spark, tags.chunk_name(F.lit(7), F.lit(12))) == "doc_07_chunk_0012"
    want = str(uuid.uuid5(uuid.NAMESPACE_URL, "c|parent:5|type:summary|index:2"))
    assert one(spark, tags.point_id("c", F.lit(5), F.lit("summary"), F.lit(2))) == want


def test_keyword_score(spark):
    q = spark.createDataFrame([(1, "123/QD-TT bao cao")], "query_id int, message string")
    c = spark.createDataFrame([(9, "123/QD-TT Báo cáo", ["123/QD-TT"]), (8, "none", [])], "chunk_id int, content string, chunk_codes array<string>")
    assert [tuple(r) for r in retrieval.keyword_scores(c, q).collect()] == [(1, 9, 15.0)]


def test_chunks_have_their_codes(spark, tmp_path):
    from tessarine.plans import retrieval_queries

    spark.createDataFrame([(2, "see 123/QD-TT", "en", "web"), (3, "see 123/QD-TT", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    q = spark.createDataFrame([(1, "123/QD-TT")], "query_id int, message string")
    assert [r.score for r in retrieval.keyword_scores(retrieval_queries.chunks(spark, str(tmp_path)), q).orderBy("chunk_id").collect()] == [13.0, 7.0]


def test_queries_in_rounds(spark, monkeypatch):
    """More queries than a block holds are broadcast block by block, with the answers of one block."""
    p = spark.createDataFrame([(i, i, "a", [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "point_id int, chunk_id int, child_type string, vector array<double>")
    c = spark.createDataFrame([(i, "word%d text" % (i % 9), []) for i in range(60)], "chunk_id int, content string, chunk_codes array<string>")
    q = spark.createDataFrame([(i, "word%d" % i, [1.0, float(i), 2.0]) for i in range(10)], "query_id int, message string, query_vector array<double>")
    ask = lambda: (retrieval.vector_topk(p, q, 5), retrieval.keyword_topk(c, q, 5))
    want = [sorted(map(tuple, df.collect())) for df in ask()]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    for df, rows in zip(ask(), want, strict=True):
        assert len(rows) and sorted(map(tuple, df.collect())) == rows
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_rrf(spark):
    v = spark.createDataFrame([(1, 10, 1, "a"), (1, 20, 2, "b")], "query_id int, chunk_id int, rank int, child_type string")
    k = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id int, chunk_id int, rank int")
    got = [(r.chunk_id, round(r.score, 6), r.retrieval_mode) for r in retrieval.rrf_merge(v, k, 5).orderBy("rank").collect()]
    assert got == [(20, 0.035801, "hybrid"), (30, 0.019355, "keyword"), (10, 0.016393, "vector")]


def test_splitters():
    t = "para one. " * 80 + "\n\n" + "x" * 1200
    chunks = splitting.split_text(t)
    assert all(len(c) <= 500 for c in chunks) and all(c in t for c in chunks)
    parts = splitting.sections("a\n# T\nx\n```\n# no\n```\n## U\ny\n# V")
    assert [h for _, h in parts] == [{}, {"h1": "T"}, {"h1": "T", "h2": "U"}, {"h1": "V"}]


def test_upsert_twice_changes_nothing(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    first = indexing.upsert(old, new, ["k"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, indexing.upsert(first, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_ingest(spark, tmp_path):
    from tessarine.streaming.ingest import ingest

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        rows.write.mode("append").parquet(f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_split_text_golden():
    """Cut at the coarsest separator that occurs, which stays with what follows it; pieces overlap by whole parts."""
    assert splitting.split_text("aa bb cc dd", 5, 2) == ["aa bb", "cc", "dd"]
    assert splitting.split_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert splitting.split_text("one\n\ntwo words\n\n" + "x" * 12, 9, 0) == ["one", "two", "words", "x" * 8, "x" * 4]
    assert splitting.split_text("", 5, 1) == splitting.split_text(" \n ", 5, 1) == []
    assert splitting.split_text("a. b. c", 4, 0) == ["a. b", ". c"]


def test_sections_golden():
    text = "intro\n# A #\nx\n### C\n#no\n~~~\n## hidden\n~~~\n##\nend"
    assert splitting.sections(text) == [("intro", {}), ("# A #\nx", {"h1": "A #"}), ("### C\n#no\n~~~\n## hidden\n~~~", {"h1": "A #", "h3": "C"}), ("##\nend", {"h1": "A #", "h2": ""})]


def test_split_tables(spark):
    d = spark.createDataFrame([(1, "# T\none two three"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.section, r.start_index, r.h1, r.content) for r in splitting.header_split(d, "id", "text").collect()] == [(1, 0, 0, "T", "# T\none two three")]
    assert [(r.id, r.chunk_index, r.start_index, r.content) for r in splitting.recursive_split(d, "id", "text", 9, 0).collect()] == [(1, 0, 0, "# T"), (1, 1, 4, "one two"), (1, 2, 12, "three")]


def test_split_documents(spark):
    pages = spark.createDataFrame([(1, 0, "# A\nfirst page ends."), (1, 1, "Second page\n## B\nmore")], "id int, page int, text string")
    merged = splitting.merge_pages(pages, "id", "page", "text")
    got = [(r.chunk_index, r.start_index, r.page, r.h1, r.h2, r.content) for r in splitting.split_documents(merged, "id").orderBy("chunk_index").collect()]
    assert got == [(0, 0, 0, "A", None, "# A\nfirst page ends.  \nSecond page"), (1, 34, 1, "A", "B", "## B\nmore")]


def test_files_by_suffix(spark):
    d = spark.createDataFrame([(1, "a.PDF", "x\n\n{4}---\n\npage"), (2, "b.md", "text"), (3, "c.txt", "  ")], "id int, name string, text string")
    assert sorted(map(tuple, splitting.markdown_of(d, "id", "name", "text").collect())) == [(1, 4, "page"), (2, 1, "text")]
    with pytest.raises(Exception, match="unsupported file type: d.exe"):
        splitting.markdown_of(spark.createDataFrame([(1, "d.exe", "x")], "id int, name string, text string"), "id", "name", "text").collect()


def test_greedy_batches(spark):
    sizes = [100, 5000, 600, 10, 10, 10, 10, 10, 10, 10, 10, 10]
    rows = [(1, k, "x" * n) for k, n in enumerate(sizes)] + [(2, 0, "x" * 9000)]
    want, batch, n, chars = [], -1, 0, 0
    for k, size in enumerate(sizes):
        if batch < 0 or n >= 8 or chars + size + 400 > 6000:
            batch, n, chars = batch + 1, 0, 0
            want.append([1, batch, k, k, 0])
        n, chars = n + 1, chars + size + 400
        want[-1][3:] = [k, n]
    got = splitting.greedy_batches(spark.createDataFrame(rows, "id int, k int, text string"), "id", "k", "text").orderBy("id", "batch").collect()
    assert [list(r) for r in got] == [*want, [2, 0, 0, 0, 1]]


def test_hash_embed(spark):
    from tessarine.operators.embedding import hash_embed

    got = {r.id: r.vector for r in hash_embed(spark.createDataFrame([(1, "Báo cáo bao"), (2, "cao BAO bao"), (3, None), (4, "x")], "id int, text string"), "id", "text", 16).collect()}
    assert got[1] == got[2] and got[3] == got[4] == [0.0] * 16
    assert sorted(abs(v) for v in got[1] if v) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_settings():
    from tessarine.settings import Settings, from_environment

    env = {"TESSARINE_TOP_K": "7", "TESSARINE_HYBRID": "off", "TESSARINE_KEYWORD_WEIGHT": "x", "TESSARINE_COLLECTION": " other ", "TOP_K": "1"}
    assert from_environment(env) == Settings(top_k=7, hybrid=False, collection="other")
    assert from_environment({"TESSARINE_HYBRID": "maybe"}).hybrid and from_environment({}) == Settings()


def test_logs_and_files(spark, tmp_path):
    from tessarine.sources.text_files import read_legacy_log, read_log, read_parsed, read_texts

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{broken\n\n{"k": 2, "z": 3}\n')
    (tmp_path / "b.json").write_text('[{"k": 3}, {"k": 4}]')
    (tmp_path / "c.json").write_text('{"entries": [{"k": 5}]}')
    assert sorted(r.k for r in read_log(spark, f"{tmp_path}/a.jsonl", "k long").collect()) == [1, 2]
    assert sorted(r.k for r in read_legacy_log(spark, f"{tmp_path}", "k long").collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "d.pdf").write_bytes(b"one|two")
    assert sorted((r.page, r.text) for r in read_parsed(spark, f"{tmp_path}/*.pdf", lambda b: b.decode().split("|")).collect()) == [(1, "one"), (2, "two")]
    (tmp_path / "e.md").write_text("x\n")
    assert [r.text for r in read_texts(spark, str(tmp_path)).collect()] == ["x\n"]


def test_windowed_counts(spark):
    from tessarine.streaming.ingest import windowed_counts

    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:59", "a"), ("2024-01-01 00:10:00", "a")], "ts string, event_type string")
    assert sorted((r.window.start.minute, r.n) for r in windowed_counts(rows).collect()) == [(0, 2), (10, 1)]


def test_store(spark, tmp_path):
    """Rows are replaced by key and run twice the same; parts that lose all rows go; other rows stay."""
    from tessarine.sources import store

    path, schema = f"{tmp_path}/t", "doc int, k int, v string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    store.delete_rows(spark, path, make((1, 1, "")), ["doc"])
    assert store.read_table(spark, path, schema).count() == 0
    store.replace_rows(make(*[(d, k, "a") for d in range(20) for k in range(2)]), path, ["doc"])
    for _ in range(2):
        store.replace_rows(make((3, 9, "b")), path, ["doc"])
    store.delete_rows(spark, path, make(*[(d, 0, "") for d in range(4, 20)]), ["doc"])
    assert sorted(map(tuple, store.read_table(spark, path, schema).collect())) == [(d, k, "a") for d in range(3) for k in range(2)] + [(3, 9, "b")]
    added = store.land_uploads(spark.createDataFrame([("x.md", b"1", " "), ("x.md", b"1", "T")], "name string, content binary, title string"), f"{tmp_path}/up").collect()
    assert sorted(r.title for r in added) == ["T", "x.md"] and {r.status for r in added} == {"uploaded"}


def test_indexing_job(spark, tmp_path):
    """A second run does nothing; a changed document replaces its own rows only; one that is deleted leaves nothing."""
    from tessarine.operators import indexing_job as job

    root, files = f"{tmp_path}/root", [(1, "quy trình.md", "# Mục\nBộ Quốc Phòng 12/QD-AB nam 2020. " + "word " * 200), (2, "b.txt", "short"), (3, "c.md", " ")]
    make = lambda rows: spark.createDataFrame(rows, "document_id long, file_name string, text string")
    read = lambda name: sorted(map(str, job.table(spark, root, name).collect()))
    states = {r.document_id: r for r in job.run(spark, make(files), root).collect()}
    assert [states[i].status for i in (1, 2, 3)] == ["embedded", "embedded", "parsed"] and states[1].parents > 1 and states[1].children == 4 * states[1].parents
    first = next(r for r in job.table(spark, root, "chunks").collect() if r.document_id == 1 and "12/QD" in r.content)
    assert first.h2 == "Mục" and first.codes == ["12/QD-AB"] and first.doc_type == "Quy_trình" and first.dates == ["2020"]
    before = {n: read(n) for n in job.TABLES}
    job.run(spark, make(files), root)
    assert {n: read(n) for n in job.TABLES} == before
    job.run(spark, make([files[0], (2, "b.txt", "changed text"), files[2]]), root)
    assert [r for r in read("chunks") if "document_id=1" in r] == [r for r in before["chunks"] if "document_id=1" in r]
    assert [r.content for r in job.table(spark, root, "chunks").collect() if r.document_id == 2] == ["changed text"]
    job.delete_documents(spark, make(files[:1]), root)
    assert {r.document_id for n in ("points", "chunks", "states", "cache", "parsed") for r in job.table(spark, root, n).collect()} == {2, 3}


def _plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", ["hybrid_search", "context_block", "page_stats", "store_chunks", "search_payload", "chunk_metadata", "child_parent_join", "doc_list", "chat_history", "pending_docs", "merge_pages", "rerank", "point_ids"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    r = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(_plain(x[names.index(k)]) for k in sorted(df.columns)) for x in r.fetchall()), key=str)
    assert sorted((tuple(_plain(x[k]) for k in sorted(df.columns)) for x in df.collect()), key=str) == want
