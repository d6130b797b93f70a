"""Keyword search by its index, vector search by cells, timed steps, header sections: against plain versions."""

import datetime
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessarine.functions import text
from tessarine.operators import keyword_index, retrieval, splitting, traces, vector_index
from tessarine.operators.keyword_index import KeywordIndex

CHUNKS, QUERIES = "chunk_id long, content string, chunk_codes array<string>", "query_id int, message string"


def fold(s):
    bare = "".join(c for c in unicodedata.normalize("NFD", s or "") if unicodedata.category(c) != "Mn")
    return " ".join(bare.lower().split())


def plain_scores(chunks, queries):
    out = {}
    for q, message in queries:
        terms = [t for t in re.findall(r"[a-z0-9/-]+", fold(message)) if len(t) > 1]
        codes = list(dict.fromkeys(c.upper() for c in re.findall(text.CODE, message)))
        for i, content, held in chunks:
            blob = fold(content)
            score = sum(t in blob for t in terms) + sum(12 if c in (held or []) else 6 if fold(c) in blob else 0 for c in codes)
            if score:
                out.setdefault(q, []).append((-score, i))
    return {q: [(i, -s, k + 1) for k, (s, i) in enumerate(sorted(x))] for q, x in out.items()}


def check(spark, chunks, queries, k, folder):
    c, q = spark.createDataFrame(chunks, CHUNKS).repartition(3), spark.createDataFrame(queries, QUERIES)
    for found in (retrieval.keyword_topk(c, q, k), KeywordIndex.build(c, str(folder)).topk(q, k)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score, r.rank))
        assert got == {q: x[:k] for q, x in plain_scores(chunks, queries).items()}


def noise(r, n):
    return " ".join("".join(r.choices("abcdeđéÀ/-1 .", k=r.randrange(1, 9))) for _ in range(n))


@pytest.mark.parametrize("block", [7, 8192])
def test_keyword_index_against_plain(spark, monkeypatch, block, tmp_path):
    monkeypatch.setattr(keyword_index, "BLOCK_CHUNKS", block)
    monkeypatch.setattr(keyword_index, "ROUND_TERMS", 40 if block == 7 else 50_000)
    r = random.Random(block)
    chunks = [(i, noise(r, 30), None) for i in range(60)]
    chunks += [(100, "theo 12/QĐ-TT và", ["12/QĐ-TT"]), (101, "12/qđ-tt", []), (102, None, ["12/QĐ-TT", None]), (103, "x", ["1/A-B"]), (104, "\x0112/q", [])]
    chunks += [(200 + i, chunks[3][1], []) for i in range(30)]  # ties
    queries = [(k, noise(r, 8)) for k in range(6)] + [(10, "12/QĐ-TT bao"), (11, "a 1 ."), (12, "ab ab de"), (13, "q")]
    check(spark, chunks, queries, 9, tmp_path / "a")
    check(spark, [], queries, 3, tmp_path / "b")
    check(spark, chunks, [], 3, tmp_path / "c")


def test_keyword_index_reads_postings_only(spark, tmp_path):
    """A million chunks: the plan of a search has no nested loop and scans no texts."""
    words = F.concat(F.lit("common word"), (F.col("id") % 5003).cast("string"))
    chunks = spark.range(1_000_000).select(F.col("id").alias("chunk_id"), words.alias("content"), F.array().cast("array<string>").alias("chunk_codes"))
    KeywordIndex.build(chunks, f"{tmp_path}/index")
    found = KeywordIndex(spark, f"{tmp_path}/index").topk(spark.createDataFrame([(1, "word4999 99"), (2, "common")], QUERIES), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan and plan.count("FileScan parquet [block") == 4
    got = {q: [(r.chunk_id, r.score) for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert got == {1: [(4999 + 5003 * k, 2.0) for k in range(3)], 2: [(k, 1.0) for k in range(3)]}


def test_texts_are_folded_as_plain_ones(spark):
    r = random.Random(8)
    texts = ["".join(r.choices("aBé đ\u0301 \t\n\r\x0b\u00a0\u2003\u3000\x85\u200b\x1c/", k=r.randrange(12))) for _ in range(400)] + ["".join(r.choices("aB  \t\n", k=9)) for _ in range(100)]
    white = re.compile("[\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.normalize_spaces("t").alias("n"), text.fold("t").alias("f")).collect()
    assert {x.k: (x.n, x.f) for x in got} == {k: (white.sub(" ", t).strip(" "), white.sub(" ", bare(t).lower()).strip(" ")) for k, t in enumerate(texts)}


def test_keyword_index_deals_terms_not_words(spark, monkeypatch, tmp_path):
    """A row of a block for each term, whatever the number of words that contain it, and no list that is null: each of these walks through its whole batch on the way to Python."""
    chunks = spark.range(3000).coalesce(1).select(F.col("id").alias("chunk_id"), F.format_string("ab/prefix%d 7/A-B", "id").alias("content"), F.array(F.lit("7/A-B")).alias("chunk_codes"))
    dealt, repartition = [], type(chunks).repartition
    monkeypatch.setattr(type(chunks), "repartition", lambda df, *by: (dealt.append(df), repartition(df, *by))[1])
    found = KeywordIndex.build(chunks, f"{tmp_path}/index").topk(spark.createDataFrame([(1, "prefix 7/A-B ab")], QUERIES), 2)
    assert [(r.chunk_id, r.score) for r in found.orderBy("rank").collect()] == [(0, 15.0), (1, 15.0)]
    rows = [r for df in dealt for r in df.collect()]
    assert sorted(r["name"] for r in rows) == ["", "code 7/A-B", "word 7/a-b", "word ab", "word prefix"]
    assert all(x is not None for r in rows for x in r)


def test_vector_index_against_all_pairs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vector_index, "CELL_ROWS", 40)
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(12)]
    rows = [(i, i // 2, "a" if i % 2 else "b", [c + r.gauss(0, 0.05) for c in r.choice(centres)]) for i in range(900)]
    rows += [(1000 + i, i, "c", rows[5][3]) for i in range(30)] + [(2000, 1, "d", [0.0] * 12), (2001, 1, "d", None)]
    p = spark.createDataFrame(rows, "point_id int, chunk_id int, child_type string, vector array<double>")
    q = spark.createDataFrame([(k, rows[k * 40][3]) for k in range(20)] + [(50, [0.0] * 12), (51, [1.0] + [0.0] * 11)], "query_id int, query_vector array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for i, v in [(k, rows[k * 40][3]) for k in range(20)] + [(51, [1.0] + [0.0] * 11)]:
        near = sorted((-dot(x, v) / (dot(x, x) * dot(v, v)) ** 0.5, n, c, kind) for n, c, kind, x in rows[:-2])[:7]
        want += [(i, k + 1, n, c, kind, pytest.approx(-s, abs=1e-12)) for k, (s, n, c, kind) in enumerate(near)]
    names = ["query_id", "rank", "point_id", "chunk_id", "child_type", "similarity"]
    found, share = vector_index.VectorIndex.build(p, f"{tmp_path}/index").topk(q, 7)
    assert list(map(tuple, found.select(names).orderBy("query_id", "rank").collect())) == want and 0 < share < 0.6
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 6)
    assert list(map(tuple, retrieval.vector_topk(p, q, 7).select(names).orderBy("query_id", "rank").collect())) == want
    assert vector_index.VectorIndex.build(p.where("point_id < 0"), f"{tmp_path}/none").topk(q, 7)[0].count() == 0


def at(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def plain_spans(events):
    out, open_ = [], {}
    for trace, step, phase, ts, n in sorted(events, key=lambda e: (e[3], e[4])):
        held = open_.setdefault((trace, step), [])
        if phase == "START":
            held.append(ts)
        elif held:
            out.append((trace, step, held.pop(), ts, "done" if phase == "DONE" else "failed"))
        else:
            out.append((trace, step, None, ts, "orphan"))
    return sorted(out + [(t, s, ts, None, "open") for (t, s), held in open_.items() for ts in held], key=str)


EVENTS = "trace_id string, step string, phase string, ts timestamp, event_id long"


def made(seed, n):
    r = random.Random(seed)
    return [(f"t{r.randrange(4)}", r.choice("ab"), r.choice(["START", "START", "DONE", "FAIL"]), at(r.randrange(n)), k) for k in range(n)]


def spans_of(df):
    return sorted(((r.trace_id, r.step, r.started, r.ended, r.outcome) for r in df.collect()), key=str)


def test_steps_are_paired(spark):
    events = made(1, 300)
    table = spark.createDataFrame(events + [("t1", "a", "note", at(5), 999)], EVENTS)
    spans = traces.pair_steps(table)
    assert spans_of(spans) == plain_spans(events)
    assert all(r.elapsed_ms == (r.ended - r.started).total_seconds() * 1000 for r in spans.where("outcome in ('done', 'failed')").collect())
    totals = {(r.trace_id, r.step): (r.runs, r.failed, r.open) for r in traces.stage_totals(spans).collect()}
    want = plain_spans(events)
    assert totals == {k: (sum(x[:2] == k and x[2] is not None for x in want), sum(x[:2] == k and x[4] == "failed" for x in want), sum(x[:2] == k and x[4] == "open" for x in want)) for k in {x[:2] for x in want}}


def test_stream_of_steps_agrees_with_the_table(spark, tmp_path):
    """Events out of order over several batches; late ones are dropped, starts that stay open are given up."""
    events = made(2, 200)
    late = ("t0", "a", "DONE", at(1), 5000)
    r = random.Random(3)
    order = sorted(events, key=lambda e: (e[3] + datetime.timedelta(seconds=r.randrange(30)), e[4]))  # up to 30 s late
    batches = [order[:80], order[80:150], order[150:], [("end", "z", "START", at(9000), 9000)], [late], [("end", "z", "DONE", at(9001), 9001)]]
    for b in batches:
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        traces.pair_stream(stream, "40 seconds", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spans_of(spark.read.schema(traces.SPANS).parquet(f"{tmp_path}/out").where("trace_id != 'end'"))
    assert got == plain_spans(events)


def test_sections_by_rule():
    """Each rule of the block machine on a text of its own."""
    s = splitting.sections
    assert s("  a \x07b  \n c ") == [("a b\nc", {})]  # stripped, without what can't be printed
    assert s("a\n\nb") == [("a  \nb", {})]  # a blank line ends a block; blocks under the same headers are put together
    assert s("# A\nx\n\ny\n# A\nz") == [("# A\nx  \ny  \n# A\nz", {"h1": "A"})]
    assert s("# A\n## B\nx") == [("# A  \n## B\nx", {"h1": "A", "h2": "B"})]  # a header takes in the deeper one below it
    assert s("# A\nt\n## B\nx\n# C\ny") == [("# A\nt", {"h1": "A"}), ("## B\nx", {"h1": "A", "h2": "B"}), ("# C\ny", {"h1": "C"})]
    assert s("### C\nx\n## B\ny") == [("### C\nx", {"h3": "C"}), ("## B\ny", {"h2": "B"})]  # a higher header drops the deeper ones
    assert s("```py\n# no\n\nx\n```\n# A") == [("```py\n# no\n\nx\n```", {}), ("# A", {"h1": "A"})]
    assert s("~~~\n```\n# no\n~~~\nend") == [("~~~\n```\n# no\n~~~\nend", {})] and s("```a``` b\n# A\nx") == [("```a``` b", {}), ("# A\nx", {"h1": "A"})]
    assert s("#no\n#\nx\n####### seven") == [("#no  \n#\nx\n####### seven", {"h1": ""})]
    assert s("") == s(" \n\n ") == []


def test_places_of_sections():
    found = lambda t: [(at, c) for at, c, _ in splitting.placed_sections(t)]
    assert found("a\n# T\nx\n# T\nx") == [(0, "a"), (1, "# T\nx  \n# T\nx")]  # put together, so not found: where the last one ended
    assert found("p\n# A\nx\n# B\nx") == [(0, "p"), (2, "# A\nx"), (8, "# B\nx")]
    assert found(" a\n\n b\n# T\nx")[0][0] == 0  # changed: not found, so where the last one ended
    assert found(" a\n\n b\n# T\nx")[1] == (7, "# T\nx")


def test_a_document_of_many_pages(spark):
    """100,000 pages: places are found by halving, and as before."""
    n = 100_000
    pages = "".join(f"p{k} " for k in range(n))
    starts, at_ = [], 0
    for k in range(n):
        starts.append(at_)
        at_ += len(f"p{k} ")
    spans = [(a, a + len(f"p{k}"), k) for k, a in enumerate(starts)]
    df = spark.createDataFrame([(1, pages.strip(), spans), (2, "no pages", []), (3, None, None)], "id int, text string, spans array<struct<start: long, end: long, page: int>>")
    got = splitting.split_documents(df, "id").orderBy("id", "chunk_index").collect()
    mine = [r for r in got if r.id == 1]
    assert len(mine) > 1000 and all(r.content.split()[0] == f"p{r.page}" for r in mine) and [(r.page, r.content) for r in got if r.id == 2] == [(None, "no pages")]


def test_thoughts_and_answers_of_models(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    split = lambda s: tuple(one(text.split_thought(F.lit(s))))
    assert split("<think> a\nb </think>\n c [Chunk 1]") == ("a\nb", "c [Chunk 1]")
    assert split("x <think> never ends") == ("never ends", "") and split("plain ") == ("", "plain ") and split("</think> x") == ("", "</think> x")
    assert one(text.json_answer(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'
    assert one(text.json_answer(F.lit('Here:\n```\n{"a": 1}\n``` done'))) == '{"a": 1}' and one(text.json_answer(F.lit("none"))) == "none"
