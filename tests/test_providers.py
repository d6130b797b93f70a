"""Models that fail now and then, answer for rows that weren't asked, or aren't there."""

import json

import pytest
from pyspark.sql import functions as F

from tessarine.operators import providers


def test_batches_by_bytes():
    of = lambda *sizes: [list(r) for r in providers.batches_of(sizes, 3, 1000, 10)]
    assert of() == [] and of(5) == [[0]] and of(5, 5, 5, 5) == [[0, 1, 2], [3]]
    assert of(400, 500, 400, 5000, 1) == [[0, 1], [2], [3], [4]]


def test_answers_of_a_model_that_fails_now_and_then():
    calls = []

    def model(rows):
        calls.append(len(rows))
        if any(r["t"] == "bad" for r in rows):
            raise RuntimeError("down")
        return [(99, "nobody"), (-1, "nobody"), *((k, r["t"].upper()) for k, r in reversed(list(enumerate(rows))) if r["t"] != "none")]

    rows = [{"t": t} for t in ["a", "b", "none", "bad", "c", "é" * 700, "d"]]
    assert providers.answers(model, rows, 2, 1200) == ["A", "B", None, None, "C", "É" * 700, "D"] and calls == [2, 2, 1, 1, 1]
    assert providers.answers(None, rows) == [None] * 7


def faked():
    """A provider whose model answers by what texts say; made here so that workers get it by value."""

    def fake():
        def model(rows):
            if any("fail" in r["content"] for r in rows):
                raise RuntimeError("down")
            for k, r in enumerate(rows):
                if "broken" in r["content"]:
                    yield k, "{broken"
                elif "entities only" in r["content"]:
                    yield k, json.dumps({"summary": "", "questions": [], "entities": ["Only"]})
                else:
                    yield k, json.dumps({"summary": f"about {r['content']} in {r['h2']}", "questions": ["Why?", "why?", "What"], "entities": ["Ann", "ann ", *(f"E{i}" for i in range(20))]})

        return model

    return fake


def test_enrichment(spark):
    fake = faked()
    texts = ["one", "broken", "entities only", "fail", None]
    rows = [(i, t, "A" if i < 3 else None, None, ["k"], ["Bob", "Ann"]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, content string, h2 string, h3 string, keywords array<string>, entities array<string>").coalesce(1)
    alone = {r.id: r for i in range(5) for r in providers.enrich(df.where(F.col("id") == i).withColumn("content", F.coalesce("content", F.lit("x"))), fake).collect()}
    assert alone[0].summary == "about one in A" and alone[0].asked[:2] == ["Why?", "What?"] and len(alone[0].asked) == 3
    assert alone[0].entities == ["Ann", *(f"E{i}" for i in range(7)), "Bob"] and alone[0].keywords[:2] == ["k", "Ann"] and len(alone[0].keywords) == 9
    assert [alone[i].summary for i in (1, 2, 3)] == [None] * 3 and alone[2].entities == ["Only", "Bob", "Ann"] and alone[3].entities == ["Bob", "Ann"]
    assert [r.summary for r in providers.enrich(df, lambda: None).collect()] == [None] * 5
    together = {r.id: r.summary for r in providers.enrich(df, fake).collect()}  # one batch, which fails as a whole
    assert together == dict.fromkeys(range(5))


def test_vectors_and_reranking(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(150)], "id int, text string")
    length = lambda: lambda rows: [(k, [float(len(r["text"])), 1.0]) for k, r in enumerate(rows)]
    assert {tuple(r.vector) for r in providers.embed(df, "text", length).collect()} == {(2.0, 1.0), (3.0, 1.0), (4.0, 1.0)}
    for broken in (lambda: None, lambda: lambda rows: [(0, [1.0])]):
        with pytest.raises(Exception, match="no vector"):
            providers.embed(df, "text", broken).collect()
    results = spark.createDataFrame([(q, k, f"c{(k * 7) % 5}{'!' if q == 2 and k == 3 else ''}", "ask") for q in (1, 2) for k in range(1, 6)], "query_id int, rank int, content string, message string")

    def scores():
        return lambda rows: [(k, float(r["content"][1])) for k, r in enumerate(rows) if "!" not in r["content"]]

    got = {q: [(r.in_rank, r.reranker_score) for r in providers.rerank(results, 3, scores).orderBy("query_id", "rank").collect() if r.query_id == q] for q in (1, 2)}
    assert got == {1: [(2, 4.0), (4, 3.0), (1, 2.0)], 2: [(1, None), (2, None), (3, None)]}
