"""Operator 12 against scores computed row by row, on odd rows, and its tables by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessarine.llm import ranked_search
from tessarine.llm.queries import op12_ranked_search

DOCS, ITEMS = "doc_id long, text string, term string, n int, block long, rank int", "item_id long, text string, doc_id long"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m, score = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_words, 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return out


def rows_of(docs):
    return [(i, t, "x", 1, 2, 3) for i, t in docs]


def answer(spark, docs, items):
    got = ranked_search.ranked(spark.createDataFrame(rows_of(docs), DOCS).repartition(3), spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r))


def text(r, n, common=30):
    return " ".join(f"w{int(r.paretovariate(0.7)) % 400 if r.random() < 0.7 else r.randrange(common)}" for _ in range(n))


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_ranked_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search.build_index, "__defaults__", ("doc_id", "text", block))
    r = random.Random(block)
    docs = [(i, text(r, r.choice([1, 5, 40, 200]))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(200)]  # many ties, over all blocks
    items = [(k, text(r, 12)) for k in range(15)] + [(50, docs[7][1]), (51, "w1 w1 w1 w2"), (52, "unknown")]
    assert answer(spark, docs, items) == sorted(plain(docs, items))


def test_ranked_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE_WORDS", 1000)
    docs = [(1, None), (2, ""), (3, " .,!-_ "), (None, "alpha beta"), (4, "Alpha BETA été-Été ×1"), (4, "alpha"), (5, "alpha " * 30 + "日本語"), (6, "beta " * 50_000 + "gamma"), (7, "été É"), (-3, "alpha")]
    items = [(None, "ALPHA"), (1, None), (2, "..."), (3, "beta beta gamma été É"), (3, "日本語"), (4, "日本")]
    want = sorted(plain(docs, items), key=lambda r: (r[0] is None, r))
    assert answer(spark, docs, items) == want and len(want) > 5
    assert answer(spark, [], items) == [] and answer(spark, docs, []) == []


def test_rounds_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ROUND_TERMS", 5)
    r = random.Random(2)
    docs, items = [(i, text(r, 30)) for i in range(80)], [(k, text(r, 6)) for k in range(12)]
    assert answer(spark, docs, items) == sorted(plain(docs, items))


def test_intervals_leave_most_documents():
    """A rare term makes its documents best; few others are scored."""
    r = np.random.default_rng(1)
    n = 20_000
    sizes = r.integers(20, 400, n)
    common = [(f"c{k}", np.sort(r.choice(n, n // 3, replace=False)), np.ones(n // 3, dtype=np.int64)) for k in range(3)]
    rare = ("rare", np.sort(r.choice(n, 15, replace=False)), np.full(15, 3))
    lists = ranked_search.Lists(np.arange(n), sizes, [*common, rare], n, int(sizes.sum()))
    best = ranked_search.Best(10)
    scored = ranked_search.search_block(lists, [("c0", 900), ("c1", 900), ("c2", 900), ("rare", 7000)], best)
    assert scored < n / 10
    whole = np.zeros(n, dtype=np.int64)
    for t, d, _ in [*common, rare]:
        k = lists.number[t]
        whole[d] += lists.impact[lists.starts[k] : lists.starts[k + 1]] * (7000 if t == "rare" else 900)
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == whole[order].tolist()


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.001"
    read = lambda t, i: [(r[i], r.text) for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]
    assert sorted(map(tuple, op12_ranked_search(spark, d).collect())) == sorted(plain(read("documents", "doc_id"), read("benchmark", "item_id")))
