"""Operator 13 against brute force on odd rows, its merge of runs, and its anchors."""

import hashlib
import random
from collections import Counter
from os.path import commonprefix

import numpy as np
import pytest

from tessarine.llm import suffix_dedup
from tessarine.llm.queries import op13_suffix_dedup

SCHEMA = "doc_id long, text string, key long, begin long, hash long, id string"


def plain(rows, length):
    """(id, n_bytes, n_removed, n_spans, kept) of each row, every window of every text looked at."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + length] for i, r in raws if i is not None for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 2, dtype=bool)
        for k in range(len(r) - length + 1 if i is not None else 0):
            if seen[r[k : k + length]] > 1:
                gone[k + 1 : k + length + 1] = True
        edges = int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(r), int(gone.sum()), edges, bytes(b for b, g in zip(r, gone[1:]) if not g)))
    return sorted(out, key=str)


def answer(spark, rows, length):
    table = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], SCHEMA).repartition(3)
    got = suffix_dedup.cut_repeats(table, length=length).collect()
    for r in got:
        assert len(r.begins) == len(r.ends) == r.n_spans and sum(r.ends) - sum(r.begins) == r.n_removed
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str)


def noise(r, n, letters="abcdeé日"):
    return "".join(r.choices(letters, k=n))


def table(r, length):
    base = [noise(r, 6 * length) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            b = r.choice(base)
            a = r.randrange(len(b) - length)
            parts.append(b[a : a + r.choice([length // 2, length - 8, length, length + 3, 3 * length])] if r.random() < 0.7 else noise(r, r.randrange(2 * length)))
        rows.append((i, "".join(parts)))
    rows += [(100 + k, base[0][: 3 * length + k % 3] + noise(r, 30) + base[0][3 * length :]) for k in range(40)]  # near copies
    rows += [(200 + k, base[1]) for k in range(40)]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    if hot:  # small runs, and prefixes that take up several ranges
        monkeypatch.setattr(suffix_dedup, "RUN_ROWS", 20)
        monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", 7)
        monkeypatch.setattr(suffix_dedup, "_splitters", lambda known, marks, n, prefix: sorted(bytes(p) for p in suffix_of(known, marks, prefix) for _ in range(3)))
        spark.conf.set("spark.sql.shuffle.partitions", "28")
    try:
        rows = table(random.Random(5), 40)
        assert answer(spark, rows, 40) == plain(rows, 40)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def suffix_of(known, marks, prefix):
    """The first bytes of nine suffixes that many documents share."""
    from pyspark.sql import functions as F

    place = F.shiftright("at", 24).cast("int") + 1
    p = known.join(marks.select("key", F.explode("ats").alias("at")), "key").select(F.substring(F.encode("text", "utf-8"), place, F.lit(prefix)).alias("p"))
    return [r.p for r in p.groupBy("p").count().orderBy(F.col("count").desc(), "p").limit(9).collect()]


def test_odd_rows(spark):
    r = random.Random(8)
    long_one, other = noise(r, 20_000), noise(r, 900)
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, "ab" * 150), (5, long_one), (6, long_one[7000:9000]), (None, other), (7, other), (8, other[:399]), (9, other[:401] + "x"), (9, "y" + other[500:]), (10, noise(r, 900)), (11, "é" * 450)]
    rows += [(12, long_one[100:600]), (12, long_one[100:600])]
    assert answer(spark, rows, 400) == plain(rows, 400)
    assert answer(spark, [], 400) == [] and answer(spark, [(1, other)], 400) == plain([(1, other)], 400)


def test_equal_rows_of_one_id_are_copies(spark):
    t = noise(random.Random(9), 500)
    assert [(x[2], x[3]) for x in answer(spark, [(1, t), (1, t)], 400)] == [(len(t.encode()), 1)] * 2


@pytest.mark.parametrize("runs", [1, 2, 3, 7])
def test_merge_gives_shared_lengths(runs):
    r = random.Random(runs)
    strings = [bytes(r.choices(b"ab", k=r.randrange(12))) for _ in range(200)]
    split = [sorted(strings[k::runs]) for k in range(runs)]
    coded = [suffix_dedup.front_coded([(s, 1, [(k, k)]) for k, s in enumerate(run)]) for run in split]
    assert [[s for s, _, _ in suffix_dedup.decoded(c)] for c in coded] == split
    out = list(suffix_dedup.merge([suffix_dedup.decoded(c) for c in coded]))
    assert [s for s, _, _ in out] == sorted(strings)
    assert [h for _, h, _ in out[1:]] == [len(commonprefix([a[0], b[0]])) for a, b in zip(out, out[1:])]


def test_merge_looks_at_known_prefixes_once(monkeypatch):
    """Of strings that share a long prefix, each byte of it is compared in a few strings only."""
    looked = []
    plain_compare = suffix_dedup.compare

    def counted(x, y, known):
        shared, first = plain_compare(x, y, known)
        looked.append(shared - known + 1)
        return shared, first

    strings = sorted(b"p" * 500 + str(k).encode() for k in range(10_000, 10_800))
    coded = [suffix_dedup.front_coded([(s, 1, [(0, 0)]) for s in strings[k::8]]) for k in range(8)]
    monkeypatch.setattr(suffix_dedup, "compare", counted)
    assert len(list(suffix_dedup.merge([suffix_dedup.decoded(c) for c in coded]))) == 800
    assert sum(looked) < 20 * 500  # a merge that starts anew each time would look at over a million


def test_anchors_cover_windows_alike(monkeypatch):
    r = random.Random(3)
    t = noise(r, 3000).encode()
    grams, at = suffix_dedup.anchors(t, 40)
    count = (at & 0xFFF) + 1
    assert count.sum() == len(t) - 39
    monkeypatch.setattr(suffix_dedup, "PIECE", 101)
    again = suffix_dedup.anchors(t, 40)
    assert (again[0] == grams).all() and (again[1] == at).all()
    first = (at >> 24) - (at >> 12 & 0xFFF)
    assert (first == np.concatenate([[0], np.cumsum(count)[:-1]])).all()
    inner = suffix_dedup.anchors(t[500:900], 40)[1]
    assert set((inner >> 24) + 500) <= set(at >> 24)


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = sorted((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in plain(rows, 400))
    assert sorted(map(tuple, op13_suffix_dedup(spark, d).collect())) == want
