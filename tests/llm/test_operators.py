"""Operators of the training-data pipeline against plain versions, on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarine.llm import bpe, decontaminate, katz, near_dup_text, near_dup_vectors, quality, sharding, substring_dedup, token_count, url_filter
from tessarine.llm.queries import tokenizer_path

from . import plain

BPE, SP = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, id string, block int, `_row` int, shard int, rows string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdeé", k=3)) for _ in range(n))


BASE = words(60, 1)
TEXTS = [None, "", "one", "Two words", BASE, BASE, BASE + " tail", words(30, 2) + "\n" + BASE[:160], "a " * 50, words(4000, 3), "<|endoftext|>  x ▁ \t", " lead", "trail ", "日本 ﬁ é"]
ROWS = [(i, t, "en", "x", 1, 2, 3, "y") for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None, None, None, None), (4, BASE, "en", "x", 1, 2, 3, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_bytes) for r in token_count.token_counts(docs, SP).collect())
    assert got == sorted((i is None, i or 0, len(m.encode(t or "")), len((t or "").encode())) for i, t, *_ in ROWS)
    assert token_count.token_counts(empty, SP).count() == 0


def test_token_counts_of_long_segments(spark, monkeypatch):
    """Texts of three-byte letters and without spaces: batches go by bytes, and segments are cut where no piece reaches across."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=SP)
    r = random.Random(6)
    kinds = ["日本語テキスト漢字かなカナ。、", "abcdeéßñ", "aあ1,.-_/x漢", "ﬁ゛か①ｶﾞ日e\u0301", "▁a日 b", "😀a€日\u200b", "0123456789"]
    texts = ["".join(r.choices(k, k=n)) for k in kinds for n in (399, 400, 401, 5000, 20_000)] + ["日" * 9000, "a" * 9000, "zx日" * 4000 + " tail " + "日b" * 3000]
    sizes = []
    monkeypatch.setattr(token_count, "LONG_CHARS", 400)
    plain_batch = token_count.count_batch
    for t in texts:
        assert plain_batch([t], SP, {}) == [len(m.encode(t))], t[:40]
    assert sum(len(token_count.cut_long(t, SP)[0]) > 5 for t in texts) > 8
    monkeypatch.setattr(token_count, "count_batch", lambda some, path, known: sizes.append(sum(len(t.encode()) for t in some)) or [0] * len(some))
    work = [t for t in ["日" * 100_000] * 30]
    import pyarrow as pa

    class Frame:  # the Arrow function by itself
        schema = {"doc_id": type("f", (), {"dataType": type("t", (), {"simpleString": lambda self: "long"})()})()}

        def select(self, *a):
            return self

        def mapInArrow(self, f, schema):
            list(f(iter([pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(work)], ["id", "text"])])))
            return self

    token_count.token_counts(Frame(), SP)
    assert sum(sizes) == 9_000_000 and max(sizes) < token_count.BATCH_BYTES + 300_000 and len(sizes) >= 4


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    for r in bpe.bpe_encode(docs, BPE, digests=True).collect():
        ids = t.encode(dict((i, x) for i, x, *_ in ROWS)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.bpe_encode(empty, BPE).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(docs.where("doc_id is not null"), BPE), BPE).collect()
    assert all(r.text == (TEXTS[r.doc_id] or "") for r in back)


def test_sharding(docs, empty):
    many = docs.unionByName(docs.where("doc_id = 4"))
    rows = sharding.shard(many, 3, bucket_rows=2).collect()
    assert len(rows) == len(ROWS) + 2
    names = [c for c in rows[0].__fields__ if c.endswith("shard") and "grown" not in c or c == "slot" or "grown" in c]
    assert "grown_shard" in names
    shard = next(c for c in rows[0].__fields__ if c == "_shard")
    for s in {r[shard] for r in rows}:
        assert sorted(r.slot for r in rows if r[shard] == s) == list(range(sum(r[shard] == s for r in rows)))
    assert all(r.grown_shard in (r[shard], 3) for r in rows)
    assert sharding.shard(empty, 3).count() == 0


def test_write_shards(docs, empty, tmp_path):
    """Whole rows are written, bucket after bucket, and long texts make more buckets."""
    many = docs.unionByName(docs.where("doc_id = 4"))
    got = sharding.write_shards(many, f"{tmp_path}/a", 3, bucket_bytes=2000)
    rows = got.collect()
    key = lambda r: tuple(str(r[c]) for c in docs.columns)
    assert sorted(map(key, rows)) == sorted(map(key, many.collect()))
    buckets = {}
    for r in rows:
        buckets.setdefault((r._shard, r.bucket), []).append(r.slot)
    for s in {s for s, _ in buckets}:
        assert [x for k in sorted(buckets) if k[0] == s for x in sorted(buckets[k])] == list(range(sum(r._shard == s for r in rows)))
    long = next(r._shard for r in rows if r.doc_id == 9)
    assert len(list(tmp_path.glob(f"a/_shard={long}/bucket=*"))) > 1  # by rows alone there would be one
    for d in tmp_path.glob("a/*/*"):
        assert len(list(d.glob("*.parquet"))) == 1
    assert sharding.write_shards(empty, f"{tmp_path}/b", 3).count() == 0


def test_op4_writes_whole_documents(spark, tmp_path):
    from tessarine.llm.queries import op4_sharding

    docs = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op4_sharding(spark, str(tmp_path))
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out.collect()) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    folders = {f.rsplit("/", 3)[0] for f in out.inputFiles()}
    assert len(folders) == 1 and "/documents.parquet" not in folders.pop()
    assert {r.text for r in spark.read.parquet(*out.inputFiles()).collect()} == set(TEXTS)


def test_near_duplicates(docs, empty, spark):
    got = {r.doc_id: r for r in near_dup_text.near_duplicates(docs).collect()}
    assert got[4].component_id == got[5].component_id == got[6].component_id == 4 and got[0].n_shingles == 0
    assert got[2].n_shingles == 1 and got[9].component_id == 9 and got[None].component_id is None
    assert near_dup_text.near_duplicates(empty).count() == 0


def test_near_duplicates_brute_force(spark):
    r, rows = random.Random(5), []
    base = [words(40, k).split() for k in range(5)]
    for i in range(120):
        w = list(base[i % 5])
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "zz%d" % r.randrange(3)
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(36)} for _, t in rows]
    comp = list(range(120))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    got = near_dup_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in range(120)}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[100:150] = x[:50] + 0.05 * rng.standard_normal((50, 16))
    x[200:220] = x[0]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [], 0), (304, [None] * 16, 0)]
    got = {r.vec_id: r for r in near_dup_vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert len(got) == 305 and sum(got[i].n_links for i in range(300)) >= 0.98 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(300)) and all(got[i].n_links == 0 and got[i].kept for i in range(300, 305))
    assert got[210].component_id == got[0].component_id == 0
    assert near_dup_vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_that_share_an_id(spark):
    """Rows are vectors of their own whatever their ids; other columns may have any name."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (5, [-1.0, 0.0]), (None, [1.0, 0.0]), (4, [-1.0, 0.05]), (7, [0.1, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, id int, rep int, v string, copies int")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_dup_vectors.link_vectors(table).collect())
    assert got == [(False, 1, 1, 1, True), (False, 1, 2, 1, True), (False, 2, 2, 1, False), (False, 2, 2, 1, False), (False, 4, 1, 4, True), (False, 5, 1, 4, False), (False, 7, 1, 1, False), (True, 0, 0, None, True)]


def test_vectors_at_the_threshold(spark):
    """Pairs by bands of cosine: those near 0.95 are found as well as closer ones."""
    rng = np.random.default_rng(7)
    bands, each, dim = (0.9505, 0.955, 0.965, 0.975), 1500, 48
    rows, n = [], 0
    for c in bands:
        x, y = rng.standard_normal((2, each, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = c * x + (1 - c * c) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
        for pair in zip(x, y, strict=True):
            rows += [(n + k, v.tolist()) for k, v in enumerate(pair)]
            n += 2
    got = {r.vec_id: r.component_id for r in near_dup_vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for k, c in enumerate(bands):
        found = sum(got[i + 1] == got[i] for i in range(2 * each * k, 2 * each * (k + 1), 2))
        assert found >= 0.99 * each, (c, found)


def test_decontamination(docs, empty, spark):
    items = spark.createDataFrame([(1, words(4000, 3)[400:600], "q"), (2, None, "q"), (3, words(20, 99), "q"), (4, "two WORDS", "q"), (1, words(4000, 3)[400:600], "q")], "item_id long, text string, lang string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_contained(docs, items).collect())
    assert got == [(3, 4), (9, 1), (9, 1)]
    assert decontaminate.find_contained(empty, items).count() == decontaminate.find_contained(docs, items.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs.where("doc_id is not null"), items).select("doc_id").distinct().collect()) == [i for i in range(len(TEXTS)) if i not in (3, 9)]


def test_url_filter(spark):
    d = lambda s: F.to_date(F.lit(s))
    cap = spark.createDataFrame([(1, "https://www.A.b.com:80/x/y?q#f", "2024-01-05"), (2, "http://b.com", "2024-01-05"), (3, None, "2024-01-05"), (4, "b.com/x", None), (5, "", "2024-01-05"), (1, "https://www.A.b.com:80/x/y?q#f", "2024-01-05")], "page_id long, url string, at string").withColumn("fetched", F.to_date("at"))
    ent = spark.createDataFrame([("l", "b.com", "2024-01-01", True), ("l", "b.com", "2024-01-05", False), ("m", "a.b.com/x", "2024-01-05", True), ("m", None, "2024-01-01", True), ("n", "b.com", "2024-01-05", True), ("n", "b.com", "2024-01-05", False)], "list string, pattern string, at string, listed boolean").withColumn("dated", F.to_date("at")).drop("at")
    got = sorted((r.page_id, r.blocked, r.rule) for r in url_filter.filter_urls(cap, ent).collect())
    assert got == [(1, True, "a.b.com/x"), (1, True, "a.b.com/x"), (2, False, None), (3, False, None), (4, False, None), (5, False, None)]
    assert url_filter.filter_urls(cap.limit(0), ent).count() == 0 and url_filter.filter_urls(cap, ent.limit(0)).where("blocked").count() == 0


def test_substring_dedup(docs, empty):
    got = [(r.doc_id, r.n_words, r.kept) for r in substring_dedup.repeats(docs).collect()]
    seen, want = {}, {}
    rows = sorted({i: t for i, t, *_ in ROWS if i is not None}.items())
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone |= set(range(k, k + 20))
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    assert {i: k for i, _, k in got if i is not None} == want and len(got) == len(ROWS)
    assert substring_dedup.repeats(empty).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_against_plain(spark, order):
    """Every column and score of a model kept as it is, also where texts go over blocks and tables are in many parts."""
    r = random.Random(3)
    text = lambda n: " ".join(r.choices(["w%d" % i for i in range(60)], weights=[1 / (i + 1) for i in range(60)], k=n))
    rows = [(i, text(r.randrange(60)).upper() if i % 5 == 0 else text(r.randrange(60))) for i in range(120)]
    rows += [(150, None), (151, ""), (152, text(900)), (153, "only here " * 3), (154, "always next " * 20), (155, rows[3][1]), (156, "é\u0085x \u00a0")]
    want = dict(zip([i for i, _ in rows], plain.katz([t for _, t in rows], [i % 4 != 1 for i, _ in rows], order, katz.discounts), strict=True))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, block long, tokens string").coalesce(2)
    for sizes in ({}, {"block_tokens": 700, "part_keys": 4000}) if order == 3 else ({"block_tokens": 1500, "part_keys": 9000},):
        got = {x.doc_id: tuple(x)[1:] for x in katz.score(docs, F.col("doc_id") % 4 != 1, order=order, **sizes).collect()}
        assert got.keys() == want.keys()
        for i, g in got.items():
            assert g == pytest.approx(want[i], rel=1e-12), (i, sizes)


def test_katz_odd_rows(spark, empty):
    rows = [(1, "a b"), (1, "a b"), (None, "x y"), (50, None), (51, ""), (52, "a b " * 40_000)]
    got = [tuple(r) for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string"), F.coalesce(F.col("doc_id"), F.lit(0)) < 51, block_tokens=30_000).collect()]
    assert len(got) == 6 and {r[3] for r in got} == {3 + 3 + 3 + 1} and [r[1:3] for r in got if r[0] == 52] == [(80_001, 80_001)]
    assert len({r for r in got if r[0] == 1}) == 1 and {r[1] for r in got if r[0] in (50, 51)} == {1}
    assert katz.score(empty.select("doc_id", "text"), F.lit(True)).count() == 0
    (alone,) = katz.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).collect()
    assert tuple(alone) == (1, 3, 0, 0, 0.0, 0.0)


def test_quality(spark, empty):
    rows = [(i, words(80, i) if i % 2 else " ".join("SPAM!! %s%%%%" % w for w in words(80, i).split())) for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = quality.train(docs, labels, usable)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and np.mean([(got[i] >= 0.5) == i % 2 for i in held]) > 0.97
    assert quality.train(empty, labels.limit(0), usable) is None and quality.scored(empty, None).count() == 0


def test_quality_border_and_odd_rows(spark):
    """Fifteen texts of a label are too few, sixteen do, whole texts are read, and repeated ids and clashing names change nothing between runs."""
    text = lambda i, good: words(60, i) if good else " ".join("SPAM!! %s%%%%" % w for w in words(60, i).split())
    rows = [(i, text(i, i % 2), "x", 0.0, "y") for i in range(120)]
    docs = spark.createDataFrame([*rows, (0, "other text", "x", 1.0, "z"), (None, "n", None, None, None), (500, words(200_000, 1), "", 0.0, "")], "doc_id long, text string, _text string, score double, _id string")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(120)] + [(1, 1, 9), (None, 1, 9), (7, 5, 9)], "doc_id long, quality int, _label int")
    few = quality.train(docs, labels, F.col("doc_id") < 40)
    model, again = quality.train(docs, labels, F.col("doc_id") < 100), quality.train(docs.orderBy("text"), labels, F.col("doc_id") < 100)
    assert few is None and (model.good, model.bad, model.weights.tolist()) == (again.good, again.bad, again.weights.tolist())
    kept = quality.keep_good(docs.drop("score"), model)
    assert kept.columns == [c for c in docs.columns if c != "score"]
    assert {r.doc_id for r in kept.collect()} & set(range(120)) >= {i for i in range(101, 120, 2)} and kept.where("doc_id = 500").count() == 1
    # a bad end decides too: texts aren't cut
    assert quality.features("a " * 3000 + text(3, False) * 40, model.good, model.bad)[0] < quality.features("a " * 3000, model.good, model.bad)[0]


def test_quality_on_held_out_rows(spark):
    """The normalised difference alone ranks good over bad, and the score nearly always."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = quality.train(docs, labels, usable)
    held = docs.join(labels, "doc_id").where(~usable).select("quality", "text").toPandas()
    y = held["quality"].to_numpy()
    auc = lambda s: np.mean([(s[y == 1] > x).mean() + (s[y == 1] == x).mean() / 2 for x in s[y == 0]])
    score, alone = model.scores(held["text"].tolist()), model.features(held["text"].tolist())[:, 0]
    print("AUC", auc(score), "of the difference alone", auc(alone), "good kept", (score[y == 1] >= 0.5).mean(), "bad rejected", (score[y == 0] < 0.5).mean())
    assert auc(alone) > 0.98 and auc(score) > 0.99 and (score[y == 1] >= 0.5).mean() > 0.98 and (score[y == 0] < 0.5).mean() > 0.95


@pytest.mark.parametrize("batch", [3, 10_000])
def test_substring_dedup_brute_force(spark, batch):
    """Shared passages with equal and with different surroundings, copies, repeats inside a text, in many and in few batches."""
    r, rows = random.Random(11), []
    passages = [words(n, 50 + n).split() for n in (19, 20, 25, 60)]
    for i in range(90):
        w = words(r.randrange(30), 1000 + i).split()
        for _ in range(r.randrange(3)):
            w += passages[r.randrange(4)] + words(r.randrange(4), 2000 + i).split()
        rows.append((i, "\n".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, " ".join(passages[3] * 3)), (103, None), (104, " ".join(passages[2]).upper())]
    r.shuffle(rows)
    seen, want = {}, {}
    for i, t in sorted(rows):
        w = plain.words_of(t)
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone |= set(range(k, k + 20))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    substring_dedup.SETTLED_ROWS, before = batch * 50, substring_dedup.SETTLED_ROWS
    try:
        got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        substring_dedup.SETTLED_ROWS = before
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in got} == want


def test_decontamination_brute_force(spark, monkeypatch):
    """Items of many sizes, whole, in part and scattered, in short and very long texts, against every pair; items shuffled or sent to all tasks."""
    r = random.Random(4)
    items = [(i, words(r.choice([3, 5, 8, 20, 60, 300]), 500 + i).upper() if i % 3 == 0 else words(r.choice([5, 9, 30, 120]), 500 + i)) for i in range(60)] + [(60, None), (61, ""), (5, "again " * 9)]
    rows = [(i, words(r.randrange(5, 200), 9000 + i)) for i in range(40)]
    for i in range(100, 220):
        w = r.choice(items[:60])[1].split()
        part = w[: max(1, int(len(w) * r.choice([1, 1, 0.9, 0.8, 0.7, 0.5])))]
        rows.append((i, " ".join(words(r.randrange(60), i).split() + part + words(r.randrange(400), i + 1).split())))
    rows += [(300, words(60_000, 7) + " " + items[7][1] + " " + words(60_000, 8)), (301, items[8][1]), (301, items[8][1]), (None, items[9][1]), (302, None), (303, "")]
    sets = lambda t: {tuple(w[k : k + 5]) for w in [plain.words_of(t, lower=True)] if w for k in range(max(1, len(w) - 4))}
    of_items = [(i, sets(t)) for i, t in items]
    want = sorted(((d is None, d or 0, i, len(s), len(s & h)) for d, t in rows for h in [sets(t)] for i, s in of_items if s and len(s & h) >= 0.75 * len(s)))
    made = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, item int, keys string"), spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc long")
    for size in (decontaminate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
        got = decontaminate.find_contained(*made).collect()
        assert sorted((x.doc_id is None, x.doc_id or 0, x.item_id, x.n_item_shingles, x.n_shared) for x in got) == want and len(want) > 60


def test_near_duplicates_with_repeated_ids_and_long_lists(spark, monkeypatch):
    """An id with two texts links their groups; lists that are dealt into parts lose no link."""
    r = random.Random(8)
    a, b, c = words(60, 1).split(), words(60, 2).split(), words(60, 3).split()
    near = lambda w: " ".join([*w[: (k := r.randrange(60))], "zz%d" % r.randrange(9), *w[k + 1 :]])
    rows = [(10 + i, near(a)) for i in range(60)] + [(100 + i, near(b)) for i in range(60)] + [(200 + i, " ".join(c)) for i in range(60)]
    rows += [(300, " ".join(a)), (300, " ".join(b)), (7, " ".join(c)), (301, "alone"), (302, "alone")]
    for size in (near_dup_text.LIST_ROWS, 7):
        monkeypatch.setattr(near_dup_text, "LIST_ROWS", size)
        got = {x.doc_id: x.component_id for x in near_dup_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {got[i] for i, _ in rows if i in range(10, 160) or i == 300} == {10}, size
        assert {got[i] for i, _ in rows if i in range(200, 260) or i == 7} == {7} and got[301] == got[302] == 301
