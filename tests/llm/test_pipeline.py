"""The pipeline against its stages done one row at a time, and on odd tables."""

import random

import pytest

import corpus_pipeline
from tessarine.llm import bpe, common, quality
from tessarine.llm.queries import learnable, tokenizer_path

from . import plain


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdeé", k=4)) for _ in range(n))


def shingles(text):
    w = plain.words_of(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def by_hand(rows, items, reject):
    """(id, text) of what is left after four stages."""
    rows = [(i, t) for i, t in rows if not reject(t)]
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    rows, seen, cut = [(i, t) for i, t in rows if top(i) == i], {}, []
    for i, t in sorted(rows):
        w, gone = plain.words_of(t), set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone |= set(range(k, k + 20))
        cut.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    held = [shingles(t) for t in items]
    return [(i, t) for i, t in cut if not any(s and len(s & shingles(t)) >= 0.75 * len(s) for s in held)]


def tables(spark, folder, docs, schema, items, labels):
    for name, rows, kinds in (("documents", docs, schema), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, kinds).coalesce(2).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_by_hand(spark, tmp_path):
    bad = lambda i: " ".join("SPAM!! %s%%%%" % w for w in words(70, i).split())
    texts = [(i, words(80, i) if i % 3 else bad(i)) for i in range(150)]
    shared, items = words(60, 900), [words(30, 901), words(9, 902), "two words"]
    texts += [(200, words(80, 1)), (201, words(80, 2) + " tail"), (202, words(80, 800) + "\n" + shared), (203, shared + "  " + words(90, 801)), (204, words(70, 802) + " " + items[0] + " " + words(70, 803))]
    texts += [(205, items[1].upper()), (206, "two words"), (207, None), (208, ""), (209, words(3000, 804))]
    tables(spark, tmp_path, [(i, t, "en", "web", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long", list(enumerate(items)), [(i, int(i % 3 > 0), 0) for i in range(150)])
    read = lambda t: common.read(spark, str(tmp_path), t)
    model = quality.train(read("documents"), read("labels"), learnable())
    want = by_hand(texts, items, lambda t: model.scores([t])[0] < 0.5)
    assert {201, 204, 206} & {i for i, _ in want} == set() and {1, 202, 203, 209} <= {i for i, _ in want}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    coded = bpe.bpe_encode(spark.createDataFrame(want, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"), digests=True).collect()
    assert got == {r.doc_id: r.ids_sha256 for r in coded}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, clashing names: every stage but the last returns the columns and keeps what is clean."""
    rows = [(i, words(60, i), "en", "web", 60, "k", "w", 1.0, 2, "r") for i in range(60)]
    rows += [(None,) * 10, (None, words(60, 1), *[None] * 8), (5, words(60, 77), *[None] * 8), (5, words(60, 5), *[None] * 8), (7, None, *[None] * 8), (90, "", *[None] * 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string, _kept string, _score double, component_id int, text_hash string"
    tables(spark, tmp_path, rows, schema, [(1, words(60, 9)), (None, None), (1, words(60, 9))], [(i, 1, None) for i in range(60)] + [(None, 0, 0), (3, None, 0)])
    docs = common.read(spark, str(tmp_path), "documents")
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        gone = set(key(docs)) - set(key(out))
        if name in ("quality", "near_duplicates"):  # one label only: nothing is learnt; the null row with the text of 1 has no id
            assert not gone, name
        if name == "benchmark":
            assert len(gone) == 1 and "(9," in gone.pop()
        if name == "repeats":  # the second row of 5 is the first one's copy, and rows without an id are no models
            assert key(out) == key(docs)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows) - 1


@pytest.mark.parametrize("empty", ["benchmark", "documents"])
def test_pipeline_with_an_empty_table(spark, tmp_path, empty):
    docs = [(i, words(40, i), "en", "web", 9) for i in range(8)]
    tables(spark, tmp_path, [] if empty == "documents" else docs, "doc_id long, text string, lang string, source string, n_chars long", [] if empty == "benchmark" else [(1, words(40, 3))], [] if empty == "labels" else [(1, 1, 0)])
    left = {"benchmark": 8, "documents": 0}[empty]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == left
