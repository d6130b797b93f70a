"""Operators 4 and 10 against versions without Spark: shards from the hashes themselves, the classifier from its compressors."""

import math
import random
import struct

import numpy as np
import xxhash
import zstandard as zstd
from pyspark.sql import functions as F

from tessarine.llm import quality, sharding


def hashed(*parts):
    """Spark's xxhash64 of whole numbers and texts, one after another."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(struct.pack("<i", p) if isinstance(p, int) else p.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def test_shards_from_their_hashes(spark):
    rows = [(i, f"text {i % 7}") for i in range(-50, 400)] + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shard(i, n):
        if i is None:
            return None
        return max((hashed(17, s, str(i), 17 + s), s) for s in range(n))[1]

    got = [(r.doc_id, r.shard, r.grown_shard) for r in sharding.shard(docs, 16).collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted((i, shard(i, 16), shard(i, 17)) for i, _ in rows if i is not None)
    assert all(a == b or b == 16 for i, a, b in got if i is not None) and any(b == 16 for _, _, b in got)
    assert len({a for _, a, _ in got}) == 16


def text(i, good):
    r = random.Random(i)
    some = ["".join(r.choices("abcdeé", k=3)) for _ in range(80)]
    return " ".join(some if good else [f"SPAM!! {w}%%%%" for w in some])


def test_quality_against_plain(spark):
    """Dictionaries by the library from the same sample; sizes, curve and scores row by row."""
    rows = [(i, text(i, i % 2)) for i in range(300)] + [(400, None), (401, ""), (402, "x" * 10_000), (403, text(5, True) * 50)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1)
    texts = dict(rows)
    order = {r.i: (r.o, r.h) for r in docs.select(F.col("doc_id").alias("i"), F.xxhash64(F.lit(10), "doc_id").alias("o"), F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2)).alias("h")).collect()}
    sample = sorted((i for i in range(300) if i % 3 != 1), key=lambda i: (order[i][0], i))

    def dictionary(label):
        parts = [texts[i].encode() for i in sample if i % 2 == label and order[i][1] == 0]
        return zstd.train_dictionary(min(quality.DICT_BYTES, max(1024, sum(map(len, parts)) // 4)), parts, k=quality.SEGMENT_BYTES, d=quality.RUN_BYTES).as_bytes()

    good, bad = dictionary(1), dictionary(0)
    assert (model.good, model.bad) == (good, bad)

    def size(raw, held, piece):
        c = zstd.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, **({"dict_data": zstd.ZstdCompressionDict(held), "write_dict_id": False} if held else {}))
        return sum(len(c.compress(raw[k : k + piece])) for k in range(0, len(raw), piece))

    def measured(t):
        raw = (t or "").encode()
        if not raw:
            return 0.0, 0.0
        g, b = size(raw, good, 128), size(raw, bad, 128)
        return (b - g) / (b + g + 40), math.log((size(raw, None, 4096) + 16) / (len(raw) + 16))

    curve = [i for i in sample if order[i][1] == 1]
    x, y = np.array([measured(texts[i]) for i in curve]), np.array([i % 2 for i in curve])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    w = np.zeros(3)  # gradient steps instead of Newton's
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = z.T @ (weight * (y - p)) - 0.3 * w * (np.arange(3) < 3)
        w += 0.02 * step
        if np.abs(step).max() < 1e-9:
            break
    for r in quality.scored(docs, model).collect():
        want = 1 / (1 + math.exp(-float(np.clip(np.append((np.array(measured(texts[r.doc_id])) - mean) / scale, 1) @ w, -30, 30))))
        assert abs(r.score - want) < 2e-3, (r.doc_id, r.score, want)
