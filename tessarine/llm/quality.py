"""Operator 10: a quality classifier made of compressors.

Two zstandard dictionaries are built, from text labelled good and from text labelled bad. A text is cut into short pieces, and each is
compressed with the one and with the other dictionary alone. The difference of the two sums, over their sum, says which it resembles; how far
the text shrinks without a dictionary tells what repeats itself and resembles neither. A logistic curve over the two, fitted on other labelled
texts, gives a probability. Only bounded samples of labelled rows are used to fit; every row is scored, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, free_name

#: The bound of the samples: rows of each label for a dictionary, and as many for the curve. Rows give their whole texts.
SAMPLE_ROWS = 1500
DICT_BYTES, LEVEL = 112_640, 3
#: Words that the dictionaries are put together from are sought in segments of this length, by runs of so many bytes.
SEGMENT_BYTES, RUN_BYTES = 256, 8
#: Bytes of a piece: short ones find little in themselves, so that what the dictionary knows decides. Bytes compressed at once without one.
PIECE_BYTES, BLOCK_BYTES = 128, 4096
#: Labelled texts of each label without which nothing is learnt; bytes added to both sizes, so that short texts stay near the middle.
LEAST_ROWS, DAMPING = 16, 40


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes | None):
    import zstandard as zstd

    if dictionary is None:
        return zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    d = zstd.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _size(raw: bytes, dictionary: bytes | None, piece: int) -> int:
    return sum(map(len, map(_compressor(dictionary).compress, [raw[i : i + piece] for i in range(0, len(raw), piece)])))


def features(text: str | None, good: bytes, bad: bytes) -> tuple[float, float]:
    """The normalised difference of a text's compressed sizes, from -1 to 1 (above 0: nearer to good), and the log of how far it shrinks alone; zeros for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0, 0.0
    g, b = (_size(raw, d, PIECE_BYTES) for d in (good, bad))
    return (b - g) / (b + g + DAMPING), float(np.log((_size(raw, None, BLOCK_BYTES) + 16) / (len(raw) + 16)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton's method in bounded steps; classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Two dictionaries, and the curve over the scaled features."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.mean, self.scale, self.weights = np.zeros(2), np.ones(2), np.array([1.0, 0.0, 0.0])

    def features(self, texts: list[str | None]) -> np.ndarray:
        return np.array([features(t, self.good, self.bad) for t in texts], dtype=np.float64).reshape(-1, 2)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:2] + self.weights[2], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 10, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the labelled rows for which usable (an expression over the id) holds; None if one of the labels has fewer than LEAST_ROWS texts for a dictionary.

    The sample is the 2 * sample_rows ids of each label that a seeded hash of the id puts first; a hash deals them to the dictionaries and to
    the curve. Labels other than 0 and 1, null ids and empty texts are left out; of labels of one id the highest counts, of its texts the
    least. Other columns are not read.
    """
    hashed = lambda s, c: F.xxhash64(F.lit(s), c)
    rows = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    picked = [rows.where(F.col("_label") == k).orderBy(hashed(seed, "_id"), "_id").limit(2 * sample_rows) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text != ''")
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    sample = checkpointed(sample.withColumn("_order", hashed(seed, "_id")).withColumn("_half", F.pmod(hashed(seed + 1, "_id"), F.lit(2))))
    got = sorted((r["_order"], r["_id"], r["_label"], r["_text"]) for r in sample.where("_half = 0").collect())  # 4 * sample_rows texts at most
    by = {k: [t for *_, label, t in got if label == k] for k in (0, 1)}
    if min(map(len, by.values())) < LEAST_ROWS:
        return None
    model = Model(*(_dictionary(by[k]) for k in (1, 0)))
    curve = with_model(sample.where("_half = 1"), "_text", model, lambda m, t: m.features(t).tolist(), "_x", T.ArrayType(T.DoubleType()))
    rest = sorted((r["_order"], r["_id"], r["_label"], r["_x"]) for r in curve.select("_order", "_id", "_label", "_x").collect())
    if rest:
        x, y = np.array([r[3] for r in rest]), np.array([r[2] for r in rest])
        model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        model.weights = _fit((x - model.mean) / model.scale, y)
    return model


def _dictionary(texts: list[str]) -> bytes:
    import zstandard as zstd

    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    try:
        return zstd.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, parts)) // 4)), parts, k=SEGMENT_BYTES, d=RUN_BYTES).as_bytes()
    except zstd.ZstdError:  # too few or too like texts for its training: their bytes serve as they are
        return b"".join(parts)[-DICT_BYTES:]


def with_model(docs: DataFrame, text_col: str, model: Model, ask: Callable[[Model, list], list], name: str, kind: T.DataType) -> DataFrame:
    """docs with what the model says of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    @F.pandas_udf(kind)
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(ask(sent.value, texts.tolist()))

    return docs.withColumn(name, answer(F.col(text_col).cast("string")))


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; 0.5 for all without a model. Null and empty texts get the score of an empty text; every row and column stays."""
    return docs.withColumn(score_col, F.lit(0.5)) if model is None else with_model(docs, text_col, model, Model.scores, score_col, T.DoubleType())


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns that docs had."""
    (name,) = free_name(docs, "_score")
    return scored(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)
