"""A deterministic embedder for use without a model: hashed terms, signed and weighted by count, of unit length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup_terms


def hash_embed(docs: DataFrame, id_col: str | list[str], text_col: str, dim: int, common: list[str] = []) -> DataFrame:
    """id (or the columns given), vector: array<float> of dim; texts without terms give zeros. Terms are found and hashed in the JVM, counted in Arrow batches; no shuffle.

    common names texts that many rows have; these are embedded once, and looked up.
    """

    @F.arrow_udf("array<float>")
    def count(hashes: pa.Array) -> pa.Array:
        none = hashes.is_null().to_numpy(zero_copy_only=False)
        n, h = int((~none).sum()), hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), pc.list_value_length(hashes.drop_null()).to_numpy(zero_copy_only=False))
        v = np.bincount(row * dim + h % dim, weights=np.where((h >> 32) % 2 == 0, 1.0, -1.0), minlength=n * dim).reshape(n, dim)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        v = (v / np.where(length == 0, 1.0, length)).astype(np.float32)
        ends = np.concatenate([[0], np.cumsum(np.where(none, 0, dim))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()), mask=pa.array(none))

    ids, hashes = [id_col] if isinstance(id_col, str) else id_col, F.transform(lookup_terms(text_col), lambda t: F.xxhash64(t))
    if not common:
        return docs.select(*ids, count(hashes).alias("vector"))
    texts = docs.sparkSession.createDataFrame([(x,) for x in sorted(set(common))], "_common string").coalesce(1)
    known = F.broadcast(hash_embed(texts, "_common", "_common", dim).withColumnRenamed("vector", "_known"))
    both = docs.join(known, F.col(text_col) == F.col("_common"), "left")
    return both.select(*ids, F.coalesce("_known", count(F.when(F.col("_known").isNull(), hashes))).alias("vector"))
