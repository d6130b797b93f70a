"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set. For each size class a document is covered by overlapping windows a little
longer than its items, so an item that lies in a document of any length has a high Jaccard similarity with some window. MinHash values of
windows meet those of the class's items in a join; every pair that agrees in one value is verified by exact containment in the whole
document. A Bloom filter over the items' values, built where they are, lets the one scan of the documents send only windows that may meet
something, and the shingles only of documents that have such windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix, raw_texts, shingle_set, shingles_in_order

#: Words of a shingle, least share of an item's shingles in a document, share of true pairs that may be missed in the search.
WORDS, CONTAINMENT, MISS = 5, 0.75, 1e-5
#: Shingles of documents hashed at once.
BATCH_SHINGLES = 40_000
#: Bits of the filter for each value of an item, its least and greatest size as powers of two (64 MB), parts in which it is put together.
BITS_A_VALUE, LEAST_POWER, MOST_POWER, SLABS = 64, 20, 29, 16
#: Bits that a value sets.
PLACES = 3
#: Ratio of the largest to the smallest size in a class.
RATIO = math.sqrt(2)
#: Items of so many rows of values and bytes of shingles go to all tasks; more are shuffled.
BROADCAST_BYTES = 64 << 20


def hashes_needed(miss: float = MISS, containment: float = CONTAINMENT) -> int:
    """MinHash values so that the smallest item of a class, contained just so, is missed in a window with a chance of at most `miss`."""
    s = 1 / RATIO
    jaccard = containment * s / (1.5 + (1 - containment) * s)
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def _hashers(n: int) -> list[tuple[np.uint64, np.uint64]]:
    rng = np.random.default_rng(5)
    return list(zip(rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) | np.uint64(1), strict=True))


def class_of(n: int) -> int:
    return math.ceil(math.log(n, RATIO) - 1e-9)


def keys_of(values: np.ndarray, c: int, k: int) -> np.ndarray:
    """MinHash values of a class and a hash function as keys of the join, by an odd factor of the two."""
    return values * (mix(np.full(1, (c << 16) + k, dtype=np.uint64)) | np.uint64(1))


def bit_place(keys: np.ndarray, power: int, k: int) -> np.ndarray:
    """The k-th place of each key in a filter of 2**power bits, of PLACES."""
    x = keys if k == 0 else mix(keys) << np.uint64(power * (k - 1))
    return (x >> np.uint64(64 - power)).astype(np.int64)


def may_hold(bits: np.ndarray, keys: np.ndarray, power: int) -> np.ndarray:
    """Indexes of the keys whose places are all set."""
    left = np.arange(len(keys))
    for k in range(PLACES):
        p = bit_place(keys[left], power, k)
        left = left[(bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
    return left


class Windows:
    """Windows of three blocks of step shingles each over documents that lie one after another."""

    def __init__(self, sizes: np.ndarray, step: int):
        blocks = -(-sizes // step)
        self.owner = np.repeat(np.arange(len(sizes)), blocks)
        self.starts = (np.cumsum(sizes) - sizes)[self.owner] + (np.arange(len(self.owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * step
        self.ends = np.cumsum(blocks) - 1

    def mins(self, v: np.ndarray) -> np.ndarray:
        low = np.minimum.reduceat(v, self.starts)
        for _ in range(2):  # with the blocks that follow in the same document
            last = low[self.ends]
            low[:-1] = np.minimum(low[:-1], low[1:])
            low[self.ends] = last
        return low


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT, words: int = WORDS) -> DataFrame:
    """(document id, item id, n_item_shingles, n_shared, containment) of items of whose shingles a document holds the given share or more.

    Words and shingles are those of shingle_set(): lower-cased A-Z, a text of fewer words is one shingle, so such an item is found only as a whole document. Null and
    empty texts match nothing. Repeated rows of either table are reported for each row; null ids are kept. Texts may have any length. Other columns are not read.
    """
    spark, hashers = docs.sparkSession, _hashers(hashes_needed(containment=containment))
    doc_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def keyed(df: DataFrame, i: str, t: str) -> DataFrame:
        """Rows of one id and text share a key; what they match is reported for each of them."""
        text = F.col(t).cast("string")
        return df.select(F.xxhash64(F.col(i).cast("string"), text).alias("row"), F.col(i).alias("id"), text.alias("text")).where("text != ''")

    def hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in raw_texts(batch.column(2))]
            keys, n = [], [len(s) for s in sets]
            for s in sets:
                keys.append(np.array([keys_of(((s ^ x) * odd).min(keepdims=True), class_of(len(s)), k)[0] for k, (x, odd) in enumerate(hashers)] if len(s) else [], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["irow", "item", "n", "item_set", "keys"])

    hashed = checkpointed(keyed(items, item_id, item_text).mapInArrow(hash_items, f"irow long, item {item_type}, n long, item_set binary, keys array<long>").where("n > 0"))
    n_items, n_shingles = hashed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = sorted({class_of(r["n"]) for r in hashed.select("n").distinct().collect()})  # sizes of items: few
    power = min(MOST_POWER, max(LEAST_POWER, (n_items * len(hashers) * BITS_A_VALUE).bit_length()))
    sent = spark.sparkContext.broadcast(_filter(hashed, power))  # 2**power bits

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value

        def flush(held: list[tuple]) -> pa.RecordBatch:
            sets = [h for *_, h in held]
            sizes = np.array([len(h) for h in sets], dtype=np.int64)
            flat, covers = np.concatenate(sets), [(c, Windows(sizes, math.ceil(RATIO**c / 2))) for c in classes]
            found: list[list[np.ndarray]] = [[] for _ in held]
            for k, (x, odd) in enumerate(hashers):
                v = (flat ^ x) * odd
                for c, cover in covers:
                    keys = keys_of(cover.mins(v), c, k)
                    hit = may_hold(bits, keys, power)
                    owner = cover.owner[hit]
                    for d in np.unique(owner).tolist() if len(hit) else ():
                        found[d].append(keys[hit[owner == d]])
            got = [(row, i, np.unique(h).tobytes(), np.unique(np.concatenate(f)).view(np.int64)) for (row, i, h), f in zip(held, found, strict=True) if f]
            cols = list(zip(*got, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), id_type, pa.binary(), pa.list_(pa.int64())], strict=True)], ["row", "doc", "doc_set", "keys"])

        for batch in batches:
            id_type, held, size = batch.schema.field(1).type, [], 0
            for row, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                if len(h := shingles_in_order(text, words)) and classes:
                    held.append((row, i, h))
                    size += len(h)
                if size >= BATCH_SHINGLES:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    found = checkpointed(keyed(docs, id_col, text_col).mapInArrow(search, f"row long, doc {doc_type}, doc_set binary, keys array<long>"))
    small = F.broadcast if n_items * len(hashers) * 16 + n_shingles * 8 < BROADCAST_BYTES else (lambda df: df)
    values = hashed.select("irow", F.explode("keys").alias("key")).distinct()
    pairs = found.select("row", F.explode("keys").alias("key")).distinct().join(small(values), "key").select("row", "irow").distinct()
    both = pairs.join(small(hashed.select("irow", "item", "n", "item_set")), "irow").join(found.select("row", "doc", "doc_set"), "row").select("doc", "item", "n", "item_set", "doc_set")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [int(np.isin(np.frombuffer(i, dtype=np.uint64), np.frombuffer(d, dtype=np.uint64), kind="sort").sum()) for i, d in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            n = batch.column(2).to_numpy()
            share = np.array(shared, dtype=np.float64) / n
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shared, pa.int64()), pa.array(share)], ["doc", "item", "n_item_shingles", "n_shared", "containment"]).filter(pa.array(np.array(shared) >= containment * n))

    out = both.mapInArrow(verify, f"doc {doc_type}, item {item_type}, n_item_shingles long, n_shared long, containment double")
    return out.withColumnRenamed("doc", id_col).withColumnRenamed("item", item_id if item_id != id_col else f"item_{item_id}")


def _filter(hashed: DataFrame, power: int) -> np.ndarray:
    """The bits of all keys. Tasks set the bits of a part each, and no more than 2**power bits are gathered."""
    width = (1 << power) // 8 // SLABS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).flatten().to_numpy().view(np.uint64)
            p = np.unique(np.concatenate([bit_place(keys, power, k) for k in range(PLACES)]))
            yield pa.RecordBatch.from_arrays([pa.array(p // (width * 8)), pa.array(p)], ["slab", "place"])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slabs: dict[int, np.ndarray] = {}
        for batch in batches:
            of, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in np.unique(of).tolist():
                p = place[of == s] % (width * 8)
                np.bitwise_or.at(slabs.setdefault(s, np.zeros(width, dtype=np.uint8)), p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        if slabs:
            yield pa.RecordBatch.from_arrays([pa.array(list(slabs), pa.int64()), pa.array([b.tobytes() for b in slabs.values()], pa.binary())], ["slab", "bits"])

    bits = np.zeros((1 << power) // 8, dtype=np.uint8)
    parts = hashed.select("keys").mapInArrow(places, "slab long, place long").distinct().repartition(SLABS, "slab").mapInArrow(set_bits, "slab long, bits binary")
    for slab, raw in parts.collect():  # SLABS rows
        bits[slab * width : (slab + 1) * width] = np.frombuffer(bytes(raw), dtype=np.uint8)
    return bits


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """docs without those that hold an item; rows with a null id stay."""
    found = find_contained(docs, items, id_col=id_col, **names).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti")
