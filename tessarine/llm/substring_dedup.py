"""Operator 8: substring deduplication by seed and extend.

Of each window of words the least seed-length gram, the rightmost of equals, is its anchor (winnowing): equal windows have equal anchors at
the same place. Documents are joined on anchors. A seed is extended both ways over all windows that chose it; where an earlier seed has the
same extension, all of it is a repeat. The first seeds of different extensions may still share some windows; only these are compared
window by window. What a batch of documents settles by itself isn't gathered: of equal seeds or windows only its first is, and of the
extensions of an anchor one; so a passage that all documents share makes a row for each batch. Windows that repeat an earlier one, put together, are the maximal repeats; their words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import _BASES, _powers_of, checkpointed, gram_hashes, mix, raw_texts, word_hashes

#: Words of a window, and of a seed; seeds or windows that are settled at once.
WINDOW, SEED, SETTLED_ROWS = 20, 8, 500_000
#: What a batch knows of a seed: nothing; that its anchor has several extensions, as the row that tells other batches so; that its extension
#: repeats an earlier one; that its anchor has several extensions.
OPEN, TELLS, REPEATS, SEVERAL = range(4)


def anchors(h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the word hashes of a text: for each anchor its hash, its extension's hash, the first window that chose it, and how many did."""
    n = len(h) - window + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    g = gram_hashes(h, seed)
    least, place = g[:n].copy(), np.arange(n)
    for k in range(1, window - seed + 1):
        other = g[k : k + n]
        take = other <= least
        least[take] = other[take]
        place[take] = np.flatnonzero(take) + k
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    up, down = _powers_of(_BASES[1], len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    span = (sums[first + count - 1 + window] - sums[first]) * down[first]
    offset = (place[first] - first) * 64 + count
    return least[first], mix(span + offset.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first, count


def settle_seeds(anchor: np.ndarray, span: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted seeds of a batch with what it knows of each, in the last two bits of at. Settled seeds get a key of their own instead of the anchor."""
    order = np.lexsort((at, ids, span, anchor))
    anchor, span, ids, at = anchor[order], span[order], ids[order], at[order]
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new_span = new_anchor | np.concatenate([[True], span[1:] != span[:-1]])
    spans = np.add.reduceat(new_span.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
    head = np.flatnonzero(new_span)[np.cumsum(new_span) - 1]
    same = ~new_span & (ids == ids[head]) & (at == at[head])  # rows of one id
    code = np.where(~new_span, REPEATS, np.where(spans == 1, OPEN, np.where(new_anchor, TELLS, SEVERAL)))
    alone = mix(mix(ids.view(np.uint64)) + at.astype(np.uint64)).view(np.int64)
    anchor = np.where(code >= REPEATS, alone, anchor)
    return tuple(x[~same] for x in (anchor, span, ids, at * 4 + code))


def settle_windows(hashes: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of a batch; start is doubled, and odd for those that repeat an earlier window of the batch, which get a key of their own."""
    order = np.lexsort((start, ids, hashes))
    hashes, ids, start = hashes[order], ids[order], start[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = ~new & (ids == ids[head]) & (start == start[head])
    alone = mix(mix(ids.view(np.uint64)) + start.astype(np.uint64)).view(np.int64)
    return tuple(x[~same] for x in (np.where(new, hashes, alone), ids, start * 2 + ~new))


def batched(parts: Iterator[tuple[np.ndarray, ...]], settle, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrays put together up to SETTLED_ROWS, settled and sent."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in settle(*map(np.concatenate, zip(*held, strict=True)))], names)

    for p in parts:
        if len(p[0]):
            held.append(p)
            size += len(p[0])
        if size >= SETTLED_ROWS:
            yield send()
            held, size = [], 0
    if held:
        yield send()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """A row for each row of docs: id, n_words, n_removed, kept (the kept words joined by one space), begins and ends (word ranges removed), text_hash (xxhash64 of the text).

    A word goes if a window that covers it has the same words as one that starts earlier: in a document of a smaller id, or further ahead
    in its own. All windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null, empty and short texts lose nothing
    (null is kept as an empty text); ids are whole numbers; rows that repeat an id are read as the same document, so that none of them
    makes the others repeats unless a window recurs further on; rows with a null id lose nothing and are no model for others.
    """
    kind = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = d.where("id is not null")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for i, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                    a, s, first, count = anchors(word_hashes(raw, lower=False), window, seed)
                    yield a.view(np.int64), s.view(np.int64), np.full(len(a), i, dtype=np.int64), first * 256 + count

        yield from batched(parts(), settle_seeds, ["anchor", "span", "id", "at"])

    rows = known.mapInArrow(seeds, "anchor long, span long, id long, at long")
    code = F.col("at").bitwiseAND(3)
    by_span = W.Window.partitionBy("anchor", "span").orderBy("id", "at")
    by_anchor = W.Window.partitionBy("anchor").orderBy("span", "id", "at").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    several = (F.min("span").over(by_anchor) != F.max("span").over(by_anchor)) | (F.max((code == TELLS).cast("int")).over(by_anchor) == 1) | (code == SEVERAL)
    placed = rows.select("id", F.shiftright("at", 2).alias("at"), F.first("id").over(by_span).alias("id0"), F.shiftright(F.first("at").over(by_span), 2).alias("at0"), several.alias("several"), (code == REPEATS).alias("repeats"))
    again = F.col("repeats") | (F.col("id") != F.col("id0")) | (F.col("at") != F.col("at0"))
    found = placed.where(again | F.col("several")).groupBy("id").agg(F.collect_list(F.col("at") * 2 + F.when(again, 0).otherwise(1)).alias("marks"))
    marks = checkpointed(found)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for i, raw, m in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2), strict=True):
                    m = m.values.to_numpy()
                    m = m[m % 2 == 1] // 2
                    first, count = m // 256, m % 256
                    start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    g = gram_hashes(word_hashes(raw, lower=False), window)
                    start = start[start < len(g)].astype(np.int64)  # others are of another row with this id
                    yield g[start].view(np.int64), np.full(len(start), i, dtype=np.int64), start

        yield from batched(parts(), settle_windows, ["hash", "id", "start"])

    probed = marks.where(F.exists("marks", lambda m: m % 2 == 1))
    each = known.join(probed, "id").select("id", "text", "marks").mapInArrow(windows, "hash long, id long, start long")
    by_hash = W.Window.partitionBy("hash").orderBy("id", "start")
    later = each.select("id", "start", F.first("id").over(by_hash).alias("id0"), F.first("start").over(by_hash).alias("start0")).where("start % 2 = 1 or id != id0 or start != start0")
    later = later.groupBy("id").agg(F.collect_list(F.shiftright("start", 1)).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, begins, ends = [], [], [], [], []
            for raw, m, s in zip(raw_texts(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = (raw or b"").split()
                n = len(words)
                first, count = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
                if m.is_valid:
                    whole = m.values.to_numpy()
                    whole = whole[whole % 2 == 0] // 2
                    first, count = whole // 256, whole % 256
                if s.is_valid:
                    starts = s.values.to_numpy()
                    first, count = np.concatenate([first, starts]), np.concatenate([count, np.ones(len(starts), dtype=np.int64)])
                inside = first + count + window - 1 <= n
                first, count = first[inside], count[inside]
                delta = np.zeros(n + 1, dtype=np.int64)
                np.add.at(delta, first, 1)
                np.add.at(delta, first + count + window - 1, -1)
                gone = np.cumsum(delta[:n]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(words, ~gone) if n_removed[-1] else words))
                begins.append(edges[::2])
                ends.append(edges[1::2])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(begins, longs), pa.array(ends, longs)], ["id", "text_hash", "n_words", "n_removed", "kept", "begins", "ends"])

    schema = "id long, text_hash long, n_words long, n_removed long, kept string, begins array<long>, ends array<long>"
    text_hash = F.xxhash64("text").alias("text_hash")  # after the joins, so that both share one shuffle of the texts
    out = known.join(marks, "id", "left").join(later, "id", "left").select("id", "text", "marks", "starts", text_hash).mapInArrow(cut, schema)
    unknown = d.where("id is null").select("id", "text", F.lit(None).cast("array<long>").alias("marks"), F.lit(None).cast("array<long>").alias("starts"), text_hash).mapInArrow(cut, schema)
    return out.unionByName(unknown).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
