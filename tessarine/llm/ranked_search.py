"""Operator 12: ranked lexical search over posting lists with range-maximum tables.

The index is a table: documents are dealt into blocks of about BLOCK_WORDS words, and each term of a block has a row with the places of its documents,
in the order of their ids, and how often they hold it. A search takes the rows of its terms, block by block. A sparse table over each list
answers which document of any interval has the term's greatest impact, so the sum of these maxima bounds every score inside the interval. The
interval of the greatest bound is split at the document in which its heaviest term peaks; that document is scored, and what lies on both sides of it
gets bounds of its own. Short intervals are scored whole. A task keeps the best documents of each query over all its blocks, and intervals that
can't beat them are left.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpointed, drop_folder, raw_texts, shared_folder, stretches

#: Results per query; words of a block, and of a piece of one that is counted at once; distinct terms of queries that go to all tasks at once.
TOP, BLOCK_WORDS, PIECE_WORDS, ROUND_TERMS = 10, 1_000_000, 500_000, 100_000
#: Intervals split at once; intervals of at most so many documents are scored whole.
FRONTIER, LEAF = 32, 48
#: Letters, digits and all bytes beyond ASCII, A-Z in lower case; everything else parts terms.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
INDEX = "block long, term string, n int, docs array<int>, counts array<int>, ids array<long>"


def terms_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TABLE).split()


class Block:
    """Documents whose terms are counted together."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.pieces: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.words: list[bytes] = []
        self.runs: list[tuple[int, int]] = []
        self.total = 0

    def add(self, i: int, raw: bytes) -> None:
        doc, size = len(self.ids), 0
        for part in stretches(raw):
            words = terms_of(part)
            size += len(words)
            self.words += words
            self.runs.append((doc, len(words)))
            if len(self.words) >= PIECE_WORDS:
                self._count()
        if size:  # a document without a term isn't one
            self.ids.append(i)
            self.sizes.append(size)
            self.total += size

    def _count(self) -> None:
        coded = pa.array(self.words, pa.binary()).dictionary_encode()
        docs = np.repeat(*np.array(self.runs, dtype=np.int64).T)
        key, n = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | docs, return_counts=True)
        self.pieces.append((coded.dictionary, key >> 32, key & 0xFFFFFFFF, n))
        self.words, self.runs = [], []

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        if self.words:
            self._count()
        place = np.empty(len(self.ids), dtype=np.int64)
        order = np.argsort(np.array(self.ids), kind="stable")
        place[order] = np.arange(len(order))
        whole = pa.concat_arrays([p[0] for p in self.pieces]).dictionary_encode()
        codes, starts = whole.indices.to_numpy().astype(np.int64), np.cumsum([0, *(len(p[0]) for p in self.pieces)])
        key = np.concatenate([codes[s + p[1]] << 32 | place[p[2]] for s, p in zip(starts, self.pieces)])
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([p[3] for p in self.pieces])).astype(np.int32)  # a long document may be in several pieces
        docs, ends = (key & 0xFFFFFFFF).astype(np.int32), np.cumsum(np.bincount(key >> 32, minlength=len(whole.dictionary)))
        sizes = np.array(self.sizes, dtype=np.int32)[order]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        ints, none = pa.list_(pa.int32()), pa.list_(pa.int64())
        for a in range(0, len(ends), 5000):
            b = min(a + 5000, len(ends))
            o = offsets.slice(a, b - a + 1)
            columns = [pa.array(np.full(b - a, block)), whole.dictionary.slice(a, b - a).cast(pa.string()), pa.array(np.diff(o.to_numpy())), pa.ListArray.from_arrays(o, pa.array(docs)), pa.ListArray.from_arrays(o, pa.array(n)), pa.nulls(b - a, none)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "term", "n", "docs", "counts", "ids"])
        columns = [pa.array([block]), pa.nulls(1, pa.string()), pa.array([len(sizes)], pa.int32()), pa.array([sizes], ints), pa.nulls(1, ints), pa.array([np.array(self.ids)[order]], none)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "term", "n", "docs", "counts", "ids"])


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Writes the index of docs below folder and reads it: a row for each term of each block, and one without a term with the sizes and ids of its documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, block = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                block.add(i, raw or b"")
                if block.total >= block_words:
                    yield from block.rows(first + made)
                    block, made = Block(), made + 1
        yield from block.rows(first + made)

    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    known.mapInArrow(work, INDEX).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(INDEX).parquet(folder)


class Lists:
    """The posting lists of a block that a search needs, one behind the other, with the sparse table of their greatest impacts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: list[tuple[str, np.ndarray, np.ndarray]], n_docs: int, n_words: int):
        self.ids, self.n = ids, len(ids)
        self.number = {t: k for k, (t, _, _) in enumerate(terms)}
        lengths = np.array([len(d) for _, d, _ in terms])
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.docs = np.concatenate([d for _, d, _ in terms]).astype(np.int64)
        counts = np.concatenate([c for _, _, c in terms]).astype(np.int64)
        m = 100 - 75 + (75 * sizes.astype(np.int64) * n_docs) // n_words
        self.impact = (1_000_000_000 * counts) // (1000 * counts + 8 * m[self.docs])
        self.key = np.repeat(np.arange(len(terms)), lengths) * self.n + self.docs
        levels = [np.arange(len(self.docs), dtype=np.int32)]
        for k in range(1, int(lengths.max()).bit_length()):  # the place of the greatest impact among 2**k from here on
            a = levels[-1].copy()
            b = levels[-1][1 << (k - 1) :]
            better = np.flatnonzero(self.impact[b] > self.impact[a[: len(b)]])
            a[better] = b[better]
            levels.append(a)
        self.table = np.stack(levels)

    def peaks(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place and the impact of the maximum of each range of places; impact 0 of empty ranges."""
        size = hi - lo
        full = size > 0
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        a = self.table[level, np.where(full, lo, 0)]
        b = self.table[level, np.where(full, hi - (1 << level), 0)]
        at = np.where(self.impact[b] > self.impact[a], b, a)
        return at, np.where(full, self.impact[at], 0)


class Best:
    """The k best documents so far, equal scores by rising id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            kept = scores >= self.scores[-1]
            scores, ids = scores[kept], ids[kept]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]

    def open(self, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether a document with such a bound and id, or a higher id, could still come in."""
        if len(self.scores) < self.k:
            return bound > 0
        return (bound > self.scores[-1]) | ((bound == self.scores[-1]) & (first_id < self.ids[-1]))


def search_block(lists: Lists, query: list[tuple[str, int]], best: Best) -> int:
    """Takes the best documents of a block into best; returns how many were scored. query: terms and what their impacts count."""
    known = [(lists.number[t], w) for t, w in query if t in lists.number and w > 0]
    if not known:
        return 0
    term, weight = (np.array(x, dtype=np.int64) for x in zip(*known, strict=True))
    first, last = np.zeros(1, dtype=np.int64), np.full(1, lists.n)
    lo, hi = lists.starts[term][None], lists.starts[term + 1][None]
    at, peak = lists.peaks(lo, hi)
    part = peak * weight
    bound, split = part.sum(axis=1), lists.docs[at[np.arange(1), part.argmax(axis=1)]]
    scored = 0
    while True:
        alive = best.open(bound, lists.ids[first])
        if not alive.all():
            first, last, lo, hi, bound, split = (x[alive] for x in (first, last, lo, hi, bound, split))
        if not len(bound):
            return scored
        taken = np.argpartition(-bound, FRONTIER)[:FRONTIER] if len(bound) > FRONTIER else np.arange(len(bound))
        rest = np.ones(len(bound), dtype=bool)
        rest[taken] = False
        short = last[taken] - first[taken] <= LEAF
        leaf, cut = taken[short], taken[~short]
        if len(leaf):
            a, size = lo[leaf].ravel(), (hi[leaf] - lo[leaf]).ravel()
            ends = np.cumsum(size)
            place = np.repeat(a - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
            worth = lists.impact[place] * np.repeat(np.tile(weight, len(leaf)), size)
            docs, back = np.unique(lists.docs[place], return_inverse=True)
            scores = np.bincount(back, weights=worth, minlength=len(docs)).astype(np.int64)  # exact: far below 2**53
            scored += len(docs)
            best.add(scores[scores > 0], lists.ids[docs[scores > 0]])
        new = [(x[rest]) for x in (first, last, lo, hi, bound, split)]
        if len(cut):
            d = split[cut]
            mid = np.clip(np.searchsorted(lists.key, term * lists.n + d[:, None]), lo[cut], hi[cut])
            there = (mid < hi[cut]) & (lists.docs[np.minimum(mid, len(lists.docs) - 1)] == d[:, None])
            scores = (np.where(there, lists.impact[np.minimum(mid, len(lists.docs) - 1)], 0) * weight).sum(axis=1)
            scored += len(d)
            best.add(scores[scores > 0], lists.ids[d[scores > 0]])
            kids_first, kids_last = np.concatenate([first[cut], d + 1]), np.concatenate([d, last[cut]])
            kids_lo, kids_hi = np.concatenate([lo[cut], mid + there]), np.concatenate([mid, hi[cut]])
            at, peak = lists.peaks(kids_lo, kids_hi)
            part = peak * weight
            heaviest = part.argmax(axis=1)
            kids = (kids_first, kids_last, kids_lo, kids_hi, part.sum(axis=1), lists.docs[at[np.arange(len(at)), heaviest]])
            full = kids_first < kids_last
            new = [np.concatenate([x, y[full]]) for x, y in zip(new, kids, strict=True)]
        first, last, lo, hi, bound, split = new


def _questions(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, terms, times: the distinct terms of each item with how often it has them; items without a term are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(t for part in stretches(raw or b"") for t in terms_of(part)) for raw in raw_texts(batch.column(1))]
            columns = [batch.column(0), pa.array([[t.decode() for t in c] for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "terms", "times"]).filter(pa.array([len(c) > 0 for c in found], pa.bool_()))

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"item {kind}, terms array<string>, times array<long>")


def search(index: DataFrame, questions: DataFrame, top: int = TOP) -> DataFrame:
    """question, doc_id, score, rank of the best documents of each question (question int, terms, times), which go to all tasks; they are few.

    Weights come from the number of documents that hold a term, over all blocks.
    """
    spark = index.sparkSession
    sizes = index.where("term is null").agg(F.sum("n"), F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    n_docs, n_words = sizes[0] or 0, sizes[1] or 0
    asked = [(r["question"], list(zip(r["terms"], r["times"], strict=True))) for r in questions.collect()]
    terms = spark.createDataFrame([(t,) for t in sorted({t for _, q in asked for t, _ in q})], "term string")
    held = dict(index.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("n")).collect())
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in held.items()}
    broad = spark.sparkContext.broadcast([(k, [(t, n * weight[t]) for t, n in q if t in weight]) for k, q in asked])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {}

        def answer(sizes, ids, lists: list) -> None:
            if lists:
                block = Lists(ids, sizes, lists, n_docs, n_words)
                for k, query in broad.value:
                    search_block(block, query, found.setdefault(k, Best(top)))

        block, sizes, ids, lists = None, None, None, []
        for batch in batches:
            blocks, names = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            docs, counts, of = batch.column(2), batch.column(3), batch.column(4)
            for r, b in enumerate(blocks.tolist()):
                if b != block:
                    answer(sizes, ids, lists)
                    block, lists = b, []
                if names[r] is None:
                    sizes, ids = docs[r].values.to_numpy(), of[r].values.to_numpy()
                else:
                    lists.append((names[r], docs[r].values.to_numpy(), counts[r].values.to_numpy()))
        answer(sizes, ids, lists)
        for k, best in found.items():
            if len(best.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), k, dtype=np.int32)), pa.array(best.ids), pa.array(best.scores)], ["question", "doc_id", "score"])

    wanted = index.join(F.broadcast(terms.withColumnRenamed("term", "asked")), F.col("term") == F.col("asked"), "left_semi").unionByName(index.where("term is null"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = wanted.select("block", "term", "docs", "counts", "ids").repartition(parts, "block").sortWithinPartitions("block", F.col("term").asc_nulls_first())
    hits = dealt.mapInArrow(work, "question int, doc_id long, score long")
    w = W.Window.partitionBy("question").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """item, rank, doc_id, score of the top documents of each item; see the contract of op12.

    Documents with a null id are neither counted nor found; rows that repeat an id are documents of their own, as are equal texts. Null and
    empty texts, and texts without a term, are no documents. Each row of items is answered for itself, also one that repeats an id or has
    none; items without a known term have no rows. Ids of documents are whole numbers. Other columns are not read; empty tables give empty ones.
    Items are asked in rounds of about ROUND_TERMS terms. The index is deleted at the end.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index = build_index(docs, folder, id_col, text_col)
    asked = checkpointed(_questions(items, item_col, item_text_col))
    rounds = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // ROUND_TERMS))
    out = None
    for k in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(rounds)) == k).collect()  # a round's worth
        questions = spark.createDataFrame([(q, r["terms"], r["times"]) for q, r in enumerate(some)], "question int, terms array<string>, times array<long>")
        named = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(some)], f"question int, item {asked.schema['item'].dataType.simpleString()}")
        found = search(index, questions, top).join(F.broadcast(named), "question")
        found = checkpointed(found.select(F.col("item").alias(item_col), "rank", F.col("doc_id").cast(kind).alias(id_col), "score"))
        out = found if out is None else out.unionByName(found)
    drop_folder(spark, folder)
    return out
