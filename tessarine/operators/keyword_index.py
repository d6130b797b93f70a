"""Keyword search by a stored index: a term counts where a text contains it anywhere, also inside a word, so words are looked up by their grams.

A table of postings below a folder: chunks are dealt into blocks, and each word of a block (a run of letters, digits, / and - of the folded texts) has a
row with the places of the chunks that hold it; so has each pair of characters, and each code of the chunks' metadata. A term of two characters is a pair; a
longer one is looked up among the words of each block by its rarest gram of three characters, and of the words found, those that contain the whole term are
exact: a text contains a term if and only if one of its words does. Only postings are read, and only those of the terms are dealt by block. A block is left
out for a query when all terms that occur in it together can't beat the query's best chunks so far.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import document_codes, fold, lookup_terms
from ..sources.scratch import checkpointed

#: Chunks of a block and bytes of their texts, whichever is reached first; terms of the queries that are answered in one round.
BLOCK_CHUNKS, BLOCK_BYTES, ROUND_TERMS = 8192, 8 << 20, 10_000
#: What a term and a code are worth: a code in the metadata, or else in the text.
TERM, CODE, CODE_IN_TEXT = 1.0, 12.0, 6.0
POSTINGS = "block long, kind string, word string, places array<int>, ids array<long>"
# đ is no letter of a term, but may be one of a code; it gets a byte of its own
_D, _MARK = "đ", "\x01"
_LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789/-\x01"
_TABLE = bytes(b if b in _LETTERS else 0x20 for b in range(256))
_NUMBER = np.array([_LETTERS.find(bytes([b])) for b in range(256)])
_PAIRS = [bytes((a, b)).decode().replace(_MARK, _D) for a in _LETTERS for b in _LETTERS]


def _flat(texts: pa.StringArray) -> tuple[np.ndarray, bytes]:
    """Where each text begins and the last one ends, and the bytes of all."""
    _, at, data = texts.buffers()
    edges = np.frombuffer(at, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return edges - edges[0], data.slice(edges[0], edges[-1] - edges[0]).to_pybytes() if data else b""


def words_of(folded: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of three or more of the characters that terms and codes are made of and the number of the text of each; numbers of texts and of their different pairs of these in a row."""
    text = pc.replace_substring(pc.replace_substring(folded.cast(pa.string()), _MARK, " "), _D, _MARK)
    edges, raw = _flat(text)
    raw = raw.translate(_TABLE)
    runs = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), pa.py_buffer(edges), pa.py_buffer(raw)))
    words, of = runs.flatten(), np.repeat(np.arange(len(text)), pc.list_value_length(runs))
    long = pc.greater(pc.binary_length(words), 2)
    n = _NUMBER[np.frombuffer(raw, dtype=np.uint8)]
    both = (n[1:] >= 0) & (n[:-1] >= 0)
    both[edges[(edges > 0) & (edges < len(raw))] - 1] = False  # the last of a text and the first of the next
    at = np.flatnonzero(both)
    met = np.zeros((len(text), len(_PAIRS)), dtype=bool)
    met[np.repeat(np.arange(len(text)), np.diff(edges))[at], n[at] * len(_LETTERS) + n[at + 1]] = True
    return words.filter(long), of[long.to_numpy(zero_copy_only=False)], *np.nonzero(met)


def _lists(number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The different numbers, with the different places of each."""
    key = np.sort(number.astype(np.int64) << 32 | place)
    key = key[np.diff(key, prepend=-1) != 0]
    count = np.bincount(key >> 32)
    met = np.flatnonzero(count)
    return met, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[met])]).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)))


def _rows(block: int, ids: list[int], found: list[tuple], codes: list[list[str]]) -> Iterator[pa.RecordBatch]:
    """The postings of a block, from what words_of() found in it; places are ranks by id."""
    place = np.empty(len(ids), dtype=np.int64)
    order = np.argsort(np.array(ids), kind="stable")
    place[order] = np.arange(len(order))
    names = ["block", "kind", "word", "places", "ids"]
    words, of, paired, pairs = (pa.concat_arrays(x) if k == 0 else np.concatenate(x) for k, x in enumerate(zip(*found, strict=True)))
    words, held = words.dictionary_encode(), pa.array([c for some in codes for c in some], pa.string()).dictionary_encode()
    for kind, known, number, docs in (
        ("word", pc.replace_substring(words.dictionary, _MARK, _D), words.indices.to_numpy(), of),
        ("pair", pa.array(_PAIRS), pairs, paired),
        ("code", held.dictionary, held.indices.to_numpy(), np.repeat(np.arange(len(codes)), [len(some) for some in codes])),
    ):
        met, places = _lists(number, place[docs])
        known = known.take(pa.array(met))
        for a in range(0, len(known), 5000):
            n = min(5000, len(known) - a)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([kind] * n), known.slice(a, n), places.slice(a, n), pa.nulls(n, pa.list_(pa.int64()))], names)
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array(["ids"]), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.array([np.array(ids)[order]], pa.list_(pa.int64()))], names)


def _grams(n: np.ndarray) -> np.ndarray:
    return (n[:-2] * len(_LETTERS) + n[1:-1]) * len(_LETTERS) + n[2:]


class Needles:
    """Terms of three characters or more, which are found in words by their rarest gram."""

    def __init__(self, needles: list[str]):
        marked = {n: n.replace(_D, _MARK).encode() for n in needles if len(n) > 2 and _MARK not in n}
        numbers = {n: _NUMBER[np.frombuffer(m, dtype=np.uint8)] for n, m in marked.items()}
        self.names = [n for n, x in numbers.items() if (x >= 0).all()]  # no word has other characters
        self.marked, grams = [marked[n].decode() for n in self.names], [_grams(numbers[n]) for n in self.names]
        self.edges = np.concatenate([[0], np.cumsum([len(g) for g in grams], dtype=np.int64)])
        self.grams = np.concatenate([np.empty(0, dtype=np.int64), *grams])

    def within(self, words: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """The number of each needle that some words contain, and which of them."""
        if not self.names:
            return
        words = pc.replace_substring(words, _D, _MARK)
        edges, raw = _flat(words)
        of = np.repeat(np.arange(len(words)), np.diff(edges))
        whole = of[2:] == of[:-2]  # words have three characters at least
        key = np.sort(_grams(_NUMBER[np.frombuffer(raw, dtype=np.uint8)])[whole] << 32 | of[:-2][whole])
        key = key[np.diff(key, prepend=-1) != 0]
        gram, of = key >> 32, key & 0xFFFFFFFF
        low, high = np.searchsorted(gram, self.grams), np.searchsorted(gram, self.grams, side="right")
        for k in np.flatnonzero(np.minimum.reduceat(high - low, self.edges[:-1])).tolist():
            a, b = self.edges[k], self.edges[k + 1]
            rarest = a + np.argmin(high[a:b] - low[a:b])
            found = of[low[rarest] : high[rarest]]
            if b - a > 1:
                found = found[pc.match_substring(words.take(pa.array(found)), self.marked[k]).to_numpy(zero_copy_only=False)]
            if len(found):
                yield k, found


def _runs(blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where equal values begin and end."""
    edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


class Best:
    """The k best chunks of a query so far: by falling score, then by rising id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0), np.empty(0, dtype=np.int64)

    def beaten_by(self, bound: float, least_id: int) -> bool:
        full = len(self.scores) == self.k
        return bound > 0 and (not full or bound > self.scores[-1] or (bound == self.scores[-1] and least_id < self.ids[-1]))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Block:
    """Which chunks of a block contain the queries' terms and have their codes: a row of flags for each of these that the block knows."""

    def __init__(self, ids: np.ndarray, names: list[str], flags: np.ndarray):
        """ids rise; flags has a row for each name."""
        self.ids, self.flags, self.row = ids, flags, {n: k for k, n in enumerate(names)}

    def search(self, terms: list[tuple[str, float]], codes: list[tuple[str, str]], best: Best) -> None:
        """terms and codes by the names of their rows; a code by the one in the metadata and the one in the text."""
        met = [(self.row[t], n) for t, n in terms if t in self.row]
        held = [(self.row.get(c), self.row.get(f)) for c, f in codes if c in self.row or f in self.row]
        bound = sum(n for _, n in met) + sum(CODE_IN_TEXT if c is None else CODE for c, _ in held)
        if not best.beaten_by(bound, int(self.ids[0])):
            return
        score = np.array([n for _, n in met]) @ self.flags[[r for r, _ in met]] if met else np.zeros(len(self.ids))
        for c, f in held:
            worth = np.zeros(len(self.ids)) if f is None else self.flags[f] * CODE_IN_TEXT
            score = score + (worth if c is None else np.where(self.flags[c], CODE, worth))
        least = best.scores[-1] if len(best.scores) == best.k else 0.0
        found = np.flatnonzero((score > 0) & (score >= least))
        if len(found) > best.k:  # of equal scores the first, which have the smallest ids
            found = found[np.argsort(-score[found], kind="stable")[: best.k]]
        best.add(score[found], self.ids[found])


def _asked(asked: list) -> tuple[list[tuple], dict[str, str], list[str]]:
    """Queries as Block.search() takes them, codes with their folded forms, and all terms and folded codes."""
    folded = {c: f for r in asked for c, f in zip(r["codes"], r["folded"], strict=True)}
    queries = [(k, [(f"word {t}", n * TERM) for t, n in Counter(r["terms"]).items()], [(f"code {c}", f"word {folded[c]}") for c in r["codes"]]) for k, r in enumerate(asked)]
    return queries, folded, sorted({t for r in asked for t in r["terms"]} | set(folded.values()))


def _found(spark: SparkSession, queries: DataFrame, answer, ids: str = "long") -> DataFrame:
    """query_id, chunk_id, score from what answer finds for the queries of a round, (number, chunk_id, score)."""
    codes: Column = document_codes("message")
    q = queries.select("query_id", lookup_terms("message").alias("terms"), codes.alias("codes")).withColumn("folded", F.transform("codes", fold)).where((F.size("terms") > 0) | (F.size("codes") > 0))
    kind = q.schema["query_id"].dataType.simpleString()
    rounds = max(1, -(-(q.agg(F.sum(F.size("terms"))).first()[0] or 0) // ROUND_TERMS))
    q = checkpointed(q) if rounds > 1 else q
    out = spark.createDataFrame([], f"query_id {kind}, chunk_id {ids}, score double")
    for r in range(rounds):
        asked = (q.where(F.pmod(F.xxhash64("query_id", "terms"), F.lit(rounds)) == r) if rounds > 1 else q).collect()  # a round's worth
        named = spark.createDataFrame([(n, x["query_id"]) for n, x in enumerate(asked)], f"number int, query_id {kind}")
        out = out.unionByName(answer(asked).join(F.broadcast(named), "number").select("query_id", "chunk_id", "score"))
    return out


def _answers(spark: SparkSession, queries: DataFrame, k: int, answer) -> DataFrame:
    """The k best of what answer finds, with their rank."""
    out = _found(spark, queries, answer)
    w = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sent(best: dict[int, Best]) -> Iterator[pa.RecordBatch]:
    for k, x in best.items():
        if len(x.ids):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(x.ids), pa.int32()), pa.array(x.ids), pa.array(x.scores)], ["number", "chunk_id", "score"])


def _blobs(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches, of about so many bytes of texts (the second column) at a time and 1024 at most."""
    for whole in batches:
        lengths = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
        a = held = 0
        for b, n in enumerate(lengths.tolist()):
            if b > a and (held + n > size or b - a == 1024):
                yield whole.slice(a, b - a)
                a, held = b, 0
            held += n
        if whole.num_rows > a:
            yield whole.slice(a)


def scan_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of all chunks with a score above 0; texts are folded and looked through once a round of queries, each needle once a text."""
    ids = chunks.schema["chunk_id"].dataType.simpleString()

    def answer(asked: list) -> DataFrame:
        questions, folded, needles = _asked(asked)
        broad = chunks.sparkSession.sparkContext.broadcast((questions, folded, needles))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions, folded, needles = broad.value
            row, codes = {f"word {n}": k for k, n in enumerate(needles)}, list(folded)
            at = {f"code {c}": k for k, c in enumerate(codes)}
            wanted, of_code = [n.encode() for n in needles], [row[f"word {folded[c]}"] for c in codes]
            by_term, by_code = np.zeros((len(questions), len(needles))), np.zeros((len(questions), len(codes)))
            for k, terms, of in questions:
                for t, n in terms:
                    by_term[k, row[t]] += n
                for c, _ in of:
                    by_code[k, at[c]] += 1
            for batch in _slices(batches):
                blobs = _blobs(batch.column(1))
                flags = np.array([[n in b for b in blobs] for n in wanted], dtype=bool).reshape(len(wanted), len(blobs))
                score = by_term @ flags
                if codes:
                    held = [set(x or ()) for x in batch.column(2).to_pylist()]
                    score += by_code @ np.where(np.array([[c in h for h in held] for c in codes], dtype=bool), CODE, flags[of_code] * CODE_IN_TEXT)
                number, place = np.nonzero(score > 0)
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), batch.column(0).take(pa.array(place)), pa.array(score[number, place])], ["number", "chunk_id", "score"])

        return chunks.select("chunk_id", fold("content").alias("blob"), "chunk_codes").mapInArrow(work, f"number int, chunk_id {ids}, score double")

    return _found(chunks.sparkSession, queries, answer, ids)


def scan_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """What KeywordIndex.topk() finds, of chunks that no index holds: their texts are folded and looked through once a round of queries."""

    def answer(asked: list) -> DataFrame:
        questions, folded, needles = _asked(asked)
        broad = chunks.sparkSession.sparkContext.broadcast((questions, list(folded), needles))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions, codes, needles = broad.value
            names, wanted = [*(f"word {n}" for n in needles), *(f"code {c}" for c in codes)], [n.encode() for n in needles]
            best: dict[int, Best] = {}
            for batch in _slices(batches):
                batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
                blobs, held = _blobs(batch.column(1)), [set(x or ()) for x in batch.column(2).to_pylist()]
                flags = np.array([[n in b for b in blobs] for n in wanted] + [[c in h for h in held] for c in codes], dtype=bool)
                some = flags.any(axis=1)
                block = Block(batch.column(0).to_numpy(), [n for n, x in zip(names, some, strict=True) if x], flags[some])
                for q, terms, of in questions:
                    block.search(terms, of, best.setdefault(q, Best(k)))
            yield from _sent(best)

        known = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), fold("content").alias("blob"), "chunk_codes")
        return known.mapInArrow(work, "number int, chunk_id long, score double")

    return _answers(chunks.sparkSession, queries, k, answer)


class KeywordIndex:
    """An index below a folder that driver and executors share; build() writes it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")

    @classmethod
    def build(cls, chunks: DataFrame, folder: str) -> KeywordIndex:
        """Indexes chunks (chunk_id, content, chunk_codes); those without an id are left out, null texts and codes are empty."""
        spark = chunks.sparkSession

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number, size = TaskContext.get().partitionId() << 32, 0
            ids: list[int] = []
            found: list[tuple] = []
            codes: list[list[str]] = []
            for batch in _slices(batches):
                while batch.num_rows:
                    some = batch.slice(0, BLOCK_CHUNKS - len(ids))
                    batch = batch.slice(some.num_rows)
                    words, of, paired, pairs = words_of(some.column(1))
                    found.append((words, of + len(ids), paired + len(ids), pairs))
                    ids += some.column(0).to_pylist()
                    codes += [[c for c in held or [] if c is not None] for held in some.column(2).to_pylist()]
                    size += some.column(1).nbytes
                    if len(ids) >= BLOCK_CHUNKS or size >= BLOCK_BYTES:
                        yield from _rows(number, ids, found, codes)
                        number, size, ids, found, codes = number + 1, 0, [], [], []
            if ids:
                yield from _rows(number, ids, found, codes)

        known = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "content", "chunk_codes")
        known.select("chunk_id", fold("content").alias("blob"), "chunk_codes").mapInArrow(work, POSTINGS).write.parquet(f"{folder}/postings")
        return cls(spark, folder)

    def _round(self, asked: list, top: int) -> DataFrame:
        """number, chunk_id, score of the best chunks of some queries: a task's, so that a query has top of them a task."""
        spark = self.spark
        questions, folded, needles = _asked(asked)
        queries = spark.sparkContext.broadcast(questions)
        wanted, none = [n for n in needles if len(n) > 2], lambda of: F.array().cast(of)  # an empty list, since null ones are slow to write to Python

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Needles(wanted)
            for whole in batches:
                for a, b in _runs(whole.column(0).to_numpy()):
                    batch = whole.slice(a, b - a)
                    met, lists = [], []
                    for k, found in known.within(batch.column(1).cast(pa.string())):
                        met.append(f"word {known.names[k]}")
                        lists.append(np.unique(batch.column(2).take(pa.array(found)).flatten().to_numpy()))
                    if met:
                        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[0].as_py()] * len(met), pa.int64()), pa.array(met), pa.array(lists, pa.list_(pa.int32()))], ["block", "name", "places"])

        met = self.postings.where("kind = 'word'").select("block", "word", "places").mapInArrow(look, "block long, name string, places array<int>").withColumn("ids", none("array<long>"))
        of = lambda kind, some: self.postings.where(F.col("kind") == kind).join(F.broadcast(spark.createDataFrame([(x,) for x in some], "word string")), "word", "left_semi").select("block", F.concat(F.lit("word " if kind == "pair" else "code "), "word").alias("name"), "places", none("array<long>").alias("ids"))
        rows = met.unionByName(of("pair", [n for n in needles if len(n) == 2])).unionByName(of("code", folded)).unionByName(self.postings.where("kind = 'ids'").select("block", F.lit("").alias("name"), none("array<int>").alias("places"), "ids"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}

            def answer(held: list[pa.RecordBatch]) -> None:
                t = pa.Table.from_batches(held).combine_chunks()
                column = lambda c: t.column(c).chunk(0)
                names = column("name").dictionary_encode()
                known = names.dictionary.to_pylist()
                if len(known) < 2:  # the ids alone
                    return
                lists, ids, which = column("places"), column("ids").flatten().to_numpy(), names.indices.to_numpy()
                flags = np.zeros((len(known), len(ids)), dtype=bool)
                flags[np.repeat(which, pc.list_value_length(lists)), lists.flatten().to_numpy()] = True
                block = Block(ids, known, flags)
                for k, terms, codes in queries.value:
                    block.search(terms, codes, best.setdefault(k, Best(top)))

            held: list[pa.RecordBatch] = []
            for batch in batches:
                blocks = batch.column(0).to_numpy()
                for a, b in _runs(blocks):
                    if held and held[0].column(0)[0].as_py() != blocks[a]:
                        answer(held)
                        held = []
                    held.append(batch.slice(a, b - a))
            if held:
                answer(held)
            yield from _sent(best)

        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(work, "number int, chunk_id long, score double")

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, score, rank: the k best chunks of each query (query_id, message) with a score above 0, ties by chunk_id.

        Queries are answered in rounds of about ROUND_TERMS terms, whose terms and best chunks go to all tasks.
        """
        return _answers(self.spark, queries, k, lambda asked: self._round(asked, k))
