"""Operator 9: language-model scoring with a Katz backoff model of any order from 2 on, trigrams by default.

Counts of n-grams are gathered over all training documents. N-grams seen up to K times are discounted by Good-Turing, each order by its own
counts of counts. What that takes from a context is given to the words not seen after it, by the model of the next lower order, with a weight
per context that makes every context sum to one; the lowest order are unigrams with half a count added. A text's n-grams are padded in front.

Texts are read once and kept as blocks of packed tokens; a long text goes over several blocks, each with the words before its own. The tables
of n-grams and of contexts are partitioned by ranges of hashes. A block sends each part its distinct n-grams with its own counts, packed, and
gets their counts over all blocks back in the same order. From trigrams on, order after order, it asks only where the two shorter n-grams
inside leave the count open: it is no more than theirs. One block owns each n-gram and adds it to the sums of its context: discounted counts,
and the discounted counts of the same words one order below. Sums are kept for contexts that texts not learnt from hold, and for those that
may have no n-gram to discount. Blocks ask for the sums of the contexts that they need, and evaluate their tokens from the unigrams upwards.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drop_folder, let_go, mix, raw_texts, shared_folder, word_hashes

#: N-grams seen more often than this are not discounted. Words of the longest n-gram. Tokens of a block; n-grams of all blocks in a part of their table.
K, ORDER, BLOCK_TOKENS, PART_KEYS = 5, 3, 1_200_000, 2_000_000
#: Discounted counts are multiples of this, so that their sums are exact in any order.
STEP = 1 / 1024
#: Hashes that stand for the end of a text, and for what precedes its beginning.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Kinds of rows: counts of n-grams by their words less one, sums of contexts from CONTEXTS on, and the block itself after the answers to it.
CONTEXTS, BLOCK = 50, 99


def tokens_of(raw: bytes | None) -> np.ndarray:
    return np.concatenate([word_hashes(raw, lower=True), [END]])


def longer(w: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Hashes of n-grams of k + 1 words, from those of their last k and the word in front."""
    return mix(w * np.uint64(0x9E3779B97F4A7C15) ^ (key + np.uint64(0x632BE59BD9B4E019 * k % 2**64)))


def gram_keys(t: np.ndarray, place: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each order from 1 on, the hash of the n-gram that ends at each token; place: the token's place in its text."""
    key = t
    yield key
    for k in range(1, order):
        w = np.full(len(t), START)
        w[k:] = np.where(place[k:] >= k, t[:-k], START)
        key = longer(w, key, k)
        yield key


def padding_keys(order: int) -> list[np.uint64]:
    """The hash of 1, 2, ... starts: the contexts of a first token."""
    run = np.full(1, START)
    out = [run]
    for k in range(1, order - 1):
        out.append(longer(run, out[-1], k))
    return [x[0] for x in out]


def discounts(of_counts: list[int], k: int = K) -> np.ndarray:
    """The discounted counts of n-grams seen 0 to k times, of the numbers of n-grams seen r times (from 0 on): Katz's form, so that the mass of unseen ones is the Good-Turing estimate.

    Where these numbers don't fall as they should (few data), half a count is taken. Something is taken always, and something stays.
    """
    n = [0.0, *[float(x) for x in of_counts[1 : k + 2]]]
    n += [0.0] * (k + 2 - len(n))
    out = np.zeros(k + 1)
    far = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        share = ((r + 1) * n[r + 1] / (r * n[r]) - far) / (1 - far) if n[r] and far < 1 else 0.0
        x = round(share * r / STEP) * STEP
        out[r] = x if 0 < x < r else r - 0.5
    return out


def worth(r: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(r <= K, cut[np.minimum(r, K)], r)


def squeeze(x: np.ndarray) -> bytes:
    """An array's bytes by place, compressed: high bytes of small numbers take no room."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def loosen(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes, by their distances."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def loosen_keys(data: bytes) -> np.ndarray:
    return np.cumsum(loosen(data, np.uint64), dtype=np.uint64)


def ranges(keys: np.ndarray, parts: int) -> dict[int, slice]:
    """Where the keys of each part are among ascending ones."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
    return {int(part[lo]): slice(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi > lo}


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of sorted batches, those of one key together; a key's rows are few and packed, and no more than one key is held."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def record(schema: pa.Schema, **row) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=schema)


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_I, _B = pa.int64(), pa.binary()
ASKED = _schema(kind=_I, part=_I, chain=_I, block=_I, keys=_B, n=_B, singles=_I)
COUNTED = _schema(kind=_I, part=_I, chain=_I, block=_I, answer=_B, seen=pa.list_(_I), total=_I)
ADDED = _schema(kind=_I, part=_I, chain=_I, block=_I, keys=_B, kept=_B, below=_B, asked=_B)
SUMMED = _schema(kind=_I, part=_I, chain=_I, block=_I, answer=_B, more=_B)
PACKED = ("words", "sizes", "lead", "train", "tokens")


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == _I else 'binary' if f.type == _B else 'array<long>'}" for f in schema)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS) -> DataFrame:
    """A row for each row of docs: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text and its end).

    training is an expression over the id. base_score: unigrams with half a count added. score: the Katz model of the given order over them.
    Null and empty texts are scored as their end alone. Repeated rows count as often as they come; a null id is scored, and learnt from if
    training says so. Other columns are not read, texts may have any length. An empty table gives an empty one. With nothing to learn from,
    both scores are those of one class that holds every token.
    """
    if order < 2:
        raise ValueError("the order of a backoff model is 2 or more")
    kind, spark = docs.schema[id_col].dataType.simpleString(), docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    folder = f"{shared_folder(spark)}/katz-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def in_parts(df: DataFrame, parts: int) -> DataFrame:
        return df.repartition(parts, "kind", "part").sortWithinPartitions("kind", "part", "block")

    block_ddl = "chain long, block long, n_words long, n_tokens long, n_learnt long, ids array<%s>, %s" % (kind, ", ".join(f"{c} binary" for c in PACKED))
    packed = written(d.mapInArrow(lambda b: pack_blocks(b, order, block_tokens), block_ddl), "blocks")
    blocks, *sums = packed.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens", "n_learnt")]).first()
    words, tokens, learnt = sums
    parts = [max(1, math.ceil(n / part_keys)) for n in [words, *[tokens] * (order - 1)]]

    def with_answers(*answers: DataFrame) -> DataFrame:
        """Blocks after the answers to them; blocks that share a text in one task, in order. More tasks than blocks, so that few get several."""
        rows = packed.select("chain", "block", F.lit(BLOCK).cast("long").alias("kind"), "ids", *PACKED)
        for a in answers:
            rows = rows.unionByName(a.drop("seen", "total"), allowMissingColumns=True)
        columns = [c for c in ("chain", "block", "kind", "part", "answer", "more", "ids", *PACKED) if c in rows.columns]
        return rows.select(columns).repartition(max(1, 3 * blocks), "chain").sortWithinPartitions("chain", "block", "kind", "part")

    def counted(keys: DataFrame, parts: int, name: str) -> DataFrame:
        return written(in_parts(keys, parts).mapInArrow(count_keys, ddl(COUNTED)), name)

    counts = counted(packed.select("chain", "block", *PACKED).mapInArrow(lambda b: ask_counts(b, parts[:2]), ddl(ASKED)), sum(parts[:2]), "counts-2")
    for k in range(2, order):
        let_go(spark)  # the shuffle of the order below
        asked = with_answers(counts).mapInArrow(lambda b, k=k: ask_open_counts(b, k, parts[k], learnt), ddl(ASKED))
        counts = counts.unionByName(counted(asked, parts[k], f"counts-{k + 1}"))
        del asked
    let_go(spark)
    of_kind = {r["kind"]: [int(x or 0) for x in r[1:]] for r in counts.groupBy("kind").agg(F.sum("total"), *[F.sum(F.col("seen")[r]) for r in range(K + 3)]).collect()}  # a row for each order
    total, _, *of_words = of_kind.get(0, [0, 0])
    below = total + 0.5 * (sum(of_words) + 1)  # one more for all words that training documents lack
    cuts = [discounts(of_kind.get(k, [0])[1:]) for k in range(order)]

    added = with_answers(counts).mapInArrow(lambda b: add_contexts(b, cuts, parts, learnt), ddl(ADDED))
    contexts = written(in_parts(added, sum(parts[1:])).mapInArrow(sum_contexts, ddl(SUMMED)), "contexts")
    del added
    let_go(spark)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    scored = with_answers(counts, contexts).mapInArrow(lambda b: finish(b, cuts, learnt, below, total, names), f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = checkpointed(scored.withColumnRenamed("id", id_col))
    drop_folder(spark, folder)
    return out


def pack_blocks(batches: Iterator[pa.RecordBatch], order: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """A row for each block of so many tokens or a task's rest: ids, distinct words (frequent ones first), sizes of texts, and their tokens as places among the words.

    A text that goes over blocks has in each later one, ahead of its tokens there, the last order - 1 of those before (lead); chain is the block where it begins.
    """
    task, made, chain = TaskContext.get().partitionId() << 32, 0, None
    ids, tokens, lead, train, size, id_type = [], [], [], [], 0, None

    def block() -> pa.RecordBatch:
        nonlocal chain
        chain = task + made if chain is None or not lead[0] else chain
        t, sizes = np.concatenate(tokens), np.array([len(x) for x in tokens], dtype=np.uint32)
        words, local, n = np.unique(t, return_inverse=True, return_counts=True)
        by_count = np.argsort(-n, kind="stable")
        place = np.empty(len(words), dtype=np.uint32)
        place[by_count] = np.arange(len(words), dtype=np.uint32)
        leads, learn = np.array(lead, dtype=np.uint8), np.array(train, dtype=np.uint8)
        arrays = dict(zip(PACKED, map(squeeze, (words[by_count], sizes, leads, learn, place[local])), strict=True))
        counts = {"n_words": len(words), "n_tokens": len(t), "n_learnt": int((learn & (leads == 0)).sum())}
        schema = _schema(chain=_I, block=_I, n_words=_I, n_tokens=_I, n_learnt=_I, ids=pa.list_(id_type), **dict.fromkeys(PACKED, _B))
        return record(schema, chain=chain, block=task + made, ids=ids, **counts, **arrays)

    for batch in batches:
        id_type = batch.column(0).type
        for i, raw, learn in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            t, at = tokens_of(raw), 0
            while at < len(t):
                ahead, to = min(at, order - 1), min(len(t), at + block_tokens - size)
                ids.append(i)
                tokens.append(t[at - ahead : to])
                lead.append(ahead)
                train.append(learn)
                size, at = size + to - at, to
                if size >= block_tokens:
                    yield block()
                    ids, tokens, lead, train, size, made = [], [], [], [], 0, made + 1
    if ids:
        yield block()


class Tokens:
    """A block unpacked: t, sizes and firsts of its texts, place of each token in its text, own (not a lead), taught (of a training text)."""

    def __init__(self, row: dict):
        self.t, self.sizes = loosen(row["words"], np.uint64)[loosen(row["tokens"], np.uint32)], loosen(row["sizes"], np.uint32).astype(np.int64)
        self.lead = loosen(row["lead"], np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.place = (np.arange(len(self.t)) - np.repeat(self.first, self.sizes)).astype(np.uint32)
        self.own = self.place >= np.repeat(self.lead, self.sizes)
        self.taught = np.repeat(loosen(row["train"], np.uint8) == 1, self.sizes)

    def before(self, x: np.ndarray, start) -> np.ndarray:
        """What x says of the token before; start for the first of a text."""
        out = np.concatenate([x[:1], x[:-1]])
        out[self.first] = start
        return out


def questions(b: Tokens, row: dict, kind: int, x: np.ndarray, which: np.ndarray | slice, parts: int, singles: int = 0) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams among x (kind: words less one) in ascending order, cut by ranges into parts; n: twice how often the block's training texts hold them, plus one if others do."""
    keys, inverse = np.unique(x[which], return_inverse=True)
    n = np.bincount(inverse, weights=(b.own & b.taught)[which], minlength=len(keys)).astype(np.uint32) * np.uint32(2)
    n[inverse[(b.own & ~b.taught)[which]]] |= np.uint32(1)
    for part, s in ({0: slice(0, 0)} | ranges(keys, parts)).items():
        yield record(ASKED, kind=kind, part=part, chain=row["chain"], block=row["block"], keys=squeeze_keys(keys[s]), n=squeeze(n[s]), singles=0 if part else singles)


def ask_counts(batches: Iterator[pa.RecordBatch], parts: list[int]) -> Iterator[pa.RecordBatch]:
    """All n-grams of as many orders as there are parts."""
    for batch in batches:
        for row in batch.to_pylist():
            b = Tokens(row)
            for kind, x in enumerate(gram_keys(b.t, b.place, len(parts))):
                yield from questions(b, row, kind, x, slice(None), parts[kind])


def ask_open_counts(batches: Iterator[pa.RecordBatch], kind: int, parts: int, learnt: int) -> Iterator[pa.RecordBatch]:
    """N-grams of one order whose counts the order below leaves open, and how many are known to be seen once."""
    for row, told in answered(batches):
        b, below = Tokens(row), None
        for below in levels(b, told, kind, learnt):
            pass
        *_, x = gram_keys(b.t, b.place, kind + 1)
        is_open, single = undecided(b, below.count, below.elsewhere, learnt)
        yield from questions(b, row, kind, x, is_open, parts, int((single & b.own).sum()))


def undecided(b: Tokens, count: np.ndarray, elsewhere: np.ndarray, learnt: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-grams at the tokens, from the counts one order below: those to ask for, and those seen once, here.

    An n-gram is seen no more often than either of the shorter ones inside. Where that is once, a training text holds it here; nobody else asks
    for it unless other texts hold both.
    """
    most = np.minimum(b.before(count, learnt), count)
    is_open = (most > 1) | ((most == 1) & (~b.taught | (b.before(elsewhere, True) & elsewhere)))
    return is_open, (most == 1) & ~is_open


def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each n-gram that a block asked for, in its order: four times the count over all training texts, plus two if other texts hold it, plus one in the one block that owns it.

    Once for each part, seen: how many have each count up to K + 1, and more; total: the sum of all counts."""
    for rows in groups_of(batches, ["kind", "part"]):
        each = [loosen_keys(r["keys"]) for r in rows]
        n = np.concatenate([loosen(r["n"], np.uint32) for r in rows]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(each), return_inverse=True)
        n, other = n >> 1, n & 1
        counts, elsewhere = np.bincount(inverse, weights=n).astype(np.int64), np.bincount(inverse, weights=other) > 0
        holds = np.flatnonzero(n)
        answer = counts[inverse].astype(np.uint64) * np.uint64(4) + elsewhere[inverse].astype(np.uint64) * np.uint64(2)
        answer[holds[np.unique(inverse[holds], return_index=True)[1]]] += np.uint64(1)
        seen, at = np.bincount(np.minimum(counts, K + 2), minlength=K + 3), 0
        seen[1] += sum(r["singles"] for r in rows)
        for k, (r, keys) in enumerate(zip(rows, each, strict=True)):
            once = {} if k else {"seen": seen.tolist(), "total": int(n.sum())}
            yield record(COUNTED, kind=r["kind"], part=r["part"], chain=r["chain"], block=r["block"], answer=squeeze(answer[at : at + len(keys)]), **once)
            at += len(keys)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[int, list[dict]]]]:
    """Blocks with the answers that precede them, by kind."""
    told: dict[int, list[dict]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            if row["kind"] == BLOCK:
                yield row | {"ids": batch.column("ids")[i].values}, told
                told = {}
            else:
                told.setdefault(row["kind"], []).append(row)


class Level:
    """An order at the tokens of a block.

    count: of the n-gram that ends there; elsewhere: whether texts not learnt from hold it; owned: places of one token for each n-gram that the
    block owns. context: hash of what comes before the last word; context_count; needs: which tokens need the context's sums; kept: for which
    contexts sums are kept. The last four are for orders from 2 on.
    """

    def __init__(self, count: np.ndarray, elsewhere: np.ndarray, owned: np.ndarray):
        self.count, self.elsewhere, self.owned = count, elsewhere, owned

    def above(self, b: Tokens, below: Level, key: np.ndarray, start: np.uint64, learnt: int) -> None:
        """key: hashes of the order below."""
        self.context, self.context_count = b.before(key, start), b.before(below.count, learnt)
        # a context with an n-gram that is discounted has room for others; what it leaves is needed where its word is new
        self.needs = b.own & (self.context_count > 0) & ((self.count == 0) | (self.count > K))
        self.kept = b.before(below.elsewhere, True) | (self.context_count > K)


def levels(b: Tokens, told: dict[int, list[dict]], order: int, learnt: int) -> Iterator[Level]:
    """The orders from 1 on, from the answers to a block."""
    starts, below, last = [np.uint64(0), *padding_keys(order)], None, None
    for k, key in enumerate(gram_keys(b.t, b.place, order)):
        which, single = undecided(b, below.count, below.elsewhere, learnt) if k > 1 else (np.ones(len(key), dtype=bool), None)
        answer = np.concatenate([loosen(r["answer"], np.uint64) for r in told[k]])
        keys, at, inverse = np.unique(key[which], return_index=True, return_inverse=True)
        if len(keys) != len(answer):
            raise ValueError("a block's n-grams and their answers differ")
        count, elsewhere = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
        count[which], elsewhere[which] = (answer >> np.uint64(2)).astype(np.int64)[inverse], ((answer >> np.uint64(1)) & np.uint64(1)).astype(bool)[inverse]
        owned = np.flatnonzero(which)[at[(answer & np.uint64(1)).astype(bool)]]
        if k > 1:
            count[single] = 1
            owned = np.concatenate([owned, np.flatnonzero(single & b.own)])
        level = Level(count, elsewhere, owned)
        if k:
            level.above(b, below, last, starts[k], learnt)
        yield level
        below, last = level, key


def add_contexts(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], parts: list[int], learnt: int) -> Iterator[pa.RecordBatch]:
    """For each order from 2 on, cut by ranges into parts: the block's contexts with the sums of the n-grams that it owns, and the contexts it asks for."""
    for row, told in answered(batches):
        b, lower = Tokens(row), None
        for k, level in enumerate(levels(b, told, len(cuts), learnt)):
            if k:
                owned = level.owned[level.kept[level.owned]]
                keys, inverse = np.unique(level.context[owned], return_inverse=True)
                less = lower[owned] + 0.5 if k == 1 else worth(lower[owned], cuts[k - 1])
                kept, below = (np.bincount(inverse, weights=x, minlength=len(keys)).astype(np.float64) for x in (worth(level.count[owned], cuts[k]), less))
                asked = np.unique(level.context[level.needs])
                mine, wanted = ranges(keys, parts[k]), ranges(asked, parts[k])
                for part in sorted(mine.keys() | wanted.keys()):
                    m, w = mine.get(part, slice(0, 0)), wanted.get(part, slice(0, 0))
                    yield record(ADDED, kind=k, part=part, chain=row["chain"], block=row["block"], keys=squeeze_keys(keys[m]), kept=squeeze(kept[m]), below=squeeze(below[m]), asked=squeeze_keys(asked[w]))
            lower = level.count


def sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each context that a block asked for, in its order: the sums over all blocks."""
    for rows in groups_of(batches, ["kind", "part"]):
        each = [(loosen_keys(r["keys"]), loosen(r["kept"], np.float64), loosen(r["below"], np.float64)) for r in rows]
        keys, inverse = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([x[i] for x in each]), minlength=len(keys)) for i in (1, 2)]
        for r in rows:
            at = np.searchsorted(keys, loosen_keys(r["asked"]))
            if len(at):
                yield record(SUMMED, kind=CONTEXTS + r["kind"], part=r["part"], chain=r["chain"], block=r["block"], answer=squeeze(sums[0][at]), more=squeeze(sums[1][at]))


def finish(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], learnt: int, below: float, total: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Evaluates the tokens of each block, order by order, and adds them up by text; the last text of a block may go on in the next one."""
    last = None
    for row, told in answered(batches):
        b = Tokens(row)
        room = p = base = known = count = None
        for k, level in enumerate(levels(b, told, len(cuts), learnt)):
            count = level.count
            if not k:
                room, p, known = np.full(len(count), below), (count + 0.5) / below, count > 0
                base = np.log10(p)
                continue
            context = level.context_count.astype(np.float64)
            left, more = np.ones(len(context)), np.ones(len(context))
            if level.needs.any():
                kept, less = (np.concatenate([loosen(r[c], np.float64) for r in told[CONTEXTS + k]]) for c in ("answer", "more"))
                _, at = np.unique(level.context[level.needs], return_inverse=True)
                kept, less, c = kept[at], less[at], context[level.needs]
                # a context whose n-grams are all too frequent for a discount gets half a count for what it has not seen
                c = c + np.where(kept >= c, 0.5, 0.0)
                # exactly what its n-grams leave, over what the same words leave one order below
                left[level.needs], more[level.needs] = 1 - kept / c, 1 - less / room[level.needs]
                context[level.needs] = c
            seen, has = count > 0, level.context_count > 0
            p[has & ~seen] *= left[has & ~seen] / np.maximum(more[has & ~seen], np.finfo(float).tiny)
            p[seen] = worth(count[seen], cuts[k]) / context[seen]
            room = context
        own = b.own
        add = lambda x: np.add.reduceat(np.where(own, x, np.zeros(1, dtype=x.dtype)), b.first)
        sums = [add(np.ones(len(own), dtype=np.int64)), add(known.astype(np.int64)), add(base), add(np.log10(p))]
        ids = row["ids"]
        if last is not None and b.lead[0]:
            for s, x in zip(sums, last[1], strict=True):
                s[0] += x[0]
        elif last is not None:
            yield rows_of(*last, total, names)
        if len(ids) > 1:
            yield rows_of(ids[:-1], [s[:-1] for s in sums], total, names)
        last = [ids[-1:], [s[-1:] for s in sums]]
    if last is not None:
        yield rows_of(*last, total, names)


def rows_of(ids: pa.Array, sums: list[np.ndarray], total: int, names: list[str]) -> pa.RecordBatch:
    n_tokens, n_known, base, katz = map(pa.array, sums)
    return pa.RecordBatch.from_arrays([ids, n_tokens, n_known, pa.array(np.full(len(ids), total)), base, katz], ["id", *names])
