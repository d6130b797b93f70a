"""Operator 13: repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every window of LENGTH bytes holds an anchor: of its grams of half that length the one of the least hash, the rightmost of equals, so that equal
windows have their anchors at the same place. Only suffixes at anchors whose gram occurs again are sorted; each reaches as far as the windows
that chose it, and carries the bytes ahead of it as the end of its sort key.

A task sorts its suffixes in runs; of equal ones a single one is kept with the places of all. Runs are front-coded (the length shared with the suffix
before, and the rest), cut at splitters from a bounded sample and exchanged. A range merges its runs by a loser tree whose entries hold what they
share with the last winner: suffixes that share different lengths are told apart without a look at their bytes, and those that share as much
are compared behind it. Neighbours that share less than a gram part the sorted suffixes into groups; in a group windows are compared by the hashes of what
is left and right of the anchor. A prefix that takes up several ranges of the sample is dealt over them by the run, and its windows are counted over
all ranges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import _BASES, _BYTE, _powers_of, checkpointed, let_go, mix, raw_texts

#: Bytes of a window; suffixes of a run; samples of a range, and their bytes; anchors that are looked at together; suffixes whose windows are.
LENGTH, RUN_ROWS, SAMPLES, PREFIX, SETTLED_ROWS, GROUP_ROWS = 400, 40_000, 16, 64, 500_000, 4096
#: Windows of a long text that are hashed at once.
PIECE = 1 << 20
#: What a batch knows of a gram: it was seen once; it was seen again, and this row tells other batches so; it was seen again.
OPEN, TELLS, SURE = range(3)


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors' grams, and their places: anchor, bytes from the first window that chose it, windows that chose it less one (12 bits each)."""
    n, gram = len(raw) - length + 1, length // 2
    grams, places, firsts = [], [], []
    for begin in range(0, max(n, 0), PIECE):
        windows = min(PIECE, n - begin)
        b = np.frombuffer(raw, dtype=np.uint8, count=windows + length - 1, offset=begin)
        up, down = _powers_of(_BASES[0], len(b) + 1)
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
        g = mix((sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1])
        least = (g & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - np.arange(len(g), dtype=np.uint64))
        size, wide = 1, length - gram + 1
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:windows], least[wide - size : wide - size + windows])
        place = 0xFFFFFF - (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        grams.append(g[place[first]])
        places.append(place[first] + begin)
        firsts.append(first + begin)
    if not grams:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    grams, places, firsts = map(np.concatenate, (grams, places, firsts))
    new = np.concatenate([[True], places[1:] != places[:-1]])  # an anchor may serve two pieces
    grams, places, firsts = grams[new], places[new], firsts[new]
    count = np.diff(np.concatenate([firsts, [n]]))
    return grams, places << 24 | (places - firsts) << 12 | (count - 1)


def settle_grams(gram: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of a batch with what it knows of each in the last two bits of at. Of grams seen again one row keeps the gram, the others get a key of their own."""
    order = np.lexsort((at, key, gram))
    gram, key, at = gram[order], key[order], at[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    again = ~new | np.concatenate([gram[1:] == gram[:-1], [False]])
    code = np.where(~again, OPEN, np.where(new, TELLS, SURE))
    alone = mix(mix(key.view(np.uint64)) + at.astype(np.uint64)).view(np.int64)
    return np.where(code == SURE, alone, gram), key, at * 4 + code


def compare(x: bytes, y: bytes, known: int) -> tuple[int, bool]:
    """The length that two strings share, of which a part is known, and whether x is not behind y."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n, len(x) <= len(y)
    shared = n - (((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) >> 3)
    return shared, x[shared] < y[shared]


def merge(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Sorted runs of (string, length shared with the one before in its run, payload) as one, each with the length shared with the one before in the output.

    A loser tree: a node holds the run that lost there and what its string shares with the last winner that passed. The string that shares more
    with the last output is smaller; only strings that share equally much are compared, behind what they share.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    done: tuple[bytes, int, object] = (b"", -1, None)
    heads = [next(r, done) for r in runs] + [done] * (size - len(runs))
    strings, shared = [h[0] for h in heads], [min(h[1], 0) for h in heads]
    losers = [0] * size

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if shared[a] != shared[b] or shared[a] < 0:
            return (a, b) if shared[a] >= shared[b] else (b, a)
        common, first = compare(strings[a], strings[b], shared[a])
        winner, loser = (a, b) if first else (b, a)
        shared[loser] = common
        return winner, loser

    level = list(range(size))
    node = size
    while len(level) > 1:
        node >>= 1
        pairs = [duel(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        losers[node : node + len(pairs)] = [loser for _, loser in pairs]
        level = [winner for winner, _ in pairs]
    winner = level[0]
    while shared[winner] >= 0:
        yield strings[winner], shared[winner], heads[winner][2]
        head = next(runs[winner], done)
        heads[winner], strings[winner], shared[winner] = head, head[0], head[1]
        node = (winner + size) >> 1
        while node:
            other = losers[node]
            a, b = shared[winner], shared[other]
            if b > a:
                losers[node], winner = winner, other
            elif a == b and a >= 0:
                winner, losers[node] = duel(winner, other)
            node >>= 1


def front_coded(entries: list[tuple[bytes, int, list[tuple[int, int]]]]) -> dict[str, list]:
    """Sorted (string, bytes of it from the anchor on, places) as columns: shared lengths, rests, and the places one behind the other."""
    out: dict[str, list] = {"shared": [], "rest": [], "after": [], "copies": [], "keys": [], "ats": []}
    before = b""
    for string, after, places in entries:
        shared = compare(before, string, 0)[0]
        out["shared"].append(shared)
        out["rest"].append(string[shared:])
        out["after"].append(after)
        out["copies"].append(len(places))
        out["keys"] += [k for k, _ in places]
        out["ats"] += [a for _, a in places]
        before = string
    return out


def decoded(row: dict[str, list]) -> Iterator[tuple[bytes, int, tuple[int, list[tuple[int, int]]]]]:
    """The suffixes of a front-coded run, as merge() takes them."""
    string, at = b"", 0
    for shared, rest, after, n in zip(row["shared"], row["rest"], row["after"], row["copies"], strict=True):
        string = string[:shared] + rest
        yield string, shared, (after, list(zip(row["keys"][at : at + n], row["ats"][at : at + n], strict=True)))
        at += n


RUN = "range int, run long, shared array<int>, rest array<binary>, after array<int>, copies array<int>, keys array<long>, ats array<long>"


def ranges_of(prefix: bytes, splitters: list[bytes], run: int) -> int:
    """The range of a suffix; prefixes that are several splitters are dealt over the ranges between these, all of a run to the same."""
    low, high = bisect_left(splitters, prefix), bisect_right(splitters, prefix)
    return low + 1 + run % (high - low) if high > low else high


class Windows:
    """Compares the windows of suffixes, given in whole groups; sends the byte ranges that repeat and what must be counted over all ranges."""

    def __init__(self, length: int):
        self.length, self.held = length, []
        self.up, _ = _powers_of(_BASES[0], length + 1)

    def add(self, group: list[tuple[bytes, int, list[tuple[int, int]]]], hot: bool) -> None:
        if hot or len(group) > 1 or len(group[0][2]) > 1:
            self.held += [(string, after, places, hot) for string, after, places in group]

    def _hashes(self, parts: list[bytes], width: int) -> np.ndarray:
        """Hashes of all prefixes of each string."""
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(-1, width)
        sums = np.zeros((len(parts), width + 1), dtype=np.uint64)
        np.cumsum(_BYTE[padded] * self.up[:width], axis=1, out=sums[:, 1:])
        return sums

    def _chunk(self, held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix, bytes ahead of the anchor and hash of each window of some suffixes."""
        at = np.array([places[0][1] for _, _, places, _ in held])
        most, count = at >> 12 & 0xFFF, (at & 0xFFF) + 1
        right = self._hashes([s[:after] for s, after, _, _ in held], self.length)
        left = self._hashes([s[after:] for s, after, _, _ in held], self.length - self.length // 2)
        row = np.repeat(np.arange(len(held)), count)
        ahead = np.repeat(most + np.cumsum(count) - count, count) - np.arange(count.sum())
        h = mix(mix(left[row, ahead] + ahead.astype(np.uint64)) + right[row, self.length - ahead])
        return row, ahead, h

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        held, self.held = self.held, []
        rows, aheads, hashes = [], [], []
        for a in range(0, len(held), 1024):
            row, ahead, h = self._chunk(held[a : a + 1024])
            rows.append(row + a)
            aheads.append(ahead)
            hashes.append(h)
        row, ahead, h = map(np.concatenate, (rows, aheads, hashes))
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        copies = np.array([min(2, len(places)) for _, _, places, _ in held])
        repeats = (np.bincount(back, weights=copies[row]) >= 2)[back]
        hot = np.array([x for *_, x in held])[row]
        keys, begins, ends = [], [], []
        found = np.flatnonzero(repeats)
        cut = np.flatnonzero((row[found][1:] != row[found][:-1]) | (ahead[found][1:] != ahead[found][:-1] - 1)) + 1
        for some in np.split(found, cut) if len(found) else []:  # windows one behind the other
            for key, at in held[row[some[0]]][2]:
                keys.append(key)
                begins.append((at >> 24) - int(ahead[some[0]]))
                ends.append((at >> 24) - int(ahead[some[-1]]) + self.length)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.nulls(len(keys), pa.int64())], ["key", "begin", "end", "hash"])
        if hot.any():
            tells = np.zeros(len(h), dtype=bool)
            tells[first] = True
            told, single = np.flatnonzero(hot & tells & repeats), np.flatnonzero(hot & ~repeats)
            places = [held[r][2][0] for r in row[single].tolist()]
            begin = np.array([a >> 24 for _, a in places], dtype=np.int64) - ahead[single]
            none = pa.nulls(len(told), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(h[told].view(np.int64))], ["key", "begin", "end", "hash"])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in places], pa.int64()), pa.array(begin), pa.array(begin + self.length), pa.array(h[single].view(np.int64))], ["key", "begin", "end", "hash"])


def _candidates(known: DataFrame, length: int) -> DataFrame:
    """key, ats: the anchors of each document whose gram occurs again."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in settle_grams(*map(np.concatenate, zip(*held, strict=True)))], ["gram", "key", "at"])

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                gram, at = anchors(raw, length)
                if len(at):
                    held.append((gram.view(np.int64), np.full(len(at), key, dtype=np.int64), at))
                    size += len(at)
                if size >= SETTLED_ROWS:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    rows = known.mapInArrow(seeds, "gram long, key long, at long")
    again = (F.count(F.lit(1)).over(W.Window.partitionBy("gram")) > 1) | (F.col("at").bitwiseAND(3) != OPEN)
    return checkpointed(rows.withColumn("again", again).where("again").groupBy("key").agg(F.collect_list(F.shiftright("at", 2)).alias("ats")))


def _splitters(known: DataFrame, marks: DataFrame, ranges: int, prefix: int) -> list[bytes]:
    """The first bytes, prefix of them, of suffixes that part all of them into about equal ranges: of a sample of SAMPLES a range."""
    total = marks.agg(F.sum(F.size("ats"))).first()[0] or 0
    if not total or ranges < 2:
        return []
    share = min(1.0, SAMPLES * ranges / total)
    drawn = marks.select("key", F.explode("ats").alias("at")).sample(share, 11)  # about SAMPLES rows a range
    place = F.shiftright("at", 24).cast("int") + 1
    prefixes = known.join(F.broadcast(drawn), "key").select(F.substring(F.encode("text", "utf-8"), place, F.lit(prefix)).alias("p")).collect()
    found = sorted(bytes(r["p"]) for r in prefixes)
    return [found[k * len(found) // ranges] for k in range(1, ranges)] if found else []


def _repeats(known: DataFrame, marks: DataFrame, ranges: int, length: int) -> DataFrame:
    """key, begin, end of what repeats, with hash null; and windows that must be counted over all ranges, with their hash, and with null places where one range knows the answer."""
    spark = known.sparkSession
    gram, prefix = length // 2, min(PREFIX, length // 2)  # all of a group share the prefix, so no group lies across two splitters
    splitters = _splitters(known, marks, ranges, prefix)
    broad = spark.sparkContext.broadcast((splitters, {a for a, b in zip(splitters, splitters[1:], strict=False) if a == b}))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sent = TaskContext.get().partitionId(), 0
        held: dict[tuple[bytes, int], list[tuple[int, int]]] = {}

        def send(run: int) -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list] = {}
            for (string, after), places in sorted(held.items()):
                dealt.setdefault(ranges_of(string[:prefix], broad.value[0], part + sent), []).append((string, after, places))
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            kinds = {"shared": ints, "rest": pa.list_(pa.binary()), "after": ints, "copies": ints, "keys": longs, "ats": longs}
            for r, entries in dealt.items():
                coded = front_coded(entries)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([run], pa.int64()), *(pa.array([coded[k]], kind) for k, kind in kinds.items())], ["range", "run", *kinds])

        for batch in batches:
            for key, raw, ats in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for at in ats:
                    a, before, more = at >> 24, at >> 12 & 0xFFF, at & 0xFFF
                    last = a - before + more + length
                    if last <= len(raw):
                        held.setdefault((raw[a:last] + raw[a - before : a][::-1], last - a), []).append((key, at))
                if len(held) >= RUN_ROWS:
                    yield from send(part << 32 | sent)
                    held, sent = {}, sent + 1
        if held:
            yield from send(part << 32 | sent)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, windows = broad.value[1], Windows(length)

        def one_range(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            group: list[tuple[bytes, int, list[tuple[int, int]]]] = []
            for string, shared, (after, places) in merge([decoded(r) for r in rows]):
                if group and shared < gram:
                    windows.add(group, group[0][0][:prefix] in hot)
                    group = []
                    if len(windows.held) >= GROUP_ROWS:
                        yield from windows.send()
                if group and shared == len(string) == len(group[-1][0]) and after == group[-1][1]:
                    group[-1][2].extend(places)
                else:
                    group.append((string, after, places))
            if group:
                windows.add(group, group[0][0][:prefix] in hot)
            yield from windows.send()

        rows: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if rows and rows[0]["range"] != row["range"]:
                    yield from one_range(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from one_range(rows)

    made = known.join(marks, "key").select("key", "text", "ats").mapInArrow(runs, RUN)
    dealt = made.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "run")
    return checkpointed(dealt.mapInArrow(merged, "key long, begin long, end long, hash long"))


def repeated_spans(known: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, begin, end: byte ranges of the documents (key long, text) that are covered by windows that also start elsewhere; ranges may overlap."""
    spark = known.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = _candidates(known, length)
    let_go(spark)
    found = _repeats(known, marks, ranges, length)
    let_go(spark)
    open_ = found.where("hash is not null")
    again = open_.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    late = open_.where("key is not null").join(again, "hash")
    return found.where("hash is null").select("key", "begin", "end").unionByName(late.select("key", "begin", "end"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), begins and ends (the removed runs).

    A byte goes if a string of length bytes that covers it also starts anywhere else, in the same document too; all strings are judged on the
    input, so of copies all lose what they share. Texts are read as UTF-8, null as empty; shorter texts lose nothing. Rows with a null id
    lose nothing and are no copies for others. Rows that repeat an id are documents of their own, so equal ones are copies of each other.
    Cuts may part the bytes of a letter, so kept is binary. Other columns are not read; an empty table gives an empty one.
    """
    if not 2 <= length <= 4000:
        raise ValueError("windows have 2 to 4000 bytes")
    kind = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    long_enough = d.where(F.col("id").isNotNull() & (F.octet_length("text") >= length)).select("key", "text")
    spans = repeated_spans(long_enough, length).groupBy("key").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, kept, begins, ends = [], [], [], [], []
            for raw, b, e in zip(raw_texts(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                raw = raw or b""
                n_bytes.append(len(raw))
                runs: list[list[int]] = []
                if b.is_valid:
                    b, e = b.values.to_numpy(), e.values.to_numpy()
                    order = np.argsort(b, kind="stable")
                    for x, y in zip(b[order].tolist(), e[order].tolist(), strict=True):
                        if runs and x <= runs[-1][1]:
                            runs[-1][1] = max(y, runs[-1][1])
                        else:
                            runs.append([x, y])
                n_removed.append(sum(y - x for x, y in runs))
                kept.append(b"".join(raw[y:x] for y, x in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(raw)], strict=True)))
                begins.append([x for x, _ in runs])
                ends.append([y for _, y in runs])
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(b) for b in begins], pa.int64()), pa.array(kept, pa.binary()), pa.array(begins, longs), pa.array(ends, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept", "begins", "ends"])

    joined = d.join(spans, (d["key"] == spans["key"]) & d["id"].isNotNull(), "left").select("id", "text", "begins", "ends")
    return joined.mapInArrow(cut, f"id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, begins array<long>, ends array<long>").withColumnRenamed("id", id_col)
