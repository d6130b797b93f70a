"""Operator 3: n-gram Jaccard join with adaptive multi-match prefixes.

Shingles have one global order, rare ones first, by counts over all documents in a table of fixed size. Two sets that are similar enough
share at least l of the first |x| - ceil(t|x|) + l shingles of each, for every l. Each document picks its own l: a longer prefix costs
more rows, but a partner must then share more of them before it is verified, so a document whose prefix meets crowded shingles lengthens
it. For a pair the smaller l of the two counts. Its sizes give the intersection o that it needs, so its prefixes are shorter than those
stored: of the first |x| - o + l and |y| - o + l shingles at least l are shared. A row of a list keeps its place in the document's order, and
rows past these lengths, or with too few shingles left behind them, make no pair.

Sets of some hundred shingles are also held against each other by 256 bits of parity (Sandes et al., the bitmap filter): shingles that one
set has alone flip at most one bit each, so bits that differ bound the intersection from above and no link is lost.

Only connected classes are asked for, so links inside a class need no proof. Of equal sets in a batch of documents one is listed. A list that
the counts show to be long is dealt into parts. Each part first links its members to its head and to their neighbours, and the heads of a
list's parts are linked alike; what is verified joins classes. Then only lists that still hold several classes give pairs, between different classes.
Verification compares whole shingle sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpointed, components, drop_folder, keep_only, let_go, mix, shared_folder, shingle_set, stored, texts_in_turn

#: Words of a shingle, and the similarity as a fraction.
WORDS, NUM, DEN = 5, 75, 100
#: Cells of the table of counts (8 bytes each), rows into which a task's table is cut, longest l.
CELLS, SLABS, MOST_MATCHES = 1 << 20, 64, 8
#: Cost of comparing two sets against that of a row of a posting list, and members of a part of a list, on average.
VERIFY_COST, LIST_ROWS = 40.0, 20_000
#: Lists in which a document and its head or neighbour have to meet in the first round, which need not find all.
STAR_MATCHES = 3
#: Bits of parity of a set, and their columns.
BITS = 256
PARITY = [f"p{k}" for k in range(BITS // 64)]


def cell_counts(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How many documents hold a shingle of each cell, over all of docs. Tasks send tables of CELLS counts at most; they are added up in SLABS parts."""
    width = CELLS // SLABS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dup_text")
        table, some = np.zeros(CELLS, dtype=np.int64), False
        for batch in batches:
            for t in texts_in_turn(batch.column(0)):
                s = shingle_set(t, words)
                if len(s):
                    np.add.at(table, (s >> np.uint64(44)).astype(np.int64), 1)
                    some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([table[k * width : (k + 1) * width].astype("<u4").tobytes() for k in range(SLABS)], pa.binary())], ["slab", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(counts, dtype="<u4").astype(np.int64)
                sums[slab] = sums[slab] + got if slab in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<u4").tobytes() for v in np.minimum(list(sums.values()), 2**32 - 1)], pa.binary())], ["slab", "counts"])

    parts = docs.select(text).mapInArrow(count, "slab int, counts binary").repartition(SLABS, "slab").mapInArrow(add, "slab int, counts binary")
    table = np.zeros(CELLS, dtype=np.int64)
    for slab, counts in parts.collect():  # SLABS rows, 4 * CELLS bytes
        table[slab * width : (slab + 1) * width] += np.frombuffer(bytes(counts), dtype="<u4")
    return table


def base_prefix(n: np.ndarray | int, num: int = NUM, den: int = DEN):
    """Length of the prefix for one match: n - ceil(t n) + 1."""
    return n - (n * num + den - 1) // den + 1


def choose_matches(cost: np.ndarray, n: int) -> int:
    """The l from 1 to MOST_MATCHES for which rows and expected verifications cost least; cost: expected partners of each shingle, in order."""
    base = base_prefix(n)
    most = min(MOST_MATCHES, n - base + 1)
    if most < 2:
        return 1
    sums = np.cumsum(cost)[base - 1 : base - 1 + most]
    lengths = np.arange(1, most + 1)
    return int(np.argmin((sums + VERIFY_COST * sums / lengths) + base - 1 + lengths)) + 1


def prefixes(docs: DataFrame, table: np.ndarray, text: str, words: int) -> DataFrame:
    """id, n, parity (p0 to p3: by cells of the hash, whether an odd number of shingles falls there), matches (its l), crowd (0 to 31, by how many partners its prefix may have; it only orders lists), sig (128 bits of the set), local (the smallest id of its set in a batch, which alone has a prefix), prefix (shingle hashes in the global order), part (of each shingle's list; -1 where it has only one)."""
    sent = docs.sparkSession.sparkContext.broadcast(table.astype(np.uint32))  # 4 * CELLS bytes
    usual = float(np.median(table))
    kind = docs.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        keep_only("near_dup_text")
        counts = sent.value
        for batch in batches:
            ns, ls, crowds, sigs, out, parts, ids = [], [], [], [], [], [], batch.column(0).to_pylist()
            none, first = np.empty(0, dtype=np.int64), {}
            place = mix(np.array([i or 0 for i in ids], dtype=np.int64).view(np.uint64))
            parity = np.zeros((batch.num_rows, BITS // 64), dtype=np.int64)
            for k, t in enumerate(texts_in_turn(batch.column(1))):
                s = shingle_set(t, words)
                n = len(s)
                parity[k] = np.packbits((np.bincount((s >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(bool)).view(np.int64)
                ns.append(n)
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                if n >> 28:
                    raise ValueError(f"a text of {n} distinct shingles: rows of lists have 28 bits for their number")
                known = first.get(sigs[-1])
                if not n or ids[k] is None or (known is not None and ids[known] <= ids[k]):
                    ls.append(1)
                    crowds.append(0)
                    out.append(none)
                    parts.append(none)
                    continue
                if known is not None:
                    out[known] = parts[known] = none
                first[sigs[-1]] = k
                c = counts[(s >> np.uint64(44)).astype(np.int64)]
                at = np.lexsort((s, c))
                cost = np.maximum(c[at] - usual, 0.0)
                matches = choose_matches(cost, n)
                ls.append(matches)
                crowds.append(min(31, int(2 * np.log2(1 + cost[: base_prefix(n)].mean()))))
                at = at[: base_prefix(n) + matches - 1]
                out.append(s[at].view(np.int64))
                # a cell counts the documents of all its shingles, so no list is longer
                dealt = (1 + c[at] // np.uint32(LIST_ROWS)).astype(np.uint64)
                parts.append(np.where(dealt > 1, (place[k] % dealt).astype(np.int64), -1))
            local = [None if s is None or s not in first else ids[first[s]] for s in sigs]
            names = ["id", "n", *PARITY, "matches", "crowd", "sig", "local", "prefix", "part"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *[pa.array(p) for p in parity.T], pa.array(ls, pa.int32()), pa.array(crowds, pa.int32()), pa.array(sigs, pa.binary()), pa.array(local, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (out, parts)]], names)

    return docs.select("id", text).mapInArrow(make, f"id {kind}, n long, {', '.join(f'{c} long' for c in PARITY)}, matches int, crowd int, sig binary, local long, prefix array<long>, part array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose whole shingle sets are similar enough. texts: id, text; partitioned by id it is read once for both joins."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dup_text")
        last, other = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(texts_in_turn(batch.column(2)), texts_in_turn(batch.column(3)), strict=True):
                if other is None or tb != last:  # the join leaves equal b together
                    last, other = tb, shingle_set(tb, words)
                mine = shingle_set(ta, words)
                merged = np.sort(np.concatenate([mine, other]))
                shared = int((merged[1:] == merged[:-1]).sum())
                keep.append(den * shared >= num * (len(mine) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def packed() -> Column:
    """A row of a list in 63 bits: n (28), pos (27, the place in the document's order), crowd (5), matches - 1 (3)."""
    return F.shiftleft("n", 35).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 8)).bitwiseOR(F.shiftleft(F.col("crowd").cast("long"), 3)).bitwiseOR(F.col("matches").cast("long") - 1)


def _fields(row: str) -> tuple[Column, Column, Column]:
    """n, pos and matches of a packed row."""
    return F.shiftright(row, 35), F.shiftright(row, 8).bitwiseAND((1 << 27) - 1), F.col(row).bitwiseAND(7) + 1


def _needed(n: Column, n2: Column, num: int, den: int) -> Column:
    """The least intersection of two sets that are similar enough: ceil((n + n2) num / (num + den))."""
    whole = (n + n2) * num + (num + den - 1)
    return (whole - whole % (num + den)) / (num + den)


def alike(num: int, den: int) -> Column:
    """Whether sets of these sizes that share the shingle at these places can be similar enough: it, those before it and those after it."""
    (n, pos, _), (n2, pos2, _) = _fields("packed"), _fields("packed2")
    return (F.least(n, n2) * den >= F.greatest(n, n2) * num) & (F.least(pos, pos2) + F.least(n - pos, n2 - pos2) >= _needed(n, n2, num, den))


def in_prefixes(num: int, den: int) -> Column:
    """Whether the shingle lies in the prefixes of which this pair has to share as many as the smaller l."""
    (n, pos, l), (n2, pos2, l2) = _fields("packed"), _fields("packed2")
    return F.greatest(pos - n, pos2 - n2) + _needed(n, n2, num, den) < F.least(l, l2)


def parity_allows(num: int, den: int) -> Column:
    """Whether the bits of two sets leave room for the intersection that they need."""
    n, n2 = _fields("packed")[0], _fields("packed2")[0]
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in PARITY), F.lit(0))
    return n + n2 - apart >= 2 * _needed(n, n2, num, den)


def candidates(near: DataFrame, most: int = MOST_MATCHES) -> DataFrame:
    """Pairs of near (id, packed, id2, packed2), one row for each shared shingle, that meet as often as the smaller l of the two, or most times."""
    need = F.least(_fields("packed")[2], _fields("packed2")[2], F.lit(most))
    p = near.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), need.cast("int").alias("need"))
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach, the own id without links) for each row of docs.

    Sets: distinct shingles of lower-cased words (A-Z), the whole sequence for fewer words; null and empty texts have none and link with
    nothing. Repeated texts link as any others. Ids are whole numbers; rows that repeat an id give a row each and are one document that
    holds any of their sets; a null id links with nothing and has a null class. Extra columns are not read. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = prefixes(d, cell_counts(d, "text", words), "text", words)
    sets = checkpointed(made.select("id", "n", "sig", "local", *PARITY))  # prefixes are made again where they are used: they are too large to keep
    own = sets.where("id is not null and n > 0")
    # documents of one set: its smallest id stands for them; batches found theirs, so a set that is everywhere has a row for each batch here
    locals_ = own.where("id = local").select("local", "sig", "n").distinct()
    heads = locals_.groupBy("sig", "n").agg(F.min("local").alias("rep"))
    locals_ = checkpointed(locals_.join(heads, ["sig", "n"]))
    # what later steps read again and again is written once; it goes as soon as the last pairs are verified
    folder = f"{shared_folder(docs.sparkSession)}/lists-{uuid.uuid4().hex}"
    members = stored(own.join(locals_, ["local", "sig", "n"]).select("id", "rep", "n"), f"{folder}/members")
    # copies follow their set's class; only an id with several sets is a link itself
    several = members.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("id")
    copies = members.join(several, "id").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    rows = made.where("size(prefix) > 0").select("id", "n", "matches", "crowd", F.posexplode(F.arrays_zip("prefix", "part")).alias("pos", "p")).select(F.col("p.prefix").alias("shingle"), F.col("p.part").alias("part"), "id", packed().alias("packed"))
    crowd = F.shiftright("packed", 3).bitwiseAND(31)
    in_part = W.Window.partitionBy("shingle", "part").orderBy(crowd.desc(), "packed", "id")
    # the only member of a part may have others in the list's other parts
    lists = rows.withColumn("of", F.count(F.lit(1)).over(W.Window.partitionBy("shingle", "part"))).where("of > 1 or part >= 0")
    # columns of sorted lists take a quarter of the room of rows
    lists = stored(lists.select("shingle", "id", "packed", "part"), f"{folder}/lists")
    let_go(docs.sparkSession)

    # members against the head of their part, and against the one before; heads of the parts of a list likewise
    def starred(of: DataFrame, w: W.WindowSpec) -> DataFrame:
        seen = of.withColumn("head", F.first(F.struct("id", "packed")).over(w)).withColumn("before", F.lag(F.struct("id", "packed")).over(w)).where("before is not null")
        return seen.select("id", "packed", F.explode(F.array_distinct(F.array("head", "before"))).alias("o")).select("id", "packed", F.col("o.id").alias("id2"), F.col("o.packed").alias("packed2"))

    order = F.struct((-crowd).alias("c"), F.col("packed").alias("packed"), F.col("id").alias("id"))
    part_heads = lists.where("part >= 0").groupBy("shingle", "part").agg(F.min(order).alias("h")).select("shingle", "h.packed", "h.id")
    star = starred(lists, in_part).unionByName(starred(part_heads, W.Window.partitionBy("shingle").orderBy(crowd.desc(), "packed", "id")))
    texts = d.where("id is not null")
    rep_a, rep_b = members.select(F.col("id").alias("a"), F.col("rep").alias("ra")), members.select(F.col("id").alias("b"), F.col("rep").alias("rb"))

    def between_reps(pairs: DataFrame) -> DataFrame:
        p = pairs.join(rep_a, "a").join(rep_b, "b").where("ra != rb")
        return p.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    first = stored(verified(between_reps(candidates(star.where(alike(num, den)), STAR_MATCHES)), texts, words, num, den).unionByName(copies), f"{folder}/first")
    let_go(docs.sparkSession)
    classes = components(first)
    let_go(docs.sparkSession)
    # lists of several classes: pairs between different ones, of one document for each set
    kin = members.select("id", "rep").join(classes.withColumnRenamed("node", "id"), "id", "left").where("id = rep").select("id", F.coalesce("component", "id").alias("class"))
    named = lists.join(kin, "id").select("shingle", "id", "packed", "class")
    spans = named.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("shingle")
    bits = own.groupBy("id").agg(*[F.first(c).alias(c) for c in PARITY], F.count(F.lit(1)).alias("of"))
    # an id with several rows has no bits of its own: it is compared with all
    mixed = named.join(spans, "shingle").join(bits, "id")
    x, y = mixed.alias("x"), mixed.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("id", "packed", "class", "of", *PARITY)]).alias("y")
    meets = (F.col("class") < F.col("class2")) & alike(num, den) & in_prefixes(num, den) & (parity_allows(num, den) | (F.greatest("of", "of2") > 1))
    across = candidates(x.join(y, "shingle").where(meets).select("id", "packed", "id2", "packed2"))
    second = stored(verified(across, texts, words, num, den), f"{folder}/second")
    let_go(docs.sparkSession)
    # links between classes of the first round, then the classes of classes
    names = classes.select("node", "component")
    lifted = second.join(names.withColumnRenamed("node", "a").withColumnRenamed("component", "ca"), "a", "left").join(names.withColumnRenamed("node", "b").withColumnRenamed("component", "cb"), "b", "left")
    lifted = lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = components(lifted)
    drop_folder(docs.sparkSession, folder)
    classed = locals_.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("local", "sig", "n", F.coalesce("component", "rep").alias("class"))
    classed = classed.join(above, classed["class"] == above["node"], "left").select("local", "sig", "n", F.coalesce("component", "class").alias("component_id"))
    final = own.join(classed, ["local", "sig", "n"]).groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = sets.select("id", "n").join(final, "id", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
