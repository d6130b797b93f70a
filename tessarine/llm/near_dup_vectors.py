"""Operator 2: near-duplicate vectors by counting collisions of projections.

Vectors are projected on many random lines. A pair at the threshold is close on a line with a known chance, so a pair that is close on too
few of the lines can be left out: the count is calibrated for a wanted recall. Pairs meet in tables: each cuts several other lines into
cells, joins the vectors of one cell, and sorts them along a line of its own, so that a vector looks only at those within its window
there; the tables make up for the pairs that a window misses. Lines per table grow with the logarithm of the number of vectors, so that cells hold a few unrelated vectors at any size. Pairs
that pass the count are verified by their exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binomial_tail, checkpointed, components

COSINE = 0.95
#: Counted lines; half a window and a cell, in distances of a pair at the threshold; shares of such pairs that the count and the tables may miss.
LINES, HALF_WINDOW, CELL, MISS_COUNT, MISS_TABLES = 48, 2.0, 4.0, 0.001, 0.002
#: Vectors of one cell that are joined in one group; larger cells are cut into blocks, and each two blocks meet.
BLOCK = 2000


def calibrate(n: int, cosine: float = COSINE) -> tuple[float, int, int, int]:
    """Distance at the threshold, least count, lines of a table and tables, for n vectors."""
    from statistics import NormalDist

    phi = NormalDist().cdf
    near = math.sqrt(2 - 2 * cosine)
    close = 2 * phi(HALF_WINDOW) - 1
    least = next(k for k in range(LINES, 0, -1) if binomial_tail(LINES, close, k) >= 1 - MISS_COUNT)

    def same_cell(distance: float) -> float:
        r = CELL * near / distance
        return 1 - 2 * phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    lines = max(1, math.ceil(math.log(max(2, n) / 2) / -math.log(same_cell(math.sqrt(2)))))
    # a table finds a pair that shares its cell and is close along the line that sorts it
    tables = math.ceil(math.log(MISS_TABLES) / math.log(1 - close * same_cell(near) ** lines))
    return near, least, lines, tables


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """id, n_links, component_id, kept for each row; see the contract of op2.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of different lengths.
    Equal vectors count as links of each other. Rows that repeat an id are vectors of their own, each with its own links and component; a
    row with a null id links with nothing, has a null component and is kept. Labels and other columns are not read; an empty table gives
    an empty one. Links have the exact cosine, in double precision, or more.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    good = v.where(fine)
    # distinct vectors by numbers, fixed once they are written: ids may repeat
    distinct = good.groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    reps = checkpointed(distinct.select(F.monotonically_increasing_id().alias("rep"), "v", "low", "copies", F.size("v").alias("dim")))
    members = good.join(reps.select("v", "rep", "copies", "low"), "v").select("id", "rep", "copies", "low")
    n = reps.count()
    near, least, per_table, tables = calibrate(n, cosine)
    half = HALF_WINDOW * near

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in lines:
                    rng = np.random.default_rng(1000 + dim)
                    lines[dim] = rng.standard_normal((dim, LINES)), rng.standard_normal((dim, tables * per_table)), rng.random(tables * per_table), rng.standard_normal((dim, tables))
                counted, cut, shift, sorting = lines[dim]
                for at in range(0, len(part), 2000):
                    some = part.slice(at, 2000)
                    x = _matrix(some.column(1))
                    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    p, first = (x @ counted).astype(np.float32), x @ sorting
                    cells = np.floor(x @ cut / (CELL * near) + shift).astype(np.int64).astype(np.uint64).reshape(len(x), tables, per_table)
                    key = np.full((len(x), tables), dim, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for k in range(per_table):
                        key = (key ^ cells[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
                        key ^= key >> np.uint64(29)
                    sketch = np.array([a.tobytes() for a in p], dtype=object)
                    ids = some.column(0).to_numpy()
                    for t in range(tables):
                        mixed = ((key[:, t] + np.uint64(t)) * np.uint64(0xFF51AFD7ED558CCD)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(mixed), pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(ids), pa.array(np.ascontiguousarray(first[:, t])), pa.array(sketch, pa.binary())], ["cell", "tab", "id", "first", "sketch"])

    placed = reps.select("rep", "v", "dim").mapInArrow(place, "cell long, tab int, id long, first double, sketch binary")
    crowded = placed.groupBy("cell", "tab").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = placed.join(crowded, ["cell", "tab"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "tab"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", "tab", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "first", "id", "sketch")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    grouped = rows.repartition(parts, "cell", "tab", "low", "high").sortWithinPartitions("cell", "tab", "low", "high", "first", "id")

    def pairs(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of the same group within half a window along its table's line that pass the count; a pair comes from each table where it meets."""
        g, ids, first, block, cross, lines = (group[k] for k in ("g", "id", "first", "block", "cross", "lines"))
        a_out, b_out = [], []
        i, lag = np.arange(len(g)), 1
        while len(i):
            i = i[i + lag < len(g)]
            j = i + lag
            near_by = (g[i] == g[j]) & (first[j] - first[i] <= half)
            i, j = i[near_by], j[near_by]
            ok = ~cross[i] | (block[i] != block[j])
            for at in range(0, len(i), 50_000):
                a, b = i[at : at + 50_000][ok[at : at + 50_000]], j[at : at + 50_000][ok[at : at + 50_000]]
                pass_ = (np.abs(lines[a] - lines[b]) <= half).sum(axis=1) >= least
                a, b = a[pass_], b[pass_]
                if len(a):
                    a_out.append(ids[a])
                    b_out.append(ids[b])
            lag += 1
        none = np.empty(0, dtype=np.int64)
        return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (none, none)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            col = lambda k: table.column(k).to_numpy()
            keys = np.stack([col("cell"), col("tab").astype(np.int64), col("low").astype(np.int64), col("high").astype(np.int64)])
            g = np.cumsum(np.concatenate([[0], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if table.num_rows else np.empty(0)
            lines = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.float32).reshape(table.num_rows, LINES)
            a, b = pairs({"g": g, "id": col("id"), "first": col("first"), "block": col("block"), "cross": col("low") != col("high"), "lines": lines})
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            names = ["cell", "tab", "low", "high"]
            last = [table.column(k)[-1].as_py() for k in names]
            open_ = np.logical_and.reduce([table.column(k).to_numpy() == x for k, x in zip(names, last, strict=True)])
            cut = int(np.argmax(open_))  # the last group may go on in the next batch; it holds two blocks at most
            if cut:
                yield flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    met = grouped.mapInArrow(count, "a long, b long").distinct()
    va, vb = reps.select(F.col("rep").alias("a"), F.col("v").alias("x")), reps.select(F.col("rep").alias("b"), F.col("v").alias("y"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                x, y = _matrix(part.column(2)), _matrix(part.column(3))
                x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
                c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield part.select(["a", "b"]).filter(pa.array(c >= cosine))

    links = checkpointed(met.join(va, "a").join(vb, "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"))
    weights = reps.select("rep", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(weights.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("beyond"))
    classes = components(links).withColumnRenamed("node", "rep")
    least_ids = classes.join(reps.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("least"))
    named = classes.join(least_ids, "component").select("rep", "least")
    found = members.join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(named, "rep", "left")
    found = found.select("id", (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    rest = v.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = found.unionByName(rest)
    return out.select(F.col("id").cast(kind).alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
