"""Vector search by cells: vectors are stored by their nearest centre, and cells that can't hold a nearer one than those found are not read.

For unit vectors the distance along the unit sphere obeys the triangle inequality: of a cell whose vectors are between r and R away from its centre, none is nearer
to a query than its distance to the centre less R, or r less that distance. A search first takes the cells nearest to each query that hold enough vectors;
the least similarity among its k best there rules out cells whose bound is lower. The rest are read, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.scratch import checkpointed

#: Vectors of a cell, about; cells at most, since their centres go to all tasks; vectors that centres are drawn from; queries of a round; slack of bounds.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS, ROUND_QUERIES, SLACK = 4096, 4096, 65_536, 1000, 1e-9
#: Products of vectors with queries that a worker holds at once (8 bytes each).
PRODUCTS = 1 << 21
ROWS = "cell int, dim int, point_id long, chunk_id long, child_type string, norm double, vector array<double>"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row products summed from the first to the last component, as a loop over them would."""
    return (x * y).cumsum(axis=1)[:, -1]


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _sound(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction."""
    return df.where(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e150)) & F.exists(vector, lambda c: c != 0))


def _rounds(queries: DataFrame, size: int) -> Iterator[list]:
    """The rows (query_id, v) of sound queries, size of them at a time, on average."""
    q = checkpointed(_sound(queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")), "v"))
    rounds = max(1, -(-q.count() // size))
    for r in range(rounds):
        yield q.where(F.pmod(F.xxhash64("query_id", "v"), F.lit(rounds)) == r).collect()


def _named(found: DataFrame, asked: list, queries: DataFrame) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    named = found.sparkSession.createDataFrame([(i, x["query_id"]) for i, x in enumerate(asked)], f"number int, query_id {kind}")
    return found.join(F.broadcast(named), "number").select("query_id", "point_id", "chunk_id", "child_type", "similarity")


def _nothing(spark: SparkSession, queries: DataFrame) -> DataFrame:
    return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, point_id long, chunk_id long, child_type string, similarity double")


def _first(found: DataFrame, k: int) -> DataFrame:
    w = W.Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "point_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_of(rows: DataFrame, asked: list, wanted: dict[tuple[int, int], list[int]] | None, k: int) -> DataFrame:
    """number, point_id, chunk_id, child_type, similarity: the k best of rows (ROWS) for each query, task by task; of the cells that it wants, or of all if there are none.

    Vectors are multiplied with all queries that look at them, PRODUCTS at once, whatever the batches of Spark hold. What may be among the best is computed anew, component by component,
    so that equal vectors are equally near wherever they stand.
    """
    spark = rows.sparkSession

    def look(part: pa.RecordBatch, dim: int, mine: list[int], y: np.ndarray, own: np.ndarray, bare: bool, best: dict[int, tuple]) -> None:
        x, points = _matrix(part.column(6), dim), part.column(2).to_numpy()
        norm = in_order(x, x) if bare else part.column(5).to_numpy()
        near = x @ y.T
        near /= np.sqrt(norm)[:, None]
        near /= np.sqrt(own)
        most = near.max(axis=0)
        for c, i in enumerate(mine):
            old = best.get(i)
            floor = old[0][-1] if old is not None and len(old[0]) == k else -2.0
            if most[c] < floor - SLACK:
                continue
            some = np.flatnonzero(near[:, c] >= floor - SLACK)
            if len(some) > k:
                cut = np.partition(near[some, c], len(some) - k)[len(some) - k]
                some = some[near[some, c] >= cut - SLACK]
            exact = in_order(x[some], y[c][None]) / np.sqrt(norm[some] * own[c])
            taken = pa.array(some)
            found = (exact, points[some], part.column(3).take(taken).to_numpy(), np.array(part.column(4).take(taken).to_pylist(), dtype=object))
            found = found if old is None else tuple(np.concatenate(z) for z in zip(old, found, strict=True))
            order = np.lexsort((found[1], -found[0]))[:k]
            best[i] = tuple(z[order] for z in found)

    broad = spark.sparkContext.broadcast(({i: np.array(x["v"]) for i, x in enumerate(asked)}, wanted))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, of = broad.value
        best: dict[int, tuple] = {}
        for batch in batches:
            keys = np.stack([batch.column(1).to_numpy(), batch.column(0).to_numpy()])
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]])) if batch.num_rows else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                dim, cell = keys[:, a].tolist()
                mine = [i for i, q in queries.items() if len(q) == dim] if of is None else of[dim, cell]
                if not mine:
                    continue
                y = np.stack([queries[i] for i in mine])
                own = in_order(y, y)
                rows = max(1, PRODUCTS // len(mine))
                for at in range(a, b, rows):
                    look(batch.slice(at, min(rows, b - at)), dim, mine, y, own, of is None, best)
        for i, (near, points, chunks, kinds) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(near), pa.int32()), pa.array(points), pa.array(chunks), pa.array(kinds.tolist(), pa.string()), pa.array(near)], ["number", "point_id", "chunk_id", "child_type", "similarity"])

    if wanted is not None:
        cells = spark.createDataFrame(list(wanted), "dim int, cell int")
        rows = rows.where(F.col("cell").isin(sorted({c for _, c in wanted}))).join(F.broadcast(cells), ["dim", "cell"], "left_semi")
    return rows.select([f.split()[0] for f in ROWS.split(", ")]).mapInArrow(work, "number int, point_id long, chunk_id long, child_type string, similarity double")


def nearest(points: DataFrame, queries: DataFrame, k: int, round_queries: int = ROUND_QUERIES) -> DataFrame:
    """What VectorIndex.topk() finds, of vectors that no index holds: each is read once a round of queries."""
    v = _sound(points.select(F.lit(0).alias("cell"), F.size("vector").alias("dim"), F.col("point_id").cast("long").alias("point_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "child_type", F.lit(None).cast("double").alias("norm"), F.col("vector").cast("array<double>").alias("vector")), "vector")
    out = _nothing(points.sparkSession, queries)
    for asked in _rounds(queries, round_queries):
        if asked:
            out = out.unionByName(_named(best_of(v, asked, None, k), asked, queries))
    return _first(out, k)


class VectorIndex:
    """Vectors below a folder that driver and executors share, dealt into cells; build() writes it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.rows = spark.read.schema(ROWS).parquet(f"{folder}/rows")
        self.cells = spark.read.parquet(f"{folder}/cells")

    @classmethod
    def build(cls, points: DataFrame, folder: str) -> VectorIndex:
        """Stores points (point_id, chunk_id, child_type, vector); null, empty and zero vectors and those with null or non-finite entries are left out.

        Centres are drawn from a sample of at most SAMPLE_ROWS vectors and moved once to the mean of those nearest to them; they only decide what is pruned.
        Vectors of each length have cells of their own.
        """
        spark = points.sparkSession
        v = _sound(points.select(F.col("point_id").cast("long").alias("point_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "child_type", F.col("vector").cast("array<double>").alias("vector")), "vector")
        sizes = {r["dim"]: r["n"] for r in v.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
        n = sum(sizes.values())
        drawn: dict[int, list] = {}
        for r in v.sample(min(1.0, SAMPLE_ROWS / max(1, n)), 5).select("vector").limit(SAMPLE_ROWS).collect() if n else []:
            drawn.setdefault(len(r[0]), []).append(r[0])
        centres: dict[int, np.ndarray] = {}
        rng = np.random.default_rng(7)
        for dim, some in drawn.items():
            x = np.array(some)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            c = x[rng.permutation(len(x))[: min(MOST_CELLS, max(1, -(-sizes[dim] // CELL_ROWS)))]]
            nearest = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, nearest, x)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres[dim] = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
        broad = spark.sparkContext.broadcast(centres)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.diff(batch.column(3).offsets.to_numpy()) if batch.num_rows else np.empty(0, dtype=int)
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    x = _matrix(part.column(3), dim)
                    norm = in_order(x, x)
                    c = broad.value.get(dim, np.eye(1, dim))  # a length that the sample missed has one cell
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    cell = (unit @ c.T).argmax(axis=1)
                    away = _angles(unit, c)[np.arange(len(x)), cell]
                    columns = [pa.array(cell.astype(np.int32)), pa.array(np.full(len(x), dim, dtype=np.int32)), part.column(0), part.column(1), part.column(2), pa.array(norm), part.column(3), pa.array(away)]
                    yield pa.RecordBatch.from_arrays(columns, [*[f.split()[0] for f in ROWS.split(", ")], "away"])

        dealt = v.mapInArrow(deal, f"{ROWS}, away double")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spread = max(1, parts // max(1, sum(len(c) for c in centres.values())))  # few cells: each over several tasks
        dealt.repartition(parts, "dim", "cell", F.pmod(F.xxhash64("point_id"), F.lit(spread))).sortWithinPartitions("dim", "cell").write.parquet(f"{folder}/rows")
        everything = spark.read.schema(f"{ROWS}, away double").parquet(f"{folder}/rows")
        known = everything.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most")).collect()  # MOST_CELLS rows a length at most
        rows = [(r["dim"], r["cell"], r["n"], r["least"], r["most"], (centres[r["dim"]] if r["dim"] in centres else np.eye(1, r["dim"]))[r["cell"]].tolist()) for r in known]
        spark.createDataFrame(rows, "dim int, cell int, n long, least double, most double, centre array<double>").coalesce(1).write.parquet(f"{folder}/cells")
        return cls(spark, folder)

    def topk(self, queries: DataFrame, k: int) -> tuple[DataFrame, float]:
        """query_id, point_id, chunk_id, child_type, similarity, rank of the k nearest points of each query (query_id, query_vector), by cosine, ties by point; and
        the share of (query, vector) pairs that were looked at.

        Queries are answered in rounds of ROUND_QUERIES. Null, empty, zero and non-finite queries, and those whose length no vector has, find nothing.
        """
        cells: dict[int, list] = {}
        for r in self.cells.collect():  # MOST_CELLS a length at most
            cells.setdefault(r["dim"], []).append(r)
        out, looked, whole = _nothing(self.spark, queries), 0, 0
        for asked in _rounds(queries, ROUND_QUERIES):
            asked = [x for x in asked if len(x["v"]) in cells]
            if asked:
                found, n = self._round(asked, cells, k)
                looked += n
                whole += sum(sum(c["n"] for c in cells[len(x["v"])]) for x in asked)
                out = out.unionByName(_named(found, asked, queries))
        return _first(out, k), looked / whole if whole else 0.0

    def _round(self, asked: list, cells: dict[int, list], k: int) -> tuple[DataFrame, int]:
        first: dict[tuple[int, int], list[int]] = {}  # the cells, and which queries look at them
        bounds: list[tuple[np.ndarray, list]] = []
        for i, x in enumerate(asked):
            v, here = np.array(x["v"]), cells[len(x["v"])]
            gap = _angles(v[None] / np.linalg.norm(v), np.array([c["centre"] for c in here]))[0]
            least, most = (np.array([c[name] for c in here]) for name in ("least", "most"))
            near = np.maximum(0, np.maximum(gap - most, least - gap) - SLACK)
            bounds.append((np.cos(near), here))
            n = 0
            for at in np.argsort(gap):
                if n >= k:
                    break
                first.setdefault((len(v), here[at]["cell"]), []).append(i)
                n += here[at]["n"]
        sizes = {(d, c["cell"]): c["n"] for d, some in cells.items() for c in some}
        hits = checkpointed(best_of(self.rows, asked, first, k))
        w = W.Window.partitionBy("number").orderBy(F.col("similarity").desc(), "point_id")
        kth = dict(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("number", "similarity").collect())  # a row a query
        rest: dict[tuple[int, int], list[int]] = {}
        for i, (bound, here) in enumerate(bounds):
            for b, c in zip(bound, here, strict=True):
                cell = (len(asked[i]["v"]), c["cell"])
                if b >= kth.get(i, -2.0) - SLACK and i not in first.get(cell, ()):
                    rest.setdefault(cell, []).append(i)
        looked = sum(sizes[c] * len(of) for some in (first, rest) for c, of in some.items())
        return (hits.unionByName(best_of(self.rows, asked, rest, k)) if rest else hits), looked
