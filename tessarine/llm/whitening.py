"""Operator 11: whitening of vectors by an incremental eigendecomposition.

The distinct vectors are dealt into partitions. Each keeps the eigenvalues and eigenvectors of the scatter of what it has seen, and every further
vector is a rank-one update of them, centred by the running mean: the roots of a secular equation are the new eigenvalues. Directions that the
vector does not touch, and all but one of those with equal eigenvalues, are deflated first. Spectra of partitions are united in a tree: those of
one are applied to the other as successive rank-one updates, with one more for the distance of their means. The basis found so is refined by one
distributed Rayleigh-Ritz step over all vectors. What reaches the driver is a few matrices of the vectors' length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: An entry c becomes floor(SCALE * c) + SHIFT; components per row; spectra that one task unites; entries beyond LARGEST are an error.
SCALE, SHIFT, COMPONENTS, FAN, LARGEST = 64, 1_000_000, 16, 16, 2.0**40
EPS = float(np.finfo(np.float64).eps)


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w / (d - x)) for rising d and positive w, one above each d, and the matrix d[j] - root[i] in full precision.

    Each root is sought as its distance from the nearer pole, by rational interpolation with the two poles around it, inside a bracket.
    """
    k = len(d)
    i = np.arange(k)
    gap = np.append(np.diff(d), w.sum())
    half = gap / 2
    at_half = 1 + (w / (d - (d + half)[:, None])).sum(axis=1)
    right = (at_half < 0) & (i < k - 1)
    w_above = np.append(w[1:], 0.0)
    origin = i + right
    delta = d - d[origin][:, None]
    lo, hi = np.where(right, -half, 0.0), np.where(right, 0.0, np.where(i < k - 1, half, gap))
    # the first guess takes all but the two poles around it as they are half-way
    c = at_half + (w - w_above) / half
    a, b = np.where(right, c * gap - w - w_above, c * gap + w + w_above), np.where(right, w_above, w) * gap
    root = np.sqrt(np.abs(a * a + np.where(right, 4, -4) * b * c))
    with np.errstate(divide="ignore", invalid="ignore"):
        mu = np.where(right, np.where(a < 0, 2 * b / (a - root), -(a + root) / (2 * c)), np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c)))
    mu = np.where((mu > lo) & (mu < hi), mu, (lo + hi) / 2)
    below = np.tri(k, dtype=bool)
    far = delta[i, i] + np.append(gap[:-1], 2 * gap[-1])  # the pole above, made up for the last root
    for _ in range(80):
        diff = delta - mu[:, None]
        q = w / diff
        f = 1 + q.sum(axis=1)
        slopes = q / diff
        slope = slopes.sum(axis=1)
        psi = (slopes * below).sum(axis=1)
        phi = slope - psi
        lo, hi = np.where(f < 0, mu, lo), np.where(f >= 0, mu, hi)
        done = (np.abs(f) <= 8 * EPS * (1 + np.abs(q).sum(axis=1) + np.abs(mu) * slope)) | (hi - lo <= 2 * EPS * np.abs(mu))
        if done.all():
            break
        left, above = diff[i, i], far - mu
        a, b, c = (left + above) * f - left * above * slope, left * above * f, f - left * psi - above * phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = mu + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        mu = np.where(done, mu, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return d[origin] + mu, delta - mu[:, None]


def rank_one(lam: np.ndarray, basis: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and the eigenvectors of basis diag(lam) basis' + weight v v'."""
    z = (v @ basis) * math.sqrt(weight)
    norm = float(z @ z)
    if norm == 0:
        return lam, basis
    tol = 8 * EPS * max(float(lam[-1]), norm)
    live = np.flatnonzero(np.abs(z) * math.sqrt(norm) > tol)
    d = lam[live]
    near = np.diff(d) <= tol
    if near.any():  # of equal eigenvalues one direction takes all of the vector, by a reflection
        basis, heads = basis.copy(), []
        for run in np.split(live, np.flatnonzero(~near) + 1):
            heads.append(run[-1])
            if len(run) > 1:
                u = z[run].copy()
                length = math.copysign(math.sqrt(float(u @ u)), u[-1])
                u[-1] += length
                basis[:, run] -= np.outer(basis[:, run] @ u, u * (2 / float(u @ u)))
                z[run[-1]] = -length
        live = np.array(heads)
        d = lam[live]
    if not len(live):
        return lam, basis
    zl = z[live]
    if len(live) == 1:
        new, turned = d + zl * zl, basis[:, live]
    else:
        new, diff = secular_roots(d, zl * zl)
        apart = d[:, None] - d
        np.fill_diagonal(apart, 1.0)
        ratio = -diff / apart  # the weights for which these roots are exact: eigenvectors stay orthogonal
        q = (np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(zl)) / diff
        q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
        turned = basis[:, live] @ q.T
    rest = np.ones(len(lam), dtype=bool)
    rest[live] = False
    values, vectors = np.concatenate([lam[rest], new]), np.concatenate([basis[:, rest], turned], axis=1)
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, sums of the entries beyond SHIFT, and the spectrum of the centred scatter of some vectors."""

    def __init__(self, n: int, sums: np.ndarray, lam: np.ndarray, basis: np.ndarray):
        self.n, self.sums, self.lam, self.basis = n, sums, lam, basis

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim, dtype=np.int64), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self.lam, self.basis = rank_one(self.lam, self.basis, x - self.sums / self.n, self.n / (self.n + 1))
        self.n += 1
        self.sums = self.sums + x

    def unite(self, other: Spectrum) -> None:
        if self.n and other.n:
            shift = self.sums / self.n - other.sums / other.n
            for value, vector in zip(other.lam[::-1], other.basis.T[::-1], strict=True):
                if value > 0:
                    self.lam, self.basis = rank_one(self.lam, self.basis, vector, float(value))
            self.lam, self.basis = rank_one(self.lam, self.basis, shift, self.n * other.n / (self.n + other.n))
        elif other.n:
            self.lam, self.basis = other.lam, other.basis
        self.n, self.sums = self.n + other.n, self.sums + other.sums


def _tree(rows: DataFrame, parts: int, schema: str, unite: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """One row a dim out of rows of partitions (part, dim, ...), FAN of them at a time."""
    while parts > 1:
        grouped = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))

        def some(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"part": g["part"].iloc[0], "dim": g["dim"].iloc[0], **unite(g)}])

        rows, parts = grouped.groupBy("dim", "part").applyInPandas(some, schema), -(-parts // FAN)
    return rows


def _by_dim(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Length, rows and matrix of the vectors of each length in a batch."""
    for batch in batches:
        if batch.num_rows:
            vectors = batch.column(column)
            dims = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                yield dim, part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean, rounded once."""
    q = sums // n
    return (x - q) - (sums - q * n) / n


def _products(fit: DataFrame, parts: int, models: dict[int, dict], of: str) -> dict[int, np.ndarray]:
    """For each length the sum over the fit list of the outer products of centred vectors projected on the columns of models[dim][of]."""
    broad = fit.sparkSession.sparkContext.broadcast(models)
    schema = "part int, dim int, sums array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for dim, _, x in _by_dim(batches, 0):
            m = broad.value[dim]
            y = _centred(x, m["n"], m["sums"]) @ m[of]
            held[dim] = held.get(dim, 0) + y.T @ y
        for dim, h in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([dim], pa.int32()), pa.array([h.ravel()], pa.list_(pa.float64()))], ["part", "dim", "sums"])

    summed = _tree(fit.mapInArrow(work, schema), parts, schema, lambda g: {"sums": np.sum(np.stack(g["sums"].to_list()), axis=0)})
    out = {}
    for r in summed.collect():  # a matrix for each length
        size = math.isqrt(len(r["sums"]))
        out[r["dim"]] = np.array(r["sums"]).reshape(size, size)
    return out


def fit_list(vectors: DataFrame, vector_col: str) -> DataFrame:
    """x of each distinct vector without null and non-finite entries, dealt into spark.sql.shuffle.partitions partitions."""
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return checkpointed(_whole(vectors, vector_col).select("x").distinct().repartition(parts, "x"))


def _whole(vectors: DataFrame, vector_col: str) -> DataFrame:
    v = vectors.withColumn("x", F.col(vector_col).cast("array<double>"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("x") > 0)
    entry = lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large to be whitened")).cast("long"))
    return v.where(fine).withColumn("x", F.transform("x", entry))


def spectra(fit: DataFrame, parts: int) -> DataFrame:
    """dim, n, sums, lam, basis: one row for each length, by rank-one updates inside partitions and between them."""
    schema = "part int, dim int, n long, sums array<long>, lam array<double>, basis array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, Spectrum] = {}
        for dim, _, x in _by_dim(batches, 0):
            s = held.setdefault(dim, Spectrum.empty(dim))
            for row in x - SHIFT:
                s.add(row)
        part = TaskContext.get().partitionId()
        for dim, s in held.items():
            doubles = pa.list_(pa.float64())
            columns = [pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([s.n]), pa.array([s.sums], pa.list_(pa.int64())), pa.array([s.lam], doubles), pa.array([s.basis.ravel()], doubles)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "dim", "n", "sums", "lam", "basis"])

    def unite(g: pd.DataFrame) -> dict:
        dim = int(g["dim"].iloc[0])
        whole = Spectrum.empty(dim)
        for r in g.sort_values("n", ascending=False).itertuples():
            whole.unite(Spectrum(int(r.n), np.array(r.sums), np.array(r.lam), np.array(r.basis).reshape(dim, dim)))
        return {"n": whole.n, "sums": whole.sums, "lam": whole.lam, "basis": whole.basis.ravel()}

    return _tree(fit.mapInArrow(work, schema), parts, schema, unite)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of each row and component; see the contract of op11.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; ids may be null or repeat, each row is answered for itself.
    Vectors of different lengths are fitted apart, each length on its own. Equal vectors count once in the fit. A component whose eigenvalue
    is not above 1e-12 of the trace can't be whitened and has no rows; so a single distinct vector gives none. Of equal eigenvalues any
    orthogonal eigenvectors serve, the same for all rows; each has its largest entry positive. Entries beyond 2**40, and deviations
    that a long can't hold, are errors. Other columns are not read; an empty table gives an empty one.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    fit = fit_list(vectors, vector_col)
    parts = fit.rdd.getNumPartitions()
    models: dict[int, dict] = {}
    for r in spectra(fit, parts).collect():  # a row for each length
        dim, n = r["dim"], r["n"]
        basis, _ = np.linalg.qr(np.array(r["basis"]).reshape(dim, dim))
        models[dim] = {"n": n, "sums": np.array(r["sums"], dtype=np.int64) + n * SHIFT, "basis": basis}
    for dim, h in _products(fit, parts, models, "basis").items():
        m = models[dim]
        values, turn = np.linalg.eigh(h / m["n"])
        values, vectors_of = values[::-1], (m.pop("basis") @ turn)[:, ::-1]
        kept = min(components, int((values > 1e-12 * values.sum()).sum())) if values.sum() > 0 else 0
        u = vectors_of[:, :kept]
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
        m |= {"whiten": u / np.sqrt(values[:kept]), "explained": values[:kept] / values.sum() if kept else values[:0]}
    for dim, h in _products(fit, parts, models, "whiten").items():
        m = models[dim]
        m["error"] = float(np.abs(h / m["n"] - np.eye(len(h))).max()) if len(h) else 0.0
    broad = spark.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in _by_dim(batches, 1):
            m = broad.value[dim]
            n, k = m["n"], m["whiten"].shape[1]
            if not k:
                continue
            q = m["sums"] // n
            far = n * (x - q) - (m["sums"] - q * n)
            if (far.astype(np.float64) ** 2).sum(axis=1).max() > 9.2e18:
                raise OverflowError("a deviation does not fit into a long")
            y = _centred(x, n, m["sums"]) @ m["whiten"]
            rows = len(x)
            columns = [
                part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                pa.array(np.repeat((far * far).sum(axis=1), k)), pa.array(y.ravel()), pa.array(np.tile(m["explained"], rows)), pa.array(np.full(rows * k, m["error"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return _whole(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v").select("id", "x").mapInArrow(work, schema).withColumnRenamed("id", id_col)
