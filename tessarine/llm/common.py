"""What several operators share: word hashes, safe names, checkpoints, connected components."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEED = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; odd bases of the two rolling sums, one over bytes and one over words.
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The white space that parts words: 0x20 and 0x09 to 0x0D.
_IN_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a long text that are hashed at once.
STRETCH = 4 << 20
_kept: dict[str, Callable[[], None]] = {}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of an odd base modulo 2**64, and their inverses."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, inverse = max(1 << 16, 1 << (n - 1).bit_length()), pow(base, -1, 1 << 64)
        both = []
        for x in (base, inverse):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(x)
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words `[^\\x20\\x09-\\x0D]+` of a text in UTF-8 begin and end."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from sums of values times powers: a range's sum, taken back to the front, depends on its bytes alone."""
    up, down = _powers_of(_BASES[0], len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[np.frombuffer(raw, dtype=np.uint8)] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def stretches(raw: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """A text in UTF-8 in parts of about size bytes that begin at white space."""
    at = 0
    while len(raw) - at > size:
        space = _SPACE.search(raw, at + size)
        if not space:
            break
        yield raw[at : space.start()]
        at = space.start()
    yield raw[at:] if at else raw


def word_hashes(raw: bytes | None, lower: bool) -> np.ndarray:
    """Hashes of a text's words in order, of A-Z in lower case if so wished; none for null or empty texts. A long text is hashed stretch by stretch."""
    if not raw:
        return np.empty(0, dtype=np.uint64)
    parts = [span_hashes(s, *word_spans(s)) for s in map(bytes.lower if lower else bytes, stretches(raw))]  # of bytes, only A-Z change
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; position i is the run that starts at word i."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers_of(_BASES[1], len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    g = (sums[n:] - sums[:-n]) * down[:size]
    return (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shingles_in_order(raw: bytes | None, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of a lower-cased text, in its order; a text of fewer words is one shingle, an empty one has none."""
    h = word_hashes(raw, lower=True)
    return gram_hashes(h, min(n, len(h))) if len(h) else h


def shingle_set(raw: bytes | None, n: int) -> np.ndarray:
    """The distinct ones of shingles_in_order(), sorted."""
    g = np.sort(shingles_in_order(raw, n))
    return g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g


def raw_texts(column) -> list[bytes | None]:
    """An Arrow column of strings as UTF-8."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def texts_in_turn(column, rows: int = 64) -> Iterator[bytes | None]:
    """raw_texts() of some rows at a time, so that a batch isn't held twice."""
    for a in range(0, len(column), rows):
        yield from raw_texts(column.slice(a, rows))


def keep_only(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Workers go on from stage to stage: what other operators have kept in this one goes, and what Arrow's pool has no use for. forget: lets go of what the owner keeps."""
    import pyarrow as pa

    if others := [k for k in _kept if k != owner]:
        for other in others:
            _kept.pop(other)()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if forget:
        _kept[owner] = forget


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not use, in any case of letters."""
    used = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in used:
            w = f"_{w}"
        used.add(w.lower())
        out.append(w)
    return out


def numbered(df: DataFrame, name: str, by: Column) -> DataFrame:
    """df with a number for each row. A task that runs again numbers alike, in whatever order it gets its rows: they are sorted by a hash of all that tells them apart."""
    return df.sortWithinPartitions(by).withColumn(name, F.monotonically_increasing_id())


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only in local sessions that name none, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once no object refers to their plans; between steps that write much, that is looked for at once."""
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut. With spark.cleaner.referenceTracking.cleanCheckpoints the session drops the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to a path that driver and executors share, and read from there: small files are read several a task, and joins know the size.

    The schema is read by a small job: until the next one, Spark's scheduler refers to shuffle files of the last, and let_go() would miss them.
    """
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that links reach), for nodes that have an edge; ids are long. The result is a checkpoint.

    Alternates large-star and small-star steps (Kiveris et al. 2014): every round rewrites the edges towards local minima, needs two
    group-bys with map-side minima and ends when the edge set no longer changes. Hubs are never gathered in one task. The driver keeps
    something of every task that ran, so a round has few of them: its edges are files that are read together, once for both directions.
    """
    spark, x, y = edges.sparkSession, F.col(a).cast("long"), F.col(b).cast("long")
    folder = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    e = stored(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), f"{folder}/0")

    def sign_of(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def each(of: DataFrame, *ends: tuple[str, str]) -> DataFrame:
        """A row u, v for each of these pairs of columns."""
        return of.select(F.inline(F.array(*[F.struct(F.col(s).alias("u"), F.col(t).alias("v")) for s, t in ends])))

    last = sign_of(e)  # links that are stars already settle in the first round
    for k in range(1, rounds + 1):
        both = each(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above u is linked to the least of u's surroundings, which is below it
        down = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the neighbours below u, and u, are linked to the least of them
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        e = stored(each(down.join(least, "u"), ("v", "m"), ("u", "m")).where("u != v").distinct(), f"{folder}/{k}")
        drop_folder(spark, f"{folder}/{k - 1}")
        let_go(spark)
        sign = sign_of(e)
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    # settled: a star forest, each edge (member, smallest)
    out = checkpointed(each(e, ("u", "v"), ("v", "v")).select(F.col("u").alias("node"), F.col("v").alias("component")).groupBy("node").agg(F.min("component").alias("component")))
    drop_folder(spark, folder)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def binomial_tail(n: int, p: float, least: int) -> float:
    """P(X >= least)."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))
