"""Operator 4: sharding in two passes, with DataFrame functions only.

Pass one scatters whole records by seeded hashes into buckets of bytes that fit in memory. Pass two applies a seeded Fisher-Yates shuffle to
each bucket and writes it; the buckets of a shard, one after another, are its order. A record's shard is the one that scores highest for its key
(rendezvous hashing), so one more shard takes records only into itself and moves no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import free_name, numbered

#: Records and bytes of a bucket on average, at most.
BUCKET_ROWS, BUCKET_BYTES = 20_000, 8 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard from 0 on whose seeded hash with the key is highest."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key, F.lit(seed + s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["s"]


def _placed(docs: DataFrame, shards: int, seed: int, id_col: str, text_col: str, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, str, str, str]:
    """docs with shard, bucket, grown_shard and slot, all rows of a bucket in one task; and the names of shard, bucket and slot."""
    shard_name, grown_name, slot_name, bucket, rows, base, order, row, tag = free_name(docs, "shard", "grown_shard", "slot", "bucket", "_rows", "_base", "_order", "_row", "_tag")
    names = docs.columns
    key = F.col(id_col).cast("string")
    shard_col = F.coalesce(shard_of(key, shards, seed), F.lit(0)).cast("int")
    text = F.col(text_col).cast("string")
    others = [F.to_json(F.struct(F.col(c).alias("v"))) for c in names if c not in (id_col, text_col)]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in [key, text, *others]), F.lit(0).cast("long"))
    # as many rows as there are shards: a shard of more rows or bytes has more buckets
    held = docs.select(shard_col.alias(shard_name), width.alias(row)).groupBy(shard_name).agg(F.count(F.lit(1)).alias(rows), F.sum(row).alias(base)).collect()
    counts = {r[shard_name]: max(1, -(-r[rows] // bucket_rows), -(-r[base] // bucket_bytes)) for r in held}
    buckets = F.element_at(F.array(*[F.lit(counts.get(s, 1)) for s in range(shards)]), F.col(shard_name) + 1)
    placed = docs.select(
        *names,
        shard_col.alias(shard_name),
        F.coalesce(shard_of(key, shards + 1, seed), F.lit(0)).cast("int").alias(grown_name),
        F.xxhash64(F.lit(seed), key, text, *others).alias(order),
    )
    # a repeated row has the same hash as its twin: the tag spreads twins over the buckets
    placed = numbered(placed, tag, F.col(order)).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(order), F.col(tag)), buckets).cast("int"))
    # as many tasks as buckets, so that a task holds a few of them at any size
    placed = placed.repartition(max(1, sum(counts.values())), shard_name, bucket)
    fields = F.struct(F.col(order), F.col(tag), *[F.col(c) for c in [*names, grown_name]])
    gathered = placed.groupBy(shard_name, bucket).agg(F.sort_array(F.collect_list(fields)).alias(rows))
    # in a settled order of buckets, so that the generator's draws are the same when a task runs again
    gathered = gathered.sortWithinPartitions(shard_name, bucket)
    shuffled = gathered.select(shard_name, bucket, F.shuffle(F.col(rows), seed).alias(rows))
    # as many rows as there are buckets; the shuffle that gathers them is used again
    sizes = gathered.select(shard_name, bucket, F.size(rows).cast("long").alias(rows))
    first = W.Window.partitionBy(shard_name).orderBy(bucket).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sizes.select(shard_name, bucket, F.coalesce(F.sum(rows).over(first), F.lit(0)).alias(base))
    out = shuffled.join(F.broadcast(starts), [shard_name, bucket]).select(shard_name, bucket, base, F.posexplode(rows).alias("pos", row))
    out = out.select(*[F.col(row)[c].alias(c) for c in names], F.col(shard_name), F.col(bucket), F.col(row)[grown_name].alias(grown_name), (F.col(base) + F.col("pos")).cast("long").alias(slot_name))
    return out, shard_name, bucket, slot_name


def shard(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The columns of docs with shard, grown_shard (with one shard more) and slot (place in the shard, gapless from 0).

    The law is `key`: id and shard count decide. Equal ids share a shard; each of their rows, and each repeated row, has a slot of its
    own. A null id counts as a key like others, a null text as none. Texts of any length and extra columns move with their row. An empty
    table gives an empty one. Rows of a bucket are ordered before they are shuffled, so a lost task is redone alike.
    """
    placed, _, bucket, _ = _placed(docs, shards, seed, id_col, text_col, bucket_rows, bucket_bytes)
    return placed.drop(bucket)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes docs in their shuffled order and returns what is written: a folder shard=N for each shard, in it one bucket=M for each bucket.

    Buckets of a shard follow each other by number, and the rows of a bucket are ordered by slot.
    """
    placed, shard_name, bucket, slot = _placed(docs, shards, seed, id_col, text_col, bucket_rows, bucket_bytes)
    placed.sortWithinPartitions(shard_name, bucket, slot).write.partitionBy(shard_name, bucket).parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path).select(placed.columns)


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc32_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast(T.BinaryType()))
