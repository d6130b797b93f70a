"""The indexing job over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import indexing_job
from ..settings import Settings
from ..sources.versions import Transaction, Versions

#: What lands: files as they were at a time, or that they were deleted then; what is kept of the last arrival of each document.
FILES = "document_id long, file_name string, text string, modified timestamp, deleted boolean"
ARRIVALS = "document_id long, modified timestamp, deleted boolean"


def apply_batch(tx: Transaction, batch: DataFrame, settings: Settings) -> None:
    """Takes a batch of arrivals into the tables, inside a transaction.

    Of several arrivals of a document the last counts (at one time, a deletion before files, then the greater text). Those that are not later than
    what was taken before change nothing, also if that was a deletion.
    """
    order = F.struct("modified", F.coalesce("deleted", F.lit(False)).alias("d"), F.coalesce("text", F.lit("")).alias("t"), F.coalesce("file_name", F.lit("")).alias("n"))
    last = batch.where("document_id is not null").groupBy("document_id").agg(F.max_by(F.struct("file_name", "text", "modified", F.coalesce("deleted", F.lit(False)).alias("deleted")), order).alias("r")).select("document_id", "r.*")
    before = tx.read("arrivals", ARRIVALS).select("document_id", F.col("modified").alias("known"))
    new = tx.scratch(last.join(before, "document_id", "left").where("known is null or modified > known").drop("known"))
    if new.isEmpty():
        return
    indexing_job.delete_from(tx, new.where("deleted").select("document_id"))
    indexing_job.index_into(tx, new.where("not deleted").select("document_id", "file_name", "text"), settings)
    tx.replace("arrivals", new.select("document_id", "modified", "deleted"), ["document_id"])


def index_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, settings: Settings = Settings(), name: str = "landing", forever: bool = False) -> StreamingQuery:
    """Indexes files that land in a folder as Parquet (FILES), batch by batch, until nothing is left, or forever.

    A batch is one transaction of the tables below root, and its number is kept with the version that it made: a batch that is sent again, after a
    failure at any point, is done once. The numbers belong to the checkpoint: with a new one, give a new name.
    """
    versions = Versions(spark, root)

    def add(batch: DataFrame, number: int) -> None:
        versions.transaction(lambda tx: apply_batch(tx, batch, settings), (name, number))

    stream = spark.readStream.schema(FILES).parquet(landing).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (stream if forever else stream.trigger(availableNow=True)).start()
