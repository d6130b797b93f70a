"""Single tables that jobs write, replace and delete rows of, by key, in a folder that driver and executors share; jobs over several take versions.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

_ROWS = "rows"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table, none if there is none."""
    return Versions(spark, path).read(_ROWS, schema)


def replace_rows(new: DataFrame, path: str, keys: list[str], part_by: list[str] | None = None) -> None:
    """Puts new in place of all rows with its keys. part_by, some of the keys, deals the table into parts (all keys if not given). Run again, it changes nothing."""
    Versions(new.sparkSession, path).transaction(lambda tx: tx.replace(_ROWS, new, keys, part_by))


def delete_rows(spark: SparkSession, path: str, gone: DataFrame, keys: list[str]) -> None:
    """Takes out the rows with these keys; without a table nothing happens."""
    Versions(spark, path).transaction(lambda tx: tx.delete(_ROWS, gone, keys))


def append_rows(new: DataFrame, path: str) -> None:
    """Adds events to a log table; nothing that is there is read."""
    Versions(new.sparkSession, path).transaction(lambda tx: tx.append(_ROWS, new))


def compact(spark: SparkSession, path: str, schema: str) -> None:
    """Puts the segments of a log table together."""
    Versions(spark, path).transaction(lambda tx: tx.compact(_ROWS, schema))


def clear(spark: SparkSession, path: str) -> None:
    Versions(spark, path).transaction(lambda tx: tx.clear(_ROWS))


def land_uploads(files: DataFrame, path: str) -> DataFrame:
    """Files (name, content binary, title) as rows of a landing table: stored under a name of their own, with status uploaded, titled by name if they have no title. Returns the rows that were added."""
    stored = F.concat(F.substring(F.sha2(F.concat(F.col("content"), F.encode(F.lit(uuid.uuid4().hex), "UTF-8"), F.encode("name", "UTF-8")), 256), 1, 32), F.lit("_"), F.col("name"))
    rows = files.select(stored.alias("stored_filename"), F.col("name").alias("original_filename"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("name")).alias("title"), F.lit("uploaded").alias("status"), "content")
    append_rows(rows, path)
    return rows.drop("content")


def write_review(sections: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """A readable dump of chunks and their headers, as text files for each document's hash."""
    line = F.concat(F.lit("## "), F.col(id_col).cast("string"), F.lit(" / "), F.col("chunk_index").cast("string"), F.lit(" | "), F.concat_ws(" > ", *[c for c in sections.columns if c[0] == "h" and c[1:].isdigit()]), F.lit("\n"), F.col("content"))
    sections.sortWithinPartitions(id_col, "chunk_index").select(line.alias("value")).write.mode("overwrite").text(path)
