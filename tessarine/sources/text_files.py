"""Files as sources: whole texts, JSON lines, and binary files for a parser that is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop

SUFFIXES = ("md", "markdown", "txt")
#: Folders into which texts are dealt that are written as files.
FOLDERS = 256


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def write_texts(texts: DataFrame, path: str) -> None:
    """Rows (name, text) as files of these names in a folder that all executors see; a file that a task writes again is the same.

    Files are dealt into FOLDERS folders by their names: tasks that make files in one folder wait for each other.
    """
    broad = texts.sparkSession.sparkContext.broadcast(path)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zlib import crc32

        system, folder = _at(broad.value)
        made: set[int] = set()
        for b in batches:
            for name, text in zip(b["name"], b["text"], strict=True):
                if (k := crc32(name.encode()) % FOLDERS) not in made:
                    made.add(k)
                    system.create_dir(f"{folder}/{k:03}", recursive=True)
                with system.open_output_stream(f"{folder}/{k:03}/{name}") as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"n": [len(b)]})

    texts.select("name", "text").mapInPandas(work, "n long").write.format("noop").mode("overwrite").save()


def drop_texts(spark: SparkSession, path: str) -> None:
    """Deletes what write_texts() wrote, its folders in as many tasks as there are cores."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = _at(path)
        for b in batches:
            for k in b["id"]:
                if system.get_file_info(f"{folder}/{k:03}").type == fs.FileType.Directory:
                    system.delete_dir(f"{folder}/{k:03}")
            yield pd.DataFrame({"n": [len(b)]})

    spark.range(0, FOLDERS, 1, spark.sparkContext.defaultParallelism).mapInPandas(work, "n long").write.format("noop").mode("overwrite").save()
    drop(spark, path)


def read_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, text, parser, kind, page: each file below path with one of the suffixes is one record; other files are left out."""
    files = spark.read.option("pathGlobFilter", "*.{%s}" % ",".join(suffixes)).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit("legacy").alias("parser"), F.lit("text").alias("kind"), F.lit(1).alias("page"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; lines that are none are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_legacy_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Logs of the older form, a file each: a JSON list, an object with a list named entries, or else JSON lines, of which broken ones are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{_fields(schema)}>>"))
    named = F.when(F.col("v").startswith("{"), F.from_json("v", f"entries array<struct<{_fields(schema)}>>")["entries"])
    lines = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    kept = F.transform(F.filter(lines, lambda x: x["_bad"].isNull()), lambda x: F.struct(*[x[n].alias(n) for n in _names(schema)]))
    return whole.select(F.explode(F.coalesce(listed, named, kept)).alias("e")).where("e is not null").select("e.*")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def _fields(schema: str) -> str:
    return ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(","))


def read_parsed(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page, text of binary files such as PDFs, by a parser from bytes to page texts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, k + 1, t) for p, c in zip(b["path"], b["content"], strict=True) for k, t in enumerate(parse(bytes(c)))], columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "path string, page int, text string")
