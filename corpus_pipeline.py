"""A corpus pipeline of five stages; each reads what its predecessor wrote.

Each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents, with those that docs has
beyond doc_id and text left as they are (n_chars follows the text). Empty tables give empty ones. A row without an id is judged by its text
alone: quality and benchmark may drop it, near_duplicates and repeats leave it as it is. Null and empty texts have no words, so they are no
copies, repeat nothing and hold no benchmark item; the classifier gives both the score of an empty text. Rows that repeat an id: quality
judges each row; near_duplicates and benchmark drop all rows of an id or none; repeats cuts each row by its own text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.llm import bpe, common, decontaminate, near_dup_text, quality, substring_dedup
from tessarine.llm.queries import learnable, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents of this stage's own input; with too few labels all stay."""
    model = quality.train(docs, common.read(spark, sf_dir, "labels"), learnable())
    return quality.keep_good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; documents without an id stay."""
    groups = near_dup_text.near_duplicates(docs)
    dropped = groups.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier passage are cut from the texts; a text that loses none stays as it is, also in its white space."""
    kept, print_ = common.free_name(docs, "kept", "text_hash")
    cut = substring_dedup.repeats(docs).where("n_removed > 0 and doc_id is not null").select("doc_id", F.col("text_hash").alias(print_), F.col("kept").alias(kept)).dropDuplicates(["doc_id", print_])
    both = docs.withColumn(print_, F.xxhash64(F.col("text").cast("string"))).join(cut, ["doc_id", print_], "left")
    new = {"text": F.coalesce(kept, "text")} | ({"n_chars": F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept))} if "n_chars" in docs.columns else {})
    return both.select([new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and a digest of what they decode to."""
    return bpe.bpe_encode(docs, tokenizer_path("byte_bpe_50k.json"), with_text=False, digests=True)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_each), ("repeats", cut_repeats), ("benchmark", drop_leaks), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again. A folder goes once the next is written."""
    docs, folder, last = common.read(spark, sf_dir, "documents"), f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            common.drop_folder(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
