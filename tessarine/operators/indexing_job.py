"""The indexing job as a whole: parse, split, describe, make children, embed, and put all of it in place of what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import tags, text
from ..settings import Settings
from ..sources.versions import Conflict, Transaction, Versions
from . import indexing, splitting
from .embedding import hash_embed

#: Rows that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Schemas of the tables below a root folder.
PARSED = "document_id long, page_id int, text string"
CHUNKS = (
    "document_id long, chunk_index int, start_index long, page int, file_name string, content string, h2 string, h3 string, codes array<string>, organisations array<string>, "
    "entities array<string>, dates array<string>, doc_type string, security_level string, department string, fingerprint string"
)
CACHE = "document_id long, file_hash string, fingerprint string, summary string, questions array<string>"
POINTS = "point_id string, document_id long, chunk_index int, child_type string, child_index int, child_text string, vector array<float>"
STATES = "document_id long, file_hash string, status string, parents long, children long"
META = "document_id long, file_hash string, parser string, kind string"
TABLES = {"parsed": PARSED, "parsed_meta": META, "chunks": CHUNKS, "cache": CACHE, "points": POINTS, "states": STATES}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return Versions(spark, root).read(name, TABLES[name])


def described(chunks: DataFrame, *more: str) -> DataFrame:
    """Chunks (document_id, file_name, content, page, h1 to h6 and places) with their metadata, and more columns as they are."""
    h = F.struct(*[f"h{i}" for i in range(1, 5)])
    c = chunks.withColumn("_h2", tags.context_h2(h)).withColumn("_h3", tags.context_h3(h)).withColumn("_kinds", text.phrase_kinds("content"))
    return c.select(
        "document_id", "chunk_index", "start_index", "page", "file_name", "content", F.col("_h2").alias("h2"), F.col("_h3").alias("h3"),
        text.document_codes("content").alias("codes"), F.col("_kinds.organisations").alias("organisations"), F.col("_kinds.entities").alias("entities"), text.dates("content").alias("dates"),
        tags.doc_type("file_name").alias("doc_type"), tags.security_level("file_name").alias("security_level"), tags.department(F.col("_h2"), F.col("_h3")).alias("department"),
        tags.fingerprint(F.col("content"), F.col("page"), F.lit("text_chunk"), F.col("file_name")).alias("fingerprint"), *more,
    )


def later(tx: Transaction, chunks: DataFrame) -> DataFrame:
    """document_id, chunk_index of chunks whose fingerprint an earlier one of their document has; to be left out of chunks that stay where they are."""
    w = W.Window.partitionBy("document_id", F.unhex("fingerprint")).orderBy("chunk_index")
    found = tx.scratch(chunks.select("document_id", "chunk_index", F.row_number().over(w).alias("n")).where("n > 1").drop("n"))
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def asked(chunks: DataFrame, settings: Settings, *more: str) -> DataFrame:
    """Fingerprints of chunks with the summary and the questions that stand for them."""
    questions = tags.hyq_questions(F.col("codes"), F.col("h2"), F.col("h3"), F.col("organisations"), F.col("entities"), F.col("dates"), settings.hyq_questions)
    return chunks.select("document_id", *more, "fingerprint", tags.hyq_summary("content", settings.summary_words).alias("summary"), questions.alias("questions"))


def child_points(tx: Transaction, chunks: DataFrame, cache: DataFrame, settings: Settings, bits: int) -> DataFrame:
    """A point for each child of each chunk: the summary and the questions, embedded.

    Chunks and what is known of their fingerprints meet in one shuffle, dealt as the parts of the table are; texts of chunks stay where they are: a summary
    is blank only where the text is, since the fingerprint covers it.
    """
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    key = ["document_id", F.unhex("fingerprint").alias("print")]
    of = F.struct("summary", "questions").alias("of")
    both = chunks.select(*key, "chunk_index", none("struct<summary: string, questions: array<string>>", "of")).unionByName(cache.select(*key, none("int", "chunk_index"), of))
    w = W.Window.partitionBy("_range", "document_id", "print")
    c = tx.ranges(both, ["document_id"], bits).withColumn("of", F.max("of").over(w)).where("chunk_index is not null and of is not null")
    kids = F.posexplode(tags.known_children(F.col("of.summary"), F.col("of.questions"))).alias("child_index", "c")
    c = c.select("document_id", "chunk_index", kids)
    parent = F.concat_ws("-", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))
    c = c.select(tags.point_id(settings.collection, parent, F.col("c.child_type"), F.col("child_index")).alias("point_id"), "document_id", "chunk_index", F.col("c.child_type").alias("child_type"), "child_index", F.col("c.child_text").alias("child_text"))
    return hash_embed(c, [k for k in c.columns], "child_text", settings.embedding_dim, tags.common_questions(settings.hyq_questions))


def index_into(tx: Transaction, files: DataFrame, settings: Settings = Settings()) -> None:
    """Indexes files (document_id, file_name, text) whose hash is new or changed, inside a transaction.

    Pages of a file that was parsed before with the same hash are taken as they are. Summaries and questions of chunks that a former run knew,
    by file hash and fingerprint, are taken from the cache. Documents without text are parsed only. Tables that had no rows are dealt into
    parts as they are written, by the bytes of the texts; texts and pages are shuffled once each, and chunks not at all.
    """
    got = lambda name: tx.read(name, TABLES[name])
    new_here = {name for name in TABLES if not tx.has(name)}  # all that they will hold is of this run
    hashed = files.withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = indexing.pending(hashed, got("states"), "document_id")
    todo = tx.scratch(texts.select("document_id", "file_hash", "file_name", F.octet_length("text").alias("n_bytes")))
    if todo.isEmpty():
        return
    bits = tx.bits(todo.agg(F.sum("n_bytes")).first()[0] or 0)
    ranges = lambda df: tx.ranges(df, ["document_id"], bits)
    unparsed = todo.join(got("parsed_meta"), ["document_id", "file_hash"], "left_anti")
    texts = texts.join(got("parsed_meta").select("document_id", "file_hash"), ["document_id", "file_hash"], "left_anti")
    tx.replace("parsed", splitting.markdown_of(ranges(texts.select("document_id", "file_name", "text")), "document_id", "file_name", "text"), ["document_id"], gone=unparsed, bits=bits)
    kind = F.when(F.lower("file_name").endswith(".pdf"), "pdf").otherwise("text")
    tx.replace("parsed_meta", unparsed.select("document_id", "file_hash", F.lit("legacy").alias("parser"), kind.alias("kind")), ["document_id"])
    semi = lambda rows, name: rows if name in new_here else rows.join(todo.select("document_id"), "document_id", "left_semi")
    here = lambda name: semi(got(name), name)
    named = ["file_name", "file_hash"]
    about = todo.select("document_id", F.lit(None).cast("int").alias("page_id"), F.lit(None).cast("string").alias("text"), F.struct(*named).alias("file"))
    pages = ranges(here("parsed").withColumn("file", F.lit(None).cast(about.schema["file"].dataType)).unionByName(about))
    pages = pages.withColumn("file", F.max("file").over(W.Window.partitionBy("_range", "document_id"))).where("page_id is not null").select("_range", "document_id", "page_id", "text", "file.*")
    merged = splitting.merge_pages(pages, "document_id", "page_id", "text", ["_range", *named])
    chunks = splitting.split_documents(merged, "document_id", settings.chunk_size, settings.chunk_overlap, named)
    tx.replace("chunks", described(chunks, "file_hash"), ["document_id"], gone=todo, bits=bits)
    chunks = semi(tx.read("chunks", f"{CHUNKS}, file_hash string"), "chunks")  # those of this run have it
    known = lambda: got("cache").join(todo.select("document_id", "file_hash"), ["document_id", "file_hash"], "left_semi")
    firsts = chunks.join(later(tx, chunks), ["document_id", "chunk_index"], "left_anti")
    new = asked(indexing.misses(firsts, known(), ["document_id", "file_hash", "fingerprint"]), settings, "file_hash")
    tx.replace("cache", new, ["document_id", "file_hash", "fingerprint"], ["document_id"], bits=bits)
    tx.replace("points", child_points(tx, chunks, got("cache") if "cache" in new_here else known(), settings, bits), ["document_id"], gone=todo, bits=bits)
    n = lambda name, c: here(name).groupBy("document_id").agg(F.count(F.lit(1)).alias(c))
    counts = todo.join(n("chunks", "parents"), "document_id", "left").join(n("points", "children"), "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    tx.replace("states", counts.select("document_id", "file_hash", F.when(zero("parents") > 0, "embedded").otherwise("parsed").alias("status"), zero("parents").alias("parents"), zero("children").alias("children")), ["document_id"])


def delete_from(tx: Transaction, gone: DataFrame) -> None:
    """Takes documents out of all tables, inside a transaction."""
    for name in TABLES:
        tx.delete(name, gone, ["document_id"])


def _failed(tx: Transaction, files: DataFrame) -> None:
    hashed = files.select("document_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"))
    todo = indexing.pending(hashed, tx.read("states", STATES), "document_id")
    none = F.lit(0).cast("long")
    tx.replace("states", todo.select("document_id", "file_hash", F.lit("index_failed").alias("status"), none.alias("parents"), none.alias("children")), ["document_id"])


def run(spark: SparkSession, files: DataFrame, root: str, settings: Settings = Settings()) -> DataFrame:
    """Indexes files in one transaction (see index_into), and returns the states of all documents.

    Readers see all of it or nothing, whatever happens to the job. When it fails, e.g. at an unsupported suffix, nothing of it stays but the
    state index_failed of the documents that were to be indexed; they are taken again by the next run.
    """
    versions = Versions(spark, root)
    try:
        versions.transaction(lambda tx: index_into(tx, files, settings))
    except Conflict:
        raise
    except Exception:
        versions.transaction(lambda tx: _failed(tx, files))
        raise
    return versions.read("states", STATES)


def rebuild_points(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """Makes all points anew from the chunks and the cache; returns the ids of the documents touched, in order."""

    def change(tx: Transaction) -> None:
        cache, chunks, key = tx.read("cache", CACHE), tx.read("chunks", CHUNKS), ["document_id", "fingerprint"]
        keys = lambda df: df.select("document_id", F.unhex("fingerprint").alias("print"))
        lacking = indexing.misses(keys(chunks), keys(cache), ["document_id", "print"])
        if not lacking.isEmpty():
            lacks = chunks.withColumn("print", F.unhex("fingerprint")).join(lacking.distinct(), ["document_id", "print"], "left_semi")
            lacks = lacks.join(later(tx, lacks), ["document_id", "chunk_index"], "left_anti")
            cache = cache.select(*key, "summary", "questions").unionByName(asked(lacks, settings))
        bits = tx.bits(sum(p["bytes"] for p in tx.parts("chunks")))
        tx.clear("points")  # all of them are made anew, none of the old ones is read
        tx.replace("points", child_points(tx, chunks, cache, settings, bits), ["document_id"], bits=bits)

    Versions(spark, root).transaction(change)
    return table(spark, root, "points").select("document_id").distinct().orderBy("document_id")


def delete_documents(spark: SparkSession, gone: DataFrame, root: str) -> None:
    """Takes documents out of all tables in one version."""
    Versions(spark, root).transaction(lambda tx: delete_from(tx, gone))
