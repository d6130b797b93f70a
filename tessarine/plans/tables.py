"""Tables as the queries see them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CODE, DATE, ORGANISATION_HINTS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))


def coded(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "source", F.concat((F.col("doc_id") % 1000).cast("string"), F.lit("/QD-"), F.upper("lang"), F.lit(" "), F.col("text")).alias("text"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


LINES = "lines AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS chunk_index, unnest(string_split(text, chr(10))) AS content FROM documents)"
CODED = "coded AS (SELECT doc_id, source, (doc_id % 1000) || '/QD-' || upper(lang) || ' ' || text AS text FROM documents)"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def folded(x: str) -> str:
    return norm(f"lower(strip_accents(coalesce({x}, '')))")


def terms(x: str) -> str:
    return f"list_filter(regexp_extract_all({folded(x)}, '[a-z0-9/-]+'), lambda t: length(t) >= 2)"


def key(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def dedupe(items: str, limit: int) -> str:
    """SQL of the first distinct items; items is written once, as a parameter of the outer lambda."""
    clean = f"list_filter(list_transform({items}, lambda x: {norm('x')}), lambda x: x <> '')"
    return f"(list_transform([{clean}], lambda l: list_slice(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: {key('y')}), {key('x')}) = i), 1, {limit})))[1]"


# The patterns of the functions, but PHRASE: RE2 knows ASCII word borders only, so that the letter ahead is looked at instead.
PHRASE = r"(?:^|[^\p{L}\p{N}_])([A-ZÀ-Ỵ][A-Za-zÀ-ỹĐđ''\-]*(?:\s+[A-ZÀ-Ỵ][A-Za-zÀ-ỹĐđ''\-]*){1,4})"


def sql_codes(x: str, n: int = 20) -> str:
    return dedupe(f"list_transform(regexp_extract_all(coalesce({x}, ''), '{CODE}'), lambda c: upper(c))", n)


def sql_dates(x: str, n: int = 20) -> str:
    return dedupe(f"regexp_extract_all(coalesce({x}, ''), '{DATE}')", n)


def sql_phrases(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '{PHRASE}', 1), lambda p: {norm('p')}), lambda p: length(p) >= 3)"


def sql_is_org(p: str) -> str:
    hinted = " OR ".join(f"contains({key(p)}, '{h}')" for h in ORGANISATION_HINTS)
    return f"({hinted} OR ({p} = upper({p}) AND {p} <> lower({p}) AND length({p}) <= 25))"


def sql_entities(x: str, n: int = 30) -> str:
    return dedupe(f"list_filter({sql_phrases(x)}, lambda p: NOT {sql_is_org('p')})", n)


def sql_orgs(x: str, n: int = 30) -> str:
    return dedupe(f"list_filter({sql_phrases(x)}, lambda p: {sql_is_org('p')})", n)


def sql_keywords(x: str, n: int = 20) -> str:
    return dedupe(f"list_concat(list_concat({sql_codes(x)}, {sql_orgs(x)}), list_concat({sql_entities(x)}, {sql_dates(x)}))", n)


def sql_words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"
