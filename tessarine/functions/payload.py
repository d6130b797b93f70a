"""What models and logs hand over: lenient casts, JSON payloads of enrichment, sources and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import QUESTION_PAD
from .text import col, dedupe, document_codes, first_words

# How many items of each kind are kept, of raw codes and of codes in one of them; keys of compact metadata.
LIMITS = {"keywords": 20, "entities": 30, "organizations": 30, "dates": 20, "document_codes": 20}
RAW_CODES, CODES_OF_ONE = 30, 5
METADATA_KEYS = ["chunk_id", "source_info", "context", "search_optimization", "admin_tags", "hyq"]


def safe_int(c: str | Column) -> Column:
    """A whole number, null where the text is none."""
    return F.when(F.trim(col(c)).rlike(r"^[+-]?[0-9]+$"), F.trim(col(c)).try_cast("long"))


def safe_float(c: str | Column) -> Column:
    return F.trim(col(c)).try_cast("double")


def json_safe(c: str | Column) -> Column:
    """Any value as JSON; what JSON has no form for becomes text."""
    return F.to_json(F.struct(col(c).alias("value")), {"ignoreNullFields": "false"})


def json_list(c: str | Column) -> Column:
    """The items of a JSON list as texts, objects as their JSON; none if it is no list."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def parse_sources(c: str | Column) -> Column:
    """The objects of a JSON list of sources; other items and broken JSON give nothing."""
    listed = F.ltrim(F.coalesce(col(c), F.lit(""))).startswith("[")
    return F.when(listed, F.filter(json_list(c), lambda x: x.startswith("{"))).otherwise(F.array().cast("array<string>"))


def compact_metadata(c: str | Column) -> Column:
    """map<string,string>: the wanted keys of a JSON object that hold something, all keys if none does; empty if it is no object."""
    raw = F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(raw, lambda k, v: k.isin(METADATA_KEYS) & v.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def search_payload(c: str | Column) -> Column:
    """struct of keywords, entities, organizations, dates, document_codes from a model's JSON: distinct, limited, codes found anew, keywords from the others where it gives none."""
    p = F.from_json(col(c), ", ".join(f"{k} array<string>" for k in LIMITS))
    given = lambda k, n: dedupe(F.array_compact(F.coalesce(p[k], F.array().cast("array<string>"))), n)
    entities, organizations, dates = (given(k, LIMITS[k]) for k in ("entities", "organizations", "dates"))
    codes = dedupe(F.flatten(F.transform(given("document_codes", RAW_CODES), lambda x: document_codes(x, CODES_OF_ONE))), LIMITS["document_codes"])
    words = given("keywords", LIMITS["keywords"])
    words = F.when(F.size(words) > 0, words).otherwise(dedupe(F.concat(codes, organizations, entities, dates), LIMITS["keywords"]))
    return F.struct(words.alias("keywords"), entities.alias("entities"), organizations.alias("organizations"), dates.alias("dates"), codes.alias("document_codes"))


def merge_payloads(first: Column, second: Column) -> Column:
    """Two of search_payload(), item by item: the first's, then what the second adds, within the limits."""
    return F.struct(*[dedupe(F.concat(first[k], second[k]), n).alias(k) for k, n in LIMITS.items()])


def hyq_payload(c: str | Column, words: int = 40, count: int = 3) -> Column:
    """struct of summary and questions from a model's JSON; null without a summary or without a list of questions. Questions are distinct, padded to count and end in a question mark."""
    p = F.from_json(col(c), "summary string, questions array<string>")
    summary, kept = first_words(p["summary"], words), dedupe(F.array_compact(F.coalesce(p["questions"], F.array().cast("array<string>"))), count)
    pads = F.filter(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.format_string(QUESTION_PAD, k)), lambda _, i: i >= F.size(kept))
    asked = F.transform(F.concat(kept, pads), lambda q: F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))))
    return F.when((summary != "") & (F.size(kept) > 0), F.struct(summary.alias("summary"), asked.alias("questions")))
