"""Text functions as Columns: nothing here leaves the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of dates, document codes, capitalised phrases, identifiers that a rewrite must keep; words that mark organisations.
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4})\b"
CODE = r"\b\d{1,6}[/-][A-Za-zĐđ]{1,12}(?:[/-][A-Za-z0-9Đđ]{1,16})+\b"
PHRASE = r"\b[A-ZÀ-Ỵ][A-Za-zÀ-ỹĐđ'\-]*(?:\s+[A-ZÀ-Ỵ][A-Za-zÀ-ỹĐđ'\-]*){1,4}\b"
PROTECTED = [r"(?iu)\d{1,3}/[A-ZĐÂĂÊÔƠƯÀÁẢÃẠ][A-ZĐÂĂÊÔƠƯÀÁẢÃẠ\-]+", r"\d{1,2}/\d{1,2}/\d{4}", r"\b\d{4}\b"]
ORGANISATION_HINTS = ["bộ ", "đội ", "ban ", "phòng ", "trung tâm", "cục ", "tập đoàn", "công ty", "học viện", "viện ", "quân khu", "viettel", "qutw"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_spaces(c: str | Column) -> Column:
    """White space collapsed to single spaces and trimmed; null gives an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s{2,}|[\s&&[^ ]]", " "))  # a single space is no match


def words(c: str | Column) -> Column:
    return F.filter(F.split(normalize_spaces(c), " "), lambda w: w != "")


def first_words(c: str | Column, n: int) -> Column:
    """The first n words; what follows them is not looked at. A part ahead of the first word may be empty, and the last part is the rest."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+", n + 2)
    return F.array_join(F.slice(F.filter(parts, lambda w: w != ""), 1, n), " ")


def casefold(c: str | Column) -> Column:
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and those letters."""
    found = {}
    for i in range(0x80, min(sys.maxunicode, 0xFFFF)):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != chr(i) and not 0xD800 <= i < 0xE000:
            found[chr(i)] = bare
    return "".join(found), "".join(found.values())


def fold(c: str | Column) -> Column:
    """Without accents, in lower case, white space collapsed. A letter such as đ that has no decomposition stays."""
    old, new = _accents()
    text = F.coalesce(col(c), F.lit(""))
    bare = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(F.translate(text, old, new), r"\p{Mn}+", ""))  # ASCII has no accents
    return normalize_spaces(F.lower(bare))


def lookup_terms(c: str | Column) -> Column:
    """Terms of two characters or more of the folded text, in order, repeats kept."""
    return F.regexp_extract_all(fold(c), F.lit("([a-z0-9/-]{2,})"))


def dedupe(items: Column, limit: int) -> Column:
    """The first of each item that differs by more than case and spaces, without empty ones, at most limit."""

    def first(x: Column) -> Column:
        return F.transform(F.slice(F.array_distinct(x["keys"]), 1, limit), lambda k: F.get(x["items"], (F.array_position(x["keys"], k) - 1).cast("int")))

    kept = F.transform(F.array(F.filter(F.transform(items, normalize_spaces), lambda x: x != "")), lambda k: F.struct(k.alias("items"), F.transform(k, casefold).alias("keys")))
    return F.transform(kept, first)[0]  # arrays of one, so that items and keys are made once


def matches(c: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"({pattern})"))


def document_codes(c: str | Column, limit: int = 20) -> Column:
    return dedupe(F.transform(matches(c, CODE), F.upper), limit)


def dates(c: str | Column, limit: int = 20) -> Column:
    return dedupe(matches(c, DATE), limit)


def phrases(c: str | Column) -> Column:
    return F.filter(F.transform(matches(c, PHRASE), normalize_spaces), lambda p: F.length(p) >= 3)


def is_organisation(p: Column) -> Column:
    """By a hint, or all upper case and short."""
    key = casefold(p)
    hinted = F.exists(F.array(*[F.lit(h) for h in ORGANISATION_HINTS]), lambda h: F.contains(key, h))
    return hinted | ((p == F.upper(p)) & (p != F.lower(p)) & (F.length(p) <= 25))


def entities(c: str | Column, limit: int = 30) -> Column:
    return dedupe(F.filter(phrases(c), lambda p: ~is_organisation(p)), limit)


def organisations(c: str | Column, limit: int = 30) -> Column:
    return dedupe(F.filter(phrases(c), is_organisation), limit)


def phrase_kinds(c: str | Column, limit: int = 30) -> Column:
    """struct of organisations and entities; the phrases are found and judged once for both."""
    judged = F.transform(phrases(c), lambda p: F.struct(p.alias("p"), is_organisation(p).alias("o")))
    pick = lambda all_, which: dedupe(F.transform(F.filter(all_, lambda x: which(x["o"])), lambda x: x["p"]), limit)
    return F.transform(F.array(judged), lambda j: F.struct(pick(j, lambda o: o).alias("organisations"), pick(j, lambda o: ~o).alias("entities")))[0]


def keywords(c: str | Column, limit: int = 20) -> Column:
    both = F.transform(F.array(phrase_kinds(c)), lambda k: F.concat(k["organisations"], k["entities"]))[0]
    return dedupe(F.concat(document_codes(c), both, dates(c)), limit)


def preview(c: str | Column, limit: int = 120) -> Column:
    t = normalize_spaces(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def protected_identifiers(c: str | Column) -> Column:
    return F.array_distinct(F.concat(*[matches(c, p) for p in PROTECTED]))


def session_title(c: str | Column) -> Column:
    t = F.substring(normalize_spaces(c), 1, 255)
    return F.when(t == "", F.lit("New chat")).otherwise(t)


def rewrite_gate(c: str | Column, least: int = 4, most: int = 8) -> Column:
    n = F.size(lookup_terms(c))
    return F.when(n < least, F.lit("too_short")).when(n >= most, F.lit("already_specific")).otherwise(F.lit("rewrite_window"))


def json_object(c: str | Column) -> Column:
    """What stands between the first { and the last }, null without them or where it is no JSON."""
    body = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(body, "$").isNotNull(), body)


def log_stem(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^A-Za-z0-9._-]+", "_")


def json_answer(c: str | Column) -> Column:
    """A model's answer without code fences at the ends of its lines; where it then doesn't begin with {, what stands between the first { and the last }, else all of it."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?m)^```(?:json)?\s*|\s*```$", ""), r"^\s+|\s+$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(bare.startswith("{") | (inner == ""), bare).otherwise(inner)


def split_thought(c: str | Column) -> Column:
    """struct of reasoning and answer: what stands in the first <think> and what follows it; all that follows an open tag, and no answer; or the text as the answer."""
    t = F.coalesce(col(c), F.lit(""))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    whole, open_ = r"(?s)<think>(.*?)</think>(.*)$", r"(?s)<think>(.*)$"
    both, one = t.rlike(whole), t.contains("<think>")
    reasoning = F.when(both, strip(F.regexp_extract(t, whole, 1))).when(one, strip(F.regexp_extract(t, open_, 1))).otherwise(F.lit(""))
    answer = F.when(both, strip(F.regexp_extract(t, whole, 2))).when(one, F.lit("")).otherwise(t)
    return F.struct(reasoning.alias("reasoning"), answer.alias("answer"))
