"""Tags that are inferred from headers, file names and metadata; identity of chunks and points."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, col, dedupe, first_words, normalize_spaces

# Labels, and the parts of names that select them, in order.
DOC_TYPES = [("lịch sử", "Quy_trình_Lịch_sử"), ("quy trình", "Quy_trình"), ("hướng dẫn", "Hướng_dẫn"), ("quy định", "Quy_định")]
DEFAULT_DOC_TYPE = "Tài_liệu_nội_bộ"
LEVEL_NAMES = [(["public", "cong khai", "công khai"], "Công_khai"), (["confidential", "mat", "mật", "bi mat", "bí mật"], "Mật"), (["internal", "noi bo", "nội bộ"], "Nội_bộ")]
LEVEL_HINTS = [(["confidential", "mật", "mat", "bí_mật", "bi_mat", "tuyệt_mật", "tuyet_mat"], "Mật"), (["public", "công_khai", "cong_khai"], "Công_khai")]
DEFAULT_LEVEL = "Nội_bộ"
DEPARTMENTS = [(["chính trị", "chinh tri"], "Chính_trị"), (["kỹ thuật", "ky thuat"], "Kỹ_thuật"), (["nhân sự", "nhan su"], "Nhân_sự"), (["truyền thông", "truyen thong"], "Truyền_thông")]
DEFAULT_DEPARTMENT = "Tổng_hợp"
QUESTION_CODE, QUESTION_H3, QUESTION_H2 = "Văn bản %s nói về nội dung gì?", "%s được trình bày như thế nào?", "Nội dung trong mục %s là gì?"
QUESTION_ORG, QUESTION_ENTITY, QUESTION_DATE = "%s có vai trò gì trong đoạn này?", "%s được nhắc đến trong bối cảnh nào?", "Sự kiện nào xảy ra vào mốc %s?"
QUESTION_ANY, QUESTION_PAD = "Đoạn này trả lời câu hỏi trong hoàn cảnh nào?", "Thông tin chính của đoạn này là gì? (%d)"
SUMMARY_CHILD, NO_CONTENT = "Tóm tắt: ", "Không có nội dung khả dụng."


def _filled(c: str | Column) -> Column:
    return F.nullif(normalize_spaces(c), F.lit(""))


def _first_of(text: Column, rules: list, default: str) -> Column:
    out = F.lit(None).cast("string")
    for parts, label in reversed(rules):
        parts = [parts] if isinstance(parts, str) else parts
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(text, F.lit(p))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def context_h2(headers: str | Column) -> Column:
    h = col(headers)
    return F.coalesce(_filled(h["h2"]), _filled(h["h1"]))


def context_h3(headers: str | Column) -> Column:
    h = col(headers)
    return F.coalesce(_filled(h["h3"]), _filled(h["h4"]))


def doc_type(file_name: str | Column, existing: Column | None = None) -> Column:
    found = _first_of(casefold(normalize_spaces(file_name)), DOC_TYPES, DEFAULT_DOC_TYPE)
    return found if existing is None else F.coalesce(_filled(existing), found)


def level_name(c: Column) -> Column:
    key, out = casefold(normalize_spaces(c)), F.lit(None).cast("string")
    for names, label in LEVEL_NAMES:
        out = F.when(key.isin(names), F.lit(label)).otherwise(out)
    return out


def security_level(file_name: str | Column, admin: Column | None = None, direct: Column | None = None) -> Column:
    given = [level_name(c) for c in (admin, direct) if c is not None]
    return F.coalesce(*given, _first_of(casefold(normalize_spaces(file_name)), LEVEL_HINTS, DEFAULT_LEVEL))


def department(h2: Column, h3: Column, admin: Column | None = None, direct: Column | None = None) -> Column:
    given = [_filled(c) for c in (admin, direct) if c is not None]
    return F.coalesce(*given, _first_of(casefold(normalize_spaces(F.concat_ws(" ", h2, h3))), DEPARTMENTS, DEFAULT_DEPARTMENT))


def resolve_page(source_page: Column, page_number: Column, page: Column, marker_page: Column) -> Column:
    return F.coalesce(F.when(source_page > 0, source_page), F.when(page_number > 0, page_number), F.when(page >= 0, page + 1), F.when(marker_page >= 0, marker_page + 1))


def source_kind(parser: Column, kind: Column, suffix: Column) -> Column:
    parser, kind = F.lower(F.coalesce(parser, F.lit("legacy"))), F.lower(F.coalesce(kind, F.lit("")))
    kind = F.when(kind != "", kind).otherwise(F.when(suffix == ".pdf", F.lit("pdf")).otherwise(F.lit("text")))
    return F.when((kind == "pdf") & (parser == "marker"), F.lit("pdf_marker_page")).when(kind == "pdf", F.lit("pdf_page")).when(kind == "text", F.lit("text_chunk")).otherwise(kind)


def chunk_name(document: str | Column, index: str | Column) -> Column:
    return F.format_string("doc_%02d_chunk_%04d", col(document), col(index))


def hyq_summary(text: str | Column, n: int = 40) -> Column:
    return first_words(text, max(20, n))


def hyq_questions(codes: Column, h2: Column, h3: Column, orgs: Column, ents: Column, days: Column, count: int = 3) -> Column:
    """Questions that a chunk may answer: by code, header, organisation, entity and date, then a general one; padded to count."""
    first = lambda a: F.get(F.filter(a, lambda x: x != ""), 0)
    ask = lambda form, c: F.when(c.isNotNull(), F.format_string(form, c))
    head = F.coalesce(ask(QUESTION_H3, h3), ask(QUESTION_H2, h2))
    some = lambda a: F.when(F.size(a) > 0, first(a))
    asked = F.array_compact(F.array(ask(QUESTION_CODE, some(codes)), head, ask(QUESTION_ORG, some(orgs)), ask(QUESTION_ENTITY, some(ents)), ask(QUESTION_DATE, some(days)), F.lit(QUESTION_ANY)))
    kept = dedupe(asked, count)
    pads = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.format_string(QUESTION_PAD, k))
    all_ = F.concat(kept, F.filter(pads, lambda p, i: i >= F.size(kept)))
    return F.transform(all_, lambda q: F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))))


def common_questions(count: int = 3) -> list[str]:
    """The questions of hyq_questions() that name nothing of their chunk."""
    return [q if q.endswith("?") else f"{q}?" for q in (QUESTION_ANY, *(QUESTION_PAD % k for k in range(1, count + 1)))]


def children(summary: Column, questions: Column, text: Column) -> Column:
    """array<struct<child_type, child_text>>: the summary and up to 12 questions, else the text's first 120 words, else a notice."""
    kind = lambda t, x: F.struct(F.lit(t).alias("child_type"), x.alias("child_text"))
    asked = F.transform(dedupe(questions, 12), lambda q: kind("question", F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?")))))
    short = normalize_spaces(summary)
    made = F.concat(F.when(short != "", F.array(kind("summary", F.concat(F.lit(SUMMARY_CHILD), short)))).otherwise(F.slice(F.array(kind("summary", short)), 1, 0)), asked)
    return F.when(F.size(made) > 0, made).otherwise(F.array(kind("fallback", F.coalesce(F.nullif(first_words(text, 120), F.lit("")), F.lit(NO_CONTENT)))))


def known_children(summary: Column, questions: Column) -> Column:
    """What children() gives of hyq_summary() and hyq_questions() (one at least), which are clean and differ already."""
    kind = lambda t, x: F.struct(F.lit(t).alias("child_type"), x.alias("child_text"))
    short = F.filter(F.array(summary), lambda s: s != "")
    return F.concat(F.transform(short, lambda s: kind("summary", F.concat(F.lit(SUMMARY_CHILD), s))), F.transform(F.slice(questions, 1, 12), lambda q: kind("question", q)))


def point_id(collection: str, parent: Column, child_type: Column, index: Column) -> Column:
    """The name-based UUID (version 5, in the URL name space) of a child: SHA-1 with the version and variant bits set."""
    name = F.concat(F.lit(f"{collection}|parent:"), parent.cast("string"), F.lit("|type:"), child_type, F.lit("|index:"), index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fingerprint(text: Column, page: Column, kind: Column, raw: Column) -> Column:
    fields = F.struct(text.alias("chunk_text"), page.alias("source_page"), kind.alias("source_kind"), raw.alias("raw_metadata"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def page_separator(before: Column, after: Column) -> Column:
    """What joins two pages: nothing after a hyphen, a space inside a sentence, else a blank line."""
    b, a = F.rtrim(before), F.ltrim(after)
    last, first = F.substring(b, -1, 1), F.substring(a, 1, 1)
    alnum, alpha = r"^[\p{L}\p{N}]$", r"^\p{L}$"
    return (
        F.when((b == "") | (a == ""), F.lit("\n\n")).when(last == "-", F.lit("")).when(last.rlike(alnum) & first.rlike(alnum), F.lit(" "))
        .when(~last.isin(*".!?;:") & first.rlike(alpha), F.lit(" ")).otherwise(F.lit("\n\n"))
    )


def keyword_blob(*parts: Column) -> Column:
    return normalize_spaces(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
