"""Splitting of documents: pages, Markdown sections, overlapping chunks, batches."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.tags import page_separator

# Characters of a chunk and of its overlap with the one before; separators, coarse ones first; marks of pages.
CHUNK, OVERLAP, SEPARATORS = 500, 50, ["\n\n", "\n", ". ", ", ", " ", ""]
PAGE_MARK = r"\{\d+\}-+"
PAGE_BREAK = r"\n\n\{(\d+)\}-+\n\n"
#: Bytes of texts and rows made of them that a Python worker holds at once.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 4096


def split_pages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, page_id, text of the pages after each page break; text ahead of the first break and empty pages are left out."""
    ids = F.regexp_extract_all(text_col, F.lit(PAGE_BREAK))
    parts = F.split(text_col, PAGE_BREAK)
    both = docs.select(id_col, F.explode(F.arrays_zip(ids.alias("page_id"), F.slice(parts, 2, F.size(ids)).alias("text"))).alias("p"))
    return both.select(id_col, F.col("p.page_id").cast("int").alias("page_id"), F.trim(F.regexp_replace("p.text", r"^\s+|\s+$", "")).alias("text")).where("text != ''")


def merge_pages(pages: DataFrame, id_col: str, page_col: str, text_col: str, by: list[str] = []) -> DataFrame:
    """id, columns of by, text, spans (array of start, end, page): pages put together in order, blank ones left out, with what fits between them.

    by names columns that are the same in all pages of a document; where pages are dealt by one of these they stay where they are.
    """
    w = W.Window.partitionBy(*by, id_col).orderBy(page_col)
    p = pages.withColumn("_t", F.trim(F.col(text_col))).where("_t != ''").withColumn("_before", F.lag("_t").over(w))
    p = p.withColumn("_sep", F.when(F.col("_before").isNull(), F.lit("")).otherwise(page_separator(F.col("_before"), F.col("_t"))))
    p = p.withColumn("_end", F.sum(F.length("_sep") + F.length("_t")).over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    span = F.struct(F.col(page_col).alias("page"), F.concat("_sep", "_t").alias("piece"), (F.col("_end") - F.length("_t")).alias("start"), F.col("_end").alias("end"))
    g = p.groupBy(*by, id_col).agg(F.array_sort(F.collect_list(span)).alias("s"))
    return g.select(id_col, *by, F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("text"), F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["page"].alias("page"))).alias("spans"))


def join_pages(pages: DataFrame, id_col: str, page_col: str, text_col: str) -> DataFrame:
    """id, markdown: page texts in order, blank ones left out, parted by blank lines."""
    kept = pages.where(F.trim(text_col) != "")
    g = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t")))).alias("s"))
    return g.select(id_col, F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("markdown"))


def with_page_stats(pages: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with the statistics of their number, nulls where there are none."""
    return pages.join(stats.dropDuplicates(keys), keys, "left")


def clean_page(c: Column) -> Column:
    """A page's text without page markers such as {3}------."""
    return F.trim(F.regexp_replace(c, PAGE_MARK, ""))


def markdown_of(files: DataFrame, id_col: str, name_col: str, text_col: str) -> DataFrame:
    """id, page_id, text of parsed files by the suffix of their name: .pdf by page breaks, .md and .txt as page 1; other suffixes are an error, empty texts give no rows."""
    suffix = F.lower(F.regexp_extract(name_col, r"(\.[^.]*)$", 1))
    checked = files.withColumn("_suffix", F.when(suffix.isin(".pdf", ".md", ".txt"), suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), F.coalesce(F.col(name_col), F.lit(""))))))
    pdf = split_pages(checked.where("_suffix = '.pdf'"), id_col, text_col)
    plain = checked.where(F.col("_suffix") != ".pdf").where(F.trim(text_col) != "").select(id_col, F.lit(1).alias("page_id"), F.col(text_col).alias("text"))
    return pdf.unionByName(plain)


def page_at(spans: Column, offset: Column) -> Column:
    """The page whose span holds the offset, else the last one's."""
    return F.coalesce(F.get(F.filter(spans, lambda s: (s["start"] <= offset) & (offset < s["end"])), 0), F.try_element_at(spans, F.lit(-1)))["page"]


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that occurs; a separator stays with the piece that follows it."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    if sep:
        first, *others = text.split(sep)
        pieces = [p for p in [first, *(sep + o for o in others)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    run: list[str] = []
    held = 0

    def emit() -> None:
        if joined := "".join(run).strip():
            out.append(joined)

    for p in pieces:
        if len(p) >= size and (finer or not sep):
            emit()
            run, held = [], 0
            out += split_text(p, size, overlap, finer) if finer else [p]
            continue
        if held + len(p) > size and run:
            emit()
            while run and (held > overlap or held + len(p) > size):
                held -= len(run.pop(0))
        run.append(p)
        held += len(p)
    emit()
    return out


def _batches(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of batches, about BATCH_BYTES of text at a time, or one longer text."""
    for b in batches:
        if b.num_rows:
            size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64").cumsum() // BATCH_BYTES
            edges = [0, *((size[1:] != size[:-1]).nonzero()[0] + 1).tolist(), b.num_rows]
            yield from (b.slice(x, y - x) for x, y in zip(edges, edges[1:]))


def _made(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of BATCH_ROWS at most."""
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _in_arrow(rows: DataFrame, f: Callable[[pa.RecordBatch], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that f makes of the rows of a batch whose second column is a text. Few of both are held at once, however large Spark's batches are."""
    types = to_arrow_schema(_parse_datatype_string(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            yield from _made(f(b), types)

    return rows.mapInArrow(work, schema)


def _per_text(docs: DataFrame, id_col: str, text_col: str, f, schema: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        return ((i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in f(t or ""))

    return _in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def recursive_split(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk_index, start_index, content: overlapping chunks; each document is split where it is, without a shuffle."""

    def chunks(text: str):
        at = 0
        for k, c in enumerate(split_text(text, size, overlap)):
            start = text.find(c, max(0, at - overlap))
            at = start + len(c)
            yield k, start, c

    return _per_text(docs, id_col, text_col, chunks, "chunk_index int, start_index long, content string")


def sections(text: str) -> list[tuple[str, dict[str, str]]]:
    """Sections of Markdown with the headers above them; a header line stays in its section, fences hide headers.

    Lines are stripped, and characters that can't be printed go. A blank line outside of a fence ends a block, and so does a header. Blocks under the
    same headers are one section, parted by two spaces and a newline; a block that ends in a header takes in the first one below a deeper header.
    """
    blocks: list[tuple[str, dict[str, str]]] = []
    held: list[str] = []
    path: dict[int, str] = {}
    above: dict[str, str] = {}  # the headers of the block that is open
    fence = ""

    def close() -> None:
        if held:
            blocks.append(("\n".join(held), above))
            held.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if not bare.isprintable():
            bare = "".join(c for c in bare if c.isprintable())
        if fence and not bare.startswith(fence):
            held.append(bare)
            continue
        if fence:
            fence = ""
        elif bare.startswith("~~~") or (bare.startswith("```") and bare.count("```") == 1):
            fence = bare[:3]
            held.append(bare)
            continue
        level = len(bare) - len(bare.lstrip("#"))
        if 1 <= level <= 6 and bare[level : level + 1] in ("", " "):
            path = {k: v for k, v in path.items() if k < level} | {level: bare[level:].strip()}
            close()
        if bare:
            held.append(bare)
        else:
            close()
        above = {f"h{k}": v for k, v in path.items()}
    close()
    out: list[tuple[str, dict[str, str]]] = []
    for content, headers in blocks:
        last, of = out[-1] if out else ("", None)
        if of == headers or (of is not None and len(of) < len(headers) and last.split("\n")[-1].startswith("#")):
            out[-1] = (f"{last}  \n{content}", headers)
        else:
            out.append((content, headers))
    return out


def placed_sections(text: str) -> Iterator[tuple[int, str, dict[str, str]]]:
    """Where each section starts in the text, its content and headers. A section whose lines were changed is no part of the text any more; then it is looked
    for as it is without outer white space, from the last one on and from the front, and stands where the last one ended if it isn't found."""
    cursor = 0
    for content, headers in sections(text):
        bare = content.strip()
        tries = (text.find(content, cursor), text.find(bare, cursor), text.find(bare)) if bare else ()
        start = next((at for at in tries if at >= 0), cursor)
        cursor = max(cursor, start + len(content))
        if bare:
            yield start, bare, headers


def header_split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, section, start_index, h1 to h6, content."""

    def cut(text: str):
        for k, (start, content, h) in enumerate(placed_sections(text)):
            yield (k, start, *[h.get(f"h{i}") for i in range(1, 7)], content)

    return _per_text(docs, id_col, text_col, cut, "section int, start_index long, h1 string, h2 string, h3 string, h4 string, h5 string, h6 string, content string")


def split_documents(merged: DataFrame, id_col: str, size: int = CHUNK, overlap: int = OVERLAP, carried: list[str] = []) -> DataFrame:
    """id, chunk_index (dense), start_index (in the whole text), page, h1 to h6, content of texts with page spans, as merge_pages() gives them, and columns carried along.

    Sections by Markdown headers, then overlapping chunks in each, with the headers above them and the page in which they start (the last one's for
    places in no span). Each document is split where it is, without a shuffle, and pages are looked up by halving the spans.
    """
    kinds = {c: merged.schema[c].dataType.simpleString() for c in (id_col, *carried)}

    def of_text(i, text: str, starts: list[int], ends: list[int], pages: list, more: tuple) -> Iterator[tuple]:
        k = 0
        for start, section, headers in placed_sections(text):
            inner = 0
            for chunk in split_text(section, size, overlap):
                found = section.find(chunk, max(0, inner - overlap))
                inner = found + len(chunk)
                at = bisect_right(starts, start + found) - 1
                page = (pages[at] if at >= 0 and start + found < ends[at] else pages[-1]) if pages else None
                yield (i, k, start + found, page, *[headers.get(f"h{n}") for n in range(1, 7)], chunk, *more)
                k += 1

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for i, text, starts, ends, pages, *more in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield from of_text(i, text or "", starts or [], ends or [], pages or [], tuple(more))

    spans = [F.col("spans")[x].alias(f"{x}s") for x in ("start", "end", "page")]
    schema = f"id {kinds[id_col]}, chunk_index int, start_index long, page int, {', '.join(f'h{i} string' for i in range(1, 7))}, content string"
    schema += "".join(f", {c} {kinds[c]}" for c in carried)
    return _in_arrow(merged.select(F.col(id_col).alias("id"), "text", *spans, *carried), rows, schema).withColumnRenamed("id", id_col)


def greedy_batches(chunks: DataFrame, id_col: str, order_col: str, text_col: str, items: int = 8, chars: int = 6000, extra: int = 400) -> DataFrame:
    """id, batch, first, last, n: chunks of a document in order, a new batch once it has enough of them or its characters would pass the limit."""
    rows = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("k"), (F.length(text_col) + extra).alias("size")))).alias("c"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= items) | (s["chars"] + x["size"] > chars))
        b = s["batch"] + full.cast("int")
        return F.struct(b.alias("batch"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, x["size"]).otherwise(s["chars"] + x["size"]).alias("chars"), F.array_append(s["out"], b).alias("out"))

    dealt = rows.select(id_col, F.explode(F.arrays_zip(F.col("c"), F.aggregate("c", start, step)["out"].alias("b"))).alias("z"))
    return dealt.groupBy(id_col, F.col("z.b").alias("batch")).agg(F.min("z.c.k").alias("first"), F.max("z.c.k").alias("last"), F.count(F.lit(1)).alias("n"))
