"""Operator 1: token counts.

Texts are encoded in batches of about equal bytes inside an Arrow function that returns lengths only. A piece of the vocabulary holds
the word mark only at its front, so no merge crosses from a character that is no space to a space: every such place is a safe boundary,
texts are cut there, and each distinct segment of a batch is encoded once. A long segment, of a text without spaces, is cut between two characters that
no piece holds side by side and that the normaliser leaves alone: no merge crosses there either.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of text encoded at once, segments remembered by a worker, longest remembered segment, longest context of a model, characters of a segment that is cut.
BATCH_BYTES, SEGMENT_CACHE, SEGMENT_CHARS, CONTEXT, LONG_CHARS = 2_000_000, 500_000, 64, 4096, 4000
_MARK = "▁"
_SAFE = re.compile(rf"(?<=[^ {_MARK}]) (?=.)", re.DOTALL)


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = any(_MARK in model.id_to_piece(i).lstrip(_MARK) for i in range(model.get_piece_size()))
    if inner or len(model.encode("ﬁ a", out_type=str)) != len(model.encode("ﬁ", out_type=str)) + len(model.encode("a", out_type=str)):
        raise ValueError(f"{path}: its pieces or its normaliser reach across word starts, so texts can't be cut there")
    return model


def segments(text: str) -> list[str]:
    """Parts of a text whose tokens add up to the text's. The space at a cut is dropped: the encoder puts one before each part."""
    if not text:
        return []
    if "  " in text or _MARK in text or text[0] == " " or text[-1] == " ":
        return _SAFE.split(text)
    return text.split(" ")


@lru_cache(maxsize=2)
def _neighbours(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters of a model's pieces, and those that stand side by side in one."""
    model = _model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return frozenset(c for p in pieces for c in p), frozenset(a + b for p in pieces for a, b in zip(p, p[1:]))


def cut_long(segment: str, path: str) -> tuple[list[str], list[str]]:
    """Strings whose tokens, less those of other strings, add up to a long segment's: each part but the first comes behind the character before it, whose
    tokens are taken off again, as the encoder begins every string with the word mark."""
    known, joined = _neighbours(path)
    plus, minus, first = [], [], 0

    def safe(i: int) -> bool:
        a, b = segment[i - 1], segment[i]
        return a in known and b in known and _MARK not in (a, b) and a + b not in joined and unicodedata.normalize("NFKC", a + b) == a + b

    for k in range(LONG_CHARS, len(segment), LONG_CHARS):
        i = next((i for i in range(max(k, first + 1), min(k + LONG_CHARS, len(segment))) if safe(i)), None)
        if i is not None:
            plus.append(segment[max(0, first - 1) : i])
            minus.append(segment[i - 1])
            first = i
    plus.append(segment[max(0, first - 1) :])
    return plus, minus


def count_batch(texts: list[str], path: str, known: dict[str, int]) -> list[int]:
    model, parts = _model(path), [segments(t) for t in texts]
    less: dict[int, list[str]] = {}
    for i, some in enumerate(parts):
        if len(texts[i]) > LONG_CHARS and any(len(s) > LONG_CHARS for s in some):
            cuts = [cut_long(s, path) if len(s) > LONG_CHARS else ([s], []) for s in some]
            parts[i], less[i] = [x for c in cuts for x in c[0]], [x for c in cuts for x in c[1]]
    if len(known) > SEGMENT_CACHE:
        known.clear()
    new = list(set().union(*parts, *less.values()).difference(known))
    lengths = dict(zip(new, map(len, model.encode(new, num_threads=1)), strict=True)) if new else {}
    known.update((s, n) for s, n in lengths.items() if len(s) <= SEGMENT_CHARS)
    get = (known | lengths if any(len(s) > SEGMENT_CHARS for s in new) else known).__getitem__
    return [sum(map(get, p)) - sum(map(get, less.get(i, ()))) for i, p in enumerate(parts)]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = CONTEXT) -> DataFrame:
    """A row for each row of docs: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no tokens; rows, repeated ids and null ids are kept as they come; other columns are not read. A text of any
    length goes to one task, in segments. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            out, first, size = [], 0, 0
            for i, n in enumerate(sizes):
                size += n
                if size >= BATCH_BYTES or i + 1 == len(texts):
                    out += count_batch(texts[first : i + 1], model_path, known)
                    first, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
