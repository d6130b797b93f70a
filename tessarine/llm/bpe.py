"""Operator 6: byte-level BPE encoding and decoding.

The encoder finds, with an Aho-Corasick automaton, the longest token that starts at each byte of a pre-token, and walks through it with
backtracking: a token may follow another only if the pair is compatible, which is to say that merging their joined bytes gives just the
two. A sequence of compatible neighbours is the result of the merges, so the walk gives it in linear time. Decoding copies byte ranges
from an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only

#: Pre-tokens whose ids a worker remembers in a generation, the longest that it remembers, and pairs of tokens that it remembers: some 100 MB in all.
PIECE_CACHE, PIECE_CHARS, PAIR_CACHE = 200_000, 48, 300_000
_NEVER = 1 << 60
# A fixed value: the pattern of the byte-level pre-tokeniser.
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place before a single space between two visible characters always starts a pre-token.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD_SPACE = re.compile(r"\s | \s|\A | \Z")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks, the automaton and the table of compatible pairs of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        decode = lambda s: bytes(letters[c] for c in s)
        vocab, model = spec["model"]["vocab"], spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for s, i in vocab.items():
            if s not in self.special:
                self.bytes[i] = decode(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        #: (left, right) -> (rank, merged); token -> (left, right) and its rank
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self.merge[pair] = (r, made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, r
        self.automaton = ahocorasick.Automaton()
        by_bytes = {}
        for s, i in vocab.items():
            if s not in self.special:
                by_bytes[self.bytes[i]] = i
                self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        #: token -> the longest shorter token that it starts with, or -1
        self.shorter = [-1] * size
        for b, i in by_bytes.items():
            self.shorter[i] = next((by_bytes[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in by_bytes), -1)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pre_token = regex.compile(_PRE_TOKEN)
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.sizes, self.pack = [len(b) for b in self.bytes], struct.pack
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.marks = {c: self._remembered(c, 0) for c in ".,;:!?)"}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that touch the border on one side, outermost first, each with the rank of the merge that ends it."""
        out, end = [], _NEVER
        while True:
            out.append((token, end))
            if token not in self.parts:
                return out
            end, token = self.rank[token], self.parts[token][side]

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge joins the two across their border before both are whole; of equal merges the left one comes first."""
        key = (left, right)
        if (known := self.compatible.get(key)) is not None:
            return known
        ok = True
        for a, a_ends in self._spine(left, 1):
            for b, b_ends in self._spine(right, 0):
                if (m := self.merge.get((a, b))) and m[0] < a_ends and m[0] <= b_ends:
                    ok = False
        if len(self.compatible) >= PAIR_CACHE:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        n, longest, sizes, table = len(piece), [-1] * (len(piece) + 1), self.sizes, self.compatible
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token  # ends ascend, so the last is the longest
        if min(longest[:n], default=0) < 0:
            raise ValueError("the vocabulary lacks a byte")
        out: list[int] = []
        dead: set[int] = set()
        at, token, before = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if before < 0:
                        break
                    ok = table.get((before, token))
                    if self.fits(before, token) if ok is None else ok:
                        break
                token = self.shorter[token]
            if token < 0:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
            else:
                out.append(token)
                at = end
                token = longest[at]
            before = out[-1] if out else -1
        return out

    def _remembered(self, piece: str, spaced: int) -> bytes:
        """The packed ids of a pre-token, given without its leading space if spaced: from this generation of remembered ones, the one before it, or the encoder."""
        known, older = self.known[spaced], self.older[spaced]
        if (got := known.get(piece)) is None:
            if (got := older.get(piece)) is None:
                ids = self.encode_piece((" " + piece if spaced else piece).encode("utf-8", "surrogatepass"))
                got = self.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= PIECE_CHARS:
                if len(known) >= PIECE_CACHE:
                    older.clear()
                    older.update(known)
                    known.clear()
                known[piece] = got
        return got

    def _segment(self, text: str) -> bytes:
        return b"".join([self._remembered(p[1:], 1) if p[0] == " " and len(p) > 1 and p[1] != " " else self._remembered(p, 0) for p in self.pre_token.findall(text)])

    def _plain(self, text: str) -> bytes:
        """Most segments between single spaces are one pre-token that is remembered; the pattern splits the others."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return b"".join([self._segment(s) for s in _CUT.split(text)])
        first, *rest = text.split(" ")
        get, segment, mark = self.known[1].get, self._segment, self.marks.get
        out = [segment(first)]
        for r in rest:
            if got := get(r):
                out.append(got)
            elif (m := mark(r[-1])) and r[-2:-1].isalpha() and (got := get(r[:-1])):  # a word and one mark
                out.append(got)
                out.append(m)
            else:
                out.append(segment(" " + r))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit integers."""
        if self.find_special is None or not self.find_special.search(text):
            return self._plain(text)
        return b"".join(np.array([self.special[s]], dtype="<u4").tobytes() if s in self.special else self._plain(s) for s in self.find_special.split(text) if s)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        if not len(ids):
            return ""
        begin, size = self.starts[ids], self.starts[ids.astype(np.int64) + 1] - self.starts[ids]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.blob[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True, digests: bool = False) -> DataFrame:
    """A row for each row of docs: its id, n_tokens, and as asked for ids (array), decoded (text), and digests of both.

    Special tokens in a text are found as such. Null and empty texts have no ids. Rows and ids are kept as they come; other columns are not
    read. Digests: ids_sha256 of little-endian 32-bit ids, decoded_sha256 of the decoded text's UTF-8.
    """
    kind = docs.schema[id_col].dataType
    fields = [("ids", "array<int>", pa.list_(pa.int32()))] * with_ids + [("decoded", "string", pa.string())] * with_text + [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] * digests

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bpe", vocabulary.cache_clear)
        v = vocabulary(path)
        for batch in batches:
            n, cols = [], {name: [] for name, _, _ in fields}
            for text in batch.column(1):
                raw = v.encode(text.as_py() or "")
                ids = np.frombuffer(raw, dtype="<u4")
                n.append(len(ids))
                if with_text or digests:
                    decoded = v.decode(ids)
                if with_ids:
                    cols["ids"].append(ids.astype(np.int32))
                if with_text:
                    cols["decoded"].append(decoded)
                if digests:
                    cols["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    cols["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(cols[name], t) for name, _, t in fields)], ["id", "n_tokens", *(name for name, _, _ in fields)])

    schema = f"id {kind.simpleString()}, n_tokens long" + "".join(f", {name} {t}" for name, t, _ in fields)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of rows of ids; null ids give an empty text, ids outside the vocabulary raise."""
    kind = encoded.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bpe", vocabulary.cache_clear)
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(work, f"id {kind.simpleString()}, text string").withColumnRenamed("id", id_col)
