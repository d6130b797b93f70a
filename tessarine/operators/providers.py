"""Models that are plugged in: asked in batches by bytes, loaded once a worker, and done without where they fail or are missing.

A provider is a function without arguments that loads a model or gives None where there is none. A model takes a list of rows (dicts of the columns that it is
sent) and gives pairs of a row's place in the list and its answer, in any order. Places that aren't in the list are passed over, rows without an
answer get null, and so do all rows of a batch in which the model fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import payload
from ..functions.text import dedupe

Model = Callable[[list[dict]], Iterable[tuple[int, Any]]]
Provider = Callable[[], Model | None]
#: Rows of a batch and bytes of their texts, and what a row counts beyond its own; entities that a model may name.
ITEMS, BYTES, EXTRA, ENTITIES = 8, 24_000, 400, 8
_loaded: dict[int, tuple[Provider, Model | None]] = {}


def batches_of(sizes: Iterable[int], items: int = ITEMS, most: int = BYTES, extra: int = EXTRA) -> list[range]:
    """Runs of rows: a new one once it has enough rows or its bytes would pass the limit; a row beyond the limit is alone."""
    out, first, held, n = [], 0, 0, 0
    for n, size in enumerate(sizes, 1):
        if n - 1 > first and (n - 1 - first >= items or held + size + extra > most):
            out.append(range(first, n - 1))
            first, held = n - 1, 0
        held += size + extra
    return [*out, range(first, n)] if n > first else out


def _model(provider: Provider) -> Model | None:
    """The provider's model, loaded once in a worker."""
    if id(provider) not in _loaded:
        _loaded[id(provider)] = (provider, provider())
    return _loaded[id(provider)][1]


def answers(model: Model | None, rows: list[dict], items: int = ITEMS, most: int = BYTES) -> list:
    """A model's answer for each row, batch by batch; null where it has none."""
    out: list = [None] * len(rows)
    if model is None:
        return out
    for some in batches_of((sum(len(v.encode()) for v in r.values() if isinstance(v, str)) for r in rows), items, most):
        try:
            given = list(model([rows[i] for i in some]))
        except Exception:  # noqa: BLE001 -- a batch that fails is a batch without answers
            continue
        for k, answer in given:
            if 0 <= k < len(some):
                out[some[k]] = answer
    return out


def ask(df: DataFrame, columns: list[str], provider: Provider, name: str, kind: str, items: int = ITEMS, most: int = BYTES) -> DataFrame:
    """df with the model's answer to each row, of a type that Spark names; the model is sent the columns. Rows stay where they are."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [{c: None if v is None or v is pd.NA else v for c, v in r.items()} for r in part.to_dict("records")]
            yield pd.Series(answers(_model(provider), rows, items, most), dtype=object)

    work.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(work, kind)(F.struct(*[F.col(c) for c in columns])))


def enrich(chunks: DataFrame, provider: Provider, words: int = 40, questions: int = 3) -> DataFrame:
    """chunks (content, h2, h3, keywords, entities and more) with summary and asked from a model's JSON ({summary, questions, entities}), null where it gives none
    that holds; its entities, ENTITIES at most, come ahead of those that are there, and behind the keywords."""
    got = ask(chunks, ["content", "h2", "h3"], provider, "_answer", "string")
    named = F.slice(dedupe(F.array_compact(F.coalesce(F.from_json("_answer", "entities array<string>")["entities"], F.array().cast("array<string>"))), ENTITIES), 1, ENTITIES)
    hyq: Column = payload.hyq_payload(F.col("_answer"), words, questions)
    got = got.withColumn("_hyq", hyq).withColumn("_named", named)
    merged = {"entities": dedupe(F.concat("_named", "entities"), payload.LIMITS["entities"]), "keywords": dedupe(F.concat("keywords", "_named"), payload.LIMITS["keywords"])}
    return got.withColumns(merged | {"summary": F.col("_hyq.summary"), "asked": F.col("_hyq.questions")}).drop("_answer", "_hyq", "_named")


def embed(df: DataFrame, text_col: str, provider: Provider, name: str = "vector", batch: int = 64) -> DataFrame:
    """df with a vector for each text. A model that is missing, fails, or gives too few vectors is an error: what is stored needs them all."""
    got = ask(df, [text_col], provider, "_vector", "array<float>", batch, 1 << 20)
    return got.withColumn(name, F.coalesce("_vector", F.raise_error(F.lit("a text has no vector")).cast("array<float>"))).drop("_vector")


def rerank(results: DataFrame, top_k: int, provider: Provider, query: str = "message", text: str = "content") -> DataFrame:
    """The top_k results of each query by a model's score of (query, text), ties by rank; a query of which any result has no score keeps its order."""
    scored = ask(results.withColumnRenamed("rank", "in_rank"), [query, text], provider, "reranker_score", "double", 32, 1 << 18)
    of = W.Window.partitionBy("query_id")
    whole = F.count("reranker_score").over(of) == F.count(F.lit(1)).over(of)
    scored = scored.withColumn("_score", F.when(whole, F.col("reranker_score"))).withColumn("reranker_score", F.round("_score", 4))
    order = of.orderBy(F.col("_score").desc_nulls_last(), "in_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("_score")
