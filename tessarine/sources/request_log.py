"""Logs of requests: events and timed steps are held back, appended as one segment at the end, and segments are put together now and then."""

from __future__ import annotations

import datetime
import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .versions import Versions

#: An event; event_id counts inside its request, phase is START, DONE, FAIL or null, details is JSON. Events held back and segments at most.
EVENTS = "trace_id string, request string, event_id long, ts timestamp, event string, step string, phase string, elapsed_ms double, details string"
HELD, SEGMENTS = 1000, 64


def _safe(value: Any) -> Any:
    """What JSON has a form for; everything else as text."""
    if isinstance(value, dict):
        return {str(k): _safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_safe(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


class RequestLog:
    """The log of one request below a root folder; as a context it is written at the end, also after an error. Without a root it does nothing."""

    def __init__(self, spark: SparkSession, root: str | None, request: str = "", trace_id: str | None = None):
        self.spark, self.root = spark, root
        self.request = re.sub(r"[^A-Za-z0-9._-]+", "_", request)[:120]
        self.trace_id = trace_id or uuid.uuid4().hex
        self.held: list[tuple] = []
        self.count = 0

    def event(self, event: str, step: str | None = None, phase: str | None = None, elapsed_ms: float | None = None, **details: Any) -> None:
        if self.root is None:
            return
        self.held.append((self.trace_id, self.request, self.count, datetime.datetime.now(datetime.timezone.utc), event, step, phase, elapsed_ms, json.dumps(_safe(details), ensure_ascii=False)))
        self.count += 1
        if len(self.held) >= HELD:
            self.flush()

    @contextmanager
    def step(self, step: str, **details: Any) -> Iterator[None]:
        """A timed step: its start, and its end or its failure, which goes on."""
        began = time.perf_counter()
        took = lambda: (time.perf_counter() - began) * 1000
        self.event(f"{step}_start", step, "START", **details)
        try:
            yield
        except Exception as e:
            self.event(f"{step}_error", step, "FAIL", took(), error=str(e), **details)
            raise
        self.event(f"{step}_done", step, "DONE", took(), **details)

    def flush(self) -> None:
        """Appends what is held back; nothing that is there is read, until there are SEGMENTS segments."""
        if not self.held:
            return
        rows, self.held = self.spark.createDataFrame(self.held, EVENTS).coalesce(1), []
        log = Versions(self.spark, self.root)
        log.transaction(lambda tx: tx.append("events", rows))
        if len(log.manifest()["tables"]["events"]["parts"]) >= SEGMENTS:
            log.transaction(lambda tx: tx.compact("events", EVENTS))

    def __enter__(self) -> RequestLog:
        return self

    def __exit__(self, *_: Any) -> None:
        self.flush()


def read_requests(spark: SparkSession, root: str) -> DataFrame:
    """All events of a log (EVENTS)."""
    return Versions(spark, root).read("events", EVENTS)
