"""Timed steps of traces: starts paired with what ended them, over tables and over streams."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Phases of a step's events, and how a span ended: done, failed, still open, or an end without a start.
START, DONE, FAIL = "START", "DONE", "FAIL"
OUTCOMES = {DONE: "done", FAIL: "failed"}
SPANS = "trace_id string, step string, started timestamp, ended timestamp, outcome string, elapsed_ms double"


def pair_steps(events: DataFrame) -> DataFrame:
    """trace_id, step, started, ended, outcome, elapsed_ms of events (trace_id, step, phase, ts, event_id).

    An end closes the latest start of its step that is open in its trace, so a step may hold itself. Starts that nothing closes are open spans,
    ends that close nothing are orphans. Order is by ts, then event_id; events of other phases are left out. Windows over (trace, step) alone.
    """
    key = ["trace_id", "step"]
    e = events.where(F.col("phase").isin(START, DONE, FAIL)).select(*[F.col(k).cast("string").alias(k) for k in key], "phase", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    order = W.Window.partitionBy(*key).orderBy("ts", "event_id")
    upto, before = order.rowsBetween(W.Window.unboundedPreceding, 0), order.rowsBetween(W.Window.unboundedPreceding, -1)
    starts = F.col("phase") == START
    e = e.withColumn("sum", F.sum(F.when(starts, 1).otherwise(-1)).over(upto))
    # the sum falls to a new low where an end closes nothing: levels are counted from the lowest sum so far
    e = e.withColumn("low", F.least(F.lit(0), F.coalesce(F.min("sum").over(before), F.lit(0))))
    orphan = ~starts & (F.col("sum") < F.col("low"))
    e = e.withColumn("level", F.when(orphan, -1).otherwise(F.col("sum") - F.col("low") + F.when(starts, 0).otherwise(1)))
    nth = F.row_number().over(W.Window.partitionBy(*key, "level", starts).orderBy("ts", "event_id"))
    e = e.withColumn("nth", F.when(F.col("level") >= 0, nth).otherwise(-nth))
    of = lambda c, cond: F.max(F.when(cond, F.col(c)))
    spans = e.groupBy(*key, "level", "nth").agg(of("ts", starts).alias("started"), of("ts", ~starts).alias("ended"), of("phase", ~starts).alias("phase"))
    outcome = F.when(F.col("ended").isNull(), "open").when(F.col("started").isNull(), "orphan").when(F.col("phase") == DONE, OUTCOMES[DONE]).otherwise(OUTCOMES[FAIL])
    ms = (F.unix_micros("ended") - F.unix_micros("started")) / 1000.0
    return spans.select(*key, "started", "ended", outcome.alias("outcome"), ms.alias("elapsed_ms"))


def stage_totals(spans: DataFrame) -> DataFrame:
    """trace_id, step, runs, failed, open, total_ms, slowest_ms of spans."""
    n = lambda what: F.count(F.when(F.col("outcome") == what, 1)).alias(what)
    return spans.groupBy("trace_id", "step").agg(F.count(F.col("started")).alias("runs"), n("failed"), n("open"), F.round(F.sum("elapsed_ms"), 3).alias("total_ms"), F.round(F.max("elapsed_ms"), 3).alias("slowest_ms"))


def pair_stream(events: DataFrame, late: str = "1 minute", longest: str = "1 hour") -> DataFrame:
    """pair_steps() over a stream: spans come out once the watermark has passed their end; starts that stay open for longer than longest come out as open.

    Events may come in any order within late; what comes later is dropped. A trace's state is its open starts and the events that the watermark has not
    passed, and goes when there is none. An end that comes after its start was given up is an orphan.
    """
    limit = int(pd.Timedelta(longest).total_seconds() * 1000)

    def advance(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, open_ = state.get if state.exists else ([], [])
        waiting, open_ = [tuple(x) for x in waiting], [tuple(x) for x in open_]
        for b in batches:
            waiting += list(zip((b["ts"].astype("datetime64[us]").astype("int64")).tolist(), b["event_id"].tolist(), b["step"].tolist(), b["phase"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        out: list[tuple] = []
        time = lambda us: None if us is None else datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc)

        def send(step: str, started: int | None, ended: int | None, outcome: str) -> None:
            out.append((key[0], step, time(started), time(ended), outcome, None if started is None or ended is None else (ended - started) / 1000))

        def give_up(now: int) -> None:
            for step, started in [x for x in open_ if x[1] + limit * 1000 < now]:
                open_.remove((step, started))
                send(step, started, None, "open")

        ready = sorted((x for x in waiting if x[0] < mark), key=lambda x: x[:2])
        waiting = [x for x in waiting if x[0] >= mark]
        for us, _, step, phase in ready:
            give_up(us)
            if phase == START:
                open_.append((step, us))
            else:
                mine = [x for x in open_ if x[0] == step]
                if mine:  # the latest of the step
                    del open_[len(open_) - 1 - open_[::-1].index(mine[-1])]
                send(step, mine[-1][1] if mine else None, us, OUTCOMES[phase])
                if not mine:
                    out[-1] = (*out[-1][:4], "orphan", None)
        give_up(mark)
        if waiting or open_:
            state.update((waiting, open_))
            next_ = min([x[0] for x in waiting] + [x[1] + limit * 1000 for x in open_])
            state.setTimeoutTimestamp(max(next_ // 1000 + 1, mark // 1000 + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["trace_id", "step", "started", "ended", "outcome", "elapsed_ms"]).astype({"started": "datetime64[us, UTC]", "ended": "datetime64[us, UTC]"})

    e = events.where(F.col("phase").isin(START, DONE, FAIL)).select(F.col("trace_id").cast("string").alias("trace_id"), F.col("step").cast("string").alias("step"), "phase", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    state = "waiting array<struct<ts: bigint, event_id: bigint, step: string, phase: string>>, open array<struct<step: string, started: bigint>>"
    return e.withWatermark("ts", late).groupBy("trace_id").applyInPandasWithState(advance, SPANS, state, "append", GroupStateTimeout.EventTimeTimeout)
