"""Queries of the catalog, conversations, users and traces."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text
from ..operators import traces
from ..sources import store
from ..sources.scratch import scratch_folder, settled
from . import tables as t
from .registry import query


@query(f"WITH {t.LINES}, c AS (SELECT * FROM lines WHERE trim(content) <> '') SELECT d.doc_id, any_value(d.source) AS title, count(c.doc_id) AS chunks FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id ORDER BY d.doc_id DESC")
def doc_list(spark, d):
    """Documents with their number of chunks (lines that aren't blank), 0 for none, newest first."""
    chunks = t.lines(spark, d).where(F.trim("content") != "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return t.docs(spark, d).select("doc_id", F.col("source").alias("title")).join(chunks, "doc_id", "left").select("doc_id", "title", F.coalesce("n", F.lit(0)).alias("chunks")).orderBy(F.col("doc_id").desc())


@query("SELECT doc_id, text FROM documents WHERE doc_id = 7")
def doc_get(spark, d):
    return t.docs(spark, d).where("doc_id = 7").select("doc_id", "text")


@query(f"WITH {t.LINES} SELECT doc_id, chunk_index, content FROM lines WHERE doc_id = 5 ORDER BY chunk_index LIMIT 10 OFFSET 2")
def chunk_page(spark, d):
    """A page of a document's chunks: the page is the feature."""
    return t.lines(spark, d).where("doc_id = 5").orderBy("chunk_index").offset(2).limit(10)


@query(f"WITH {t.LINES} SELECT doc_id, count(*) AS total FROM lines GROUP BY doc_id")
def chunk_total(spark, d):
    return t.lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))


_WANTED = [42, 7, 999_999_999, 13, 0]


@query(f"SELECT row_number() OVER (ORDER BY w.rank) AS rank, d.doc_id, d.source FROM (SELECT unnest({_WANTED}) AS doc_id, unnest(range(1, {len(_WANTED) + 1})) AS rank) w JOIN documents d ON d.doc_id = w.doc_id")
def multi_get(spark, d):
    """Rows of a list of ids in its order, without those that are missing."""
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(_WANTED)], "doc_id long, place int")
    got = t.docs(spark, d).select("doc_id", "source").join(F.broadcast(wanted), "doc_id")
    return got.withColumn("rank", F.row_number().over(W.Window.orderBy("place"))).drop("place")


@query(f"WITH {t.LINES} SELECT count(*) AS chunks, (SELECT bool_or(doc_id % 7 = 3) FROM documents) AS any_indexing, count(DISTINCT doc_id) AS documents FROM lines")
def catalog_totals(spark, d):
    per_doc = t.docs(spark, d).select("doc_id", F.size(F.split("text", "\n")).alias("chunks"))
    return per_doc.agg(F.sum("chunks").alias("chunks"), F.bool_or(F.col("doc_id") % 7 == 3).alias("any_indexing"), F.count("doc_id").alias("documents"))


_SESSIONS = f"sessions AS (SELECT conv_id AS session_id, max(turn) AS last_turn, count(*) AS messages, CASE WHEN {t.norm("min_by(text, turn) FILTER (WHERE role = 'user')")} = '' THEN 'New chat' ELSE {t.norm("min_by(text, turn) FILTER (WHERE role = 'user')")}[1:255] END AS title FROM conversations GROUP BY conv_id)"


def sessions(spark, d):
    m = t.messages(spark, d)
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("id")))
    return m.groupBy("session_id").agg(F.max("id").alias("last_turn"), F.count(F.lit(1)).alias("messages"), F.max(F.col("role") == "user").alias("asked"), first.alias("first")).select(
        "session_id", "last_turn", "messages", text.session_title(F.when(F.col("asked"), F.col("first"))).alias("title"))


@query(f"WITH {_SESSIONS} SELECT session_id, last_turn, messages FROM sessions ORDER BY last_turn DESC, session_id")
def session_list(spark, d):
    return sessions(spark, d).select("session_id", "last_turn", "messages").orderBy(F.col("last_turn").desc(), "session_id")


@query(f"WITH {_SESSIONS} SELECT session_id, title FROM sessions")
def session_titles(spark, d):
    return sessions(spark, d).select("session_id", "title")


@query(f"WITH {_SESSIONS} SELECT session_id, title FROM sessions WHERE contains(lower(title), 'the')")
def session_search(spark, d):
    return sessions(spark, d).where(F.contains(F.lower("title"), F.lit("the"))).select("session_id", "title")


@query("SELECT conv_id AS session_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 8 GROUP BY conv_id")
def chat_history(spark, d):
    """The last eight messages of each session, oldest first, as the block that a prompt takes."""
    w = W.Window.partitionBy("session_id").orderBy(F.col("id").desc())
    last = t.messages(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 8")
    line = F.concat(F.upper("role"), F.lit(": "), F.col("content"))
    return last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("m")).select("session_id", F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("history"))


@query("SELECT c_custkey AS id, c_name AS username FROM customer ORDER BY id LIMIT 20 OFFSET 40")
def user_page(spark, d):
    return t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username")).orderBy("id").offset(40).limit(20)


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_acctbal > 0 AND c_name = 'Customer#000000007'")
def user_active(spark, d):
    return t.read(spark, d, "customer").where("c_acctbal > 0 and c_name = 'Customer#000000007'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


@query("SELECT source, lang AS kind, count(*) AS n, avg(n_chars) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY ALL")
def split_stats(spark, d):
    g = t.docs(spark, d).groupBy("source", F.col("lang").alias("kind"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return g.agg(F.count(F.lit(1)).alias("n"), z(F.avg("n_chars")).alias("mean"), z(F.min("n_chars")).alias("least"), z(F.max("n_chars")).alias("most"))


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang")
def kind_counts(spark, d):
    return t.docs(spark, d).groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS steps, round(sum(ms), 3) AS total_ms, round(max(ms), 3) AS slowest_ms FROM (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1000.0 AS ms FROM events) WHERE ms IS NOT NULL GROUP BY user_id")
def stage_latency(spark, d):
    """Time between the events of each trace (here of each user), summed up."""
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))
    e = t.read(spark, d, "events").select("user_id", ((us("ts") - us(F.lag("ts").over(w))) / 1000).alias("ms")).where("ms is not null")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("ms"), 3).alias("total_ms"), F.round(F.max("ms"), 3).alias("slowest_ms"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id % 10 <> 3")
def trace_read(spark, d):
    """Log lines read as JSON; lines that are none are left out."""
    e = t.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.col("props")).alias("line"))
    return e.select("event_id", F.from_json("line", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j")).where("j._bad is null and j is not null").select("event_id", "j.k")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE event_id % 5 = 0) GROUP BY event_type")
def trace_append(spark, d):
    """Events appended to a log in two segments, of which the second comes without a look at the first, and put together."""
    path, e = f"{scratch_folder(spark)}/log", t.read(spark, d, "events").select("event_id", "event_type")
    for segment in (e, e.where("event_id % 5 = 0")):
        store.append_rows(segment, path)
    schema = "event_id long, event_type string"
    store.compact(spark, path, schema)
    return settled(store.read_table(spark, path, schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)


def steps(spark, d):
    """Events as the starts and ends of steps, by their number; a user's are a trace."""
    phase = F.when(F.col("event_id") % 4 < 2, traces.START).when(F.col("event_id") % 4 == 2, traces.DONE).otherwise(traces.FAIL)
    return t.read(spark, d, "events").select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("step"), phase.alias("phase"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


_SPANS = """e AS (SELECT user_id::VARCHAR AS trace_id, event_type AS step, event_id % 4 < 2 AS starts, event_id % 4 = 2 AS done, epoch_us(ts::TIMESTAMP) AS us, event_id FROM events),
s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE -1 END) OVER w AS total FROM e WINDOW w AS (PARTITION BY trace_id, step ORDER BY us, event_id)),
m AS (SELECT *, least(0, coalesce(min(total) OVER (PARTITION BY trace_id, step ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
l AS (SELECT *, CASE WHEN NOT starts AND total < low THEN -1 ELSE total - low + CASE WHEN starts THEN 0 ELSE 1 END END AS level FROM m),
n AS (SELECT *, CASE WHEN level < 0 THEN -1 ELSE 1 END * row_number() OVER (PARTITION BY trace_id, step, level, starts ORDER BY us, event_id) AS nth FROM l),
spans AS (SELECT trace_id, step, max(us) FILTER (WHERE starts) AS started_us, max(us) FILTER (WHERE NOT starts) AS ended_us,
  CASE WHEN max(us) FILTER (WHERE NOT starts) IS NULL THEN 'open' WHEN max(us) FILTER (WHERE starts) IS NULL THEN 'orphan' WHEN bool_or(done) THEN 'done' ELSE 'failed' END AS outcome FROM n GROUP BY trace_id, step, level, nth)"""


@query(f"WITH {_SPANS} SELECT trace_id, step, started_us, ended_us, outcome, (ended_us - started_us) / 1000.0::DOUBLE AS elapsed_ms FROM spans")
def step_spans(spark, d):
    """Starts of steps paired with what ended them."""
    s = traces.pair_steps(steps(spark, d))
    return s.select("trace_id", "step", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "outcome", "elapsed_ms")


@query(f"WITH {_SPANS} SELECT trace_id, step, count(started_us) AS runs, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'open') AS open, round(sum((ended_us - started_us) / 1000.0::DOUBLE), 3) AS total_ms, round(max((ended_us - started_us) / 1000.0::DOUBLE), 3) AS slowest_ms FROM spans GROUP BY ALL")
def step_totals(spark, d):
    return traces.stage_totals(traces.pair_steps(steps(spark, d)))


_THOUGHT = "said AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think> ' || text || ' </think> so ' || role WHEN 1 THEN 'x <think>' || text WHEN 2 THEN '<think>a</think>' || text || '<think>b</think>' ELSE text END AS t FROM conversations)"


@query(f"WITH {_THOUGHT} SELECT conv_id, turn, CASE WHEN contains(t, '</think>') THEN trim(substr(t, strpos(t, '<think>') + 7, strpos(t, '</think>') - strpos(t, '<think>') - 7)) WHEN contains(t, '<think>') THEN trim(substr(t, strpos(t, '<think>') + 7)) ELSE '' END AS reasoning, CASE WHEN contains(t, '</think>') THEN trim(substr(t, strpos(t, '</think>') + 8)) WHEN contains(t, '<think>') THEN '' ELSE t END AS answer FROM said")
def think_split(spark, d):
    """Reasoning and answer of messages that think aloud, to the end or not at all."""
    c = t.read(spark, d, "conversations")
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think> "), "text", F.lit(" </think> so "), "role")).when(F.col("turn") % 4 == 1, F.concat(F.lit("x <think>"), "text")).when(F.col("turn") % 4 == 2, F.concat(F.lit("<think>a</think>"), "text", F.lit("<think>b</think>"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.split_thought(said).alias("s")).select("conv_id", "turn", "s.reasoning", "s.answer")


@query("WITH a AS (SELECT conv_id, turn, 'x [Chunk ' || (turn % 4) || '] and [Chunk ' || (conv_id % 3 + 1) || ']' AS answer FROM conversations), e AS (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '\\[Chunk (\\d+)\\]', 1))::INTEGER AS n FROM a) SELECT DISTINCT conv_id, turn, n, 'src' || n AS source FROM e WHERE n BETWEEN 1 AND 3".replace("\\\\", "\\"))
def citations(spark, d):
    """Citations of an answer outside its <think> part, joined to the numbered sources; numbers without a source stay text."""
    c = t.read(spark, d, "conversations")
    answer = F.concat(F.lit("<think>[Chunk 2] no</think> x [Chunk "), (F.col("turn") % 4).cast("string"), F.lit("] and [Chunk "), (F.col("conv_id") % 3 + 1).cast("string"), F.lit("]"))
    said = c.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.regexp_replace(answer, r"(?s)^.*?</think>", ""), F.lit(r"\[Chunk (\d+)\]"))).alias("n"))
    sources = spark.createDataFrame([(1, "src1"), (2, "src2"), (3, "src3")], "n int, source string")
    return said.select("conv_id", "turn", F.col("n").cast("int").alias("n")).distinct().join(F.broadcast(sources), "n")
