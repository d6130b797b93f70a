"""Folders of many files as a data source, in batches and as a stream."""

import json
import os

from tessarine.sources.folder import TEXTS, listed, packed, read_folder


def test_partitions_pack_files_by_bytes():
    files = [(f"f{i:03}", 10 + i % 7, 0) for i in range(200)] + [("big", 5000, 0)]
    got = [p.files for p in packed(files, 1000, 5)]
    assert sorted(f for some in got for f in some) == sorted(files) and got[0] == [("big", 5000, 0)]
    assert all(sum(n + 5 for _, n, _ in some) <= 1000 for some in got[1:]) and len(got) <= 6
    assert packed([], 10) == []


def test_ten_thousand_files_in_few_tasks(spark, tmp_path):
    for i in range(10_000):
        if i % 1000 == 0:
            os.makedirs(tmp_path / "in" / str(i // 1000))
        (tmp_path / "in" / str(i // 1000) / f"{i}.md").write_text(f"text {i}\n")
    (tmp_path / "in" / ".hidden.md").write_text("no")
    (tmp_path / "in" / "x.exe").write_text("no")
    df = read_folder(spark, f"{tmp_path}/in", part_bytes=128 << 20)
    assert df.rdd.getNumPartitions() <= 6
    rows = df.collect()
    assert len(rows) == 10_000 and {(r.kind, r.page, r.stats) for r in rows} == {("md", 1, None)}
    assert all(r.text == f"text {r.path.rsplit('/', 1)[1][:-3]}\n" for r in rows)
    assert read_folder(spark, f"{tmp_path}/none").collect() == [] and listed(f"{tmp_path}/none", (".md",)) == []


def test_pages_of_a_layout_parser(spark, tmp_path):
    def layout(raw):
        found = json.loads(raw)
        return [(p["page"], p["text"], json.dumps({"blocks": p["blocks"]})) for p in found]

    (tmp_path / "a.PDF").write_text(json.dumps([{"page": 1, "text": "one", "blocks": 3}, {"page": 2, "text": "two", "blocks": 5}]))
    (tmp_path / "b.pdf").write_text("{broken")
    (tmp_path / "c.txt").write_bytes(b"\xffx")
    rows = {(r.path.rsplit("/", 1)[1], r.kind, r.page, r.text): r.stats for r in read_folder(spark, str(tmp_path), TEXTS | {".pdf": layout}).collect()}
    assert rows.keys() == {("a.PDF", "pdf", 1, "one"), ("a.PDF", "pdf", 2, "two"), ("b.pdf", "pdf", None, None), ("c.txt", "txt", 1, "�x")}
    assert json.loads(rows["a.PDF", "pdf", 2, "two"]) == {"blocks": 5} and "error" in json.loads(rows["b.pdf", "pdf", None, None])


def test_a_folder_as_a_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for k in range(3):
        for n in range(k * 4, k * 4 + 4):
            (tmp_path / "in" / f"{n}.txt").write_text(f"t{n}")
            os.utime(tmp_path / "in" / f"{n}.txt", (1_700_000_000 + n, 1_700_000_000 + n))
        stream = read_folder(spark, f"{tmp_path}/in", stream=True)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(f"t{n}" for n in range(k * 4 + 4))


def test_logs_of_requests(spark, tmp_path, monkeypatch):
    """Steps are timed and paired, failures are logged and go on, segments are put together without loss."""
    import datetime as dt

    import pytest

    from tessarine.operators.traces import pair_steps
    from tessarine.sources import request_log
    from tessarine.sources.versions import Versions

    monkeypatch.setattr(request_log, "SEGMENTS", 3)
    root = f"{tmp_path}/log"
    for k in range(4):
        try:
            with request_log.RequestLog(spark, root, f"quy trình {k}.md", f"t{k}") as log:
                log.event("begin", day=dt.date(2024, 1, k + 1), tags={"x"})
                with log.step("search", top_k=5):
                    with log.step("embed"):
                        pass
                    if k == 3:
                        raise KeyError("lost")
        except KeyError:
            assert k == 3
        assert len(Versions(spark, root).manifest()["tables"]["events"]["parts"]) == [1, 2, 1, 2][k]
    rows = request_log.read_requests(spark, root).orderBy("trace_id", "event_id").collect()
    assert [(r.trace_id, r.event) for r in rows] == [(f"t{k}", e) for k in range(4) for e in ("begin", "search_start", "embed_start", "embed_done", "search_error" if k == 3 else "search_done")]
    assert rows[0].request == "quy_tr_nh_0.md" and json.loads(rows[0].details) == {"day": "2024-01-01", "tags": ["x"]} and json.loads(rows[-1].details)["error"] == "'lost'"
    spans = {(r.trace_id, r.step): r.outcome for r in pair_steps(request_log.read_requests(spark, root)).collect()}
    assert spans == {(f"t{k}", s): "failed" if (k, s) == (3, "search") else "done" for k in range(4) for s in ("search", "embed")}
    nothing = request_log.RequestLog(spark, None)
    with pytest.raises(ValueError), nothing.step("x"):
        raise ValueError
    assert nothing.held == []


def test_reviews_and_clean_pages(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessarine.functions import payload
    from tessarine.operators import splitting
    from tessarine.sources.store import write_review

    d = spark.createDataFrame([(1, 0, "T", None, "one\ntwo"), (1, 1, "T", "U", "three")], "doc_id int, chunk_index int, h1 string, h2 string, content string")
    write_review(d.coalesce(1), f"{tmp_path}/review")
    assert "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/review").collect()) == "## 1 / 0 | T\none\ntwo\n## 1 / 1 | T > U\nthree\n"
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(splitting.clean_page(F.lit(" {12}----- a {3}- b"))) == "a  b"
    assert json.loads(one(payload.json_safe(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"), F.to_date(F.lit("2024-01-02")).alias("c"))))) == {"value": {"a": 1, "b": None, "c": "2024-01-02"}}
