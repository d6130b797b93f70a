"""What a worker or a task holds at once does not grow with the input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessarine.operators import keyword_index, retrieval, splitting, vector_index
from tessarine.sources.versions import Versions


def test_vectors_are_multiplied_few_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    points = spark.createDataFrame([(i, i, "q", v.tolist()) for i, v in enumerate(x)], "point_id long, chunk_id long, child_type string, vector array<double>").coalesce(1)
    queries = points.where("point_id < 40").select(F.col("point_id").alias("query_id"), F.col("vector").alias("query_vector"))
    monkeypatch.setattr(vector_index, "PRODUCTS", 40 * 7)  # seven vectors at once
    got = {(r["query_id"], r["rank"]): r["point_id"] for r in vector_index.nearest(points, queries, 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(u[:40] @ u.T), axis=1)[:, :5]
    assert got == {(q, k + 1): int(want[q, k]) for q in range(40) for k in range(5)}


def test_texts_are_split_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["x" * 600_000, None, "", "y" * 3_000_000, "z", "x" * 600_000, "x" * 600_000, "w"])], ["id", "text"])
    for cut in (splitting._batches, keyword_index._slices):
        parts = list(cut(iter([batch])))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(8))
        assert len(parts) > 2 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) < 4_100_000 for p in parts)
    made = list(splitting._made(((i, "x") for i in range(10_000)), pa.schema([("id", pa.int64()), ("t", pa.string())])))
    assert max(b.num_rows for b in made) <= splitting.BATCH_ROWS and sum(b.num_rows for b in made) == 10_000


def test_each_text_is_looked_through_in_arrow(spark):
    chunks = spark.createDataFrame([(1, "Ünder 7/QD-EN here", ["7/QD-EN"]), (2, "under 7/qd-en", None), (None, "under", []), (3, "", [])], "chunk_id int, content string, chunk_codes array<string>")
    queries = spark.createDataFrame([(1, "under under 7/QD-EN"), (2, "zz"), (3, None)], "query_id long, message string")
    found = retrieval.keyword_scores(chunks, queries)
    assert sorted(((r["query_id"], r["chunk_id"] or 0, r["score"]) for r in found.collect())) == [(1, 0, 2.0), (1, 1, 15.0), (1, 2, 9.0)]
    assert found.schema["chunk_id"].dataType.simpleString() == "int"
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_parts_are_dealt_to_tasks_evenly(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/root", part_bytes=1 << 60)
    rows = spark.range(4000).withColumnRenamed("id", "k")

    def change(tx):
        dealt = tx.ranges(rows, ["k"], 4)
        sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == 32 and max(sizes) < 3 * 4000 / 32  # sixteen names of parts in as many tasks leave some of these empty
        tx.replace("t", dealt.drop("_range"), ["k"], bits=4)

    store.transaction(change)
    parts = store.manifest()["tables"]["t"]["parts"]
    assert len(parts) == 16 and store.read("t", "k long").distinct().count() == 4000
    store.transaction(lambda tx: tx.delete("t", rows.where("k < 10"), ["k"]))
    assert store.read("t", "k long").count() == 3990


def test_joins_with_tables_that_are_not_there_are_left_out(spark, tmp_path):
    rows = spark.range(9).withColumnRenamed("id", "k")
    none = Versions(spark, f"{tmp_path}/root").read("t", "k long, v array<string>")
    plan = rows.join(none, "k", "left_anti")
    assert none.columns == ["k", "v"] and none.count() == 0 and plan.count() == 9
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_points_are_made_anew_without_the_old_ones(spark, tmp_path):
    from tessarine.operators import indexing_job as job

    files = spark.createDataFrame([(i, f"f{i}.md", f"# Head {i}\n\n" + f"Bộ Công An says {i}. " * 60) for i in range(4)], "document_id long, file_name string, text string")
    job.run(spark, files, f"{tmp_path}/root")
    points = lambda: sorted((r["point_id"], r["child_text"], tuple(r["vector"])) for r in job.table(spark, f"{tmp_path}/root", "points").collect())
    before = points()
    store = Versions(spark, f"{tmp_path}/root")
    for p in store.manifest()["tables"]["points"]["parts"]:
        for f in (tmp_path / "root" / p["path"]).rglob("*.parquet"):
            f.write_bytes(b"not to be read")
    assert [r["document_id"] for r in job.rebuild_points(spark, f"{tmp_path}/root").collect()] == [0, 1, 2, 3] and points() == before and len(before) > 8
