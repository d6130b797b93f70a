"""What a Python worker holds from stage to stage is bounded."""

import pyarrow as pa

from tessarine.llm import bpe, common
from tessarine.llm.queries import tokenizer_path


def test_remembered_pre_tokens_are_bounded():
    v = bpe.Vocabulary(tokenizer_path("byte_bpe_50k.json"))
    letters = "abcdefghijklmnopqrst"
    for k in range(550):  # words of letters alone, each one pre-token
        v.encode(" ".join(["z"] + ["".join(letters[n // 20**j % 20] for j in range(5)) for n in range(k * 400, k * 400 + 400)]))
    assert max(map(len, (*v.known, *v.older))) == 200_000
    v.compatible = {(i, i): True for i in range(300_000)}
    assert v.fits(5, 6) in (True, False) and len(v.compatible) == 1


def test_a_worker_lets_go_of_what_the_last_operator_kept(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    gone = []
    common.keep_only("a", lambda: gone.append("a"))
    common.keep_only("a", lambda: gone.append("a"))
    assert gone == []
    common.keep_only("b")
    assert gone == ["a"] and common._kept == {}


def test_texts_in_turn_are_those_of_the_batch():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array([None if i % 7 == 0 else "é" * i for i in range(200)], kind).slice(3)
        assert list(common.texts_in_turn(column)) == common.raw_texts(column)


def _tasks(spark, group: str) -> int:
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = {i: tracker.getStageInfo(i) for j in jobs for i in j.stageIds}
    return sum(s.numCompletedTasks for s in stages.values() if s)


def test_components_of_many_partitions_take_few_tasks(spark):
    """The driver keeps something of every task: a round takes about five for each partition, not twelve."""
    n, before = 64, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, (str(n), "false"), strict=True):
        spark.conf.set(k, v)
    try:
        edges = spark.range(600).selectExpr("id as a", "id + if(id % 60 = 59, 0, 1) as b")
        spark.sparkContext.setJobGroup("components", "")
        got = {r.node: r.component for r in common.components(edges).collect()}
        spark.sparkContext.setJobGroup("", "")
        assert got == {i: i // 60 * 60 for i in range(600)}
        taken = _tasks(spark, "components")
        assert 0 < taken < 60 * n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
