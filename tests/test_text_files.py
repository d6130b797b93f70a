"""Texts written as files of their own."""

import os

from tessarine.sources import text_files
from tessarine.sources.folder import read_folder


def test_texts_are_dealt_into_folders_and_dropped(spark, tmp_path):
    path = f"{tmp_path}/out"
    texts = spark.createDataFrame([(f"doc-{i}.md", "é\n" * (i % 5) if i % 11 else None) for i in range(3000)], "name string, text string").repartition(3)
    for _ in range(2):  # a task that runs again writes the same files
        text_files.write_texts(texts, path)
    folders = os.listdir(path)
    assert 200 < len(folders) <= text_files.FOLDERS and max(len(os.listdir(f"{path}/{f}")) for f in folders) < 60
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in read_folder(spark, path).collect()}
    assert got == {r["name"]: r["text"] or "" for r in texts.collect()}
    text_files.drop_texts(spark, path)
    assert not os.path.exists(path)
    text_files.drop_texts(spark, path)
