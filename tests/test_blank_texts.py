"""Queries over blank texts give the rows of their SQL."""

from collections import Counter

import duckdb

import __spark_entry__ as entry

TEXTS = ["", "", "  ", " \n ", "\n", "\t\r\n", "a b", "two words\nand more"]


def compared(spark, folder, name):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return Counter(map(tuple, entry.queries()[name](spark, str(folder)).collect())), Counter(c.execute(entry.oracle_sql()[name]).fetchall())


def test_no_notice_stands_in_for_a_blank_text(spark, tmp_path):
    got, want = compared(spark, tmp_path, "reindex")
    assert got == want and len(want) == 6


def test_documents_without_points_are_the_same_after_a_rebuild(spark, tmp_path):
    got, want = compared(spark, tmp_path, "rebuild_index")
    assert got == want and len(want) == len(TEXTS)
