"""What the indexing job takes shortcuts for is what the longer ways give."""

from pyspark.sql import functions as F

from tessarine.functions import tags, text
from tessarine.operators.embedding import hash_embed

TEXTS = [None, "", " ", "a", " a\u00a0b\u3000 c ", "one two  three\nfour", "\tone two", "x " * 50, "Straße STRASSE b", "a-1/2 b cd"]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_first_words_are_those_of_all_words(spark):
    got = texts(spark).select(*[(text.first_words("text", n) == F.array_join(F.slice(text.words("text"), 1, n), " ")).alias(str(n)) for n in (1, 2, 3, 40)]).collect()
    assert len(got) == len(TEXTS) and all(all(r) for r in got)


def test_common_texts_have_the_vectors_of_others(spark):
    vectors = lambda common: {r.id: r.vector for r in hash_embed(texts(spark), "id", "text", 16, common).collect()}
    assert vectors(["x " * 50, "one two  three\nfour", "", "not there"]) == vectors([]) and len(vectors([])) == len(TEXTS)


def test_known_children_are_the_children(spark):
    rows = spark.createDataFrame([("some words here", ["1/AB-2"], ["Bộ Công An"]), ("", [], []), ("a  b", [], ["x", "X"])], "content string, codes array<string>, orgs array<string>")
    none = F.array().cast("array<string>")
    for n in (1, 3, 15):
        made = rows.select(tags.hyq_summary("content").alias("s"), tags.hyq_questions(F.col("codes"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("orgs"), none, none, n).alias("q"))
        both = made.select(tags.known_children(F.col("s"), F.col("q")).alias("k"), tags.children(F.col("s"), F.col("q"), F.lit("")).alias("c")).collect()
        assert len(both) == 3 and all(r.k == r.c for r in both)
