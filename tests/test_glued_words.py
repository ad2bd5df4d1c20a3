from stratalith.operators.quality import glued_words
from stratalith.plans import registry

SCHEMA = "doc string, pos int, md string"


def test_glued_words_of_documents(spark):
    rows = [("d", 2, "mill stones"), ("d", 0, "wind mill wind mill wind"), ("d", 1, None), ("d", 3, "windmill, millwind and mill-wind"), ("e", 0, "windmill"), (None, 0, "wind mill wind mill wind mill windmill")]
    got = glued_words(spark.createDataFrame(rows, SCHEMA).repartition(4), frequent=3, together=3).collect()
    assert [tuple(r) for r in got] == [("d", "windmill", "wind", "mill")]  # "mill wind" stands together twice only


def test_glued_words_take_the_first_cut(spark):
    text = "abc de ab cde " * 3 + "abcde"
    got = glued_words(spark.createDataFrame([("d", 0, text)], SCHEMA), frequent=3, together=1).collect()
    assert [tuple(r) for r in got] == [("d", "abcde", "ab", "cde")]


def test_glued_words_move_their_texts_once(spark):
    plan = registry.QUERIES["glued_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Generate")
