"""Queries against their SQL over rows that the small tables don't hold."""

import oracle
from stratalith.plans import layout_queries, registry  # noqa: F401


def same_as_sql(spark, folder, name, texts):
    rows = [(k, text, "en", "web", len(text)) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    oracle.compare(spark, str(folder), registry.QUERIES[name], registry.ORACLES[name])
    return registry.QUERIES[name](spark, str(folder)).collect()


def test_fallback_headings_levels_and_spaces(spark, tmp_path):
    ten = "One two three four five six seven eight nine tenth"
    texts = [ten + "x" * k + " é" for k in range(3)]  # a space stays at the end once é is gone
    texts += [number + " SOME TITLE IN CAPITALS" + " É" * 20 + "X" * k for number in ("4355709550244650", "1.2.3") for k in range(3)]
    got = same_as_sql(spark, tmp_path, "fallback_headings", texts)
    assert sorted(r.level for r in got) == [1, 1, 1, 2, 2, 2, 2, 2]


def test_fallback_headings_keep_the_depth_of_their_number(spark):
    from stratalith.operators.layout import fallback_headings

    ten = "1.2.3 One two three four five six seven eight nine tenth "
    df = spark.createDataFrame([("d", 0, "paragraph", ten, None)], "doc string, pos int, type string, md string, level int")
    assert [(r.type, r.level) for r in fallback_headings(df).collect()] == [("heading", 3)]


def test_heading_levels_count_all_spaces(spark, tmp_path):
    small, left, right = "x" * 240, "a" * 80, "b" * 79  # the first is body text of size 8, the lines behind it are of size 10
    got = same_as_sql(spark, tmp_path, "heading_levels", [f"{small}\n{left} é é é {right}", f"{small}\n{left} {right}"])
    assert [(r.doc, r["size"], r.level) for r in got] == [("d1", 10.0, 1)]
