from stratalith.operators import retrieval, structure
from stratalith.sources import jsonlines


def test_list_runs(spark):
    rows = [("decimal", 0, "one"), ("bullet", 1, "inner"), ("decimal", 0, "two"), (None, None, "text"), ("decimal", 0, "again"), ("decimal", 1, "a"), ("decimal", 1, "b"), ("decimal", 0, "next"), ("decimal", 1, "anew")]
    df = spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "doc string, pos int, kind string, depth int, text string")
    got = [r.md for r in structure.list_runs(df).orderBy("pos").collect()]
    assert got == ["1. one\n  - inner\n2. two", "1. again\n  1. a\n  2. b\n2. next\n  1. anew"]


def test_page_numbers(spark):
    df = spark.createDataFrame([("d", 0, 0), ("d", 1, 1), ("d", 2, 0), ("d", 3, 2)], "doc string, pos int, breaks int")
    assert [r.page for r in structure.page_numbers(df).orderBy("pos").collect()] == [0, 1, 1, 3]


def test_lines_of_type(spark):
    rows = [("f", 1, '{"type":"table","md":"x"}'), ("f", 2, '{"md":"\\"type\\":\\"table\\"","type":"code"}'), ("f", 3, '{"id":"b","type":"table"}'), ("g", 1, "broken")]
    df = spark.createDataFrame(rows, "path string, line int, value string")
    assert [r.line for r in jsonlines.lines_of_type(df, "table").orderBy("line").collect()] == [1, 3]
    assert [(r.path, r.line) for r in jsonlines.first_of_type(df, "table").collect()] == [("f", 1)]


def test_paths_survive_circles_and_missing_parents(spark):
    rows = [("d", 0, "d#e1", "heading", "# A", None), ("d", 1, "d#e2", "group", "box\nmore", "d#e1"), ("d", 2, "d#e3", "paragraph", "x", "d#e2"), ("d", 3, "d#e4", "paragraph", "y", "d#e99")]
    df = spark.createDataFrame(rows, "doc string, pos int, id string, type string, md string, parent string")
    got = {r.id: r.path for r in structure.ancestors(df).collect()}
    assert got == {"d#e1": [], "d#e2": ["A"], "d#e3": ["A", "box"], "d#e4": []}


def test_search_leaves_out_what_may_not_be_seen(spark):
    chunks = spark.createDataFrame([(1, "secret plans", ["staff"]), (2, "public plans of the day", ["all"]), (3, "nothing", ["all"])], "id long, text string, access array<string>")
    questions = spark.createDataFrame([(7, "Which plans?"), (8, "unknownword")], "q long, text string")
    index = retrieval.TfidfIndex(chunks, access="access")
    assert [(r.id, r["rank"]) for r in index.search(questions, "q", "text").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [r.id for r in index.search(questions, "q", "text", allowed=("all",)).collect()] == [2]


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    got = retrieval.nearest_vectors(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding", 3).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        cos = unit @ unit[q]
        cos[q] = -9
        assert [r.vec_id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == np.argsort(-cos)[:3].tolist()
