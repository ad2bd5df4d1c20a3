from stratalith.operators import layout as L

PAGE = "doc string, page int, page_w double, page_h double, item int, kind string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, chars int, lines array<string>, digest string"


def item(page, n, y0, lines, size=10.0, x0=50.0, x1=500.0, kind="text", y1=None, digest=None):
    return ("d", page, 600.0, 800.0, n, kind, float(x0), float(y0), float(x1), y0 + 12.0 if y1 is None else float(y1), size, False, sum(map(len, lines)), lines, digest)


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGE)


def test_running_noise(spark):
    rows = []
    for page in range(10):
        rows += [item(page, 0, 20, [f"PERSUASION. {page}"]), item(page, 1, 400, ["Body text stays."]), item(page, 2, 780, [f"{page + 1}"])]
    rows += [item(3, 3, 30, ["Chapter IV"]), item(4, 3, 30, ["Chapter IV"]), item(5, 3, 30, ["only once here"])]
    got = {(r.page, r.item): r.noise for r in L.running_noise(frame(spark, rows)).collect()}
    assert {got[p, 0] for p in range(10)} == {"header"} and {got[p, 1] for p in range(10)} == {None} and {got[p, 2] for p in range(10)} == {"page_number"}
    assert got[3, 3] is None and got[5, 3] is None


def test_sizes_and_levels(spark):
    rows = [item(0, k, 100 + 20 * k, ["body text " * 5]) for k in range(5)] + [item(0, 10, 50, ["Title"], 24.0), item(0, 11, 300, ["Section"], 14.0), item(1, 0, 50, ["small"], 8.0), item(1, 1, 90, ["x" * 200], 30.0)]
    items = frame(spark, rows)
    sizes = L.body_size(items)
    assert sizes.first().body == 10.0
    assert [(r.size, r.level) for r in L.heading_levels(items, sizes).orderBy("level").collect()] == [(24.0, 1), (14.0, 2)]


def test_sidebars_and_columns(spark):
    rows = [item(0, 0, 100, ["main text"], x0=200, x1=560), item(0, 1, 110, ["aside"], 7.0, 20, 150), item(0, 2, 200, ["aside two"], 7.0, 20, 150)]
    rows += [item(1, 0, 50, ["wide title"], x0=50, x1=550)]
    rows += [item(1, k, 100 + 50 * k, [f"left {k}"], x0=40, x1=290) for k in (1, 2)] + [item(1, k + 2, 90 + 50 * k, [f"right {k}"], x0=310, x1=560) for k in (1, 2)]
    items = frame(spark, rows)
    got = L.page_order(L.sidebars(items, L.body_size(frame(spark, [item(0, 0, 0, ["m" * 99])]))))
    order = {p: [r.item for r in got.where(f"page = {p}").orderBy("rank").collect()] for p in (0, 1)}
    assert order == {0: [0, 1, 2], 1: [0, 1, 2, 3, 4]}
    assert [r.item for r in got.where("side").orderBy("item").collect()] == [1, 2]


def test_images(spark):
    rows = [item(p, 0, 10, [], kind="image", digest="logo") for p in range(4)] + [item(1, 1, 300, [], kind="image", digest="once")]
    got = {(r.page, r.item): (r.role, r.keep) for r in L.image_roles(frame(spark, rows)).collect()}
    assert got == {(0, 0): ("logo", True), (1, 0): ("logo", False), (2, 0): ("logo", False), (3, 0): ("logo", False), (1, 1): ("photo", True)}


def els(spark, rows):
    return spark.createDataFrame([("d", k, f"d#e{k + 1}", *r) for k, r in enumerate(rows)], "doc string, pos int, id string, type string, level int, page int, md string")


def test_hyphens(spark):
    s = L.SOFT
    rows = [("paragraph", None, 0, f"self{s}esteem and some{s}thing"), ("paragraph", None, 0, "self-esteem is written so"), ("paragraph", None, 0, f"re{s}cover, recover, re-cover")]
    got = [r.md for r in L.resolved_hyphens(els(spark, rows)).orderBy("pos").collect()]
    assert got == ["self-esteem and something", "self-esteem is written so", "recover, recover, re-cover"]


def test_joined_lines(spark):
    df = spark.createDataFrame([(["a some-", "thing  here ", "an­", "other", "X-", "Y"],)], "lines array<string>")
    assert df.select(L.joined_lines(df.lines).alias("t")).first().t == f"a some{L.SOFT}thing here another X- Y"


def test_lost_initials(spark):
    rows = [("heading", 1, 0, "# I"), ("paragraph", None, 0, "IR WALTER went"), *[("paragraph", None, 0, "a sir came; fir") for _ in range(6)]]
    assert L.lost_initials(els(spark, rows)).collect() == []
    rows = [("heading", 1, 0, "# I"), ("paragraph", None, 0, "IR WALTER went"), *[("paragraph", None, 0, "a sir came") for _ in range(6)]]
    assert [(r.pos, r.letter) for r in L.lost_initials(els(spark, rows)).collect()] == [(1, "S")]


def test_number_headings_and_chapters(spark):
    rows = [("heading", 2, 0, "## 6"), ("heading", 1, 0, "# Anxiety"), ("paragraph", None, 0, "x")]
    assert [(r.md, r.level) for r in L.number_headings(els(spark, rows)).orderBy("pos").collect()] == [("# 6 Anxiety", 1), ("x", None)]
    rows = [("heading", 1, 0, "# A title"), ("paragraph", None, 0, "Chapter I"), ("paragraph", None, 1, "x"), ("paragraph", None, 2, "Chapter II"), ("heading", 3, 3, "### Chapter III")]
    got = L.chapters(els(spark, rows)).orderBy("pos").collect()
    assert [(r.type, r.level, r.md) for r in got] == [("paragraph", None, "A title"), ("heading", 1, "# Chapter I"), ("paragraph", None, "x"), ("heading", 1, "# Chapter II"), ("heading", 1, "# Chapter III")]
    assert {r.body for r in got} == {"d#e2"}
    few = els(spark, rows[:3])
    assert L.chapters(few).where("body is not null").isEmpty()


def test_fallback_headings(spark):
    rows = [("paragraph", None, 0, t) for t in ("1.2 Some title", "LOUD WORDS", "ends here.", "quiet words", "1. lower", "AB")]
    got = [r.md for r in L.fallback_headings(els(spark, rows)).orderBy("pos").collect()]
    assert got == ["## 1.2 Some title", "# LOUD WORDS", "ends here.", "quiet words", "1. lower", "AB"]


def test_lists_and_trailing_numbers(spark):
    schema = "doc string, page int, pos int, type string, md string, y0 double, y1 double"
    df = spark.createDataFrame([("d", 0, 0, "list", "- a", 10.0, 20.0), ("d", 0, 1, "list", "- b", 40.0, 50.0), ("d", 0, 2, "list", "- c", 90.0, 99.0), ("d", 0, 3, "paragraph", "17", 200.0, 210.0)], schema)
    assert [r.md for r in L.merged_lists(df).orderBy("pos").collect()] == ["- a\n- b", "- c", "17"]
    assert [(r.type, r.subtype) for r in L.trailing_numbers(df).orderBy("pos").collect()][-1] == ("noise", "page_number")


def test_page_continuations(spark):
    rows = [("paragraph", None, 0, "goes"), ("noise", None, 1, "head"), ("paragraph", None, 1, "on here."), ("paragraph", None, 2, "new"), ("paragraph", None, 3, "New again")]
    assert [(r.id, r.continues) for r in L.page_continuations(els(spark, rows)).collect()] == [("d#e3", "d#e1")]


def test_kinds(spark):
    blocks = [["Title"], ["1. one", "2) two", "more of it"], ["R. B. Smith"], ["a) x", "b) y"], ["- lonely"], ["• dot", "• dots"], ["Figure 2: it"], ["plain text", "over two-", "lines"], ["(b) x", "(a) y"]]
    rows = [item(0, k, 100 + 20 * k, lines, 20.0 if k == 0 else 10.0) for k, lines in enumerate(blocks)]
    items = L.running_noise(frame(spark, rows))
    sizes = L.body_size(items)
    got = [(r.type, r.md) for r in L.element_kinds(items, sizes, L.heading_levels(items, sizes)).orderBy("item").collect()]
    assert got == [
        ("heading", "# Title"), ("list", "1. one\n2. two more of it"), ("paragraph", "R. B. Smith"), ("list", "- a) x\n- b) y"), ("paragraph", "- lonely"), ("list", "- dot\n- dots"),
        ("caption", "Figure 2: it"), ("paragraph", f"plain text over two{L.SOFT}lines"), ("paragraph", "(b) x (a) y"),
    ]


def test_scans(spark):
    rows = [item(0, 0, 0, [], x0=0, x1=600, y1=800, kind="image"), item(0, 1, 100, ["text"]), item(0, 2, 300, ["* —"]), item(0, 3, 600, [], kind="image", y1=700), item(1, 0, 100, ["*"])]
    items = frame(spark, rows)
    assert [(r.doc, r.page) for r in L.scanned_pages(items).collect()] == [("d", 0)]
    rows.append(item(0, 4, 610, ["words on it"], y1=690))
    assert sorted((r.page, r.item) for r in L.cleaned_scans(frame(spark, rows)).collect()) == [(0, 0), (0, 1), (0, 4), (1, 0)]


def test_colon_lists_and_text_tables(spark):
    schema = "doc string, page int, item int, kind string, size double, lines array<string>, line_x1 array<double>"
    df = spark.createDataFrame([("d", 0, 0, "text", 10.0, ["You need:", "salt", "pepper", "oil"], [500.0, 80.0, 90.0, 70.0]), ("d", 0, 1, "text", 10.0, ["He said:", "a full line here", "end"], [500.0, 500.0, 70.0])], schema)
    assert [(r.item, r.part, r.lines) for r in L.colon_lists(df).orderBy("item", "part").collect()] == [(0, 0, ["You need:"]), (0, 1, ["- salt", "- pepper", "- oil"]), (1, 0, ["He said:", "a full line here", "end"])]
    cells = "doc string, page int, item int, x0 double, y0 double, cells array<array<struct<x:double,text:string>>>"
    row = lambda *c: [(x, t) for x, t in c]
    df = spark.createDataFrame([("d", 0, 0, 1.0, 10.0, [row((50.0, "a"), (200.0, "b"))]), ("d", 0, 1, 1.0, 20.0, [row((55.0, "1"), (190.0, "2")), row((50.0, "3"), (200.0, "4"))]), ("d", 0, 2, 1.0, 30.0, None), ("d", 0, 3, 1.0, 40.0, [row((50.0, "x"), (200.0, "y"))])], cells)
    assert [(r.item, r.rows) for r in L.text_tables(df).collect()] == [(0, [["a", "b"], ["1", "2"], ["3", "4"]])]
