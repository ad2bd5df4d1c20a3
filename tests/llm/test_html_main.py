import random

import pytest
from stratalith.llm import html_main as H

SCORES = H.learn(H.labelled_pages())


def text(page):
    return H.main_text(page, SCORES)


LONG = "The bridge opened on a cold morning and the whole town came to see it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("just words & signs &lt;ok&gt;", "just words & signs <ok>"),
        (f"<nav>Menu</nav><article><h1>A  title</h1><p>{LONG}<br>more\n text</p></article><footer>end</footer>", f"A title\n\n{LONG} more text"),
        (f"<article><p>{LONG}</p><aside>side</aside><div class='ad-box'>buy</div><p>Next.</p><section id=comments><p>I liked it</p></section></article>", f"{LONG}\n\nNext."),
        (f"<header><h1>Site</h1></header><main><p>{LONG}</p><form><p>your name</p></form></main><div id='cookie-notice'><p>We use them</p></div>", LONG),
        (f"<article><p>a<script>var t='</p><p>no';</script>b</p><!-- <p>no</p> --><p>{LONG}</p></article>", f"ab\n\n{LONG}"),
        (f"<article><h1>T</h1><p><b>unclosed {LONG}<br><p>Two</p></article><footer>&copy; x</footer>", f"T\n\nunclosed {LONG}\n\nTwo"),
        ("<article><p>Cut off in the mid &am", "Cut off in the mid &am"),
        ("<article><p>Cut off in a tag <a hre", "Cut off in a tag"),
        ("<article><p>é&nbsp;&eacute; &#233; &amp;lt;</p></article>", "é é é &lt;"),
        ("<article><header><h1>Own head</h1></header><p>Body text here.</p></article>", "Own head\n\nBody text here."),
        ("<ul><li><a href=1>a</a></li><li><a href=2>b</a></li></ul><div><p>" + LONG + "</p><p>Two words</p></div><ul><li><a href=3>c</a></li></ul>", LONG + "\n\nTwo words"),
        (f"<div class='site-header'><p>{LONG} no</p></div><div><p>{LONG}</p><ol class=commentlist><li>I liked it</li></ol></div>", LONG),
        (f"<article><div class=header><h1>Its title</h1></div><p>{LONG}</p></article>", f"Its title\n\n{LONG}"),
        ("<article><p>a > b and 1 < 2</p></article>", "a > b and 1 < 2"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_region_against_all_regions():
    rng = random.Random(6)
    for _ in range(400):
        values = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.25, 1.0, 2.0]) for _ in range(rng.randrange(14))]
        first, end = H.region(values)
        best = max((sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=0.0)
        assert sum(values[first:end]) == pytest.approx(max(best, 0.0))


def test_learnt_scores_have_the_signs():
    assert SCORES["free"] > 0 and SCORES["in"] > 0
    assert all(v <= 0 for k, v in SCORES.items() if k not in ("free", "in", "in-link"))


def test_rows(spark):
    rows = [(1, "u", "<article><p>Some words</p></article>"), (2, None, None), (None, "v", "x" * 200000), (1, "u", "<article><p>Some words</p></article>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(H.extract_main_text(df).collect(), key=repr)
    assert len(got) == 4 and [r.n_chars for r in got if r.page_id == 1] == [10, 10]
    assert [r.text for r in got if r.page_id == 2] == [""] and [r.n_chars for r in got if r.page_id is None] == [200000]
    assert H.extract_main_text(df.limit(0)).collect() == []


def test_wrappers_with_suspicious_names_stay():
    scores = H.learn(H.labelled_pages())
    text = "the river rose over its banks in the night and the old mill was lost to the water"
    menu = "<ul><li><a href=a>home</a></li><li><a href=b>news</a></li></ul>"
    for tag in ("form id='aspnetForm'", "div class='layout-with-sidebar'", "div class='has-sidebar'", "div class='content-widget'", "div class='no-banner'", "div id='page-search'"):
        end = tag.split()[0]
        for inner in (f"<article><p>{text}</p></article>", f"<main><p>{text}</p></main>", f"<div><p>{text}</p></div>"):
            page = f"<body>{menu}<{tag}>{inner}<div class='ad'>buy now</div></{end}><div class='footer'>imprint</div></body>"
            assert H.main_text(page, scores) == text, page
    for inner in (f"<article><p>{text}</p></article>", f"<div><p>{text}</p></div>"):
        page = f"<body>{inner}<div class='comments'><article><p>{text} {text}</p></article></div></body>"
        assert H.main_text(page, scores) == text, page
