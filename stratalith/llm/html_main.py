"""Main text of web pages by a maximum-scoring contiguous region.

A page is read as a sequence of words and tags. What is never the article is taken
out first, with all that it contains: ``DROPPED`` tags and elements whose class, id
or role names them as menus, adverts, notices, comments and the like. A wrapper stays
in spite of its name if it holds most words of the page's article and main elements or,
without these, most words outside links (``wrappers``). Each remaining
word and tag has a score, and one linear scan finds the contiguous region with the
largest sum; the blocks with words in it are the text.

Scores are log odds of being inside the main text, learnt from labelled pages
(``labelled_pages()``; any list of (html, main blocks) will do). A word's kind is
whether it stands in a link and where it stands relative to an article element; a
tag's kind is its name. Words outside links and outside of nothing score positive at
least, tags never do.

White space in a block becomes one space, the block is trimmed, and blocks are joined
in page order by two newlines. Character references are decoded, once. A page cut off
in the middle is read up to its end, an unfinished tag being markup. Null counts as
an empty page, with empty text. Pages of any length are read whole; of regions with equal
sums the longest counts, of these the first. Repeated rows get repeated results, an empty
table an empty one; columns besides page_id, url and html aren't read, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.textbytes import lean
from stratalith.storage import Shared

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|xmp|title)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<(?P<odd>/?[a-zA-Z][^<>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: Beginnings of words that name the same, as in commentlist.
BAD_BEGINNINGS = ("comment", "advert", "sponsor", "cookie", "newsletter", "sidebar", "breadcrumb")
#: Names of what isn't the article unless it stands in one.
HEADER_NAMES = frozenset("header topbar toolbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form button select option svg canvas audio video object dialog menu".split())
#: Words of a class, id or role, between separators, that name what isn't the article.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond "
    "related recommended footer masthead copyright pager pagination toolbar widget skip complementary contentinfo search".split()
)
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - {"body", "html"}
HOLDERS = frozenset(("article", "main"))
#: Names of what may well be longer than a short article, unless they say what a layout has.
_REMARKS = re.compile(r"(?<!has-)(?<!with-)(?<!no-)(?:comment|disqus|repl(?:y|ies)|respond|cookie|consent|gdpr|related|recommended|footer|header|topbar|toolbar)", re.IGNORECASE)


def _bad(rest: str, inside: bool) -> bool:
    for groups in _NAMED.findall(rest):
        words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(groups)).lower())
        if BAD_NAMES.intersection(words) or any(w.startswith(BAD_BEGINNINGS) for w in words) or not inside and HEADER_NAMES.intersection(words):
            return True
    return False


def wrappers(found: list[re.Match]) -> set[int]:
    """Where the elements begin that stay in spite of their names."""
    stack: list[tuple[str, int, int, int, bool, bool]] = []
    closed: list[tuple[int, int, int]] = []
    words = main = links = held = lost = 0

    def close(k: int) -> None:
        nonlocal links, held, lost
        for name, at, w, h, suspect, out in stack[k:]:
            links -= name == "a"
            held -= name in HOLDERS
            lost -= out
            if suspect:
                closed.append((at, words - w, main - h))
        del stack[k:]

    for m in found:
        if m["text"] is not None:
            n = 0 if links or lost else len(m["text"].split())
            words += n
            main += n if held else 0
            continue
        name = (m["name"] or "").lower()
        if not name or m["raw"]:
            continue
        if m["end"]:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != name:
                k -= 1
            if k >= 0:
                close(k)
        elif name not in VOID and not m["rest"].rstrip().endswith("/"):
            bad = name not in ("body", "html", "article", "main") and _bad(m["rest"], held > 0)
            out = name in DROPPED and name != "form" or bad and any(_REMARKS.search("".join(g)) for g in _NAMED.findall(m["rest"]))
            stack.append((name, m.start(), words, main, not out and (bad or name == "form"), out))
            links += name == "a"
            held += name in HOLDERS
            lost += out
    close(0)
    return {at for at, w, h in closed if (2 * h > main if main else 2 * w > words)}


def tokens(page: str) -> list[tuple[str, str, int]]:
    """(kind, text, block number) in page order: a run of text has its words' kind, a tag an empty text.

    Dropped elements are gone. Kinds of text: "in" an article or main element,
    "out" of it, "free" on a page without one, each with "-link" in a link.
    """
    out: list[tuple[str, str, int]] = []
    block, links, held, skipping = 0, 0, 0, []
    open_tags: list[str] = []
    matches = list(_TOKEN.finditer(page))
    kept = wrappers(matches)
    for m in matches:
        name = (m["name"] or "").lower()
        if m["text"] is not None:
            if not skipping:
                out.append((("in" if held else "out") + ("-link" if links else ""), m["text"], block))
            continue
        if not name or m["raw"]:
            continue
        if skipping:  # until the element that is dropped ends, or one around it
            if m["end"]:
                if name == skipping[-1]:
                    skipping.pop()
                elif name in skipping:
                    del skipping[skipping.index(name) :]
                elif name in open_tags and (name in HOLDERS or name in ("body", "html")):
                    skipping = []
            elif name not in VOID and not m["rest"].rstrip().endswith("/") and name in (skipping[0], *skipping):
                skipping.append(name)
            if skipping or m["end"] and name not in open_tags:
                continue
            if not m["end"]:
                continue
        if m["end"]:
            if name in open_tags:
                k = len(open_tags) - 1 - open_tags[::-1].index(name)
                for gone in open_tags[k:]:
                    links -= gone == "a"
                    held -= gone in HOLDERS
                del open_tags[k:]
        else:
            inside = held > 0
            if m.start() not in kept and (name in DROPPED or name == "header" and not inside or name not in ("body", "html", "article", "main") and _bad(m["rest"], inside)):
                if name not in VOID and not m["rest"].rstrip().endswith("/"):
                    skipping = [name]
                block += name in BLOCKS
                continue
            if name in ENDS_P and "p" in open_tags:
                k = len(open_tags) - 1 - open_tags[::-1].index("p")
                if not any(t in ("table", "td", "th", "li", "div", "section", "article") for t in open_tags[k:]):
                    del open_tags[k : k + 1]
            if name not in VOID:
                open_tags.append(name)
                links += name == "a"
                held += name in HOLDERS
        if name in BLOCKS or name in DROPPED:
            block += 1
        elif name == "br":
            out.append(("br", " ", block))
            continue
        out.append(("/" * bool(m["end"]) + name, "", block))
    if not any(kind in HOLDERS for kind, text, _ in out if not text):
        out = [("free" + kind[3:] if kind in ("out", "out-link") and text else kind, text, b) for kind, text, b in out]
    return out


def blocks_of(found: list[tuple[str, str, int]]) -> list[str]:
    """The text of each block, empty ones left out."""
    parts: dict[int, list[str]] = {}
    for _, text, block in found:
        if text:
            parts.setdefault(block, []).append(text)
    clean = (_SPACE.sub(" ", entities.unescape("".join(p))).strip() for p in parts.values())
    return [c for c in clean if c]


_WORDS = ("in", "in-link", "out", "out-link", "free", "free-link")


def learn(labelled: list[tuple[str, list[str]]]) -> dict[str, float]:
    """Scores by kind: log odds of being inside the main text, smoothed."""
    inside, outside = Counter(), Counter()
    for page, main in labelled:
        found = tokens(page)
        texts: dict[int, list[str]] = {}
        for _, text, block in found:
            texts.setdefault(block, []).append(text)
        true = {b for b, parts in texts.items() if _SPACE.sub(" ", entities.unescape("".join(parts))).strip() in main}
        region = [k for k, t in enumerate(found) if t[2] in true and t[1].strip()]
        for k, (kind, text, _) in enumerate(found):
            here = inside if region and region[0] <= k <= region[-1] else outside
            here[kind] += len(text.split()) if text and kind in _WORDS else 1
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    scores = {}
    for kind in {*inside, *outside, *_WORDS}:
        odds = math.log((inside[kind] + 0.5) / n_in) - math.log((outside[kind] + 0.5) / n_out)
        if kind in ("in", "free"):
            scores[kind] = min(3.0, max(0.25, odds))
        elif kind in _WORDS:
            scores[kind] = min(0.0, max(-3.0, odds)) if kind != "in-link" else 0.1
        else:
            scores[kind] = min(0.0, max(-3.0, odds))
    return scores


def region(values: list[float]) -> tuple[int, int]:
    """The longest contiguous region with the largest sum, as (first, end); (0, 0) if no sum is positive."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for k, v in enumerate(values):
        if total < 0:
            total, begin = 0.0, k
        total += v
        if total > 0 and (total > best + 1e-12 or total >= best - 1e-12 and k + 1 - begin > at[1] - at[0]):
            best, at = max(best, total), (begin, k + 1)
    return at


def main_text(page: str | None, scores: dict[str, float]) -> str:
    found = tokens(page or "")
    values = [scores.get(kind, 0.0) * (len(text.split()) if text and kind in _WORDS else 1.0) if text or kind in scores else 0.0 for kind, text, _ in found]
    first, end = region(values)
    if first == end:
        return ""
    # a region begins and ends with whole blocks
    while first and found[first - 1][2] == found[first][2] and found[first][1]:
        first -= 1
    while end < len(found) and found[end][2] == found[end - 1][2] and found[end - 1][1]:
        end += 1
    return "\n\n".join(blocks_of(found[first:end]))


def labelled_pages() -> list[tuple[str, list[str]]]:
    """Pages with known main blocks, in the layouts that the scores are learnt from."""
    say = "the council met on monday to discuss the new bridge and its cost which had grown since the first plan was drawn".split()
    text = [" ".join(say[k % 7 :] + say[: k % 5]) + "." for k in range(12)]
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in say[:9])
    out = []
    for n in range(1, 9):
        body = "".join(f"<p>{t}</p>" for t in text[:n])
        inner = "".join(f"<p>{t} <b>{t}</b><br><a href=x>{say[3]}</a> {t}</p>" for t in text[:n])
        rich = [f"{t} {t} {say[3]} {t}" for t in text[:n]]
        title = " ".join(say[:5])
        out += [
            (f"<html><body><ul>{links}</ul><div>{say[0]}</div><article><h1>{title}</h1>{body}</article><div><a href=x>{title}</a> {say[1]}</div></body></html>", [title, *text[:n]]),
            (f"<html><body><div><ul>{links}</ul></div><h1>{title}</h1>{inner}<table><tr><td><a href=y>{say[2]}</a></td></tr></table><ul>{links}</ul></body></html>", [title, *rich]),
            (f"<body><main><h2>{title}</h2>{inner}<ul><li>{text[0]}</li></ul></main><div>{title}</div><ul>{links}</ul>", [title, *rich, text[0]]),
            (f"<div><a href=/>{say[4]}</a> <a href=/b>{say[5]}</a></div><div><div><p>{text[0]}</p>{body}</div></div><ul>{links}</ul>", text[: max(1, n)]),
        ]
    return out


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame, labelled: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``SCHEMA`` for every row of ``pages``; no exchange."""
    shared = Shared(pages.sparkSession, learn(labelled or labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        for batch in batches:
            text = [main_text(page.as_py(), scores) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(lean(run), SCHEMA)


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_html_main_text": op9_html_main_text}
ORACLES: dict[str, str] = {}
