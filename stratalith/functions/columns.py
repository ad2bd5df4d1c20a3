"""Column expressions of the element model: ids, hashes, canonical text, detection, rows of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalith.model import WHITE, WHITE_CHARACTERS


def element_hash(kind: Column, md: Column) -> Column:
    """The first 16 hex digits of SHA-256 over type, a newline and the text."""
    return F.substring(F.sha2(F.concat(kind, F.lit("\n"), md), 256), 1, 16)


def id_number(element_id: Column) -> Column:
    """The number behind the last ``#e``."""
    return F.regexp_extract(element_id, r"#e([0-9]+)$", 1).try_cast("long")


def short_id(element_id: Column, doc: Column) -> Column:
    prefix = F.concat(doc, F.lit("#"))
    return F.when(F.startswith(element_id, prefix), F.substr(element_id, F.length(prefix) + 1)).otherwise(element_id)


def full_id(reference: Column, doc: Column) -> Column:
    return F.when(reference.rlike("^e[1-9][0-9]*$"), F.concat(doc, F.lit("#"), reference)).otherwise(reference)


def strip(text: Column) -> Column:
    """Without white space at both ends, all of Unicode's counting as such."""
    return F.btrim(text, F.lit(WHITE_CHARACTERS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_CHARACTERS))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{WHITE}+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "_")


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def canonical_lines(md: Column) -> Column:
    """Line ends as newlines, two spaces at a line's end as a backslash, no blank edges."""
    text = F.regexp_replace(md, "\r\n?", "\n")
    lines = F.transform(F.split(text, "\n", -1), lambda s: F.when(s.rlike(r"  $") & (strip(s) != ""), F.concat(rstrip(s), F.lit("\\"))).otherwise(rstrip(s)))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def canonical_text(kind: Column, md: Column, latex: Column | None = None) -> Column:
    """Canonical text of every type but tables with merged cells, which have functions of their own."""
    lines = canonical_lines(md)
    first = F.regexp_extract(lines, r"^([^\n]*)", 1)
    title = strip(F.regexp_replace(F.regexp_extract(first, f"^#{{1,6}}{WHITE}*(.*)$", 1), f"(^|{WHITE})#+$", ""))
    marks = F.regexp_extract(first, "^(#{1,6})", 1)
    rest = F.substr(lines, F.length(first) + 1)
    heading = F.when(marks != "", F.concat(marks, F.when(title != "", F.concat(F.lit(" "), title)).otherwise(F.lit("")), rest)).otherwise(lines)
    bullets = F.regexp_replace(lines, f"(?m)^([ \\t]*)[*+]({WHITE})", "$1-$2")
    is_grid = F.forall(F.split(lines, "\n", -1), lambda s: F.ltrim(s).startswith("|")) & (lines != "")
    grid = F.array_join(canonical_grid(F.transform(F.split(lines, "\n", -1), split_row)), "\n")
    out = F.when(kind == "code", md)
    if latex is not None:
        out = out.when((kind == "formula") & latex.isNotNull(), F.concat(F.lit("$$"), latex, F.lit("$$")))
    return out.when(kind == "heading", heading).when(kind.isin("list", "form_field"), bullets).when((kind == "table") & is_grid, grid).otherwise(lines)


def split_row(line: Column) -> Column:
    """The cells of a table row. A pipe behind a backslash stays in its cell."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), strip)


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def canonical_grid(rows: Column) -> Column:
    """Rows of cells as lines; a separator in the second row is written in its short form."""
    dash = lambda c: F.concat(F.when(F.startswith(c, F.lit(":")), ":").otherwise(""), F.lit("---"), F.when(F.endswith(c, F.lit(":")), ":").otherwise(""))
    separator = lambda cells: F.forall(cells, lambda c: c.rlike("^:?-+:?$"))
    return F.transform(rows, lambda cells, k: pipe_row(F.when((k == 1) & separator(cells), F.transform(cells, dash)).otherwise(cells)))


def detect_type(block: Column) -> Column:
    """The element type that a block of Markdown reads as."""
    s = F.regexp_replace(block, f"^{WHITE}+", "")
    trimmed = strip(block)
    return (
        F.when(s.rlike(r"^#{1,6}([ \t]|$|\n)"), "heading")
        .when(block.rlike(r"^ {0,3}(`{3,}|~{3,})"), "code")
        .when(s.startswith("|") | s.rlike(f"(?i)^<table({WHITE}|>)"), "table")
        .when(s.startswith("$$") & trimmed.endswith("$$") & (F.length(trimmed) >= 4), "formula")
        .when(~trimmed.contains("\n") & trimmed.rlike(rf"^!\[.*\]\([^{WHITE[1:-1]}]+\)$"), "image")
        .when(s.startswith(">"), "quote")
        .when(s.rlike(f"^([-*+]|[0-9]+[.)]){WHITE}"), "list")
        .otherwise("paragraph")
    )


def strip_dollars(md: Column) -> Column:
    """A formula's source without its pair of double dollars."""
    inner = F.regexp_replace(F.regexp_replace(strip(md), r"^\$\$", ""), r"\$\$$", "")
    return F.when(strip(md).contains("\n"), F.regexp_replace(inner, r"^\n+|\n+$", "")).otherwise(strip(inner))


def citation(doc: Column, page: Column, element_id: Column) -> Column:
    where = F.when(page.isNotNull(), F.concat(F.lit("page "), (page + 1).cast("string"))).otherwise(F.lit("no page"))
    return F.concat(doc, F.lit(", "), where, F.lit(", "), short_id(element_id, doc))


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def title_of(kind: Column, md: Column) -> Column:
    """A heading's text, or the first line of another element."""
    return strip(F.when(kind == "heading", F.regexp_replace(md, f"^#{{1,6}}{WHITE}*", "")).otherwise(F.regexp_extract(md, r"^([^\n]*)", 1)))
