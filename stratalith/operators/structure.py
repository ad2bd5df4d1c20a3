"""Hierarchy, sections and continuations, as windows and doubling joins.

Inputs are element tables with doc, pos (reading order), id, type, level, md and what
an operator names. All windows are by doc, so a document is the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.columns import short_id, title_of
from stratalith.model import ELEMENT_TYPES, RUNNING_TEXT, WHITE
from stratalith.storage import materialize

MAX_LEVEL = 6
#: Rounds of pointer doubling: chains of up to 2 ** ROUNDS steps.
ROUNDS = 14


def reading_order() -> Window:
    return Window.partitionBy("doc").orderBy("pos")


def default_parent(elements: DataFrame) -> DataFrame:
    """Adds ``parent``: the nearest heading above, for a heading one of a smaller level.

    For each level the last heading above is a window value; the nearest of the levels
    that qualify is their greatest by position. Levels out of 1 to 6 are clamped.
    """
    above = reading_order().rowsBetween(Window.unboundedPreceding, -1)
    level = F.when(F.col("type") == "heading", F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(MAX_LEVEL)))
    out = elements.withColumn("__level", level)
    # a heading closes the open headings of its level and deeper ones
    last = {k: F.last(F.when(F.col("__level") <= k, F.struct("pos", "__level", "id")), True).over(above) for k in range(1, MAX_LEVEL + 1)}
    for k, c in last.items():
        out = out.withColumn(f"__h{k}", c)
    own = F.lit(None).cast(out.schema["__h1"].dataType)
    for k in range(MAX_LEVEL, 1, -1):
        own = F.when(F.col("__level") == k, F.col(f"__h{k - 1}")).otherwise(own)
    parent = F.when(F.col("__level").isNull(), F.col(f"__h{MAX_LEVEL}")).otherwise(own)
    return out.withColumn("parent", parent["id"]).drop("__level", *[f"__h{k}" for k in last])


def _with_default_paths(elements: DataFrame) -> DataFrame:
    """Adds ``default_parent`` and ``default_path``: the open headings above each element, from one window by document."""
    above = reading_order().rowsBetween(Window.unboundedPreceding, -1)
    level = F.when(F.col("type") == "heading", F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(MAX_LEVEL)))
    rows = elements.withColumn("__level", level).withColumn("__title", title_of(F.col("type"), F.col("md")))
    for k in range(1, MAX_LEVEL + 1):
        rows = rows.withColumn(f"__h{k}", F.last(F.when(F.col("__level") == k, F.struct("pos", "id", "__title")), True).over(above))
    last = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"__h{k}.pos").alias("pos"), F.col(f"__h{k}.id").alias("id"), F.col(f"__h{k}.__title").alias("title")) for k in range(1, MAX_LEVEL + 1)])
    there = F.filter(last, lambda h: h["pos"].isNotNull() & (h["level"] < F.coalesce("__level", F.lit(MAX_LEVEL + 1))))
    # a heading is open where no heading of a smaller level stands behind it
    rows = rows.withColumn("__heads", there).withColumn("__open", F.filter("__heads", lambda h: ~F.exists("__heads", lambda g: (g["level"] < h["level"]) & (g["pos"] > h["pos"]))))
    rows = rows.withColumn("default_parent", F.try_element_at(F.col("__open"), F.lit(-1))["id"]).withColumn("default_path", F.transform("__open", lambda h: h["title"]))
    return rows.drop("__level", "__title", "__heads", "__open", *[f"__h{k}" for k in range(1, MAX_LEVEL + 1)])


def ancestors(elements: DataFrame) -> DataFrame:
    """(doc, id, path): the titles above each element, the top one first.

    Documents whose parents are all the nearest headings, and whose ids are unique, need
    one window. In the others (groups, parents given otherwise) each round joins a step
    of 2 ** k parents to the step behind it, among the elements that are parents only. A
    parent that doesn't exist ends the path, and so does one of a circle. Of elements
    with one id the last counts.
    """
    columns = ["doc", "id", "type", "md", "pos", "parent", *(["level"] if "level" in elements.columns else [])]
    rows = elements.select(*columns) if "level" in columns else elements.select(*columns, F.length(F.regexp_extract("md", "^(#{0,6})", 1)).alias("level"))
    rows = _with_default_paths(rows)
    each = rows.groupBy("doc", "id").agg(F.max_by(F.struct("parent", "default_parent", "default_path", title_of(F.col("type"), F.col("md")).alias("title")), "pos").alias("x"), F.count("*").alias("n"))
    each = each.select("doc", "id", "x.*", ((F.col("n") > 1) | ~F.col("x.parent").eqNullSafe(F.col("x.default_parent"))).alias("odd"))
    each = materialize(each.withColumn("odd", F.max("odd").over(Window.partitionBy("doc"))), "path")
    plain, odd = each.where("not odd").select("doc", "id", F.col("default_path").alias("path")), each.where("odd")
    if odd.isEmpty():
        return plain
    heads = odd.join(odd.select("doc", F.col("parent").alias("id")).distinct(), ["doc", "id"], "left_semi")
    known = heads.select("doc", F.col("id").alias("parent"), F.col("title").alias("above"))
    up = F.when(F.col("above").isNotNull(), F.col("parent"))
    now = heads.join(known, ["doc", "parent"], "left").select("doc", "id", up.alias("up"), F.array_compact(F.array("above")).alias("path"), F.array_compact(F.array(up)).alias("ids"))
    now = materialize(now, "path")
    for _ in range(ROUNDS):
        if now.where("up is not null").isEmpty():
            break
        far = now.select("doc", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"), F.col("ids").alias("far_ids"))
        met = F.arrays_overlap("ids", F.coalesce("far_ids", F.array().cast("array<string>"))) | F.array_contains("far_ids", F.col("id"))  # a circle
        then = now.join(far, ["doc", "up"], "left").withColumn("met", F.coalesce(met, F.lit(False)))
        longer = lambda before, own: F.when(F.col("met") | F.col(before).isNull(), F.col(own)).otherwise(F.concat(before, own))
        now = materialize(then.select("doc", "id", F.when(~F.col("met"), F.col("next")).alias("up"), longer("before", "path").alias("path"), longer("far_ids", "ids").alias("ids")), "path")
    of_parent = now.join(heads.select("doc", "id", "title"), ["doc", "id"]).select("doc", F.col("id").alias("parent"), F.concat("path", F.array("title")).alias("path"))
    found = odd.select("doc", "id", "parent").join(of_parent, ["doc", "parent"], "left").select("doc", "id", F.coalesce("path", F.array().cast("array<string>")).alias("path"))
    return plain.union(found)


def sections(elements: DataFrame) -> DataFrame:
    """Adds ``section``, numbered from 1 by document.

    A heading begins a section, unless the element before it is a heading of smaller
    level: then it goes on with that heading's section.
    """
    wd = reading_order()
    above = (F.lag("type").over(wd) == "heading") & (F.coalesce(F.lag("level").over(wd), F.lit(1)) < F.coalesce("level", F.lit(1)))
    begins = F.lag("id").over(wd).isNull() | ((F.col("type") == "heading") & ~F.coalesce(above, F.lit(False)))
    return elements.withColumn("__b", begins.cast("int")).withColumn("section", F.sum("__b").over(wd.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def continuation_roots(elements: DataFrame) -> DataFrame:
    """Adds ``root``: the id of the first part of the chain that an element continues, or its own id.

    An element continues an earlier one of its type; of several that claim the same
    one the first does. ``elements`` has doc, pos, id, type, continues.
    """
    before = elements.select("doc", F.col("id").alias("continues"), F.col("type").alias("t"), F.col("pos").alias("p")).groupBy("doc", "continues").agg(F.max_by(F.struct("t", "p"), "p").alias("x"))
    claims = elements.where("continues is not null").join(before, ["doc", "continues"]).where("type = x.t and pos > x.p")
    first = Window.partitionBy("doc", "continues").orderBy("pos")
    links = claims.withColumn("n", F.row_number().over(first)).where("n = 1").select("doc", "id", F.col("continues").alias("up"))
    now = materialize(links, "chain")
    if now.isEmpty():
        return elements.withColumn("root", F.col("id"))
    for _ in range(ROUNDS):  # over the links only
        far = now.select("doc", F.col("id").alias("up"), F.col("up").alias("next"))
        then = materialize(now.join(far, ["doc", "up"], "left"), "chain")
        now = then.select("doc", "id", F.coalesce("next", "up").alias("up"))
        if then.where("next is not null").isEmpty():
            break
    return elements.join(now.withColumnRenamed("up", "root"), ["doc", "id"], "left").withColumn("root", F.coalesce("root", "id"))


def joined_hash(hashes: Column) -> Column:
    """The hash of several parts: of their hashes, a line each."""
    return F.substring(F.sha2(F.array_join(F.transform(hashes, lambda h: F.coalesce(h, F.lit(""))), "\n"), 256), 1, 16)


def joined_text(kind: Column, parts: Column) -> Column:
    """Continued parts as one text: a word cut by a hyphen is whole again in running text."""
    running = kind.isin(*RUNNING_TEXT)
    cut = lambda a, b: a.rlike(r"(?U)\w-$") & b.rlike(r"^\p{javaLowerCase}")
    glue = lambda a, b: F.when(running & cut(a, b), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), b)).when(running, F.concat(a, F.lit(" "), b)).when(kind == "list", F.concat(a, F.lit("\n"), b)).otherwise(F.concat(a, F.lit("\n\n"), b))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), glue)


def page_range(pages: Column) -> tuple[Column, Column]:
    """(page, pages) of a set of page numbers: one page, or the first and the last."""
    known = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    one = F.when(F.size(known) == 1, F.element_at(known, 1))
    more = F.when(F.size(known) > 1, F.array(F.element_at(known, 1), F.element_at(known, -1)))
    return one, more


def in_order(column: str | Column, order: str = "pos") -> Column:
    """The group's values of ``column`` as an array in reading order."""
    value = F.col(column) if isinstance(column, str) else column
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def joined_units(elements: DataFrame) -> DataFrame:
    """Chains of continued elements as one element each, at the place and with the id of the first part.

    ``part_ids`` and ``part_hashes`` list the parts. A single part keeps its own hash.
    """
    rooted = continuation_roots(elements)
    kept = [c for c in elements.columns if c not in ("doc", "pos", "id", "md", "page", "pages", "hash", "continues", "type")]
    own_pages = F.array("page") if "pages" not in elements.columns else F.coalesce(F.when(F.col("page").isNotNull(), F.array("page")), F.col("pages"), F.array().cast("array<int>"))
    part_pages = F.flatten(in_order(own_pages))
    grouped = rooted.groupBy("doc", "root").agg(
        F.min("pos").alias("pos"),
        F.min_by("type", "pos").alias("type"),
        in_order(F.coalesce("md", F.lit(""))).alias("texts"),
        in_order("id").alias("part_ids"),
        in_order(F.coalesce("hash", F.lit(""))).alias("part_hashes"),
        part_pages.alias("part_pages"),
        *[F.min_by(c, "pos").alias(c) for c in kept],
    )
    page, pages = page_range(F.col("part_pages"))
    own = F.when(F.size("part_ids") > 1, joined_hash(F.col("part_hashes"))).otherwise(F.element_at("part_hashes", 1))
    return grouped.select("doc", F.col("root").alias("id"), "pos", "type", joined_text(F.col("type"), F.col("texts")).alias("md"), page.alias("page"), pages.alias("pages"), own.alias("hash"), "part_ids", "part_hashes", "part_pages", *kept)


def clamped_levels(headings: DataFrame) -> DataFrame:
    """Adds ``clamped``: a heading is at most one level below the clamped level of the heading before it."""
    each = headings.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "level"))).alias("h"))
    step = lambda acc, x: F.concat(acc, F.array(F.least(x["level"], F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1)))
    each = each.withColumn("c", F.aggregate("h", F.array().cast("array<int>"), step))
    return each.select("doc", F.explode(F.arrays_zip("h", "c")).alias("x")).select("doc", "x.h.pos", "x.h.id", "x.h.level", F.col("x.c").alias("clamped"))


def outline(elements: DataFrame) -> DataFrame:
    """(doc, pos, line): headings indented by their level, and groups."""
    heading = F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(1)) - 1), F.lit("- "), F.regexp_replace("md", f"^#{{1,6}}{WHITE}*", ""))
    group = F.concat(F.lit("  - (group) "), "md")
    return elements.where(F.col("type").isin("heading", "group")).select("doc", "pos", F.when(F.col("type") == "heading", heading).otherwise(group).alias("line"))


def type_counts(elements: DataFrame) -> DataFrame:
    """(doc, type, elements, characters)"""
    return elements.groupBy("doc", "type").agg(F.count("*").alias("elements"), F.sum("characters").alias("characters"))


def info_text(headers: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc, text): what a document is, how many elements of each type it has, and its outline."""
    counts = type_counts(elements).withColumn("nth", F.array_position(F.array(*[F.lit(t) for t in ELEMENT_TYPES]), F.col("type")))
    counts = counts.groupBy("doc").agg(F.sum("elements").alias("n"), F.coalesce(F.sum("characters"), F.lit(0)).alias("size"), in_order(F.concat(F.lit("  "), F.rpad("type", 11, " "), F.col("elements").cast("string")), "nth").alias("types"))
    lines = outline(elements).join(elements.select("doc", "pos", short_id(F.col("id"), F.col("doc")).alias("short")), ["doc", "pos"])
    lines = lines.groupBy("doc").agg(in_order(F.concat("line", F.lit("  ["), "short", F.lit("]"))).alias("lines"))
    h = headers.select(*[F.col(c) if c in headers.columns else F.lit(None).cast("string").alias(c) for c in ("doc", "title", "version", "date", "source", "lang", "created")], F.array_join("authors", ", ").alias("authors"))
    named = [F.when(F.col(c) != "", F.concat(F.lit(f"{c}: "), c)) for c in ("authors", "date", "source", "lang", "created")]
    first = F.concat(F.coalesce("title", "doc"), F.lit("  (doc: "), "doc", F.lit(", version "), F.coalesce("version", F.lit("unknown")), F.lit(")"))
    total = F.concat(F.lit("elements: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit("  ("), F.coalesce("size", F.lit(0)).cast("string"), F.lit(" characters)"))
    none = F.array().cast("array<string>")
    text = F.concat(F.array_compact(F.array(first, *named, total)), F.coalesce("types", none), F.array(F.lit("outline:")), F.coalesce("lines", none))
    return h.join(counts, "doc", "left").join(lines, "doc", "left").select("doc", F.concat(F.array_join(text, "\n"), F.lit("\n")).alias("text"))


def caption_targets(elements: DataFrame) -> DataFrame:
    """(doc, id, target): a caption's table below or image above it, else what stands on its other side.

    Captions that begin with "table" look for tables first, all others for images; a
    neighbour of the other kind is taken where there is none of the wanted one.
    """
    wd = reading_order()
    near = {n: (F.lag, F.lead)[n == "below"] for n in ("above", "below")}
    rows = elements
    for name, step in near.items():
        rows = rows.withColumn(f"__{name}", F.struct(step("type").over(wd).alias("type"), step("id").over(wd).alias("id")))
    wanted = F.when(F.startswith(F.lower("md"), F.lit("table")), "table").otherwise("image")

    def pick(first: str, second: str) -> Column:
        a, b = F.col(f"__{first}"), F.col(f"__{second}")
        fits = lambda x, kinds: x["type"].isin(*kinds)
        exact = F.when(a["type"] == wanted, a["id"]).when(b["type"] == wanted, b["id"])
        return F.coalesce(exact, F.when(fits(a, ("image", "table")), a["id"]).when(fits(b, ("image", "table")), b["id"]))

    target = F.when(wanted == "table", pick("below", "above")).otherwise(pick("above", "below"))
    return rows.where("type = 'caption'").select("doc", "id", target.alias("target"))


def runs(rows: DataFrame, inside: Column) -> DataFrame:
    """Adds ``run``: the number of the stretch of consecutive rows that are ``inside``; null for others."""
    wd = reading_order()
    rows = rows.withColumn("__in", F.coalesce(inside, F.lit(False)))
    begins = F.col("__in") & ~F.coalesce(F.lag("__in").over(wd), F.lit(False))
    return rows.withColumn("run", F.when(F.col("__in"), F.sum(begins.cast("int")).over(wd.rowsBetween(Window.unboundedPreceding, 0)))).drop("__in")


def code_runs(paragraphs: DataFrame) -> DataFrame:
    """(doc, pos, md): consecutive code paragraphs (``code``, text) as one fenced block."""
    rows = runs(paragraphs, F.col("code")).where("run is not null")
    return rows.groupBy("doc", "run").agg(F.min("pos").alias("pos"), F.concat(F.lit("```\n"), F.array_join(in_order("text"), "\n"), F.lit("\n```")).alias("md")).drop("run")


def list_runs(paragraphs: DataFrame) -> DataFrame:
    """(doc, pos, md): consecutive list paragraphs (kind is a number format, depth) as one list, numbered by depth.

    ``paragraphs`` has doc, pos, kind (null: no list), depth, text. A deeper count begins
    anew behind a shallower item, and with another kind.
    """
    rows = runs(paragraphs, F.col("kind").isNotNull()).where("run is not null")
    lists = rows.groupBy("doc", "run").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "kind", "depth", "text"))).alias("items"))
    empty = F.struct(F.array().cast("array<struct<depth:int,kind:string,n:int>>").alias("counts"), F.array().cast("array<string>").alias("lines"))

    def step(acc, x):
        same = F.filter(acc["counts"], lambda c: (c["depth"] == x["depth"]) & (c["kind"] == x["kind"]))
        n = F.when(F.size(same) > 0, F.element_at(same, 1)["n"] + 1).otherwise(F.lit(1))
        counts = F.concat(F.filter(acc["counts"], lambda c: c["depth"] < x["depth"]), F.array(F.struct(x["depth"].alias("depth"), x["kind"].alias("kind"), n.alias("n"))))
        mark = F.when(x["kind"] == "bullet", F.lit("- ")).otherwise(F.concat(n.cast("string"), F.lit(". ")))
        return F.struct(counts.alias("counts"), F.concat(acc["lines"], F.array(F.concat(F.repeat(F.lit("  "), x["depth"]), mark, x["text"]))).alias("lines"))

    return lists.select("doc", "pos", F.array_join(F.aggregate("items", empty, step, lambda a: a["lines"]), "\n").alias("md"))


def page_numbers(paragraphs: DataFrame) -> DataFrame:
    """Adds ``page``: the page breaks (``breaks`` of each paragraph) up to and with a paragraph."""
    return paragraphs.withColumn("page", F.sum("breaks").over(reading_order().rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def recovered(truth: DataFrame, reading: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``truth`` that ``reading`` has too, by all of ``keys``, nulls being equal."""
    tests = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    condition = tests[0]
    for t in tests[1:]:
        condition = condition & t
    return truth.alias("a").join(reading.select(*keys).distinct().alias("b"), condition, "left_semi")


def accuracy(truth: DataFrame, reading: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, correct, total): how many values of each field a reading has right."""
    both = truth.alias("t").join(reading.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in fields]), key, "left")
    each = [F.struct(F.lit(f).alias("field"), F.col(f).eqNullSafe(F.col(f"__{f}")).cast("long").alias("right")) for f in fields]
    return both.select(F.explode(F.array(*each)).alias("x")).groupBy("x.field").agg(F.sum("x.right").alias("correct"), F.count("*").alias("total"))
