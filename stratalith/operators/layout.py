"""Rules that turn page layout into elements, over tables of layout items.

An item has doc, page, page_w, page_h, item (its number on the page), kind, x0, y0, x1,
y1, size, bold, chars, lines (an array of strings), and for images digest. Pages and
documents are the units of the windows; nothing depends on a PDF library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.columns import strip
from stratalith.operators.structure import reading_order

# Fixed patterns and limits of the rules.
BULLET = r"^\s*([•·▪●◦■–—*\-]|\d{1,3}[.)]|[a-zA-Z][.)]|\([a-zA-Z0-9]{1,3}\))\s+(.*)$"
PAGE_NUMBER = r"(?i)^\s*(page\s*)?[\divxlc]{1,7}(\s*(of|/|-)\s*\d{1,5})?\s*$"
CAPTION = r"(?i)^\s*(figure|fig\.?|table|chart|diagram|image|photo)\s*\d+[a-z]?\s*([:.\-–—)]|$)"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last"
CHAPTER = rf"^(?i:chapter|part|book|volume|canto)\s+([IVXLCDM]+|\d{{1,3}}|(?i:{NUMBER_WORDS}))\s*[.:]?(\s*[.:—–-]?\s+\S.{{0,70}})?$"
PART = r"(?i)^(part|book|volume)\b"
FRONT = r"(?i)^(preface|introduction|prologue|foreword)\.?$"
SENTENCE_END = r"[.!?:;\"”’)\]]$"
HEADING_END = r"[.:;,\"”’]$"
HEADER_ZONE, FOOTER_ZONE = 0.12, 0.88
HEADING_FACTOR = 1.15
MIN_CHAPTERS = 3
#: A hyphen at a line's end, until it is decided whether the word has one.
SOFT = "\ue000"


def joined_lines(lines: Column) -> Column:
    """A block's lines as one text; a hyphen at a line's end before a small letter stays open."""
    trimmed = F.transform(lines, strip)

    def glue(acc, line):
        soft = F.endswith(acc, F.lit("\u00ad"))
        open_word = F.endswith(acc, F.lit("-")) & line.rlike(r"^\p{javaLowerCase}")
        cut = F.substr(acc, F.lit(1), F.length(acc) - 1)
        return F.when(acc == "", line).when(soft, F.concat(cut, line)).when(open_word, F.concat(cut, F.lit(SOFT), line)).otherwise(F.concat(acc, F.lit(" "), line))

    text = F.aggregate(trimmed, F.lit(""), glue)
    return F.replace(F.regexp_replace(text, r"[ \t]+", " "), F.lit("\u00ad"), F.lit(""))


def header_key(text: Column) -> Column:
    """The key of a running header: its letters, without a Roman page number at either end."""
    bare = F.regexp_replace(strip(text), r"(?i)^\W*[ivxlcdm]+\b|\b[ivxlcdm]+\W*$", "")
    bare = F.when(bare == "", strip(text)).otherwise(bare)
    letters = F.regexp_replace(F.lower(bare), "[^a-z]+", "")
    other = F.lower(strip(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"\d+", "#")))
    return F.when(letters != "", letters).otherwise(other)


def body_size(items: DataFrame) -> DataFrame:
    """(doc, body): the size that most characters have; of equal ones the one that comes first."""
    sizes = items.where("kind = 'text'").groupBy("doc", "size").agg(F.sum("chars").alias("chars"), F.min(F.struct("page", "item")).alias("first"))
    return sizes.groupBy("doc").agg(F.max_by("size", F.struct("chars", (-F.col("first.page")).alias("p"), (-F.col("first.item")).alias("i"))).alias("body"))


def running_noise(items: DataFrame) -> DataFrame:
    """Adds ``noise``: page_number, header or footer, or null.

    A line in the outer zones of a page is noise if it is a page number, or if its key
    stands there on enough pages and it isn't a chapter's title.
    """
    text = F.array_join("lines", " ")
    top, bottom = F.col("y0") / F.col("page_h"), F.col("y1") / F.col("page_h")
    number = text.rlike(PAGE_NUMBER)
    zone = F.when(bottom < HEADER_ZONE, "header").when(top > FOOTER_ZONE, "footer").when(number & (bottom < 0.15), "header").when(number & (top > 0.8), "footer")
    rows = items.withColumn("__zone", F.when(F.col("kind") == "text", zone)).withColumn("__key", header_key(text))
    seen = rows.where("__zone is not null").groupBy("doc", "__zone", "__key").agg(F.count("*").alias("__seen"))
    pages = items.groupBy("doc").agg(F.greatest(F.lit(2), F.least(F.lit(3), F.floor((F.max("page") + 1) * 0.3).cast("int"))).alias("__least"))
    rows = rows.join(seen, ["doc", "__zone", "__key"], "left").join(pages, "doc")
    title = joined_lines(F.col("lines"))
    repeated = (F.col("__seen") >= F.col("__least")) & (F.length(text) < 200) & ~title.rlike(CHAPTER) & ~title.rlike(FRONT)
    return rows.withColumn("noise", F.when(F.col("__zone").isNotNull(), F.when(number, "page_number").when(repeated, F.col("__zone")))).drop("__zone", "__key", "__seen", "__least")


def same_size(a: Column, b: Column) -> Column:
    """Sizes that are equal for layout: scans measure each block a little differently."""
    return F.abs(a - b) <= F.greatest(F.lit(0.5), F.greatest(a, b) * 0.2)


def heading_levels(items: DataFrame, sizes: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc, size, level): the five largest sizes of short blocks clearly larger than the body.

    A block is as long as its joined lines, or as ``text`` if that is given.
    """
    text = joined_lines(F.col("lines")) if text is None else text
    short = items.join(sizes, "doc").where((F.col("kind") == "text") & (F.col("size") >= F.col("body") * HEADING_FACTOR))
    if "noise" in items.columns:
        short = short.where("noise is null")
    short = short.where((F.length(text) <= 160) & (F.size("lines") <= 3)).select("doc", "size").distinct()
    return short.withColumn("level", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("size")))).where("level <= 5")


def sidebars(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``side``: smaller, narrow text beside the body text, two blocks of it on a page at least."""
    rows = items.join(sizes, "doc")
    text = (F.col("kind") == "text") & (F.col("noise").isNull() if "noise" in items.columns else F.lit(True))
    main = rows.where(text & same_size(F.col("size"), F.col("body"))).groupBy("doc", "page").agg(F.collect_list(F.struct("x0", "x1")).alias("__main"))
    narrow = text & (F.col("size") < F.col("body")) & ~same_size(F.col("size"), F.col("body")) & (F.col("x1") - F.col("x0") < F.col("page_w") * 0.4) & ~F.array_join("lines", " ").rlike(CAPTION)
    rows = rows.join(main, ["doc", "page"], "left")
    beside = F.forall("__main", lambda m: (F.col("x0") >= m["x1"] - 2) | (F.col("x1") <= m["x0"] + 2))
    rows = rows.withColumn("__side", F.coalesce(narrow & F.col("__main").isNotNull() & beside, F.lit(False)))
    many = F.sum(F.col("__side").cast("int")).over(Window.partitionBy("doc", "page")) >= 2
    return rows.withColumn("side", F.col("__side") & many).drop("__side", "__main", "body")


def page_order(items: DataFrame) -> DataFrame:
    """Adds ``rank``, the reading order on a page.

    Sidebars come last. On a page with two columns of two narrow blocks at least, what
    is wide parts the page in bands, and a band is read column by column; other pages
    are read by lines.
    """
    w, width = F.col("page_w"), F.col("x1") - F.col("x0")
    narrow = width < w * 0.6
    left = narrow & (F.col("x1") <= w * 0.56) & (F.col("x0") < w * 0.4)
    right = narrow & (F.col("x0") >= w * 0.44)
    side = F.col("side") if "side" in items.columns else F.lit(False)
    rows = items.withColumn("__s", side.cast("int")).withColumn("__c", F.when(left, 0).when(right, 1))
    page = Window.partitionBy("doc", "page", "__s")
    count = lambda k: F.sum((F.col("__c") == k).cast("int")).over(page)
    rows = rows.withColumn("__two", (F.coalesce(count(0), F.lit(0)) >= 2) & (F.coalesce(count(1), F.lit(0)) >= 2) & (F.col("__s") == 0))
    down = page.orderBy("y0", "item").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__wide", F.sum(F.col("__c").isNull().cast("int")).over(down))
    band = F.when(F.col("__two"), F.col("__wide") * 2 - F.col("__c").isNull().cast("int")).otherwise(F.lit(0))
    column = F.when(F.col("__two"), F.coalesce("__c", F.lit(0))).otherwise(F.lit(0))
    line = F.when(F.col("__two") | (F.col("__s") == 1), F.col("y0")).otherwise(F.bround(F.col("y0") / 4))
    rank = F.row_number().over(Window.partitionBy("doc", "page").orderBy("__s", band, column, line, "x0", "item"))
    return rows.withColumn("rank", rank).drop("__s", "__c", "__two", "__wide")


def image_roles(items: DataFrame) -> DataFrame:
    """(doc, page, item, role, keep) of images: one on half the pages and three at least is a logo, kept once."""
    images = items.where("kind = 'image'")
    pages = items.groupBy("doc").agg(F.max("page").alias("__last"))
    on = images.groupBy("doc", "digest").agg(F.count_distinct("page").alias("__on")).join(pages, "doc")
    logo = F.col("__on") >= F.greatest(F.lit(3.0), (F.col("__last") + 1) / 2)
    first = F.row_number().over(Window.partitionBy("doc", "digest").orderBy("page", "item")) == 1
    rows = images.join(on, ["doc", "digest"])
    return rows.select("doc", "page", "item", F.when(logo, "logo").otherwise("photo").alias("role"), (~logo | first).alias("keep"))


def resolved_hyphens(elements: DataFrame) -> DataFrame:
    """``md`` with open hyphens decided: one stays if its document writes the word with a hyphen elsewhere and never without."""
    seen = elements.select("doc", F.explode(F.regexp_extract_all(F.lower(F.replace("md", F.lit(SOFT), F.lit(" "))), F.lit(r"(?U)\w+"), F.lit(0))).alias("w")).distinct()
    hyphened = elements.select("doc", F.explode(F.regexp_extract_all(F.lower("md"), F.lit(r"(?U)\w+-\w+"), F.lit(0))).alias("w")).distinct()
    pieces = elements.where(F.col("md").contains(SOFT)).select("doc", "pos", F.posexplode(F.regexp_extract_all("md", F.lit(rf"(?U)\w*{SOFT}\w*"), F.lit(0))).alias("k", "piece"))
    joined, kept = F.lower(F.replace("piece", F.lit(SOFT), F.lit(""))), F.lower(F.replace("piece", F.lit(SOFT), F.lit("-")))
    pieces = pieces.withColumn("__j", joined).withColumn("__k", kept)
    pieces = pieces.join(seen.select("doc", F.col("w").alias("__j"), F.lit(True).alias("__plain")), ["doc", "__j"], "left").join(hyphened.select("doc", F.col("w").alias("__k"), F.lit(True).alias("__hyphen")), ["doc", "__k"], "left")
    word = F.when(F.col("__hyphen") & F.col("__plain").isNull(), F.replace("piece", F.lit(SOFT), F.lit("-"))).otherwise(F.replace("piece", F.lit(SOFT), F.lit("")))
    choices = pieces.groupBy("doc", "pos").agg(F.collect_list(F.struct(F.col("piece").alias("a"), word.alias("b"))).alias("__w"))
    rows = elements.join(choices, ["doc", "pos"], "left")
    done = F.aggregate("__w", F.col("md"), lambda acc, x: F.replace(acc, x["a"], x["b"]))
    return rows.withColumn("md", F.when(F.col("__w").isNotNull(), done).otherwise(F.col("md"))).drop("__w")


def lost_initials(elements: DataFrame) -> DataFrame:
    """(doc, pos, letter): a paragraph behind a heading that lacks its first letter, which a picture showed.

    The first word, in capitals, occurs once; with one letter before it, it is a word
    used five times or more, and three times as often as with any other letter.
    """
    wd = reading_order()
    words = elements.select("doc", F.explode(F.regexp_extract_all(F.lower("md"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("doc", "w").agg(F.count("*").alias("n"))
    first = F.regexp_extract("md", r"^(\p{L}+)", 1)
    rows = elements.withColumn("__before", F.lag("type").over(wd)).where((F.col("type") == "paragraph") & (F.col("__before") == "heading")).select("doc", "pos", first.alias("word")).where("word <> '' and word = upper(word) and word <> lower(word)")
    rows = rows.withColumn("w", F.lower("word")).join(words, ["doc", "w"]).where("n <= 1").select("doc", "pos", "word")
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    tries = rows.select("doc", "pos", "word", F.explode(letters).alias("letter")).withColumn("w", F.lower(F.concat("letter", "word"))).join(words, ["doc", "w"])
    best = Window.partitionBy("doc", "pos").orderBy(F.desc("n"), F.desc("letter"))
    ranked = tries.withColumn("k", F.row_number().over(best)).withColumn("second", F.coalesce(F.lead("n").over(best), F.lit(0)))
    return ranked.where((F.col("k") == 1) & (F.col("n") >= 5) & (F.col("n") >= 3 * F.greatest("second", F.lit(1)))).select("doc", "pos", "letter")


def number_headings(elements: DataFrame) -> DataFrame:
    """Elements with a chapter number on its own line joined to the title behind it on the page."""
    wd = reading_order()
    bare = F.regexp_replace("md", r"^#{1,6}\s*", "")
    alone = (F.col("type") == "heading") & bare.rlike(r"^(\d{1,3}|[IVXLC]{1,7})$")
    rows = elements.withColumn("__bare", bare).withColumn("__n", alone & (F.lead("type").over(wd) == "heading") & F.lead("page").over(wd).eqNullSafe(F.col("page")))
    rows = rows.withColumn("__n", F.coalesce("__n", F.lit(False)))
    rows = rows.withColumn("__take", F.coalesce(F.lag("__n").over(wd), F.lit(False))).withColumn("__num", F.lag("__bare").over(wd)).withColumn("__level", F.lag("level").over(wd))
    level = F.least("level", "__level")
    md = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "__num", F.lit(" "), "__bare")
    return rows.withColumn("md", F.when(F.col("__take"), md).otherwise(F.col("md"))).withColumn("level", F.when(F.col("__take"), level).otherwise(F.col("level"))).where("not __n").drop("__bare", "__n", "__take", "__num", "__level")


def chapters(elements: DataFrame) -> DataFrame:
    """Elements of books with three chapter lines or more: these are the headings, earlier headings become paragraphs.

    Adds ``body``: the id of the first chapter line, null for other documents.
    """
    whole = Window.partitionBy("doc")
    title = F.regexp_replace("md", r"^#{1,6}\s*", "")
    mark = F.when(F.col("type") == "noise", None).when(title.rlike(CHAPTER), F.when(title.rlike(PART), "part").otherwise("chapter")).when(title.rlike(FRONT), "front")
    rows = elements.withColumn("__m", mark).withColumn("__t", title)
    rows = rows.withColumn("__book", F.sum(F.col("__m").isin("part", "chapter").cast("int")).over(whole) >= MIN_CHAPTERS)
    rows = rows.withColumn("__m", F.when(F.col("__book"), F.col("__m"))).withColumn("__parts", F.max(F.coalesce(F.col("__m") == "part", F.lit(False))).over(whole))
    rows = rows.withColumn("__first", F.min(F.when(F.col("__m").isNotNull(), F.struct("pos", "id"))).over(whole))
    level = F.when(F.col("__parts") & (F.col("__m") != "part"), 2).otherwise(1)
    demoted = F.coalesce((F.col("type") == "heading") & F.col("__m").isNull() & (F.col("pos") < F.col("__first.pos")), F.lit(False))
    marked = F.col("__m").isNotNull()
    out = rows.withColumn("__type", F.when(marked, "heading").when(demoted, "paragraph").otherwise(F.col("type")))
    out = out.withColumn("__level", F.when(marked, level).when(~demoted, F.col("level")))
    out = out.withColumn("md", F.when(marked, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "__t")).when(demoted, F.col("__t")).otherwise(F.col("md")))
    out = out.withColumn("type", F.col("__type")).withColumn("level", F.col("__level")).withColumn("body", F.col("__first.id"))
    return out.drop("__m", "__t", "__book", "__parts", "__first", "__type", "__level")


def section_number(text: Column) -> Column:
    """The number before a title that begins with a capital, empty if there is none."""
    return F.regexp_extract(text, r"^(\d+(?:\.\d+)*)\.?\s+(\p{Lu}.*)$", 1)


def fallback_headings(elements: DataFrame) -> DataFrame:
    """Short paragraphs in capitals, or with a section number, as headings: for texts without font sizes."""
    md, words = F.col("md"), F.size(F.split(strip(F.col("md")), r"\s+"))
    number = section_number(md)
    title_words = F.size(F.split(strip(F.regexp_extract("md", r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$", 2)), r"\s+"))
    letters = F.regexp_replace("md", r"[^\p{L}]", "")
    fits = (F.col("type") == "paragraph") & (F.length("md") <= 80) & ~md.contains("\n") & ~md.rlike(HEADING_END)
    numbered = (number != "") & (title_words <= 10)
    capitals = (F.length(letters) >= 3) & (letters == F.upper(letters)) & (letters != F.lower(letters)) & (words <= 10)
    level = F.when(fits & numbered, F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)).when(fits & capitals, 1)
    rows = elements.withColumn("__l", level)
    rows = rows.withColumn("md", F.when(F.col("__l").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("__l")), F.lit(" "), "md")).otherwise(F.col("md")))
    return rows.withColumn("type", F.when(F.col("__l").isNotNull(), "heading").otherwise(F.col("type"))).withColumn("level", F.coalesce("__l", "level")).drop("__l")


def merged_lists(elements: DataFrame, gap: float = 30.0) -> DataFrame:
    """(doc, page, pos, type, md, y0, y1): lists that follow each other closely on a page as one."""
    wd = Window.partitionBy("doc", "page").orderBy("pos")
    goes_on = (F.col("type") == "list") & (F.lag("type").over(wd) == "list") & (F.col("y0") - F.lag("y1").over(wd) <= gap)
    rows = elements.withColumn("__g", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(wd.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"])
    return rows.groupBy("doc", "page", "__g").agg(F.min("pos").alias("pos"), F.min_by("type", "pos").alias("type"), F.array_join(ordered, "\n").alias("md"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("__g")


def trailing_numbers(elements: DataFrame) -> DataFrame:
    """Elements with a number alone below all text of its page as noise: type and subtype."""
    page = Window.partitionBy("doc", "page")
    lowest = F.max(F.when(F.col("type") != "noise", F.struct("y1", "pos"))).over(page)
    others = F.array_max(F.transform(F.filter(F.collect_list(F.struct("pos", "y1", "type")).over(page), lambda o: (o["pos"] != F.col("pos")) & (o["type"] != "noise")), lambda o: o["y1"]))
    alone = (F.col("type") == "paragraph") & strip(F.col("md")).rlike(r"^\d{1,3}$") & (others <= F.col("y0") + 2) & lowest.isNotNull()
    rows = elements.withColumn("__a", F.coalesce(alone, F.lit(False)))
    subtype = F.col("subtype") if "subtype" in elements.columns else F.lit(None).cast("string")
    return rows.withColumn("subtype", F.when(F.col("__a"), "page_number").otherwise(subtype)).withColumn("type", F.when(F.col("__a"), "noise").otherwise(F.col("type"))).drop("__a")


def page_continuations(elements: DataFrame, indent_style: bool = False) -> DataFrame:
    """(doc, id, continues): paragraphs that go on with the last one of the page before, by stream.

    ``elements`` may have side (the stream), indented and full (the last line is full).
    """
    has = lambda c, other: F.col(c) if c in elements.columns else F.lit(other)
    rows = elements.where(~F.col("type").isin("noise", "caption", "image")).withColumn("__side", has("side", False)).withColumn("__in", has("indented", None).cast("boolean")).withColumn("__full", has("full", False))
    wd = Window.partitionBy("doc", "__side").orderBy("pos")
    for c in ("id", "type", "page", "md", "__full"):
        rows = rows.withColumn(f"__p_{c}", F.lag(c).over(wd))
    open_end = ~F.col("__p_md").rlike(SENTENCE_END) & (F.col("md").rlike(r"^\p{javaLowerCase}") | F.col("__p___full"))
    style = F.lit(indent_style) & F.col("__p___full") & F.coalesce(~F.col("__in"), F.lit(False))
    goes_on = (F.col("type") == "paragraph") & (F.col("__p_type") == "paragraph") & (F.col("page") == F.col("__p_page") + 1) & ~F.coalesce(F.col("__in"), F.lit(False)) & (open_end | style)
    return rows.where(goes_on).select("doc", "id", F.col("__p_id").alias("continues"))


def is_list(lines: Column) -> Column:
    """Whether a block's lines are list items.

    The first line and half of all have a marker, two if it is a dash. Markers that are
    letters must come in order, or be Roman numbers, and be two at least: a name such as
    "R. B. Smith" is no list.
    """
    marks = F.filter(F.transform(lines, lambda s: F.regexp_extract(s, BULLET, 1)), lambda m: m != "")
    letters = F.transform(F.filter(marks, lambda m: m.rlike(r"^\(?[a-zA-Z]{1,4}[.)]$")), lambda m: F.lower(F.regexp_replace(m, "[().]", "")))
    first = F.transform(letters, lambda m: F.ascii(m))
    enough = F.size(marks) >= F.greatest(F.lit(1), F.floor((F.size(lines) + 1) / 2))
    dash = (F.size(marks) < 2) & F.element_at(marks, 1).isin("–", "—", "-", "*")
    ordered = (F.size(letters) >= 2) & (F.forall(letters, lambda m: m.rlike("^[ivxlc]+$")) | (first == F.array_sort(first)))
    return F.element_at(lines, 1).rlike(BULLET) & enough & ~F.coalesce(dash, F.lit(False)) & ((F.size(letters) == 0) | (F.size(letters) != F.size(marks)) | ordered)


def list_text(lines: Column) -> Column:
    """The lines of a list as Markdown items; a line without a marker goes on with the item before it."""

    def step(acc, line):
        mark, rest = F.regexp_extract(line, BULLET, 1), F.trim(F.regexp_extract(line, BULLET, 2))
        number = F.regexp_extract(line, r"^\s*(\d{1,3})[.)]\s+", 1)
        item = F.when(number != "", F.concat(number, F.lit(". "), rest)).when(mark.rlike("^[a-zA-Z0-9(]"), F.concat(F.lit("- "), mark, F.lit(" "), rest)).otherwise(F.concat(F.lit("- "), rest))
        before = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        longer = F.concat(before, F.array(joined_lines(F.array(F.element_at(acc, -1), line))))
        return F.when(mark != "", F.concat(acc, F.array(item))).when(F.size(acc) > 0, longer).otherwise(F.array(F.concat(F.lit("- "), F.trim(line))))

    return F.array_join(F.aggregate(lines, F.array().cast("array<string>"), step), "\n")


def element_kinds(items: DataFrame, sizes: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc, page, item, type, subtype, level, md) of text items.

    ``items`` has noise; short blocks of a heading's size, or bold ones, are headings.
    """
    count = levels.groupBy("doc").agg(F.max("level").alias("__n"))
    rows = items.where("kind = 'text'").join(sizes, "doc").join(levels.withColumnRenamed("level", "__level"), ["doc", "size"], "left").join(count, "doc", "left")
    rows = rows.withColumn("__text", joined_lines(F.col("lines")))
    short = (F.length("__text") <= 160) & (F.size("lines") <= 3) & ~F.col("__text").rlike(HEADING_END)
    head = short & (F.col("__level").isNotNull() | (F.col("bold") & (F.col("size") >= F.col("body"))))
    level = F.coalesce("__level", F.least(F.lit(6), F.coalesce("__n", F.lit(0)) + 1))
    kind = F.when(F.col("noise").isNotNull(), "noise").when(head, "heading").when(is_list(F.col("lines")), "list").when(F.col("__text").rlike(CAPTION) & (F.length("__text") <= 300), "caption").otherwise("paragraph")
    rows = rows.withColumn("type", kind)
    md = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "__text")).when(F.col("type") == "list", list_text(F.col("lines"))).otherwise(F.col("__text"))
    return rows.select("doc", "page", "item", "type", F.when(F.col("type") == "noise", F.col("noise")).alias("subtype"), F.when(F.col("type") == "heading", level).alias("level"), md.alias("md"))


def scanned_pages(items: DataFrame) -> DataFrame:
    """(doc, page): pages of text over a picture of the whole page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    whole = F.max((F.col("kind") == "image") & (area > F.col("page_w") * F.col("page_h") * 0.8))
    return items.groupBy("doc", "page").agg(whole.alias("w"), F.max(F.col("kind") == "text").alias("t")).where("w and t").select("doc", "page")


def cleaned_scans(items: DataFrame) -> DataFrame:
    """Items without what a scan adds: on scanned pages, images with text on a third of them, and text without a letter or digit."""
    marked = items.join(scanned_pages(items).withColumn("__scan", F.lit(True)), ["doc", "page"], "left")
    texts = F.collect_list(F.when(F.col("kind") == "text", F.struct("x0", "y0", "x1", "y1"))).over(Window.partitionBy("doc", "page"))
    side = lambda a, b, c, d: F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0.0))
    rows = marked.withColumn("__t", texts)
    covered = F.aggregate("__t", F.lit(0.0), lambda acc, t: acc + side(F.col("x0"), F.col("x1"), t["x0"], t["x1"]) * side(F.col("y0"), F.col("y1"), t["y0"], t["y1"]))
    part = (F.col("kind") == "image") & (covered >= (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 0.3)
    bare = (F.col("kind") == "text") & ~F.array_join("lines", "").rlike(r"[\p{L}\p{N}]")
    return rows.where(~(F.coalesce(F.col("__scan"), F.lit(False)) & (part | bare))).drop("__scan", "__t")


def colon_lists(items: DataFrame) -> DataFrame:
    """Items with a list behind a colon split off: (doc, page, item, part, lines), part 1 being the list.

    ``line_x1`` gives the right end of each line: all but the last of the list's lines
    end clearly before the block's right margin.
    """
    n = F.size("lines")
    at = F.array_min(F.filter(F.transform("lines", lambda s, k: F.when(F.endswith(F.rtrim(s), F.lit(":")) & (k < n - 2), k + 1)), lambda k: k.isNotNull()))
    rows = items.withColumn("__k", at).withColumn("__rest", F.when(at.isNotNull(), F.slice("lines", at + 1, n - at))).withColumn("__x1", F.when(at.isNotNull(), F.slice("line_x1", at + 1, n - at)))
    inner = lambda c: F.slice(c, 1, F.size(c) - 1)
    right = F.array_max("line_x1")
    fits = F.forall(inner("__x1"), lambda x: x < right - F.col("size") * 3) & ~F.exists(inner("__rest"), lambda s: F.rtrim(s).rlike("[.!?]$")) & ~F.exists("__rest", lambda s: s.rlike(BULLET))
    rows = rows.withColumn("__fits", F.coalesce((F.col("kind") == "text") & F.col("__k").isNotNull() & fits, F.lit(False)))
    items_of = F.transform("__rest", lambda s: F.concat(F.lit("- "), F.trim(s)))
    parts = F.when(F.col("__fits"), F.array(F.slice("lines", 1, F.coalesce("__k", F.lit(1))), items_of)).otherwise(F.array("lines"))
    return rows.select("doc", "page", "item", F.posexplode(parts).alias("part", "lines"))


def text_tables(items: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """(doc, page, item, rows): neighbouring blocks with equal columns as one table, of two blocks and three rows at least.

    ``cells`` holds a block's rows as arrays of (x, text); null: no columns.
    """
    page = Window.partitionBy("doc", "page").orderBy("y0", "x0")
    first = lambda c: F.element_at(c, 1)
    before = F.lag("cells").over(page)
    rows = items.withColumn("__b", before)
    same = (F.size(first(F.col("__b"))) == F.size(first(F.col("cells")))) & F.forall(F.arrays_zip(first(F.col("__b")).alias("a"), first(F.col("cells")).alias("b")), lambda p: F.abs(p["a"]["x"] - p["b"]["x"]) <= tolerance)
    goes_on = F.col("cells").isNotNull() & F.col("__b").isNotNull() & F.coalesce(same, F.lit(False))
    rows = rows.withColumn("__run", F.sum((~goes_on).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0))).where("cells is not null")
    runs = rows.groupBy("doc", "page", "__run").agg(F.min_by("item", "y0").alias("item"), F.count("*").alias("__n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "cells"))), lambda x: x["cells"])).alias("__r"))
    return runs.where((F.col("__n") >= 2) & (F.size("__r") >= 3)).select("doc", "page", "item", F.transform("__r", lambda r: F.transform(r, lambda c: c["text"])).alias("rows"))
