"""Retrieval chunks by element or by section, their windows and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.model import ATTACHABLE, NEVER_EMBEDDED
from stratalith.operators.structure import ancestors, in_order, joined_hash, joined_units, page_range, sections
from stratalith.storage import materialize


def embeddable(elements: DataFrame) -> DataFrame:
    """Without the types that are never embedded."""
    return elements.where(~F.coalesce(F.col("type").isin(*NEVER_EMBEDDED), F.lit(False)))


def body_only(elements: DataFrame, body: Column | str = "body") -> DataFrame:
    """From a document's first element with the id ``body`` on; all of it where there is none."""
    body = F.col(body) if isinstance(body, str) else body
    start = F.min(F.when(F.col("id") == body, F.col("pos"))).over(Window.partitionBy("doc"))
    return elements.withColumn("__s", start).where("pos >= coalesce(__s, pos)").drop("__s")


def with_header(elements: DataFrame, headers: DataFrame) -> DataFrame:
    """An element's access groups, or its document's, or everyone; title and source of the document."""
    h = headers.select("doc", F.col("access").alias("__a"), *[c for c in ("title", "source") if c in headers.columns])
    return elements.join(h, "doc", "left").withColumn("access", F.coalesce("access", "__a", F.array(F.lit("all")))).drop("__a")


def chunk_text(path: Column, md: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n"), md)).otherwise(md)


def _attached(units: DataFrame) -> DataFrame:
    """(doc, id, target): captions and footnotes with the id of the unit that they refer to."""
    parts = units.select("doc", F.col("id").alias("target"), F.explode("part_ids").alias("reference"))
    notes = units.where(F.col("type").isin(*ATTACHABLE) & F.col("reference").isNotNull()).select("doc", "id", "reference")
    return notes.join(parts, ["doc", "reference"]).select("doc", "id", "target")


#: Fields that a chunk takes from its element and the element from its document, where there are any.
CARRIED = ("access", "title", "source", "file", "reference", "bbox")


def element_chunks(elements: DataFrame, rerooted: bool = False, every: DataFrame | None = None) -> DataFrame:
    """One chunk per element, with the captions and footnotes that refer to it.

    A note that refers to another note goes with neither, unless ``rerooted``, when it
    goes to the note's own target. ``elements``: doc, pos, id, type, level, md, page,
    hash, parent, reference (one id), continues; of ``CARRIED`` what it has goes along.
    ``every``: all elements, for the paths, where ``elements`` are some of them.
    """
    elements = materialize(elements, "elements")
    units = materialize(joined_units(embeddable(elements)), "units")
    links = _attached(units)
    if rerooted:
        onward = links.select("doc", F.col("id").alias("target"), F.col("target").alias("__t"))
        links = links.join(onward, ["doc", "target"], "left").select("doc", "id", F.coalesce("__t", "target").alias("target"))
    tied = units.join(links, ["doc", "id"], "left")
    carried = [c for c in CARRIED if c in units.columns]
    if "bbox" in carried:  # parts on several pages have no place in common
        tied = tied.withColumn("bbox", F.when(F.size("part_ids") == 1, F.col("bbox")))
    member = tied.withColumn("chunk", F.coalesce("target", "id")).withColumn("rank", F.when(F.col("target").isNull(), F.lit(-1)).otherwise(F.col("pos")))
    whole = member.groupBy("doc", "chunk").agg(
        F.max(F.col("target").isNull()).alias("anchored"),
        *[F.min_by(c, "rank").alias(c) for c in ("pos", "type", "page", "pages", "hash")],
        in_order("md", "rank").alias("texts"),
        F.flatten(in_order("part_ids", "rank")).alias("part_ids"),
        F.flatten(in_order("part_hashes", "rank")).alias("part_hashes"),
        *[F.min_by(c, "rank").alias(f"__{c}") for c in carried],
    )
    whole = whole.where("anchored")
    paths = ancestors(elements if every is None else every).withColumnRenamed("id", "chunk")
    whole = whole.join(paths, ["doc", "chunk"], "left")
    md = F.array_join("texts", "\n\n")
    several = F.size("part_ids") > 1
    return whole.select(
        "doc",
        F.col("chunk").alias("id"),
        "pos",
        "type",
        "page",
        "pages",
        F.when(several, F.col("part_ids")).alias("elements"),
        F.when(several, joined_hash(F.col("part_hashes"))).otherwise(F.col("hash")).alias("hash"),
        "path",
        md.alias("md"),
        chunk_text(F.col("path"), md).alias("text"),
        *[F.col(f"__{c}").alias(c) for c in carried],
    )


def _packed(max_chars: int) -> Column:
    """The part number of each member of a section, from the array ``m`` of (pos, head, n).

    A part is full when the next member would take it over ``max_chars``; a heading
    alone is never left behind.
    """
    first = F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("count"), F.lit(False).alias("only_head"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        full = (acc["count"] > 0) & (acc["size"] + x["n"] > max_chars) & ~acc["only_head"]
        part = F.when(full, acc["part"] + 1).otherwise(acc["part"])
        fresh = full | (acc["count"] == 0)
        return F.struct(
            part.alias("part"),
            (F.when(full, F.lit(0).cast("long")).otherwise(acc["size"]) + x["n"]).alias("size"),
            F.when(fresh, F.lit(1)).otherwise(acc["count"] + 1).alias("count"),
            (fresh & x["head"]).alias("only_head"),
            F.concat(acc["out"], F.array(part)).alias("out"),
        )

    return F.aggregate("m", first, step, lambda acc: acc["out"])


def section_chunks(elements: DataFrame, max_chars: int = 0, strict_access: bool = False, every: DataFrame | None = None) -> DataFrame:
    """One chunk per section, or several of at most ``max_chars`` characters where that can be.

    Of ``CARRIED`` all but the place go along, from the section's first element. With ``strict_access`` a section is also cut where the access groups change, so
    that no chunk shows a text to more readers than its element does.
    """
    elements = materialize(elements, "elements")
    units = sections(joined_units(embeddable(elements)))
    by = ["doc", "section"]
    if strict_access and "access" in units.columns:
        wd = Window.partitionBy("doc", "section").orderBy("pos")
        change = (~F.col("access").eqNullSafe(F.lag("access").over(wd)) & F.lag("id").over(wd).isNotNull()).cast("int")
        units = units.withColumn("__c", change).withColumn("zone", F.sum("__c").over(wd.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")
        by.append("zone")
    first = F.row_number().over(Window.partitionBy(*by).orderBy("pos")) == 1
    units = units.withColumn("head", first & (F.col("type") == "heading"))
    if max_chars:
        arrays = units.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "head", F.length("md").cast("long").alias("n")))).alias("m"))
        parts = arrays.withColumn("part", _packed(max_chars)).select(*by, F.explode(F.arrays_zip(F.col("m.pos").alias("pos"), F.col("part").alias("part"))).alias("x")).select(*by, "x.pos", "x.part")
        units = units.join(parts, [*by, "pos"])
    else:
        units = units.withColumn("part", F.lit(1))
    carried = [c for c in CARRIED if c in units.columns and c != "bbox"]
    chunks = units.groupBy(*by, "part").agg(
        F.min("pos").alias("pos"),
        F.min_by("id", "pos").alias("first_id"),
        F.min_by(F.when(F.col("head"), F.col("id")), "pos").alias("head_id"),
        F.flatten(in_order("part_ids")).alias("elements"),
        F.flatten(in_order("part_hashes")).alias("hashes"),
        F.flatten(in_order("part_pages")).alias("all_pages"),
        in_order("md").alias("texts"),
        *[F.min_by(c, "pos").alias(f"__{c}") for c in carried],
    )
    whole = Window.partitionBy(*by)
    chunks = chunks.withColumn("parts", F.max("part").over(whole)).withColumn("anchor", F.coalesce(F.max("head_id").over(whole), "first_id"))
    page, pages = page_range(F.col("all_pages"))
    paths = ancestors(elements if every is None else every).withColumnRenamed("id", "anchor")
    md = F.array_join("texts", "\n\n")
    chunks = chunks.join(paths, ["doc", "anchor"], "left")
    return chunks.select(
        "doc",
        F.when(F.col("parts") > 1, F.concat("anchor", F.lit("/"), F.col("part").cast("string"))).otherwise(F.col("anchor")).alias("id"),
        "pos",
        F.lit("section").alias("type"),
        page.alias("page"),
        pages.alias("pages"),
        "elements",
        joined_hash(F.col("hashes")).alias("hash"),
        "path",
        md.alias("md"),
        chunk_text(F.col("path"), md).alias("text"),
        *[F.col(f"__{c}").alias(c) for c in carried],
    )


def chunks(elements: DataFrame, headers: DataFrame, by: str = "element", max_chars: int = 0, front: bool = False) -> DataFrame:
    """The chunks of whole documents, ``by`` element or section, with the fields of their documents.

    Unless ``front``, a document begins at the element that its header's ``meta`` names
    under ``body``, or a key that ends so. Headings are found before that cut.
    """
    if by not in ("element", "section"):
        raise ValueError(f"chunks are made by element or section, not by {by}")
    h = headers.select("doc", *[F.col(c) if c in headers.columns else F.lit(None).cast("string").alias(c) for c in ("access", "title", "source", "meta")])
    key = F.try_element_at(F.filter(F.json_object_keys("meta"), lambda k: (k == "body") | F.endswith(k, F.lit(".body"))), F.lit(1))
    starts = h.where("meta is not null").select("doc", F.element_at(F.from_json("meta", "map<string,string>"), key).alias("__body"))
    every = materialize(with_header(elements, h), "elements")
    cut = every if front else body_only(every.join(starts, "doc", "left"), "__body").drop("__body")
    return section_chunks(cut, max_chars, every=every) if by == "section" else element_chunks(cut, every=every)


def retrieval_chunks(chunks_: DataFrame) -> DataFrame:
    """Without the chunks that are a heading only, whose title stands in the paths of others."""
    return chunks_.where("type <> 'heading'")


def changed_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """Chunks of ``new`` (id, hash) that are new or whose hash differs; of old chunks with one id the last (by pos) counts."""
    last = old.groupBy("id").agg(F.max_by("hash", "pos").alias("__h"))
    return new.join(last, "id", "left").where(~F.col("hash").eqNullSafe(F.col("__h"))).drop("__h")


def removed_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    return old.join(new.select("id"), "id", "left_anti")


def reembed_count(new: DataFrame, old: DataFrame, by: str = "md") -> DataFrame:
    """(to_embed): distinct blocks of ``new`` that ``old`` doesn't have."""
    return new.select(by).distinct().join(old.select(by).distinct(), by, "left_anti").agg(F.count("*").alias("to_embed"))


def fixed_windows(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``docs`` with (window, piece): the text in pieces of ``size`` characters."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda at: F.substr(F.col(text), at, F.lit(size)))
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(pieces).alias("window", "piece"))
