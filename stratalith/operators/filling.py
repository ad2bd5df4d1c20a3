"""Completing rows: ids, levels, canonical text, hashes, parents and header fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.columns import canonical_text, element_hash, id_number, strip, strip_dollars
from stratalith.model import ELEMENT_TYPES, ID, KNOWN_VERSIONS, VERSION
from stratalith.operators.structure import default_parent, in_order


def header_rollup(elements: DataFrame) -> DataFrame:
    """(doc, sha256, elements, structure, last_id) as the elements have them."""
    return elements.groupBy("doc").agg(
        F.sha2(F.array_join(in_order(F.concat("type", F.lit("\n"), "md", F.lit("\n"))), ""), 256).alias("sha256"),
        F.count("*").alias("elements"),
        F.max(F.col("type") == "heading").alias("structure"),
        F.max(id_number(F.col("id"))).alias("last_id"),
    )


def new_ids(elements: DataFrame, headers: DataFrame) -> DataFrame:
    """Elements without a valid id get numbers beyond all that are used, in reading order."""
    valid = F.coalesce(F.col("id").rlike(ID), F.lit(False))
    used = F.max(F.when(valid, id_number(F.col("id")))).over(Window.partitionBy("doc"))
    nth = F.sum((~valid).cast("int")).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = elements.join(headers.select("doc", F.col("last_id").alias("__last")), "doc", "left")
    base = F.greatest(F.coalesce("__last", F.lit(0)), F.coalesce(used, F.lit(0)))
    return rows.withColumn("id", F.when(valid, F.col("id")).otherwise(F.concat("doc", F.lit("#e"), (base + nth).cast("string")))).drop("__last")


def fill(elements: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, headers) with every field that follows from others.

    ``elements``: doc, pos, id, type, level, md; latex and html where there are any.
    ``parent_known`` says that a parent (null too) was given; otherwise the default
    parent is taken, from headings only.
    """
    rows = new_ids(elements, headers)
    kind = F.when(F.col("type").isin(*ELEMENT_TYPES), F.col("type")).otherwise("paragraph")
    rows = rows.withColumn("type", kind).withColumn("md", F.coalesce("md", F.lit("")))
    marks = F.length(F.regexp_extract("md", r"^(#{1,6})(?:[ \t]|$|\n)", 1))
    heading = F.col("type") == "heading"
    rows = rows.withColumn("level", F.when(heading, F.coalesce("level", F.when(marks > 0, marks), F.lit(1))).otherwise(F.col("level")))
    rows = rows.withColumn("md", F.when(heading & (marks == 0), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), strip(F.col("md")))).otherwise(F.col("md")))
    latex = F.coalesce("latex", F.when(F.col("type") == "formula", strip_dollars(F.col("md")))) if "latex" in rows.columns else F.when(F.col("type") == "formula", strip_dollars(F.col("md")))
    rows = rows.withColumn("latex", latex)
    rows = rows.withColumn("md", canonical_text(F.col("type"), F.col("md"), F.col("latex")))
    if "parent" in rows.columns:
        known = F.coalesce("parent_known", F.lit(False)) if "parent_known" in rows.columns else F.col("parent").isNotNull()
        rows = rows.withColumn("__p", F.col("parent")).withColumn("__k", known)
        rows = default_parent(rows).withColumn("parent", F.when(F.col("__k"), F.col("__p")).otherwise(F.col("parent"))).drop("__p", "__k")
    else:
        rows = default_parent(rows)
    rows = rows.withColumn("hash", element_hash(F.col("type"), F.col("md"))).withColumn("characters", F.length("md").cast("long"))
    rolled = header_rollup(rows).select("doc", *[F.col(c).alias(f"__{c}") for c in ("sha256", "elements", "structure", "last_id")])
    h = headers.join(rolled, "doc", "left")
    defaults = {"version": F.lit(VERSION), "source": F.concat("doc", F.lit(".md")), "protection": F.lit("none"), "signed": F.lit(False), "lang": F.lit("en"), "access": F.array(F.lit("all"))}
    for name, value in defaults.items():
        h = h.withColumn(name, F.coalesce(name, value) if name in h.columns else value)
    h = h.withColumn("sha256", F.coalesce("sha256", "__sha256") if "sha256" in h.columns else F.col("__sha256"))
    own = F.coalesce("structure", F.lit(False)) if "structure" in h.columns else F.lit(False)
    h = h.withColumn("structure", own | F.coalesce("__structure", F.lit(False))).withColumn("elements", F.coalesce("__elements", F.lit(0)))
    h = h.withColumn("last_id", F.greatest(F.coalesce("last_id", F.lit(0)), F.coalesce("__last_id", F.lit(0))))
    return rows, h.drop("__sha256", "__elements", "__structure", "__last_id")


def upgrade(elements: DataFrame, headers: DataFrame, converter: str = "stratalith") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, headers, changes by document): rows of any known version, filled anew.

    A header with an unknown version raises an error when its row is read.
    """
    known = F.col("version").isNull() | F.col("version").isin(*KNOWN_VERSIONS)
    version = F.when(known, F.lit(VERSION)).otherwise(F.raise_error(F.concat(F.lit("cannot upgrade version "), "version")).cast("string"))
    by = F.when(F.col("version").eqNullSafe(VERSION), F.col("converter")).otherwise(F.concat(F.coalesce("converter", F.lit("unknown")), F.lit(f"; upgraded by {converter}")))
    before = elements.select("doc", "id", F.col("hash").alias("__before"))
    rows, h = fill(elements.drop("hash", "characters"), headers.withColumn("converter", by).withColumn("version", version))
    changed = rows.join(before, ["doc", "id"], "left").where(~F.col("hash").eqNullSafe(F.col("__before"))).groupBy("doc").agg(F.count("*").alias("changed"))
    return rows, h, changed
