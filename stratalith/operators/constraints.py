"""Whole-document rules. Each is a table of violations (doc, pos, rule, message); pos 0 is the header's line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.columns import canonical_text, element_hash, id_number
from stratalith.model import ACCESS, CREATED, DATE, ELEMENT_REQUIRED, ELEMENT_TYPES, FILE, HEADER_REQUIRED, ID, LABEL, LANG, LINK, PROTECTIONS, SUBTYPES


def _bad(rows: DataFrame, condition: Column, rule: str, message: Column | str) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    return rows.where(condition).select("doc", "pos", F.lit(rule).alias("rule"), message.alias("message"))


def missing_fields(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Rows (doc, pos, keys) that lack a required key."""
    lost = F.array_except(F.array(*[F.lit(k) for k in required]), F.col("keys"))
    return rows.select("doc", "pos", F.explode(lost).alias("k")).select("doc", "pos", F.lit("required").alias("rule"), F.concat(F.lit("missing '"), "k", F.lit("'")).alias("message"))


def field_patterns(elements: DataFrame) -> DataFrame:
    """Values that don't have their field's form."""
    present = set(elements.columns)
    rules = [(f, F.col(f).isNotNull() & ~F.col(f).rlike(p)) for f, p in (("id", ID), ("hash", "^[0-9a-f]{16}$"), ("label", LABEL), ("parent", ID), ("continues", ID), ("lang", LANG), ("file", FILE)) if f in present]
    if "type" in present:
        rules.append(("type", F.col("type").isNotNull() & ~F.col("type").isin(*ELEMENT_TYPES)))
    if "level" in present:
        rules.append(("level", ~F.col("level").between(1, 6)))
    if "page" in present:
        rules.append(("page", F.col("page") < 0))
    if "confidence" in present:
        rules.append(("confidence", ~F.col("confidence").between(0, 1)))
    if "bbox" in present:
        rules.append(("bbox", F.col("bbox").isNotNull() & ((F.size("bbox") != 4) | F.exists("bbox", lambda v: (v < 0) | (v > 1000)))))
    if "access" in present:
        rules.append(("access", F.col("access").isNotNull() & ((F.size("access") == 0) | F.exists("access", lambda a: ~a.rlike(ACCESS)))))
    return reduce(DataFrame.unionByName, [_bad(elements, c, "pattern", f"{f} has not the form of its field") for f, c in rules])


def field_companions(elements: DataFrame) -> DataFrame:
    """Fields that need each other, or a type that they don't have."""
    has = lambda c: F.col(c).isNotNull() if c in elements.columns else F.lit(False)
    kind = F.col("type")
    sub = F.col("subtype") if "subtype" in elements.columns else F.lit(None).cast("string")
    rules = [
        (has("bbox") & ~has("page"), "bbox is allowed only together with page"),
        (has("page") & has("pages"), "page and pages exclude each other"),
        ((kind == "heading") & ~has("level"), "a heading needs a level"),
        ((kind == "formula") & ~has("latex"), "a formula needs latex"),
        ((kind == "image") & ~(has("file") & F.coalesce(sub.isin(*SUBTYPES["image"]), F.lit(False))), "an image needs a file and a subtype"),
        ((kind == "noise") & ~F.coalesce(sub.isin(*SUBTYPES["noise"]), F.lit(False)), "noise needs a subtype"),
        ((kind == "group") & ~F.coalesce(sub.isin(*SUBTYPES["group"]), F.lit(False)), "a group needs a subtype"),
        ((kind != "heading") & has("level"), "level is only for headings"),
        ((kind != "table") & has("html"), "html is only for tables"),
        ((kind != "formula") & has("latex"), "latex is only for formulas"),
        ((kind != "image") & has("file"), "file is only for images"),
        (~kind.isin("image", "noise", "group") & has("subtype"), "subtype is only for image, noise and group"),
    ]
    return reduce(DataFrame.unionByName, [_bad(elements, c, "companion", m) for c, m in rules])


def id_prefix(elements: DataFrame) -> DataFrame:
    return _bad(elements, F.col("id").rlike(ID) & ~F.startswith("id", F.concat("doc", F.lit("#"))), "prefix", F.concat(F.lit("id must start with "), "doc", F.lit("#")))


def duplicates(elements: DataFrame, column: str) -> DataFrame:
    """The second and later rows of a document with one value."""
    again = F.row_number().over(Window.partitionBy("doc", column).orderBy("pos"))
    return _bad(elements.where(F.col(column).isNotNull()).withColumn("__n", again), F.col("__n") > 1, f"duplicate_{column}", F.concat(F.lit(f"{column} "), column, F.lit(" is used twice")))


def id_beyond_last(elements: DataFrame, headers: DataFrame) -> DataFrame:
    joined = elements.join(headers.select("doc", "last_id"), "doc")
    return _bad(joined, id_number(F.col("id")) > F.col("last_id"), "last_id", "id number is higher than last_id in the header")


def reserved_labels(elements: DataFrame) -> DataFrame:
    return _bad(elements, F.col("label").isin("above", "below"), "reserved", F.concat(F.lit("label "), "label", F.lit(" is a reserved word")))


def single_reference_list(elements: DataFrame) -> DataFrame:
    """``reference_is_list`` with one reference only."""
    return _bad(elements, F.col("reference_is_list") & (F.size("reference") == 1), "reference_list", "a single reference must be a string")


def stored_text(elements: DataFrame) -> DataFrame:
    """Text that isn't canonical, hashes and lengths that aren't its own."""
    latex = F.col("latex") if "latex" in elements.columns else None
    plain = ~F.col("html").isNotNull() if "html" in elements.columns else F.lit(True)
    return reduce(
        DataFrame.unionByName,
        [
            _bad(elements, plain & (canonical_text(F.col("type"), F.col("md"), latex) != F.col("md")), "canonical", "md is not canonical"),
            _bad(elements, F.col("hash") != element_hash(F.col("type"), F.col("md")), "hash", "hash is wrong"),
            _bad(elements, F.col("characters") != F.length("md"), "characters", F.concat(F.lit("characters should be "), F.length("md").cast("string"))),
        ],
    )


def heading_level(elements: DataFrame) -> DataFrame:
    marks = F.length(F.regexp_extract("md", r"^(#{1,6})(?:[ \t]|$|\n)", 1))
    return _bad(elements, (F.col("type") == "heading") & (marks != F.col("level")), "level", "level does not match the marks")


def missing_files(elements: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose file isn't among ``files`` (doc, file)."""
    lost = elements.where((F.col("type") == "image") & F.col("file").isNotNull()).join(files.select("doc", "file"), ["doc", "file"], "left_anti")
    return _bad(lost, F.lit(True), "file", F.concat(F.lit("file "), "file", F.lit(" does not exist")))


def _targets(elements: DataFrame) -> DataFrame:
    """(doc, target, t_pos, t_type, t_level): of elements with one id the last."""
    last = elements.groupBy("doc", F.col("id").alias("target")).agg(F.max_by(F.struct("pos", "type", "level"), "pos").alias("x"))
    return last.select("doc", "target", F.col("x.pos").alias("t_pos"), F.col("x.type").alias("t_type"), F.col("x.level").alias("t_level"))


def parents(elements: DataFrame) -> DataFrame:
    """Parents that don't exist, come later, are no heading or group, or a heading of no smaller level."""
    own = elements.where("parent is not null")
    rows = own.join(_targets(elements).withColumnRenamed("target", "parent"), ["doc", "parent"], "left")
    heads = (F.col("type") == "heading") & (F.col("t_type") == "heading")
    message = (
        F.when(F.col("t_pos").isNull(), F.concat(F.lit("parent "), "parent", F.lit(" does not exist")))
        .when(F.col("t_pos") >= F.col("pos"), "parent must come before the element")
        .when(~F.col("t_type").isin("heading", "group"), "parent must be a heading or a group")
        .when(heads & (F.coalesce("t_level", F.lit(0)) >= F.coalesce("level", F.lit(0))), "a heading's parent must be a heading with a smaller level")
    )
    return _bad(rows.withColumn("__m", message), F.col("__m").isNotNull(), "parent", F.col("__m"))


def references(elements: DataFrame) -> DataFrame:
    """``reference`` (one id, or an array of ids) to elements that don't exist."""
    many = dict(elements.dtypes)["reference"].startswith("array")
    each = elements.select("doc", "pos", (F.explode("reference") if many else F.col("reference")).alias("target")).where("target is not null")
    lost = each.join(elements.select("doc", F.col("id").alias("target")).distinct(), ["doc", "target"], "left_anti")
    return _bad(lost, F.lit(True), "reference", F.concat(F.lit("reference "), "target", F.lit(" does not exist")))


def continuations(elements: DataFrame) -> DataFrame:
    rows = elements.where("continues is not null").join(_targets(elements).withColumnRenamed("target", "continues"), ["doc", "continues"], "left")
    message = F.when(F.col("t_pos").isNull() | (F.col("t_pos") >= F.col("pos")), "continues must point to an earlier element").when(F.col("t_type") != F.col("type"), "continues must point to an element of the same type")
    return _bad(rows.withColumn("__m", message), F.col("__m").isNotNull(), "continues", F.col("__m"))


def links(elements: DataFrame) -> DataFrame:
    """In-text links to no element or label; code is passed over."""
    text = F.regexp_replace("md", r"(?m)^ {0,3}(`{3,}|~{3,})[\s\S]*?^ {0,3}\1", "")
    text = F.regexp_replace(text, r"(`+)[\s\S]*?\1", "")
    each = elements.where("type <> 'code'").select("doc", "pos", F.explode(F.regexp_extract_all(text, F.lit(LINK), F.lit(1))).alias("target"))
    ids = elements.select("doc", F.substr(F.col("id"), F.length("doc") + 2).alias("target"))
    names = elements.where("label is not null").select("doc", F.col("label").alias("target"))
    lost = each.join(ids.union(names).distinct(), ["doc", "target"], "left_anti")
    return _bad(lost, F.lit(True), "link", F.concat(F.lit("link to #"), "target", F.lit(" points to no element or label")))


def element_count(elements: DataFrame, headers: DataFrame) -> DataFrame:
    """Headers whose ``elements`` isn't the number of elements, or is null: not finished."""
    counted = headers.select("doc", F.col("elements").alias("says")).join(elements.groupBy("doc").agg(F.count("*").alias("has")), "doc", "left").withColumn("has", F.coalesce("has", F.lit(0))).withColumn("pos", F.lit(0))
    message = F.when(F.col("says").isNull(), "elements is null: the file is not finished").when(F.col("says") != F.col("has"), F.concat(F.lit("elements says "), F.col("says").cast("string"), F.lit(" but the file has "), F.col("has").cast("string")))
    return _bad(counted.withColumn("__m", message), F.col("__m").isNotNull(), "count", F.col("__m"))


def header_rules(headers: DataFrame) -> DataFrame:
    """Header values that don't have their field's form. ``headers`` has ``keys``, the keys that are there."""
    h = headers.withColumn("pos", F.lit(0))
    forms = (("version", r"^[0-9]+\.[0-9]+$"), ("doc", "^[a-z0-9_-]+$"), ("source", "(?s)^.+$"), ("sha256", "^[0-9a-f]{64}$"), ("converter", "(?s)^.+$"), ("created", CREATED), ("lang", LANG), ("date", DATE))
    rules = [_bad(h, F.col(f).isNotNull() & ~F.col(f).rlike(p), "header", f"{f} has not the form of its field") for f, p in forms if f in h.columns]
    if "protection" in h.columns:
        rules.append(_bad(h, ~F.col("protection").isin(*PROTECTIONS), "header", "protection is none of its values"))
    if "access" in h.columns:
        rules.append(_bad(h, F.col("access").isNotNull() & ((F.size("access") == 0) | F.exists("access", lambda a: ~a.rlike(ACCESS))), "header", "access has not the form of its field"))
    if "keys" in h.columns:
        rules.append(missing_fields(h, HEADER_REQUIRED))
    return reduce(DataFrame.unionByName, rules)


def check_elements(elements: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """All rules that the columns of ``elements`` and ``headers`` allow, in one table."""
    has = set(elements.columns)
    found = [field_patterns(elements), field_companions(elements), id_prefix(elements), duplicates(elements, "id"), stored_text(elements), heading_level(elements)]
    if "keys" in has:
        found.append(missing_fields(elements, ELEMENT_REQUIRED))
    if "label" in has:
        found += [duplicates(elements, "label"), reserved_labels(elements), links(elements)]
    if "reference_is_list" in has:
        found.append(single_reference_list(elements))
    found += [rule(elements) for rule, c in ((parents, "parent"), (references, "reference"), (continuations, "continues")) if c in has]
    if headers is not None:
        found += [id_beyond_last(elements, headers), element_count(elements, headers), header_rules(headers)]
    return reduce(DataFrame.unionByName, found)


def report(violations: DataFrame) -> DataFrame:
    """In line order, repeated rows once."""
    return violations.distinct().orderBy("doc", "pos", "rule", "message")
