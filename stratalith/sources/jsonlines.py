"""Element files: one JSON object a line, the document's header first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.model import ELEMENT_SCHEMA, HEADER_SCHEMA
from stratalith.storage import materialize


def file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, value), lines numbered from 1. A file is a row of the scan, so numbers are exact."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n", -1)).alias("k", "value")).select("path", (F.col("k") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def _not_object(value: Column) -> Column:
    return F.try_parse_json(value).isNull() | ~F.startswith(F.trim(value), F.lit("{"))


def json_rows(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(path, line, value, keys, type) of the lines that hold an object; blank ones are passed over.

    With ``strict`` any other line is an error that names it; otherwise it is left out.
    """
    rows = lines.where("trim(value) <> ''")
    bad = _not_object(F.col("value"))
    if strict:
        message = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": not one JSON object"))
        rows = rows.withColumn("value", F.when((F.trim("value") != "") & bad, F.raise_error(message).cast("string")).otherwise(F.col("value")))
    else:
        rows = rows.where(~bad)
    return rows.withColumn("keys", F.json_object_keys("value")).withColumn("type", F.get_json_object("value", "$.type"))


def read_documents(spark: SparkSession, paths: str | list[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(headers, elements) of element files.

    ``keys`` lists the keys that a row has, which tells a missing parent from a null one;
    ``references`` is reference as an array, whether it was written as a string or a list.
    """
    rows = json_rows(file_lines(spark, paths), strict)
    first = F.row_number().over(Window.partitionBy("path").orderBy("line")) == 1
    rows = rows.withColumn("first", first)
    headers = rows.where("first and type = 'document'").select("path", "line", "keys", F.from_json("value", HEADER_SCHEMA).alias("h")).select("path", "line", "keys", "h.*")
    els = rows.where("type <> 'document' or type is null").select("path", "line", "keys", F.from_json("value", ELEMENT_SCHEMA).alias("e")).select("path", "line", "keys", "e.*")
    listed = F.startswith("reference", F.lit("["))
    els = els.withColumn("reference_is_list", F.coalesce(listed, F.lit(False))).withColumn("references", F.when(listed, F.from_json("reference", "array<string>")).when(F.col("reference").isNotNull(), F.array("reference")))
    els = els.join(headers.select("path", "doc"), "path", "left").withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1)
    return headers, els.withColumn("parent_known", F.array_contains("keys", "parent"))


def load_folder(spark: SparkSession, pattern: str, violations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents of a folder: files with violations are left out, and of two files with one document the first by name stays."""
    headers, elements = read_documents(spark, pattern, strict=False)
    if violations is not None:
        headers = headers.join(violations.select("path").distinct(), "path", "left_anti")
    once = F.row_number().over(Window.partitionBy("doc").orderBy("path"))
    headers = headers.withColumn("__n", once).where("__n = 1").drop("__n")
    return headers, elements.join(headers.select("path"), "path", "left_semi")


def check_files(spark: SparkSession, paths: str) -> DataFrame:
    """(path, line, rule, message): what is wrong with files as such, before any rule about their rows."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    files = files.select("path", text.alias("text"))
    mark = "﻿"
    bare = F.when(F.startswith("text", F.lit(mark)), F.substr(F.col("text"), F.lit(2))).otherwise(F.col("text"))
    files = files.withColumn("bom", F.startswith("text", F.lit(mark))).withColumn("text", bare)
    plain = F.regexp_replace("text", "\r\n?", "\n")
    first_cr = F.regexp_count(F.substring_index("text", "\r", 1), F.lit("\n")) + 1
    last = F.regexp_count(plain, F.lit("\n")) + 1

    def rule(name: str, condition: Column, line: Column, message: str) -> DataFrame:
        return files.where(condition).select("path", line.cast("int").alias("line"), F.lit(name).alias("rule"), F.lit(message).alias("message"))

    found = rule("utf8", F.col("text").isNull(), F.lit(1), "the file is not UTF-8")
    found = found.union(rule("bom", F.col("bom"), F.lit(1), "remove the byte-order mark at the start of the file"))
    found = found.union(rule("line_end", F.col("text").contains("\r"), first_cr, "lines must end with a newline only"))
    found = found.union(rule("last_line", (F.col("text") != "") & ~F.endswith(plain, F.lit("\n")), last, "the last line must end with a newline"))
    lines = files.where("text is not null").select("path", F.posexplode(F.split(F.regexp_replace(plain, "\n$", ""), "\n", -1)).alias("k", "value")).select("path", (F.col("k") + 1).alias("line"), "value")
    blank = F.trim("value") == ""
    found = found.union(lines.where(blank & ~((F.col("line") == 1) & (F.col("value") == ""))).select("path", "line", F.lit("empty"), F.lit("empty line")))
    found = found.union(lines.where(~blank & _not_object(F.col("value"))).select("path", "line", F.lit("json"), F.lit("not one JSON object")))
    valid = lines.where(~blank & ~_not_object(F.col("value"))).select("path").distinct()
    found = found.union(files.where("text is not null").join(valid, "path", "left_anti").select("path", F.lit(1), F.lit("no_rows"), F.lit("file has no valid lines")))
    return found


def check_documents(spark: SparkSession, paths: str) -> DataFrame:
    """All violations of element files (path, line, rule, message), in order of path and line."""
    from stratalith.operators import constraints as R

    headers, elements = read_documents(spark, paths, strict=False)
    doc = F.coalesce("doc", F.lit(""))
    # some twenty rules read the rows; the files are read and parsed once
    rows = materialize(elements.withColumn("document", doc).withColumn("doc", F.col("path")).drop("reference").withColumnRenamed("references", "reference"), "checked-rows")
    heads = materialize(headers.withColumn("document", doc).withColumn("doc_name", F.col("doc")).withColumn("doc", F.col("path")), "checked-headers")
    # ids are compared inside a file: the path stands in for the document
    found = [R.field_patterns(rows), R.field_companions(rows), R.missing_fields(rows, R.ELEMENT_REQUIRED), R.duplicates(rows, "id"), R.duplicates(rows, "label"), R.reserved_labels(rows)]
    found += [R.single_reference_list(rows), R.stored_text(rows), R.heading_level(rows), R.parents(rows), R.references(rows), R.continuations(rows), R.id_beyond_last(rows, heads), R.element_count(rows, heads)]
    found.append(R.header_rules(heads.withColumn("doc", F.col("doc_name"))).join(heads.select(F.col("doc_name").alias("doc"), "path"), "doc").select(F.col("path").alias("doc"), "pos", "rule", "message").withColumn("pos", F.lit(-1)))
    named = rows.withColumn("__links", F.lit(True))
    ids = named.withColumn("id", F.concat("doc", F.lit("#"), F.substring_index("id", "#", -1)))
    found.append(R.links(ids))
    prefix = rows.where(F.col("id").rlike(R.ID) & ~F.startswith("id", F.concat("document", F.lit("#")))).select("doc", "pos", F.lit("prefix").alias("rule"), F.lit("id must start with the document's name").alias("message"))
    found.append(prefix)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    every = every.withColumn("pos", F.when(F.col("rule") == "count", -1).otherwise(F.col("pos")))
    at = rows.select("doc", "pos", "line").union(heads.select("doc", F.lit(-1).alias("pos"), "line"))
    lined = every.join(at, ["doc", "pos"], "left").select(F.col("doc").alias("path"), F.coalesce("line", F.lit(1)).alias("line"), "rule", "message")
    first = json_rows(file_lines(spark, paths)).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line")))
    order = first.where("(n = 1) <> coalesce(type = 'document', false)")
    message = F.when(F.col("n") == 1, "line 1 must be the header").otherwise("only line 1 may be a header")
    lined = lined.union(order.select("path", "line", F.lit("header_line"), message))
    files = check_files(spark, paths)
    return lined.union(files).distinct().orderBy("path", "line", "rule", "message")


def lines_of_type(lines: DataFrame, kind: str) -> DataFrame:
    """Lines (path, line, value) of elements of one type: a plain search goes before any decoding."""
    return lines.where(F.col("value").contains(f'"type":"{kind}"')).where(F.get_json_object("value", "$.type") == kind)


def first_of_type(lines: DataFrame, kind: str) -> DataFrame:
    """The first such line of each file."""
    hits = lines_of_type(lines, kind)
    return hits.groupBy("path").agg(F.min_by("value", "line").alias("value"), F.min("line").alias("line"))
