"""Whole files as tables: load and save documents, cut them into chunks, check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions.authoring import fill, parse, render
from stratalith.operators import chunking, constraints
from stratalith.operators.chunking import changed_chunks, removed_chunks, retrieval_chunks
from stratalith.operators.filling import upgrade
from stratalith.operators.structure import ancestors, info_text
from stratalith.sources import jsonlines
from stratalith.sources.jsonlines import load_folder
from stratalith.sources.markdown import storage_text, write_texts

__all__ = ["ancestors", "changed_chunks", "check", "chunks", "fill", "folder_chunks", "info_text", "load", "load_folder", "parse", "removed_chunks", "render", "save", "upgrade"]


def load(spark: SparkSession, paths: str | list[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(headers, elements) of element files."""
    return jsonlines.read_documents(spark, paths, strict)


def save(lines: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Storage lines (path, line, value) as one file for each document, named by its path."""
    named = storage_text(lines).select(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), "text")
    write_texts(named, folder, "jsonl", "overwrite" if overwrite else "errorifexists")


def chunks(spark: SparkSession, paths: str | list[str], by: str = "element", max_chars: int = 0, front: bool = False) -> DataFrame:
    """The chunks of element files; see ``operators.chunking.chunks``."""
    headers, elements = load(spark, paths)
    one = elements.withColumn("reference", F.when(~F.col("reference_is_list"), F.col("reference")))
    return chunking.chunks(one, headers, by, max_chars, front)


def folder_chunks(spark: SparkSession, pattern: str, by: str = "section", max_chars: int = 0) -> DataFrame:
    """What a folder's documents give to search: files that break rules and second files of a document left out, heading chunks too."""
    headers, elements = load_folder(spark, pattern, jsonlines.check_documents(spark, pattern))
    one = elements.withColumn("reference", F.when(~F.col("reference_is_list"), F.col("reference")))
    return retrieval_chunks(chunking.chunks(one, headers, by, max_chars))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, file): the image files below ``folder``, named as documents beside them name them; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return found.where(F.col("path").contains("/images/")).select(F.regexp_extract("path", "^(.*)/images/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "(images/[^/]*)$", 1).alias("file"))


def check(spark: SparkSession, paths: str, images: str | None = None) -> DataFrame:
    """Violations (path, line, rule, message) in order; with the folder ``images`` also of image files that aren't there."""
    found = jsonlines.check_documents(spark, paths)
    if images is None:
        return found
    _, elements = load(spark, paths, strict=False)
    rows = elements.withColumn("doc", F.col("path")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    there = rows.select("doc", "folder").distinct().join(image_files(spark, images), "folder").select("doc", "file")
    lost = constraints.missing_files(rows, there).join(rows.select("doc", "pos", "line"), ["doc", "pos"])
    lost = lost.select(F.col("doc").alias("path"), "line", "rule", "message")
    return found.unionByName(lost).distinct().orderBy("path", "line", "rule", "message")


def numbered(violations: DataFrame) -> DataFrame:
    """Violations with ``n``, their place in a file's report."""
    return violations.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line", "rule", "message")))
