"""Authoring texts and element rows as tables: one document is one row, parsed in its task."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import authoring
from stratalith.functions.columns import slug
from stratalith.model import ELEMENT_SCHEMA, HEADER_SCHEMA


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, text): whole files, the document's name from the file's."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return files.select("path", slug(F.regexp_replace("file", r"\.[^.]*$", "")).alias("name"), "file", "text")


def parse_texts(texts: DataFrame) -> DataFrame:
    """(path, line, value, error, warnings): the storage lines of each authoring text (path, name, file, text).

    A text that can't be read has one row, with the error and no value.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, name, file, text in zip(frame["path"], frame["name"], frame["file"], frame["text"], strict=True):
                try:
                    rows, warnings = authoring.parse(text or "", name, file)
                except ValueError as e:
                    out.append((path, 0, None, str(e), []))
                else:
                    out += [(path, k + 1, authoring.dump(row), None, warnings if k == 0 else []) for k, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "line", "value", "error", "warnings"])

    return texts.select("path", "name", "file", "text").mapInPandas(run, "path string, line int, value string, error string, warnings array<string>")


def render_documents(lines: DataFrame) -> DataFrame:
    """(path, text): the authoring text of storage lines (path, line, value)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [json.loads(v) for v in frame.sort_values("line")["value"]]
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "text": [authoring.render(rows)]})

    return lines.select("path", "line", "value").groupBy("path").applyInPandas(run, "path string, text string")


def storage_text(lines: DataFrame) -> DataFrame:
    """(path, text): storage lines as the text of a file."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])
    return lines.groupBy("path").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("text"))


def as_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, elements) of storage lines."""
    headers = lines.where("line = 1").select("path", F.from_json("value", HEADER_SCHEMA).alias("h")).select("path", "h.*")
    els = lines.where("line > 1 and value is not null").select("path", (F.col("line") - 2).alias("pos"), F.from_json("value", ELEMENT_SCHEMA).alias("e")).select("path", "pos", "e.*")
    return headers, els.join(headers.select("path", "doc"), "path")


def write_texts(texts: DataFrame, folder: str, suffix: str, mode: str = "errorifexists") -> None:
    """Texts (name, text) as one file each: a folder ``name=...`` holds a document's file.

    An existing folder is an error unless ``mode`` says otherwise.
    """
    texts.select("name", F.regexp_replace("text", "\n$", "").alias("text")).write.mode(mode).partitionBy("name").option("lineSep", "\n").text(f"{folder}/{suffix.strip('.')}")
