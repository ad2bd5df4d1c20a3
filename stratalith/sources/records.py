"""Tables, mails and subtitles as elements."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_string
from email.policy import default

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions.columns import element_hash, slug


def _finished(rows: DataFrame) -> DataFrame:
    """Elements of rows (doc, order columns as ``o``, type, md)."""
    pos = F.row_number().over(Window.partitionBy("doc").orderBy("o")) - 1
    out = rows.withColumn("pos", pos).drop("o")
    return out.select("doc", "pos", F.concat("doc", F.lit("#e"), F.col("pos") + 1).alias("id"), "type", "md", element_hash(F.col("type"), F.col("md")).alias("hash"), F.length("md").cast("long").alias("characters"))


def record_rows(table: DataFrame, doc: str, order: Column | None = None) -> DataFrame:
    """Each row of ``table`` as a record, a line ``Name: value`` per column; nulls are left out.

    Without ``order`` rows stand in the order in which they are read.
    """
    lines = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in table.columns]
    order = order if order is not None else F.monotonically_increasing_id()
    return _finished(table.select(F.lit(doc).alias("doc"), order.alias("o"), F.lit("record").alias("type"), F.concat_ws("\n", *lines).alias("md")))


def read_csv(spark: SparkSession, path: str, doc: str) -> DataFrame:
    """A CSV file's rows as records."""
    return record_rows(spark.read.option("header", True).csv(path), doc)


def read_json(spark: SparkSession, path: str, doc: str) -> DataFrame:
    """A JSON Lines file's objects as records."""
    return record_rows(spark.read.json(path), doc)


def read_mails(spark: SparkSession, paths: str) -> DataFrame:
    """Mail files as messages, sender and subject on top."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, value in zip(frame["path"], frame["value"], strict=True):
                mail = message_from_string(value, policy=default)
                body = mail.get_body(("plain", "html"))
                text = body.get_content().strip() if body is not None else ""
                out.append((path, f"**{mail.get('from', '')}**\n\n{mail.get('subject', '')}\n\n{text}".strip()))
            yield pd.DataFrame(out, columns=["path", "md"])

    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    mails = files.mapInPandas(run, "path string, md string")
    name = slug(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    return _finished(mails.select(name.alias("doc"), F.col("path").alias("o"), F.lit("message").alias("type"), "md"))


def read_subtitles(spark: SparkSession, paths: str) -> DataFrame:
    """Subtitle files as utterances: the blocks between blank lines, without number and time."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    name = slug(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    cues = files.select(name.alias("doc"), F.posexplode(F.split("value", r"\n[ \t]*\n", -1)).alias("o", "cue"))
    text = F.regexp_extract("cue", r"(?s)[0-9:,.]+ --> [0-9:,.]+[^\n]*\n(.*)$", 1)
    return _finished(cues.select("doc", "o", F.lit("utterance").alias("type"), F.trim(F.regexp_replace(text, r"\s+$", "")).alias("md")).where("md <> ''"))
