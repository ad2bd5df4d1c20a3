"""Chunks of documents that arrive in a folder, re-embedded only where they changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalith.model import ELEMENT_SCHEMA
from stratalith.operators.chunking import changed_chunks, removed_chunks, section_chunks
from stratalith.storage import materialize


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, arrived, value): element files as they arrive. A file is a whole document, so nothing can be late."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"), "value")


def documents_of(files: DataFrame) -> DataFrame:
    """(doc): the documents that whole files (path, value) hold, without elements too."""
    first = F.regexp_extract("value", r"^\s*([^\n]*)", 1)
    return files.select(F.get_json_object(first, "$.doc").alias("doc")).where("doc is not null").distinct()


def elements_of(files: DataFrame) -> DataFrame:
    """Elements (doc, pos, ...) of whole files (path, value), for a batch."""
    lines = files.select("path", F.posexplode(F.split("value", "\n", -1)).alias("line", "value")).where("trim(value) <> ''")
    rows = lines.withColumn("type", F.get_json_object("value", "$.type"))
    docs = rows.where("type = 'document'").select("path", F.get_json_object("value", "$.doc").alias("doc"))
    els = rows.where("type <> 'document'").select("path", "line", F.from_json("value", ELEMENT_SCHEMA).alias("e")).select("path", F.col("line").alias("pos"), "e.*")
    return els.join(docs, "path")


STATE = "doc string, id string, hash string, pos int, v int"


def read_state(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(doc, id, hash, pos) of the chunks of each document as they were in its last batch before ``version``."""
    try:
        rows = spark.read.schema(STATE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STATE)
    rows = rows.where(F.col("v") <= version)
    last = rows.groupBy("doc").agg(F.max("v").alias("v"))
    return rows.join(last, ["doc", "v"], "left_semi").where("id is not null").select("doc", "id", "hash", "pos")


def apply_batch(files: DataFrame, state: str, version: int, embed: Callable[[DataFrame], None], max_chars: int = 0, remove: Callable[[DataFrame], None] | None = None) -> None:
    """Chunks a batch's documents, hands the new and changed chunks to ``embed`` and those that are gone to ``remove``.

    Only the batch's documents are written, under its version, with a row without an id
    for each, so that a document without chunks is known too. A batch that is run again
    after a lost driver reads the same state, gives the same result and writes over its own.
    """
    spark = files.sparkSession
    elements = materialize(elements_of(files), "batch")
    chunks = materialize(section_chunks(elements, max_chars=max_chars).select("doc", "id", "hash", "pos", "text"), "batch-chunks")
    docs = documents_of(files)
    old = materialize(read_state(spark, state, version).join(docs, "doc", "left_semi"), "batch-state")
    embed(changed_chunks(chunks, old.select("id", "hash", "pos")))
    if remove is not None:
        remove(removed_chunks(chunks, old.select("doc", "id")))
    marks = docs.select("doc", *[F.lit(None).cast(kind).alias(c) for c, kind in (("id", "string"), ("hash", "string"), ("pos", "int"))])
    marks.unionByName(chunks.select("doc", "id", "hash", F.col("pos").cast("int").alias("pos"))).write.mode("overwrite").parquet(f"{state}/v={version + 1}")


def follow(spark: SparkSession, folder: str, state: str, checkpoint: str, embed: Callable[[DataFrame], None], max_chars: int = 0, available_now: bool = True, remove: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Starts a query that keeps the chunks of ``folder`` embedded."""

    def batch(files: DataFrame, number: int) -> None:
        latest = files.groupBy("path").agg(F.max_by("value", "arrived").alias("value"))
        apply_batch(latest, state, number, embed, max_chars, remove)

    writer = document_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_windows(events: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by time window, tumbling or sliding, over a batch or a stream; rows later than ``late`` are passed over in a stream."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    timed = events.withWatermark(time, late) if events.isStreaming else events
    counted = timed.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
