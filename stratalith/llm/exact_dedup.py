"""Exact dedup by progressive refinement.

Rows are grouped by the length of the normalised text, then by a hash of its
first characters, then by a hash of the whole text; the last is taken only of
rows whose (length, prefix hash) another row shares. Length groups are unions of
(length, prefix hash) groups, so both cheap levels go through one exchange of
narrow rows. Which rows survive them is handed to the second scan as a bitmap, with
``BITS_PER_KEY`` bits for each key that several rows share, from ``LEAST_BITS`` (128 kB)
to ``MOST_BITS`` (128 MB): a bit that two keys share only costs a hash that was not
needed, and so does a full bitmap. Texts are never shuffled.

Texts are equal when identical after lower-casing A-Z; a null text counts as an
empty one. Of equal texts the row with the largest doc_id stays, a null doc_id
being smaller than all others; of repeated rows (same doc_id, equal texts) one
stays. Texts of any length are hashed whole. An empty table gives an empty result; columns
besides doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.rowsets import bitmap_bytes, keep_rows, row_key
from stratalith.llm.textbytes import lean
from stratalith.storage import materialize

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
BITS_PER_KEY = 16
PREFIX_CHARS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, the key of the row, and its length and prefix hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    prefix = F.translate(F.substring(text, 1, PREFIX_CHARS), _UPPER, _LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("len"), F.xxhash64(prefix).alias("prefix"), row_key().alias("key"))


def bits_for(keys: int) -> int:
    """Bits of the bitmap of so many keys, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, BITS_PER_KEY * keys - 1).bit_length()))


def surviving_buckets(keyed: DataFrame) -> tuple[bytes, int]:
    """A bitmap with a set bit for each (length, prefix hash) that several rows share, and its size."""
    shared = keyed.groupBy("len", "prefix").count().where("count > 1")
    shared = materialize(shared.select(F.xxhash64("len", "prefix").alias("h")), "shared-keys")
    bits = bits_for(shared.count())
    return bitmap_bytes(shared, "h", bits), bits


def text_digests(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (unique), key, class_sha and text_sha256.

    class_sha is null for rows that the cheap levels prove single. text_sha256 is
    class_sha, or the hash of every text if ``digest_all``.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    bitmap, size = surviving_buckets(keyed)
    bits = spark.sparkContext.broadcast(bitmap)
    rows = keyed.select("doc_id", "text", F.pmod(F.xxhash64("len", "prefix"), F.lit(size)).alias("bit"), "key")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = bits.value
        for batch in batches:
            known, every = [], []
            for text, bit in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_numpy(), strict=True):
                repeated = shared[bit >> 3] >> (bit & 7) & 1
                sha = hashlib.sha256(text.as_py().lower()).hexdigest() if repeated or digest_all else None
                known.append(sha if repeated else None)
                every.append(sha)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.string()), pa.array(every, pa.string()), batch.column(3)], ["doc_id", "class_sha", "text_sha256", "key"])

    found = rows.mapInArrow(lean(digest), "doc_id long, class_sha string, text_sha256 string, key long")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "digests")


def exact_dedup(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """doc_id, row, key, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    rows = text_digests(docs, digest_all)
    groups = rows.where("class_sha is not null").groupBy("class_sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialize(groups, "groups", rows.count())  # an exchange of its own for the join, so that Spark can split a hot group
    shared = rows.where("class_sha is not null").join(groups, "class_sha", "left")
    single = rows.where("class_sha is null").select("*", F.lit(None).cast("struct<doc_id:long,row:long>").alias("keep"), F.lit(None).cast("long").alias("group_size"))
    both = shared.unionByName(single)
    return both.select(
        "doc_id",
        "row",
        "key",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest doc_id."""
    return keep_rows(docs, materialize(exact_dedup(docs).select("key", "kept"), "kept", docs.count()))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, digest_all=True).drop("row", "key")


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {
    "op4_exact_dedup": """
        with d as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents
        )
        select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
               row_number() over (partition by text_sha256 order by doc_id desc) = 1 as kept, text_sha256
        from d
    """
}
