"""Dropping rows of a table of texts without moving the texts that stay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.storage import materialize

#: Bits of a bitmap that becomes a literal (128 kB).
BITS = 1 << 20


def row_key() -> Column:
    """Names a row by its doc_id and text; only repeated rows share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or with underscores behind it where a column has it already, whatever the case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def bitmap_bytes(values: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of the values modulo ``bits``: bits / 32768 rows reach the driver, whatever the table."""
    b = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = values.select(b.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = bytearray(-(-bits // 32768) * 4096)
    for n, part in parts:
        out[(n - 1) * 4096 : n * 4096] = part
    return bytes(out)


def bit_test(bitmap: bytes, bits: int):
    """A function of a long column: whether its bit is set. The bitmap is folded to one literal."""
    longs = np.frombuffer(bitmap, np.int64)
    table = F.split(F.lit(",".join(map(str, longs.tolist()))), ",").cast("array<bigint>")

    def test(h: Column) -> Column:
        at = F.pmod(h, F.lit(bits))
        word = F.element_at(table, F.shiftright(at, 6).cast("int") + 1)
        return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def without_rows(docs: DataFrame, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` without the rows whose ``row_key()`` is among ``keys`` (key), a written table.

    Rows that a bitmap of the keys clears pass as they are; the others, the rows to
    drop and a few more, go through an exact anti-join.
    """
    keys = keys.select("key").distinct()
    keys = materialize(keys, "drop", keys.count())
    test = bit_test(bitmap_bytes(keys, "key", bits), bits)
    own = free_name("__key", docs.columns)
    keyed = docs.withColumn(own, row_key())
    clear = keyed.where(~test(F.col(own)))
    rest = keyed.where(test(F.col(own))).join(keys.withColumnRenamed("key", own), own, "left_anti")
    return clear.unionByName(rest).select(*docs.columns)


def one_row_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with one row of those that share a key of ``keys`` (key)."""
    if keys.isEmpty():
        return docs
    own = free_name("__key", docs.columns)
    keyed = docs.withColumn(own, row_key())
    keys = keys.select(F.col("key").alias(own)).distinct()
    once = keyed.join(keys, own, "left_semi").dropDuplicates([own])
    return keyed.join(keys, own, "left_anti").unionByName(once).select(*docs.columns)


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` by verdicts (key, kept), a written table, one for each row: of rows with one key, one at most stays."""
    each = verdicts.groupBy("key").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    each = materialize(each.where("not kept or rows > 1"), "verdicts", verdicts.count())
    return one_row_each(without_rows(docs, each.where("not kept")), each.where("kept"))
