from pyspark.sql import functions as F
from stratalith.llm import rowsets as R
from stratalith.storage import materialize


def test_bitmap_never_clears_a_member(spark):
    keys = spark.range(0, 500).select((F.xxhash64("id")).alias("key"))
    test = R.bit_test(R.bitmap_bytes(keys, "key", 1 << 15), 1 << 15)
    assert keys.where(~test(F.col("key"))).isEmpty()
    other = spark.range(10**6, 10**6 + 2000).select(F.xxhash64("id").alias("key"))
    assert other.where(test(F.col("key"))).count() < 200


def test_without_rows_and_one_row_each(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, None, "y"), (None, "c", None), (3, "d", "z")], "doc_id long, text string, key string")
    keyed = docs.withColumn("k", R.row_key())
    drop = materialize(keyed.where("doc_id is null or text = 'd'").select(F.col("k").alias("key")), "t")
    left = R.without_rows(docs, drop)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=repr) == sorted([(1, "a", "x"), (1, "a", "x"), (2, None, "y")], key=repr)
    verdicts = materialize(keyed.select(F.col("k").alias("key"), (F.coalesce("doc_id", F.lit(0)) < 3).alias("kept")), "t")
    assert sorted((r.doc_id, r.text) for r in R.keep_rows(docs, verdicts).where("doc_id is not null").collect()) == [(1, "a"), (2, None)]
