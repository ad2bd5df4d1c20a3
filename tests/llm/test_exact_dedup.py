import hashlib

import oracle
from pyspark.sql import functions as F
from stratalith.llm import exact_dedup as D


def brute(rows):
    norm = lambda t: hashlib.sha256((t or "").encode().lower()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return groups, norm


def test_small_cases(spark):
    long = "Lorem Ipsum " * 20000
    rows = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, long), (7, long.upper()), (8, long + "x"), (9, "É"), (10, "é"), (11, "same"), (11, "same"), (None, "abc")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, keep_id string, kept int")
    got = D.exact_dedup(df, digest_all=True).collect()
    groups, norm = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_empty(spark):
    assert D.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of One text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = D.exact_dedup(df)
    assert got.where("kept").count() == 2001
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000


def test_sql(spark):
    oracle.compare(spark, "/root/testdata/sf0.01", D.op4_exact_dedup, D.ORACLES["op4_exact_dedup"])


def test_bitmap_grows_with_its_keys():
    assert D.bits_for(0) == D.bits_for(60_000) == 1 << 20
    assert D.bits_for(100_000) == 1 << 21 and D.bits_for(10**6) == 1 << 24 and D.bits_for(10**12) == 1 << 30
