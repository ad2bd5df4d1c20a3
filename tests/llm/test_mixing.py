import random

import oracle
from stratalith.llm import mixing as M


def waterfill(sizes, weights=(5, 2, 1), share=1.5, top=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > top * sizes[s]}
        if not over:
            target.update({s: w[s] * unit for s in open_})
            break
        for s in over:
            target[s] = top * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def corpus(spark, weight=False):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None, "d"])
        text = None if i % 97 == 0 else " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((i if i % 89 else None, text, source, rng.choice([0.5, 1.0, 4.0])))
    rows += rows[:5]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, w double")


def test_targets_and_taken(spark):
    rows, df = corpus(spark)
    got = M.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = sorted(round(x, 6) for x in waterfill(sizes).values())
    assert sorted({round(r.target, 6) for r in got}) == sorted(set(want))
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken.setdefault((r.target, r.source_size), []).append(r.taken)
    for (target, _), each in taken.items():
        assert abs(sum(each) - target) <= 1
    again = M.mix_sources(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_unequal_probabilities(spark):
    rows, df = corpus(spark)
    got = M.mix_sources(df, weight="w", share=0.1).collect()
    by = {}
    for r in got:
        by.setdefault((r.target, r.source_size), []).append(r.taken)
    for (target, _), each in by.items():
        assert abs(sum(each) - target) <= 1
    shares = {}
    w = {i: x for i, _, _, x in rows if i is not None}
    for r in got:
        if r.doc_id is not None and r.size:
            shares.setdefault(w[r.doc_id], []).append(r.taken / r.size)
    mean = {k: sum(v) / len(v) for k, v in shares.items()}
    assert mean[0.5] < mean[1.0] < mean[4.0]


def test_empty(spark):
    assert M.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_sql(spark):
    oracle.compare(spark, "/root/testdata/sf0.01", M.op1_mix_sources, M.ORACLES["op1_mix_sources"])


def test_mixed_documents_follow_the_plan(spark):
    import random

    rng = random.Random(6)
    rows = [(k, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "a", "a", "b", "c", None]), k, "own", "KEY") for k in range(400)]
    rows += [rows[7], (None, "one two", "b", 0, "x", None), (900, None, "a", 1, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_taken long, __key string, __Size string")
    named = df.select(M.row_key().alias("doc_id"), "source", "text")
    plan = {}
    for r in M.mix_sources(named).collect():
        plan[r.doc_id] = max(plan.get(r.doc_id, 0), r.taken)
    out = M.mixed_documents(df)
    assert out.columns[:6] == df.columns and out.columns[6:] == ["mix_taken_", "mix_whole_copies", "mix_size", "mix_target"]
    got = out.withColumn("k", M.row_key()).collect()
    assert {r.k: r.mix_taken_ for r in got} == {k: v for k, v in plan.items() if v > 0}
    assert len(got) == sum(plan[r.k] > 0 for r in df.select(M.row_key().alias("k")).collect())
    assert all(r.mix_taken == r.doc_id for r in got if r.doc_id is not None and r.doc_id < 400)


def test_very_long_text_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "word " * 1_000_000, "a", 5), (2, "x", "a", 6)], "doc_id long, text string, source string, size int")
    got = {r.doc_id: (r["size"], r.taken) for r in M.mix_sources(df).collect()}
    assert got[1][0] == 1_000_000 and 0 < got[1][1] <= 2_000_000 and got[2][0] == 1
