import random

import pytest
from stratalith.llm import decontaminate as D
from stratalith.storage import materialize
from test_decontaminate import brute as leaks
from test_ngram_join import brute as near

pipeline = pytest.importorskip("corpus_pipeline")

BAD = ["vile", "nasty", "grimor"]


def corpus():
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(25))) for k in range(4)]
    docs, labels, toxic = [], [], set()
    for i in range(260):
        w = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 80]))]
        if i % 5 == 0:
            w[3:3] = rng.sample(BAD, 2)
            toxic.add(i)
        if i % 37 == 1:
            w += rng.choice(items)[1].split(" ")
        docs.append((i, " ".join(w)))
        labels.append((i, int(i in toxic)))
    for i in range(260, 300):
        base = docs[rng.randrange(200)]
        text = base[1].upper() if i % 2 else base[1]
        if i % 3 == 0:
            words = text.split(" ")
            words[len(words) // 2] = rng.choice(vocab)
            text = " ".join(words)
        docs.append((i, text))
        if base[0] in toxic or any(b in text.lower() for b in BAD):
            toxic.add(i)
    docs += [(400, None), (401, ""), (402, docs[0][1]), (7, docs[7][1])]
    if any(b in docs[0][1] for b in BAD):
        toxic.add(402)
    return docs, labels, toxic, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, toxic, items = corpus()
    rows = [(i, t, "en", ["a", "b", None][(i or 0) % 3], len(t or ""), "more") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir, out = f"file://{tmp_path}", {}
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before = now.columns
        now = materialize(stage(spark, now, sf_dir), "stage")
        assert now.columns[: len(before)] == before or set(before) <= set(now.columns)
        out[name] = [(r.doc_id, r.text) for r in now.collect()]
    names = [n for n, _ in pipeline.STAGES]
    clean = out[names[0]]
    assert sorted(i for i, _ in clean) == sorted(i for i, _ in docs if i not in toxic)
    # the largest id of equal texts, once
    last: dict = {}
    for i, t in clean:
        last[(t or "").lower()] = max(i, last.get((t or "").lower(), i))
    single = out[names[1]]
    assert sorted(i for i, _ in single) == sorted(last.values())
    groups: dict = {}
    for (i, t), (_, _, root) in zip(sorted(single, key=repr), near(sorted(single, key=repr), 5, 80), strict=True):
        groups.setdefault(root if t else ("empty", i), []).append(i)
    kept = {i for i, _ in out[names[2]]}
    assert len(kept) == len(out[names[2]]) == len(groups) and all(len(kept & set(g)) == 1 for g in groups.values())
    held = {d for d, _ in leaks(out[names[2]], items)}
    assert sorted(i for i, _ in out[names[3]]) == sorted(kept - held) and held
    final = now.collect()
    words = {i: len((t or "").split()) for i, t in out[names[3]]}
    assert all(0 < r.mix_taken <= 2 * words[r.doc_id] for r in final)
    assert abs(sum(r.mix_taken for r in final) - 1.5 * sum(words.values())) <= 3
    ran = pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in ran) == sorted(r.doc_id for r in final)
    assert pipeline.ORACLE_SQL is None and D.SHORTEST


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").collect() == []
