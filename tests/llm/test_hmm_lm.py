import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from stratalith.llm import hmm_lm as H


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def corpus():
    rng = random.Random(3)
    tongues = [[f"{p}{k}" for k in range(60)] for p in ("Foo", "bar", "qüx")]
    rows = [(i, " ".join(rng.choice(rng.choice(tongues) if rng.random() < 0.05 else tongues[i % 3]) for _ in range(rng.choice([3, 40, 90, 700])))) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, "neverseen"), (None, "Foo1 bar2"), (5, rows[5][1])]


def test_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(H, "HEAD", 50)  # most tokens go through the join
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, token string")
    got = H.hmm_scores(df, states=3, rounds=4).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in got:
        w = tokens(texts[r.doc_id][0])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs=1e-6)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def brute(hmm, seq):
    total = 0.0
    for path in itertools.product(range(len(hmm.start)), repeat=len(seq)):
        p = hmm.start[path[0]]
        for k, s in enumerate(path):
            p *= hmm.emit[seq[k], s] * (hmm.move[path[k - 1], s] if k else 1)
        total += p
    return total


def small_hmm():
    rng = np.random.default_rng(7)
    one = lambda *n: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(n))
    return H.Hmm(one(3), one(3, 3), np.ascontiguousarray(one(3, 5).T))


def test_forward_against_all_paths():
    hmm = small_hmm()
    seqs = [np.array(s, np.uint16) for s in ([0], [4, 1], [1, 2, 3, 4, 0, 1], [], [2, 2, 2, 1])]
    want = [math.log10(brute(hmm, s)) if len(s) else 0.0 for s in seqs]
    assert np.allclose(H.forward(hmm, seqs), want)


def test_expected_counts_against_all_paths():
    hmm = small_hmm()
    seqs = [np.array([0, 3, 1], np.uint16), np.array([2, 2, 4, 1], np.uint16)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for seq in seqs:
        z = brute(hmm, seq)
        for path in itertools.product(range(3), repeat=len(seq)):
            p = hmm.start[path[0]] / z
            for k, s in enumerate(path):
                p *= hmm.emit[seq[k], s] * (hmm.move[path[k - 1], s] if k else 1)
            start[path[0]] += p
            for k, s in enumerate(path):
                emit[seq[k], s] += p
                if k:
                    move[path[k - 1], s] += p
    got = [H.expected_counts(hmm, b, r) for b, r in H.segments(seqs, 5)]
    assert len(got) == 1
    for mine, true in zip(got[0], (start, move, emit, sum(math.log(brute(hmm, s)) for s in seqs)), strict=True):
        assert np.allclose(mine, true)


def test_rounds_raise_the_likelihood(spark):
    rng = np.random.default_rng(1)
    rows = [(bytes(np.array([rng.integers(0, 4) + 4 * (k % 3) for _ in range(50)], np.uint16)),) for k in range(60)]
    df = spark.createDataFrame(rows, "classes binary")
    _, likelihood = H.train(df, np.full(12, 1 / 12), states=3, rounds=6)
    assert all(b >= a - 1e-6 for a, b in zip(likelihood, likelihood[1:], strict=False)) or likelihood[-1] > likelihood[0]


def test_only_held_out_and_empty(spark):
    assert H.hmm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    got = H.hmm_scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string"), rounds=1).collect()
    assert [r.train_tokens for r in got] == [0, 0] and all(math.isfinite(r.score) for r in got)


def test_scores_against_plain_recursion(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 15)))) for i in range(60)] + [(70, None), (71, "unseen words w1 UNSEEN"), (72, "w1 w2 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).cache()
    got = {r.doc_id: r for r in H.hmm_scores(docs, states=3, rounds=2).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = H.token_counts(docs.where(~docs.doc_id.isin(list(held))))
    table, _ = H.vocabulary(counts)
    seqs = H.sequences(docs.selectExpr("doc_id", "false held_out", "text"), H.Shared(spark, table)).collect()
    by_id = {r.doc_id: np.frombuffer(r.classes, np.uint16) for r in seqs}
    train = spark.createDataFrame([(r.classes,) for r in seqs if r.doc_id not in held], "classes binary")
    hmm, _ = H.train(train, table.mass, states=3, rounds=2)
    for i, classes in by_id.items():
        log, state = 0.0, hmm.start
        for k, c in enumerate(classes.tolist()):
            state = (state if k == 0 else state @ hmm.move) * hmm.emit[c]
            log += math.log10(state.sum())
            state = state / state.sum()
        want = got[i].base_score + log - sum(math.log10(table.mass[c]) for c in classes.tolist())
        assert math.isclose(got[i].score, want, rel_tol=1e-6), i
