import os
import random

import pytest
from stratalith.llm import token_counts as T

needs_file = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


def brute(token, scores, floor):
    """Best (score, -pieces) over all segmentations, by plain recursion over ends."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        width = len(token[end - 1].encode())
        options = [(best[end - 1][0] + floor * width, best[end - 1][1] - width)]
        for begin in range(end):
            if token[begin:end] in scores:
                options.append((best[begin][0] + scores[token[begin:end]], best[begin][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_trie_against_each_token_alone():
    rng = random.Random(9)
    alphabet = "▁abcé"
    scores = T.log_probabilities(sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))) for _ in range(80)}, key=len))
    floor = min(scores.values()) - T.BYTE_COST
    tokens = ["▁" + "".join(rng.choice(alphabet + "xß") for _ in range(rng.randrange(12))) for _ in range(500)]
    want = [brute(t, scores, floor) for t in tokens]
    assert T.count_pieces(tokens, T.Pieces(scores), T.Trie()) == want
    trie = T.Trie()
    assert [T.count_pieces([t], T.Pieces(scores), trie)[0] for t in tokens[:50]] == want[:50]


@needs_file
def test_rows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 20)
    texts = [None, "", " \n", "Hello hello, Welt! größer 日本語 \x0b mixed", "a" * 3000, "The quick brown fox " * 200, "𝒳 zz"]
    scores = T.log_probabilities(T.read_pieces(T.VOCABULARY))
    floor = min(scores.values()) - T.BYTE_COST
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "The", 2)], "doc_id long, text string, n_tokens int")
    for r in T.token_counts(df).collect():
        words = [w for w in ("The" if r.doc_id is None else texts[r.doc_id] or "").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
        assert r.n_words == len(words)
        assert r.n_tokens == sum(brute(T.MARK + w, scores, floor) for w in words)
    assert T.token_counts(df.limit(0)).collect() == []


def test_long_tokens_need_no_nodes(monkeypatch):
    rng = random.Random(4)
    scores = T.log_probabilities(sorted({"".join(rng.choice("ab▁é") for _ in range(rng.randrange(1, 7))) for _ in range(60)}, key=len))
    floor, pieces = min(scores.values()) - T.BYTE_COST, T.Pieces(scores)
    tokens = ["▁" + "".join(rng.choice("abéx") for _ in range(n)) for n in (62, 63, 64, 65, 100, 700)]
    trie = T.Trie()
    assert T.count_pieces(tokens, pieces, trie) == [brute(t, scores, floor) for t in tokens]
    assert 0 < trie.nodes <= 64 * 3
    monkeypatch.setattr(T, "NODES", 30)
    small = T.Trie()
    some = ["▁" + "".join(rng.choice("abé") for _ in range(9)) for _ in range(50)]
    assert T.count_pieces(some, pieces, small) == [brute(t, scores, floor) for t in some] and small.nodes <= 40


@needs_file
def test_word_of_megabytes_and_repeated_rows(spark):
    word = "abcdefgh" * 400_000
    df = spark.createDataFrame([(1, word), (2, word[:8]), (2, word[:8])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_tokens) for r in T.token_counts(df).collect())
    assert got[1] == got[2] and got[0][1] == 1 and got[0][2] > 400_000
