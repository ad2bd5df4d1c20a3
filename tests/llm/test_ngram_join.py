import random
import re

import numpy as np
import pytest
from stratalith.llm import ngram_join as J
from stratalith.llm.components import components


def brute(rows, width, percent):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\x0b", " ").replace("\x0c", " ")
        for c in "\t\n\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def brute_links(rows, width, percent):
    """(doc_id, rows that the row links with), by all pairs."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    return sorted(((d, sum(link(a, b) for j, b in enumerate(sets) if j != i)) for i, ((d, _), a) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["É", "ß"]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, len(base) // 30])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.2:
                copy = copy + passage
            text = rng.choice([" ", "\n", " \t "]).join(copy)
            rows.append((len(rows) * 3 % 1000, text.upper() if rng.random() < 0.1 and "ß" not in copy and "É" not in copy else text))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (None, "one"), (2005, "a b c d"), (2005, "a b c d")]
    return rows


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, width, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, sid string")
    got = sorted(map(tuple, J.jaccard_components(df, width, percent).collect()), key=repr)
    assert got == brute(rows, width, percent)


def families():
    """A large family of near copies, others around it, and texts in many sizes that share a passage."""
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(3000)}"
    base = [word() for _ in range(60)]
    rows = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            copy[rng.randrange(60)] = word()
        rows.append(copy)
    for n in range(4, 200, 3):
        rows.append(base[:30] + [word() for _ in range(n)])
    for n in (10, 11, 12, 13, 14, 20, 21, 22, 23, 24, 40, 41, 44, 46, 47, 48):
        rows.append(base[-n:])
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


@pytest.mark.parametrize(("classes", "exact"), [(512, False), (20, False), (3, False), (20, True)])
def test_links_of_a_family(spark, monkeypatch, classes, exact):
    monkeypatch.setattr(J, "BLOCK_CLASSES", classes)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = J.jaccard_links(df, 4, 85, exact_keys=exact).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == brute_links(rows, 4, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4, 85)


def test_links_of_odd_rows(spark):
    rows = corpus(4) + [(5000, "tie one two three four"), (5001, "tie one two three four"), (5002, "tie one two three four five")]
    got = J.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == brute_links(rows, 4, 85)


@pytest.mark.parametrize("percent", [50, 80, 85, 99])
def test_linked_sizes_are_in_neighbouring_bands(percent):
    starts = J.band_starts(percent, 3000)
    band = lambda n: int(np.searchsorted(starts, n, "right"))
    assert all(band(100 * n // percent) - band(n) <= 1 for n in range(1, 2500))


def test_very_long_text(spark):
    text = " ".join(f"x{k}" for k in range(60_000))
    rows = [(1, text), (2, text + " more"), (3, text[: len(text) // 2])]
    got = {r.doc_id: (r.component_id, r.n_links) for r in J.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(J, "BLOCK_CLASSES", 3)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df, 4, 85).collect()), key=repr) == brute(rows, 4, 85)


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), 4, 85).collect() == []


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(3, 400)).astype(np.uint64)) for _ in range(40)]
    maps = [J.signature(s) for s in sets]
    cut, size = J.folded(maps, min(map(len, maps))), np.array([len(s) for s in sets])
    for i in range(40):
        some = np.arange(40)
        assert all(b >= o for b, o in zip(J.bound(cut, size, i, some), J.overlaps(sets[i], sets), strict=True))


def test_reachable_keeps_every_linked_set():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    sets = []
    for n in (10, 60, 63, 64, 65, 70, 127, 128, 129, 500):
        for cut in (0, 1, 3, 8):
            sets.append(np.unique(np.concatenate([base[cut:n], rng.integers(0, 1 << 63, cut // 2).astype(np.uint64)])))
    size = np.array([len(s) for s in sets])
    linked = np.array([any(j != i and 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o) for j, o in enumerate(J.overlaps(sets[i], sets))) for i in range(len(sets))])
    assert not (linked & ~J.reachable(size, [J.signature(s) for s in sets], None, 85)).any()


def test_components(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 150: 100}


def strangers():
    """Texts of many sizes that share a line and little else, some with a near copy."""
    rng = random.Random(11)
    line = [f"l{k}" for k in range(12)]
    rows = []
    for n in range(30, 130):
        own = [f"v{rng.randrange(100_000)}" for _ in range(n)]
        at = rng.randrange(n)
        rows.append(own[:at] + line + own[at:])
        if n % 4 == 0:
            rows.append(own[:at] + line + own[at:-1] + ["other"])
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_a_common_line_makes_no_cells(spark, monkeypatch, width, percent):
    monkeypatch.setattr(J, "BLOCK_CLASSES", 8)
    made, cells = [], J._cells

    def watched(shared, *columns):
        out = J.materialize(cells(shared, *columns), "watched")
        made.append((shared.count(), out.count()))
        return out

    monkeypatch.setattr(J, "_cells", watched)
    rows = strangers()
    got = J.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width, percent).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == brute_links(rows, width, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, width, percent)
    assert all(after <= 1.2 * before for before, after in made), made


def test_keys_beside_common_ones():
    rng = np.random.default_rng(3)
    common = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    for percent, n, m in ((80, 400, 0), (80, 400, 60), (80, 400, 150), (80, 400, 299), (85, 40, 20), (80, 10, 5), (80, 0, 7)):
        s = np.unique(np.concatenate([rng.integers(0, 1 << 63, n).astype(np.uint64), common[:: max(1, 300 // max(m, 1))][:m]]))
        keys = J.uncommon_keys(s, common, percent)
        other, least = s[~np.isin(s, common)], J.keys_for(percent)
        held = keys[np.isin(keys, common)]
        assert len(np.unique(keys)) == len(keys) and list(keys) == [*held, *other[: len(keys) - len(held)]]
        if len(held):  # as many first keys as without common ones
            assert set(s[:least].tolist()) <= set(keys.tolist()) and len(keys) - len(held) == min(len(other), 2 * least)
        else:
            h = 1 - len(other) / len(s)
            assert len(keys) == len(other) or (1 - (percent / 100 - h) / (1 - h)) ** len(keys) <= 1e-10 * 1.001
