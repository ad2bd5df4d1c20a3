import random
import re

import pytest
import regex
from stratalith.llm import decontaminate as D

UNITS = "|".join(sorted(D.UNITS, key=lambda u: (-len(u), u)))


def template(text):
    """(template words, values), stated plainly."""
    letter = "a-zA-ZäöüßéÄÖÜÉ"
    out = re.sub(r"(?<=[^.!?:\s][ \t])[A-ZÄÖÜÉ][a-zäöüßé][" + letter + "]*", D.NAME, text)
    out = re.sub(f"(?<![{letter}0-9])" + r"[0-9]+(?:[.,][0-9]+)*", D.NUMBER, out)
    sign = letter + "0-9" + D.NAME + D.NUMBER + D.UNIT
    out = re.sub(D.NUMBER + "( ?)(?i:" + UNITS + f")(?![{sign}])", D.NUMBER + r"\1" + D.UNIT, out)
    words = re.findall(f"[{sign}]+", out.lower())
    values = re.findall(f"[0-9]+(?:[.,][0-9]+)*[{letter}0-9]*|[{letter}0-9]+", text.lower())
    assert len(words) == len(values)
    return words, values


def brute(docs, items):
    """All alignments of all items over all documents; a run of WIDTH words, some of them literal, must agree."""
    mark = lambda w: any(c in w for c in D.NAME + D.NUMBER + D.UNIT)
    out = set()
    for d, text in docs:
        w, dv = template(text or "")
        for item, body in items:
            for source in (body or "", (body or "").lower()):
                t, v = template(source)
                if len(t) < D.SHORTEST:
                    continue
                for shift in range(-len(t), len(w)):
                    same = [k for k in range(len(t)) if 0 <= shift + k < len(w) and w[shift + k] == t[k]]
                    if len(same) < max(D.COVERAGE * len(t), 1):
                        continue
                    need = D.WIDTH + D.STRIDE - 1 if len(t) >= D.WIDTH + D.STRIDE - 1 else len(t)
                    runs, ok = [], set(same)
                    for k in same:
                        if k - 1 not in ok:
                            runs.append([k])
                        else:
                            runs[-1].append(k)
                    if not any(len(r) >= need for r in runs):
                        continue
                    slots = {(dv[shift + k], v[k]) for k in same if mark(t[k])}
                    literal = sum(not mark(t[k]) for k in same)
                    if literal >= min(D.LITERALS, len(t)) and len(slots) == len({a for a, _ in slots}) == len({b for _, b in slots}):
                        out.add((d, item))
    return out


ITEMS = [
    (1, "Anna bought 12 apples for 3 dollars each and gave 5 of them to Bruno. How many apples does she have left after that?"),
    (2, "A train leaves the station at 60 km per hour and another one follows it at 80 km per hour two hours later."),
    (3, "what is the capital"),
    (4, None),
    (5, "too short"),
    (6, "the old man and the sea"),
]


def leaked(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, item int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    return {(r.doc_id, r.item_id): r for r in D.find_leaks(d, b).collect()}


def test_cases(spark):
    one, two = ITEMS[0][1], ITEMS[1][1]
    docs = [
        (10, "Some words before. " + one + " And after."),
        (11, "x " + one.upper()),
        (12, one.replace("12", "17").replace("Bruno", "Clara").replace("3 dollars", "4 euros")),
        (13, two.replace("60", "70").replace("80", "90")),
        (14, "Unrelated words " * 2000 + two.lower()),
        (15, "I ask what is the capital of it"),
        (16, "too short too short"),
        (17, None),
        (18, ""),
        (19, two.replace("80 km", "60 km")),  # two values of the item are one here: another question
        (20, "12 12 12 12 12 12 12 12 12"),
        (21, "he read the old man and the sea twice"),
        (22, one[:40]),
        (23, one.replace(" ", "\n").replace("apples", "apples,")),
    ]
    got = leaked(spark, docs, ITEMS)
    assert set(got) == {(10, 1), (11, 1), (12, 1), (13, 2), (14, 2), (15, 3), (21, 6), (23, 1)}
    assert got[10, 1].changed_slots == 0 and got[12, 1].changed_slots == 4 and got[13, 2].changed_slots == 2
    assert got[10, 1].coverage == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_alignments(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Anna", "Bruno", "7", "12", "kg", "3.5", "x9", "b2.5", "4km", "-", "end."]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 5, 6, 7, 8, 15, 30])))) for k in range(25)]
    docs = []
    for k in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 30, 90]))]
        piece = rng.choice(items)[1].split(" ")
        piece = piece[rng.choice([0, 0, 0, len(piece) // 3]) :]
        if rng.random() < 0.5:
            piece[rng.randrange(len(piece))] = rng.choice(vocab)
        at = rng.randrange(len(w) + 1)
        docs.append((k, " ".join(w[:at] + piece + w[at:])))
    got, want = set(leaked(spark, docs, items)), brute(docs, items)
    assert want <= got
    # shorter runs are found too where they happen to lie at a window's place
    assert all(d in {x for x, _ in docs} for d, _ in got)


def test_empty(spark):
    assert leaked(spark, [], ITEMS) == {} and leaked(spark, [(1, "a b c d e f")], []) == {}


LETTERS = [f"q{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]


def test_runs_at_several_shifts_are_chained(spark):
    forty = LETTERS[:40]
    items = [(1, " ".join(forty)), (2, " ".join(LETTERS[40:46]) + " Berlin " + " ".join(LETTERS[46:52]) + " Hamburg " + " ".join(LETTERS[52:58])), (3, " ".join(LETTERS[:4]) + " Rome " + " ".join(LETTERS[20:24]) + " 5km " + " ".join(LETTERS[30:34]) + " Oslo end")]
    docs = [
        (1, " ".join([*forty[:13], "zz", *forty[13:26], "yy", *forty[26:]])),
        (2, items[1][1].replace("Berlin", "New York").replace("Hamburg", "San Jose")),
        (3, items[2][1].replace("Rome", "New York").replace("5km", "7 km")),
        (4, " ".join(["aa", *forty[:19], "bb"])),
        (5, " ".join(["aa", *forty[:11], "bb"])),
    ]
    got = leaked(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 1)}
    assert got[1, 1].matched == 40


def test_short_items(spark):
    twelve = LETTERS[:12]
    changed = " ".join([*twelve[:5], "zz", *twelve[6:]])
    items = [(1, "Which city hosted the games"), (2, "Anna has read seven old books"), (3, " ".join(twelve))]
    docs = [
        (1, "He asked Which city hosted the games today"),
        (2, "He said. Bruno has read seven old books"),
        (3, changed),
        (4, "aa " + changed),
        (5, "the games were hosted by which city"),
    ]
    assert set(leaked(spark, docs, items)) == {(1, 1), (2, 2), (3, 3), (4, 3)}


def test_readings_have_their_values(spark):
    texts = ["5 Km to New York. Anna9 has 3.5x, b2.5 and 9Abc", "İstanbul 5km iPhone USA Mc Donald 1,000 kmx", "In Rome Anna paid 12 EUR 7"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = d.select(D.slot_words(d.text).alias("t"), D.slot_values(d.text).alias("v")).collect()
    assert all(len(r.t) == len(r.v) for r in got)
    assert got[0].t[:4] == [D.NUMBER, "to", D.NAME, "anna9"] and got[0].v[:3] == ["5 km", "to", "new york"]
    assert got[2].t == [D.NAME, "paid", D.NUMBER, D.NUMBER]


def slots(text):
    """(words, values) of the second reading, stated plainly."""
    numbered = regex.sub(D._NUMBERS, D.NUMBER, text)
    words = regex.findall(rf"[{D._SIGN}\u0307]+", regex.sub(D._NAMES, D.NAME, numbered).lower())
    values = [m.group().lower() for m in regex.finditer(rf"{D._NUMBERS}|{D._NAMES}|[{D._WORD}]+", text)]
    assert len(words) == len(values)
    return words, values


def chain(points):
    ends = []  # the chain of m + 1 points that ends first
    for x in sorted(points, key=lambda x: (x[0], -x[1])):
        at = sum(path[-1][1] < x[1] for path in ends)
        ends[at : at + 1] = [(ends[at - 1] if at else []) + [x]]
    return ends[-1]


def holds(same, n, literals):
    """same: (item place, document place, template word, document's value, item's value)."""
    mark = lambda w: any(c in w for c in D.NAME + D.NUMBER + D.UNIT)
    best = exact = run = equal = 0
    for k, x in enumerate(same):
        on = k > 0 and (x[0], x[1]) == (same[k - 1][0] + 1, same[k - 1][1] + 1)
        run = run + 1 if on else 1
        equal = 0 if x[3] != x[4] else equal + 1 if on else 1
        best, exact = max(best, run), max(exact, equal)
    pairs = {(x[3], x[4]) for x in same if mark(x[2])}
    covers = len(same) >= D.COVERAGE * n and best >= D.WIDTH or len(same) >= D.CLOSE * n or exact >= D.LONG
    enough = sum(not mark(x[2]) for x in same) >= min(D.LITERALS, literals)
    return covers and enough and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def oracle(docs, items):
    """All items against all documents, by every alignment; no hashes, windows or bitmaps."""
    mark = lambda w: any(c in w for c in D.NAME + D.NUMBER + D.UNIT)
    out = set()
    for d, text in docs:
        if text is None:
            continue
        plain = template(text)[1]
        for item, body in items:
            body = body or ""
            words, values = template(body)
            if 0 < len(values) < D.SHORTEST or values and all(map(mark, words)):
                n = len(values)
                if any(plain[k : k + n] == values for k in range(len(plain) - n + 1)) and (n >= D.SHORT_WIDTH or len(plain) == n):
                    out.add((d, item))
            for t, v in [template(body), template(body.lower()), slots(body), slots(body.lower())]:
                n, literals = len(t), sum(not mark(w) for w in t)
                if n < D.SHORTEST or not literals:
                    continue
                need = n if n < D.WIDTH else min(D.WIDTH, max(D.SHORT_WIDTH, (n - 1) // 2))
                for w, dv in (template(text), slots(text)):
                    laid = {}
                    for shift in range(-n, len(w)):
                        same = [(k, shift + k, t[k], dv[shift + k], v[k]) for k in range(max(0, -shift), min(n, len(w) - shift)) if w[shift + k] == t[k]]
                        places = {x[0] for x in same}
                        if any(all(k + j in places for j in range(need)) and any(not mark(t[k + j]) for j in range(need)) for k in places):
                            laid[shift] = same
                    for shift, same in laid.items():
                        near = [s for s in laid if shift / n <= s / n <= shift / n + 1]
                        firm = lambda one: [x for x in one if not mark(x[2]) or any(abs(y[0] - x[0]) == 1 for y in one)]
                        ways = [same] + ([chain([x for s in near for x in firm(laid[s])])] if len(near) > 1 else [])
                        if any(holds(way, n, literals) for way in ways):
                            out.add((d, item))
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_equals_the_oracle(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30)] + ["Anna", "Bruno", "Anna", "7", "12", "kg", "3.5", "9", "4km", "-", "end.", "New York"]
    sizes = [1, 2, 3, 3, 4, 5, 6, 7, 9, 12, 13, 14, 20, 33]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice(sizes)))) for k in range(24)] + [(90, "7 12 9"), (91, "7 12 9 3.5 7 12 9 3.5"), (92, ""), (93, None)]
    docs = [(900, None), (901, ""), (902, "7 12 9"), (903, "7 9 12 5 6 7 12 9 3.5 7 12 9 3.5")]
    for k in range(70):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40]))]
        piece = rng.choice(items[:24])[1].split(" ")
        piece = piece[rng.choice([0, 0, len(piece) // 3]) :]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(piece))
            piece[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocab)]
        at = rng.randrange(len(w) + 1)
        docs.append((k, " ".join(w[:at] + piece + w[at:])))
    got = set(leaked(spark, docs, items))
    assert got == oracle(docs, items)
    assert len(got) > 20


def test_few_words_or_literals(spark):
    items = [(1, "Compute 3 + 4 quickly please"), (2, "Who wrote Hamlet in London?"), (3, "Is water wet"), (4, "yes no"), (5, "42"), (6, "17 4 2001 8")]
    docs = [
        (1, "Please compute: Compute 3 + 4 quickly please. Thanks"),
        (2, "Compute 5 + 8 quickly please"),
        (3, "They asked: Who wrote Hamlet in London? Nobody knew"),
        (4, "Who wrote Faust in Weimar?"),
        (5, "Tell me, is water wet or not"),
        (6, "is fire wet"),
        (7, "yes no"),
        (8, "yes no maybe"),
        (9, "42"),
        (10, "in 42 days"),
        (11, "on 17 4 2001 8 came"),
        (12, "on 18 4 2001 8 came"),
    ]
    assert set(leaked(spark, docs, items)) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (7, 4), (9, 5), (11, 6)}


def test_runs_of_six_are_found_at_every_place(spark):
    items = [(1, " ".join(LETTERS[:12]))]
    docs = [(k, " ".join(["x"] * k + ["zz"] + LETTERS[1:7] + ["y"] * 6)) for k in range(5)]
    assert set(leaked(spark, docs, items)) == {(k, 1) for k in range(5)}


def test_very_long_text_repeated_rows_and_ties(spark):
    one = ITEMS[0][1]
    long = "some words go on " * 100_000 + one + " and on" * 50_000
    docs = [(1, long), (1, long), (2, one + " " + one), (None, one)]
    got = leaked(spark, docs, ITEMS)
    assert set(got) == {(1, 1), (2, 1), (None, 1)} and all(r.coverage == 1.0 and r.changed_slots == 0 for r in got.values())


def test_whole_texts_stay_out_of_joins_and_lambdas(spark):
    d = spark.createDataFrame([(1, ITEMS[0][1])], "doc_id long, text string")
    b = spark.createDataFrame([(i, t) for i, t in ITEMS if i < 3], "item_id long, text string")
    lines = D.find_leaks(d, b)._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [k for k, line in enumerate(lines) if "Join" in line]
    assert len(joins) == 2
    # the values of a text are read behind the joins, not for each row that they compare
    assert not any("regexp_extract_all" in lines[k] for k in joins)
    # and its windows are hashed without lambda functions
    assert not any("lambdafunction" in line for line in lines[joins[0] :])


def test_window_hashes(spark):
    words = LETTERS[:7] + LETTERS[:5]
    rows = spark.createDataFrame([(words,), ([],)], "w array<string>").selectExpr("w", "explode(sequence(0, 12)) as at")
    got = {(len(r.w), r.at): (r.five, r.one) for r in rows.select("w", "at", *[D.window_hash("w", rows["at"], size).alias(name) for size, name in ((5, "five"), (1, "one"))]).collect()}
    five, one = ([got[12, at][k] for at in range(13)] for k in (0, 1))
    assert five[0] == five[7] and len(set(five[:7])) == 7 and five[8:] == [None] * 5
    assert one[:5] == one[7:12] and len(set(one[:7])) == 7 and one[12] is None
    assert all(got[0, at] == (None, None) for at in range(13))
