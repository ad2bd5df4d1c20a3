import random
import re

import numpy as np
import pyarrow as pa

from stratalith.llm import secret_scan as S
from stratalith.llm.automaton import Matcher, compile_rules, rules_hit
from stratalith.llm.textbytes import slices

PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def plain_base(text):
    out = [(m.start(), m.end(), k) for k, (p, g, n) in PLAIN.items() for m in p.finditer(text) if len(m[g]) >= n]
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[2])))


def texts():
    rng = random.Random(5)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIkey", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "0123456789abcdef", "abc", "XYZ0123456789ABCD", "\n", ",", "é", "ſecret", "zz+/_.", "ghp_", "xoxb-", "deadbeef", "𝒳"]
    out = ["", "x", "token = abcdefghijkl", "password= token = abcdefghijklmnop", "AKIA" + "Q" * 5000, "a" * 15, "a" * 16, "secret:" + "f" * 9000]
    out += ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(600)]
    return out


def test_rows_against_regexes(spark):
    given = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.scan_secrets(df).collect()}
    assert got[-1].spans == "" and got[-1].n_hex == 0
    for i, t in enumerate(given):
        base = plain_base(t)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[2] for x in base) for k in PLAIN)
        import hashlib

        assert r.base_sha256 == hashlib.sha256(S.joined(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(S.joined(base).split(",")) - {""} <= set(every)


def test_shadowed_assignment_is_added():
    base, every = S.spans_of("password= token = abcdefghijklmnop", list(S.RULES), S.exact_rules())
    assert base == [] and S.joined(every) == "assign:10:34"


def test_automaton_against_search():
    rules = [("ab+c", False), ("(x|yz){2,3}q", True), ("[0-9]{4}", False), ("a?b?c", False)]
    auto = compile_rules(rules)
    rng = random.Random(2)
    rows = ["".join(rng.choice("abcxyzq0123 XYZ") for _ in range(rng.randrange(3000))) for _ in range(80)] + [""]
    exact = [re.compile(p, re.I if f else 0) for p, f in rules]
    for _, _, buf, off in slices(pa.array(rows)):
        hits = rules_hit(auto, buf, off)
    assert hits.tolist() == [sum(1 << k for k, p in enumerate(exact) if p.search(t)) for t in rows]


def test_automaton_is_minimal():
    one, two = compile_rules([("(ab|ac)", False)]), compile_rules([("a[bc]", False)])
    assert one.n_states == two.n_states == 3
    assert np.array_equal(np.sort(one.ends), np.sort(two.ends))


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans int, n_hex string")
    assert S.scan_secrets(empty).collect() == []


def test_added_kinds_against_regexes():
    exact = S.exact_rules()
    rng = random.Random(11)
    parts = ["ghp_", "ghs_", "a" * 36, "B9" * 20, "xoxb-", "xoxp", "12-ab-34-zz", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", "abcdefgh", ".eyJ", ".", "_-x", " ", "\n", "é", "𝒳"]
    whole = {k: (re.compile(r[2], re.ASCII | (re.I if r[1] else 0)), r[4]) for k, r in S.ADDED.items()}
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        _, every = S.spans_of(text, list(S.ADDED), exact)
        want = {(m.start(), m.end(), k) for k, (p, least) in whole.items() for m in p.finditer(text) if m.end() - m.start() >= least}
        assert set(every) == want, text


def test_longest_matches_of_an_automaton():
    m = Matcher([("ab+", False), ("a(b|bc)*d", False)])
    assert list(m.find(b"xabbbyab", 0)) == [(1, 3, 5), (6, 8, 8)]
    assert list(m.find(b"abcbcdad", 1)) == [(0, 6, 6), (6, 8, 8)]


def test_very_long_and_repeated_texts(spark):
    long = "x " * 500_000 + "token = abcdefghijkl " + "f" * 100_000
    got = S.scan_secrets(spark.createDataFrame([(1, long), (1, long), (2, "AKIA" + "A" * 14)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in got) == [(1, 1, 0, 1), (1, 1, 0, 1), (2, 0, 1, 0)]
