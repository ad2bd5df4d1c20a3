"""Secrets in texts, found with one minimal automaton for all rules.

All rules, down to the shortest text that can pass, are compiled into one deterministic
automaton, and a single pass over a text's UTF-8 bytes tells which rules match somewhere
in it; texts without a match, nearly all, are done after the pass. In the others the
automaton of the whole rules, run from where a match can begin, places the spans: a
rule's match ends where the automaton last accepts, and its value begins where it first
does. No regex engine is used. Matches are the leftmost, the longest of each, without
overlaps by kind; of ties by start the kind listed first comes first.

Base kinds are leftmost non-overlapping matches of ``BASE`` that pass its test;
they are counted and hashed on their own. Added spans: kinds of ``ADDED``, and
assignments that a failing match had covered. Spans are in code points, the end
excluded, ordered by start, then by kind as listed. A null text counts as empty:
no spans, and the hash of the empty string. Texts of any length are read whole, a slice
of about a megabyte at a time, or one text. Repeated rows give repeated results, an empty
table an empty one; columns besides doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratalith.llm.automaton import Automaton, Matcher, compile_rules, rules_hit
from stratalith.llm.textbytes import lean, slices

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: kind: (the shortest text that can pass, case counts for nothing, the whole rule, group to measure, least length)
BASE = {
    "assign": (_ASSIGN + "[A-Za-z0-9+/_.=-]", True, _ASSIGN + "([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("AKIA[A-Z0-9]{14}", False, "AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]{16}", False, "[0-9a-f]+", 0, 16),
}
ADDED = {
    "github": ("gh[pousr]_[A-Za-z0-9]{8}", False, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": ("xox[abprs]-[A-Za-z0-9]{4}", False, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "pem": ("-----BEGIN ", False, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 27),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8}", False, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 35),
}
RULES = BASE | ADDED


def exact_rules() -> Matcher:
    """The automaton of the whole rules, numbered as in ``RULES``."""
    return Matcher([(exact, fold) for _, fold, exact, *_ in RULES.values()])


def spans_of(text: str | bytes, kinds: list[str], exact: Matcher) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of ``kinds``, as (start, end, kind) in code points, in order."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    number = {k: n for n, k in enumerate(RULES)}
    base, more = [], []

    def passes(begin: int, first: int, end: int, kind: str) -> bool:
        _, _, _, group, least = RULES[kind]
        return end - (first - 1 if group else begin) >= least  # a group's value begins with the first byte that ends a match

    for kind in kinds:
        for begin, first, end in exact.find(data, number[kind]):
            if passes(begin, first, end, kind):
                (base if kind in BASE else more).append((begin, end, kind))
            elif kind == "assign":  # later keywords in what the failing match covers
                at = begin + 1
                while at < end:
                    found = exact.longest(data, at, number[kind])
                    if found is not None and passes(at, *found, kind):
                        more.append((at, found[1], kind))
                        at = found[1]
                    else:
                        at += 1
    key = lambda s: (s[0], number[s[2]], s[1])
    if not data.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]).tolist()
        base, more = ([(points[a], points[b], k) for a, b, k in some] for some in (base, more))
    return sorted(base, key=key), sorted({*base, *more}, key=key)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_automaton() -> Automaton:
    return compile_rules([(evidence, fold) for evidence, fold, *_ in RULES.values()])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``SCHEMA`` for every row of ``docs``; no exchange."""
    auto = scan_automaton()  # some hundred kB, the same for every input
    nothing = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, names = exact_rules(), list(RULES)
        for batch in batches:
            text = batch.column(1)
            for lo, hi, buf, offsets in slices(text):
                counts = {k: [0] * (hi - lo) for k in BASE}
                digest, spans = [nothing] * (hi - lo), [""] * (hi - lo)
                hits = rules_hit(auto, buf, offsets)
                for r in hits.nonzero()[0].tolist():
                    bits = int(hits[r])
                    body = buf[offsets[r] : offsets[r + 1]].tobytes()
                    base, every = spans_of(body, [k for n, k in enumerate(names) if bits >> n & 1], exact)
                    for _, _, kind in base:
                        counts[kind][r] += 1
                    if base:
                        digest[r] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[r] = joined(every)
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digest), pa.array(spans, pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(scan), SCHEMA)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
