"""Toxicity by nearest labelled examples, under exact TF-IDF cosine.

Fitting reads a bounded sample of labelled rows: the ``EXAMPLES`` training rows of
each class with the least hash of their doc_id, one text for each. Terms are words
(runs of letters and digits, A-Z in lower case) and their first ``PREFIXES`` bytes, so
that an unseen inflection of a known stem counts. All terms of the sample, toxic and
clean, span the vector space; none is selected by class. A term weighs (1 + ln tf) *
idf * (1 + telling): ``telling`` is the size of the log odds of its document
frequencies in the two classes, times 1 - ``CHANCE`` / G2 and 0 below, so that what
chance explains tells nothing. For it a term counts once for each different word
before it, so that a family of copies isn't taken for many texts.

Examples are kept in an inverted index whose postings are cut into blocks of
``BLOCK`` examples with the largest weight of each term in the block. A text's
weights times the block maxima bound every cosine in a block from above. The
``FIRST`` blocks of highest bound are opened, then those whose bound reaches the
``NEIGHBOURS``-th best cosine so far, so the nearest examples are exact; equal cosines
go to the example of the lower number. They vote by squared cosine times the number of
rows of their class that each stands for. The share of toxic votes becomes a score by a
logistic curve, fitted to up to ``CALIBRATION`` examples of each class, each of
which is left out of its own neighbours. A text without any known term, an empty or
null one included, gets the rate of toxic rows. The nearest examples' ids are returned
as evidence.

Labels that are null, rows of labels without a document, and rows with a null doc_id
don't teach; of contradicting labels of one doc_id the larger counts, of several texts
of one doc_id the least. Without training rows of both classes every score is the rate
of the rows there are, or 0. Repeated rows get repeated results, an empty table an empty
result. Texts of any length are read whole: a slice of about a megabyte at a time, or one
text. Only doc_id and text are read, of labels doc_id and toxic, whatever else there is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.textbytes import hash_sums, lean, slices, span_hashes, tables, words
from stratalith.storage import Shared, materialize

EXAMPLES = 1024
PREFIXES = (5, 7)
#: The value of G2 that chance exceeds once in a thousand terms.
CHANCE = 10.8
NEIGHBOURS = 15
CALIBRATION = 400
BLOCK = 64
FIRST = 4
#: Results of texts that a task keeps for copies of them.
KEPT = 1 << 13
_SLOTS = 1 << 22


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))) % 5 == 0


def term_tables() -> dict:
    """Byte tables under which everything but letters, digits and bytes beyond ASCII is white space."""
    tab = tables()
    space = np.ones(256, bool)
    space[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return {"space": space, "lower": tab["lower"]}


_APART = np.uint64(0xD1B54A32D192ED03)


def _terms(batch: pa.RecordBatch, column: int, lengths: tuple[int, ...], tab: dict, cache: dict):
    """(first row, end row, [(length, term, row, word number)]) for slices of a text column.

    Length 0 is the whole word, others are its first bytes.
    """
    for lo, hi, buf, offsets in slices(batch.column(column)):
        start, end, row = words(buf, offsets, tab)
        out = []
        if len(start):
            sums, number = hash_sums(buf, tab, cache), np.arange(len(start))
            for n in lengths:
                if n:
                    at = np.flatnonzero(end - start > n)
                    out.append((n, (span_hashes(sums, start[at], start[at] + n) ^ _APART).view(np.int64), row[at], at))
                else:
                    out.append((n, span_hashes(sums, start, end).view(np.int64), row, number))
        yield lo, hi, out


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one behind the other."""
    size = end - start
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - at, size)


@dataclass
class Index:
    """Block-max inverted index over examples with unit vectors."""

    terms: np.ndarray  # sorted
    lengths: tuple[int, ...]  # of the prefixes among them, 0 for whole words
    idf: np.ndarray  # with what the term tells
    ids: np.ndarray  # doc_id by example
    label: np.ndarray
    votes: np.ndarray  # rows that an example stands for
    rate: float  # of toxic rows
    entry: np.ndarray  # by term: its first entry; an entry is a term in a block
    block: np.ndarray  # by entry
    most: np.ndarray  # by entry: the largest weight
    posting: np.ndarray  # by entry: its first posting
    example: np.ndarray  # by posting
    weight: np.ndarray  # by posting
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[term]
        return w / math.sqrt(float((w * w).sum()))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest positive cosine (ties: lower number first) and their cosines."""
        blocks = -(-len(self.ids) // BLOCK)
        lists = self.entry[term], self.entry[term + 1]
        entries, own = _ranges(*lists), np.repeat(weight, lists[1] - lists[0])
        at = self.block[entries]
        bound = np.bincount(at, own * self.most[entries], blocks)
        order = np.argsort(-bound, kind="stable")
        cosine, wanted = np.zeros(blocks * BLOCK), np.zeros(blocks, bool)
        wanted[order[:FIRST]] = True
        for step in range(2):
            if step and 2 * wanted.sum() > blocks:  # all lists from end to end cost less than most of their entries
                first, last, each = self.posting[lists[0]], self.posting[lists[1]], weight
                cosine[:] = 0
            else:
                some = np.flatnonzero(wanted[at])
                first, last, each = self.posting[entries[some]], self.posting[entries[some] + 1], own[some]
            post = _ranges(first, last)
            cosine += np.bincount(self.example[post], np.repeat(each, last - first) * self.weight[post], len(cosine))
            if without is not None:
                cosine[without] = 0
            kth = np.partition(cosine, -k)[-k] if len(cosine) > k else 0.0
            wanted = ~wanted & (bound >= kth - 1e-9) & (bound > 0)
            if not wanted.any():
                break
        found = np.flatnonzero(cosine > max(0.0, kth - 1e-9))
        best = found[np.lexsort((found, -np.round(cosine[found], 12)))[:k]]
        return best, cosine[best]

    def share(self, term: np.ndarray, tf: np.ndarray, k: int, without: int | None = None) -> tuple[float | None, np.ndarray]:
        """The toxic share of the nearest examples' votes, None without any, and these examples."""
        if not len(term) or not len(self.ids):
            return None, np.zeros(0, np.int64)
        at, near = self.nearest(term, self.vector(term, tf), k, without)
        say = near * near * self.votes[at]
        return (float((say * self.label[at]).sum() / say.sum()) if len(at) else None), at

    def calibrated(self, share: float | None) -> float:
        if share is None:
            return self.rate
        if not 0 < self.rate < 1:
            return share
        a, b = self.curve
        return 1 / (1 + math.exp(-(a * _logit(share) + b)))

    def score(self, term: np.ndarray, tf: np.ndarray, k: int) -> tuple[float, list[int]]:
        share, at = self.share(term, tf, k)
        return self.calibrated(share), self.ids[at[:3]].tolist()


def _logit(share: float) -> float:
    share = min(max(share, 0.005), 0.995)
    return math.log(share / (1 - share))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve of y over x, by Newton steps from (1, 0) with a weak pull there."""
    at, pull = np.array([1.0, 0.0]), 1e-3 * float(weight.sum())
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (weight * (y - p)) - pull * (at - [1.0, 0.0])
        curvature = design.T @ (design * (weight * p * (1 - p))[:, None]) + pull * np.eye(2)
        step = np.linalg.solve(curvature, slope)
        at = at + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 0.05), float(at[1])


def build_index(terms: np.ndarray, lengths: tuple[int, ...], idf: np.ndarray, examples: list[tuple[int, int, float, np.ndarray, np.ndarray]], rate: float) -> Index:
    """examples: (doc_id, label, votes, term numbers, tf), vectors not empty."""

    def heaviest(e):  # alike examples share blocks
        return e[1], e[3][np.argsort(-idf[e[3]], kind="stable")[:3]].tolist(), e[0]

    examples = sorted(examples, key=heaviest)
    none = np.zeros(0)
    weights = [(w := (1 + np.log(e[4])) * idf[e[3]]) / math.sqrt(float((w * w).sum())) for e in examples]
    term = np.concatenate([e[3] for e in examples]).astype(np.int64) if examples else none.astype(np.int64)
    number = np.repeat(np.arange(len(examples)), [len(e[3]) for e in examples])
    weight = np.concatenate(weights) if examples else none
    order = np.lexsort((number, term))
    term, number, weight = term[order], number[order], weight[order]
    block = number // BLOCK
    new = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(block) != 0)])) if len(term) else none.astype(np.int64)
    most = np.maximum.reduceat(weight, new) if len(term) else none
    most = np.nextafter(most.astype(np.float32), np.float32(2))  # in few bytes and still no less than any weight
    entry = np.searchsorted(term[new], np.arange(len(terms) + 1)) if len(term) else np.zeros(len(terms) + 1, np.int64)
    return Index(
        terms, lengths, idf, np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], np.int64), np.array([e[2] for e in examples]), rate,
        entry.astype(np.int32), block[new].astype(np.int32), most, np.append(new, len(term)).astype(np.int32), number.astype(np.int32), weight,
    )


def calibrate(index: Index, examples: list[tuple[int, int, float, np.ndarray, np.ndarray]], k: int) -> tuple[float, float]:
    """The curve from vote shares to scores, from ``CALIBRATION`` examples of each class."""
    place = {int(i): n for n, i in enumerate(index.ids)}
    some = [e for c in (0, 1) for e in sorted((e for e in examples if e[1] == c), key=lambda e: e[0])[:CALIBRATION]]
    shares = [index.share(e[3], e[4], k, place[e[0]])[0] for e in some]
    kept = [(_logit(s), e[1], e[2]) for s, e in zip(shares, some, strict=True) if s is not None]
    if len({y for _, y, _ in kept}) < 2:
        return 1.0, 0.0
    x, y, weight = (np.array(v, float) for v in zip(*kept, strict=True))
    drawn = np.array([sum(e[1] == c for e in examples) / max(1.0, (y == c).sum()) for c in (0, 1)])
    return fit_curve(x, y, weight * drawn[y.astype(int)])


def _weigh_terms(sample: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, tuple[int, ...], np.ndarray]:
    """The sample's terms, sorted, their lengths and weights; one row per term of the bounded sample reaches the driver."""
    lengths = (0, *PREFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, cache = term_tables(), {}
        for batch in batches:
            label = batch.column(1).to_numpy()
            for lo, _, found in _terms(batch, 2, lengths, tab, cache):
                if not found:
                    continue
                _, word, row, _ = found[0]
                before = np.where(np.concatenate([[True], row[1:] != row[:-1]]), 0, np.concatenate([[0], word[:-1]]))
                for _, term, row, number in found:
                    # one row for each term of a text, with the word before its first place
                    order = np.lexsort((number, term, row))
                    first = order[np.flatnonzero(np.concatenate([[True], (np.diff(term[order]) != 0) | (np.diff(row[order]) != 0)]))] if len(order) else order
                    yield pa.RecordBatch.from_arrays([pa.array(term[first]), pa.array(before[number[first]]), pa.array(label[lo + row[first]].astype(np.int32))], ["term", "before", "label"])

    seen = sample.mapInArrow(lean(run), "term long, before long, label int")
    one = seen.groupBy("term", "before").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    counted = one.groupBy("term").agg(F.sum(F.col("a") + F.col("b")).alias("df"), F.sum(F.least("a", F.lit(1))).alias("a"), F.sum(F.least("b", F.lit(1))).alias("b")).toArrow()
    order = np.argsort(counted["term"].to_numpy())
    term, df, a, b = (counted[c].to_numpy()[order].astype(float if c != "term" else np.int64) for c in ("term", "df", "a", "b"))
    na, nb = float(max(1, sizes.get(1, 0))), float(max(1, sizes.get(0, 0)))
    idf = np.log((1 + na + nb) / (1 + np.minimum(df, na + nb))) + 1
    return term, lengths, idf * (1 + telling(np.minimum(a, na), np.minimum(b, nb), na, nb))


def telling(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """How much a term in a of na toxic and b of nb clean texts says about the class."""
    part = lambda seen, want: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(want, 1e-300)), 0.0)
    has, lacks = a + b, na + nb - a - b
    g2 = 2 * sum(part(seen, every * n / (na + nb)) for seen, every, n in ((a, has, na), (b, has, nb), (na - a, lacks, na), (nb - b, lacks, nb)))
    odds = np.log((a + 0.5) / (na + 1) * (nb + 1) / (b + 0.5))
    return np.maximum(0.0, 1 - CHANCE / np.maximum(g2, 1e-300)) * np.abs(odds)


def sparse_rows(batch: pa.RecordBatch, column: int, terms: np.ndarray, lengths: tuple[int, ...], tab: dict, cache: dict):
    """(first row, end row, row, term number, frequency) for slices of a text column, by row and number, of the given sorted terms."""
    slots = cache.get("slots")
    if slots is None:
        slots = cache["slots"] = np.zeros(_SLOTS, bool)
        slots[(terms.view(np.uint64) & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
    none = np.zeros(0, np.int64)
    for lo, hi, buf, offsets in slices(batch.column(column)):
        start, end, row = words(buf, offsets, tab)
        if not len(start) or not len(terms):
            yield lo, hi, none, none, none
            continue
        sums = hash_sums(buf, tab, cache)
        word, first, which = np.unique(span_hashes(sums, start, end).view(np.int64), return_index=True, return_inverse=True)
        numbers = np.full((len(word), len(lengths)), -1, np.int64)  # of each different word's terms
        for k, n in enumerate(lengths):
            at = np.arange(len(word)) if n == 0 else np.flatnonzero(end[first] - start[first] > n)
            term = word if n == 0 else (span_hashes(sums, start[first[at]], start[first[at]] + n) ^ _APART).view(np.int64)
            may = slots[(term.view(np.uint64) & np.uint64(_SLOTS - 1)).astype(np.int64)]
            at, term = at[may], term[may]
            found = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            same = terms[found] == term
            numbers[at[same], k] = found[same]
        own = numbers[which]
        pair = (row[:, None] * len(terms) + own)[own >= 0]
        pair, tf = np.unique(pair, return_counts=True)
        yield lo, hi, pair // len(terms), pair % len(terms), tf


def _vectors(sample: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, label, term, tf) of the sample's texts: term numbers and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, cache, (terms, lengths) = term_tables(), {}, shared.value
        for batch in batches:
            for lo, hi, row, number, tf in sparse_rows(batch, 2, terms, lengths, tab, cache):
                cut = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (number, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *lists], ["doc_id", "label", "term", "tf"])

    return sample.mapInArrow(lean(run), "doc_id long, label int, term array<int>, tf array<int>")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Index:
    """An index over a bounded sample of the labelled training rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.sha2(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string")), 256)
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [known.where(F.col("label") == c).orderBy(order).limit(examples) for c in (0, 1)]
    chosen = materialize(drawn[0].union(drawn[1]).withColumnRenamed("doc_id", "example"), "chosen", 2 * examples)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("example"))  # 2 * examples rows at most
    sample = sample.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))  # one text for each
    sample = sample.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label", "text")
    sample = materialize(sample, "sample", 2 * examples * 20)
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    terms, lengths, idf = _weigh_terms(sample, sizes)
    votes = {c: totals.get(c, 0) / max(1, sizes.get(c, 0)) for c in (0, 1)}
    rows = _vectors(sample, Shared(docs.sparkSession, (terms, lengths))).toArrow()  # numbers of 2 * examples texts at most
    held = [(i, c, votes[c], np.array(n), np.array(tf, float)) for i, c, n, tf in zip(*(rows.column(x).to_numpy(zero_copy_only=False) for x in range(4)), strict=True) if len(n)]
    index = build_index(terms, lengths, idf, held, rate)
    index.curve = calibrate(index, held, k)
    return index


def row_scores(index: Index, batch: pa.RecordBatch, column: int, k: int, tab: dict, cache: dict) -> Iterator[tuple[float, list[int]]]:
    """(score, ids of the nearest examples) for each row of the batch; copies of a text are scored once."""
    kept = cache.setdefault("scores", {})
    for lo, hi, row, number, tf in sparse_rows(batch, column, index.terms, index.lengths, tab, cache):
        cut = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
        for a, b in zip(cut, cut[1:], strict=False):
            key = hashlib.blake2b(number[a:b].tobytes() + tf[a:b].tobytes(), digest_size=16).digest()
            if key not in kept:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[key] = index.score(number[a:b], tf[a:b].astype(float), k)
            yield kept[key]


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence string"


def score_toxicity(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """``SCHEMA`` for every row of ``docs``; no exchange."""
    shared = Shared(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tab, cache = shared.value, term_tables(), {}
        for batch in batches:
            found = list(row_scores(index, batch, 2, k, tab, cache))
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([",".join(map(str, ids)) for _, ids in found], pa.string())],
                ["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)


def keep_clean(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5; no exchange."""
    shared = Shared(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tab, cache = shared.value, term_tables(), {}
        for batch in batches:
            clean = [s < 0.5 for s, _ in row_scores(index, batch, batch.schema.get_field_index("text"), k, tab, cache)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit(docs, labels))


QUERIES = {"op8_toxicity_knn": op8_toxicity_knn}
ORACLES: dict[str, str] = {}
