"""A hidden Markov language model, trained by Baum-Welch over all training texts.

Tokens are a text's words with A-Z in lower case, then one end. The base model is
the unigram u(w) = (c + 0.5) / (N + 0.5 * (V + 1)) of the training tokens: c the
token's count, N all, V distinct; an unseen token has c = 0.

The model's states emit classes of tokens, and a class emits its tokens as the base
model does within the class: P(text) = P(classes) * product of u(w) / U(class). The
``OWN`` most frequent tokens and the end are classes of their own, all others fall
into ``SUFFIXES`` classes by their last bytes, and each of these holds one unseen
token besides its known ones, so that U sums up to a proper distribution. So the
model's size is fixed while the counts grow with the corpus, and
log P(text) = base score - sum of log U(class) + log P(classes); the last comes from
the scaled forward recursion, exactly, over the whole text.

Training: Baum-Welch. Each round, every partition runs forward and backward over
its training texts (in segments of ``SEGMENT`` tokens; all are used) and emits
expected counts by class, which are summed by class before they reach the driver
(one row per class). Emissions are smoothed with ``PRIOR`` tokens of U.

Counts: the ``HEAD`` most frequent tokens go to executors as a table of fixed size;
what other tokens add to the base score comes from a join on the token's 64-bit
hash. Texts are parsed twice, never shuffled.

A null text counts as empty: one token, the end. A null doc_id isn't held out.
Repeated rows are learnt from and scored as separate rows. Tokens of equal count go by
their hashes where only some are taken, so that reruns agree. A text of any length is
scored whole, in one recursion. An empty table gives an empty result. Columns besides
doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.textbytes import lean, mix, slices, tables, word_hashes, words
from stratalith.storage import Shared, materialize

STATES = 8
ROUNDS = 6
OWN = 1 << 15
SUFFIXES = 1 << 14
HEAD = 1 << 18
SLOTS = 1 << 20
SEGMENT = 256
LANES = 512
PRIOR = 2000.0
#: The end, as a token; hashes of words don't take a value on purpose.
END = -7046029254386353131
_FLUSH = 1 << 19


def _suffix(buf: np.ndarray, start: np.ndarray, end: np.ndarray, tab: dict) -> np.ndarray:
    """A class from the last three bytes of each word."""
    low, code = tab["lower"], np.zeros(len(start), np.uint64)
    for k in range(1, 4):
        at = end - k
        inside = at >= start
        code = code * np.uint64(257) + np.where(inside, low[buf[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    with np.errstate(over="ignore"):
        return (mix(code) % np.uint64(SUFFIXES)).astype(np.int64)


def _tokens(batch: pa.RecordBatch, column: int, tab: dict, cache: dict):
    """(first row, end row, token, suffix class, first token of each row, tokens of each row)."""
    for lo, hi, buf, offsets in slices(batch.column(column)):
        start, end, row = words(buf, offsets, tab)
        hashes = word_hashes(buf, start, end, tab, cache).view(np.int64)
        n = np.bincount(row, minlength=hi - lo) if len(row) else np.zeros(hi - lo, np.int64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        last = first + n
        yield lo, hi, np.insert(hashes, last, END), np.insert(_suffix(buf, start, end, tab), last, 0), first + np.arange(hi - lo), n + 1


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, suffix, c) over all texts of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, cache = tables(), {}
        held: list[tuple] = []

        def merged():
            token, suffix, c = (np.concatenate(x) for x in zip(*held, strict=True))
            distinct, at, back = np.unique(token, return_index=True, return_inverse=True)
            return distinct, suffix[at], np.bincount(back, c).astype(np.int64)

        def out(part):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["token", "suffix", "c"])

        size = 0
        for batch in batches:
            for _, _, token, suffix, _, _ in _tokens(batch, 0, tab, cache):
                distinct, at, c = np.unique(token, return_index=True, return_counts=True)
                held.append((distinct, suffix[at], c))
                size += len(distinct)
                if size > _FLUSH:
                    part = merged()
                    held, size = [part], len(part[0])
                    if size > _FLUSH // 2:
                        yield out(part)
                        held, size = [], 0
        if held:
            yield out(merged())

    parts = docs.select("text").mapInArrow(lean(run), "token long, suffix long, c long")
    return parts.groupBy("token").agg(F.first("suffix").alias("suffix"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What executors need to parse texts: fixed size, whatever the corpus."""

    token: np.ndarray  # by slot
    count: np.ndarray
    own: np.ndarray  # class, or -1
    total: float  # N + 0.5 * (V + 1)
    mass: np.ndarray  # U by class

    def look_up(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, count, class or -1) of each token."""
        slot = (token.view(np.uint64) >> np.uint64(64 - int(SLOTS).bit_length() + 1)).astype(np.int64)
        found = self.token[slot] == token
        return found & (self.count[slot] > 0), np.where(found, self.count[slot], 0), np.where(found, self.own[slot], -1)


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary and N. The end is class 0, then come the frequent tokens, then the suffixes."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = n + 0.5 * (v + 1)
    # a step of counts from which on there are HEAD tokens at most: a histogram, not a sort of all tokens
    step = F.floor(F.log2("c") * 16).cast("int")
    least, seen = 0, 0
    for s, many in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        least, seen = s, seen + many
        if seen > HEAD:
            least += 1
            break
    top = counts.where((step >= least) | (F.col("token") == END)).toPandas()
    top = top[top["token"] != END].sort_values(["c", "token"], ascending=[False, True])
    ends = counts.where(F.col("token") == END).first()
    token, c = np.append(top["token"].to_numpy(np.int64), END), np.append(top["c"].to_numpy(np.int64), ends["c"] if ends else 0)
    suffix = np.append(top["suffix"].to_numpy(np.int64), 0)
    own = np.where(np.arange(len(token)) < OWN, np.arange(len(token)) + 1, -1)
    own[-1] = 0
    slot = (token.view(np.uint64) >> np.uint64(64 - int(SLOTS).bit_length() + 1)).astype(np.int64)
    table = Vocabulary(np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.full(SLOTS, -1, np.int32), total, np.zeros(1 + OWN + SUFFIXES))
    order = np.arange(len(token) - 2, -1, -1)  # rarer first, so that in a slot the most frequent stays
    for k in (order, np.array([len(token) - 1])):
        table.token[slot[k]], table.count[slot[k]], table.own[slot[k]] = token[k], c[k], own[k]
    mine = (table.token[slot] == token) & (own >= 0)
    for s, mass in counts.groupBy("suffix").agg(F.sum(F.col("c") + 0.5)).collect():  # SUFFIXES rows at most
        table.mass[1 + OWN + s] = mass / total
    np.subtract.at(table.mass, 1 + OWN + suffix[mine & (c > 0)], (c[mine & (c > 0)] + 0.5) / total)
    table.mass[own[mine]] = (c[mine] + 0.5) / total
    table.mass[1 + OWN :] = np.maximum(table.mass[1 + OWN :], 0) + 0.5 / total
    return table, int(n)


SEQUENCES = "doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, tail array<long>, classes binary"


def sequences(docs: DataFrame, vocab) -> DataFrame:
    """``SEQUENCES``: each text as classes, with its share of the base score and the tokens that the table lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, cache, table = tables(), {}, vocab.value
        for batch in batches:
            for lo, hi, token, suffix, first, n in _tokens(batch, 2, tab, cache):
                found, c, own = table.look_up(token)
                score = np.where(found, np.log10((c + 0.5) / table.total), 0.0)
                classes = np.where(own >= 0, own, 1 + OWN + suffix).astype(np.uint16)
                ends = (first + n).tolist()
                begins = first.tolist()
                lost = ~found
                n_lost = np.add.reduceat(lost, first)
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_lost)]), pa.int32()), pa.array(token[lost]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(n),
                        pa.array(n - n_lost),
                        pa.array(np.add.reduceat(score, first)),
                        tail,
                        pa.array([classes[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "held_out", "n_tokens", "head_known", "head_score", "tail", "classes"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(lean(run), SEQUENCES)


@dataclass
class Hmm:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


def first_guess(mass: np.ndarray, states: int) -> Hmm:
    rng = np.random.default_rng(11)
    emit = mass[:, None] * np.exp(rng.normal(0, 1, (len(mass), states)))
    emit /= emit.sum(axis=0)
    stay = 0.95 if states > 1 else 1.0
    move = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(move, stay)
    return Hmm(np.full(states, 1 / states), move, emit)


def segments(classes: list[np.ndarray], pad: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (time, lane) of segments of similar length, padded with ``pad``, and which entries are real."""
    parts = [s[k : k + SEGMENT] for s in classes for k in range(0, len(s), SEGMENT)]
    parts.sort(key=len)
    for k in range(0, len(parts), LANES):
        some = parts[k : k + LANES]
        block = np.full((len(some), len(some[-1])), pad, np.int64)
        for r, s in enumerate(some):
            block[r, : len(s)] = s
        yield np.ascontiguousarray(block.T), np.ascontiguousarray((block != pad).T)


def expected_counts(hmm: Hmm, block: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(start, move, emit by class and state, log likelihood) expected in a block of segments."""
    steps, lanes = block.shape
    states = len(hmm.start)
    one = np.vstack([hmm.emit, np.ones(states)])
    e = one[block]
    alpha, scale = np.empty((steps, lanes, states)), np.empty((steps, lanes))
    a = hmm.start * e[0]
    for t in range(steps):
        if t:
            a = (alpha[t - 1] @ hmm.move) * e[t]
        scale[t] = a.sum(axis=1)
        alpha[t] = a / scale[t][:, None]
    move, beta = np.zeros((states, states)), np.ones((lanes, states))
    emit = np.empty((steps, lanes, states))
    emit[-1] = alpha[-1]
    for t in range(steps - 2, -1, -1):
        ahead = e[t + 1] * beta / scale[t + 1][:, None]
        move += alpha[t].T @ (ahead * real[t + 1][:, None])
        beta = ahead @ hmm.move.T
        emit[t] = alpha[t] * beta
    flat, size = block.reshape(-1), len(one)
    by_class = np.stack([np.bincount(flat, emit[:, :, k].reshape(-1), size)[:-1] for k in range(states)], axis=1)
    return emit[0].sum(axis=0), move * hmm.move, by_class, float(np.log(scale[real]).sum())


def train(seqs: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """Baum-Welch over the ``classes`` of ``seqs``: the model, and the log likelihood before each round."""
    spark = seqs.sparkSession
    hmm, likelihood = first_guess(mass, states), []
    names = [f"s{k}" for k in range(states)]
    schema = "class int, " + ", ".join(f"{n} double" for n in names)
    width = len(mass)
    for _ in range(rounds):
        sent = Shared(spark, hmm)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model = sent.value
            start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((width, states)), 0.0
            for batch in batches:
                classes = [np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()]
                for block, real in segments(classes, width):
                    s, m, e, log = expected_counts(model, block, real)
                    start, move, emit, total = start + s, move + m, emit + e, total + log
            at = np.flatnonzero(emit.any(axis=1))
            # below the classes: -1 the starts, -2 the likelihood, then a row per state it moves from
            rows = np.vstack([emit[at], start, np.eye(1, states)[0] * total, move])
            key = np.concatenate([at, [-1, -2], -3 - np.arange(states)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(states))], ["class", *names])

        found = seqs.select("classes").mapInArrow(lean(run), schema).groupBy("class").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        key, value = found["class"].to_numpy(), found[names].to_numpy()
        emit, start, move = np.zeros((width, states)), np.full(states, 1e-3), np.full((states, states), 1e-3)
        emit[key[key >= 0]] = value[key >= 0]
        for k, row in zip(key, value, strict=True):
            if k == -1:
                start = start + row
            elif k == -2:
                likelihood.append(float(row[0]))
            elif k < -2:
                move[-3 - k] += row
        emit += PRIOR * (mass / mass.sum())[:, None]
        hmm = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        sent.drop()
    return hmm, likelihood


def forward(hmm: Hmm, classes: list[np.ndarray]) -> np.ndarray:
    """log10 P of each sequence, by the scaled forward recursion; sequences advance together."""
    out = np.zeros(len(classes))
    order = sorted((k for k in range(len(classes)) if len(classes[k])), key=lambda k: -len(classes[k]))
    if not order:
        return out
    length = np.array([len(classes[k]) for k in order])
    flat = np.concatenate([classes[k] for k in order]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    log, a = np.zeros(len(order)), np.tile(hmm.start, (len(order), 1))
    for t, n in enumerate(alive.tolist()):
        now = a[:n] @ hmm.move if t else a[:n]
        now = now * hmm.emit[flat[begin[:n] + t]]
        scale = now.sum(axis=1)
        a[:n] = now / scale[:, None]
        log[:n] += np.log10(scale)
    out[order] = log
    return out


def hmm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % 5
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = materialize(token_counts(docs.where("not held_out")), "counts")
    table, n = vocabulary(counts)
    vocab = Shared(spark, table)
    seqs = materialize(sequences(docs, vocab).withColumn("row", F.monotonically_increasing_id()), "sequences")
    hmm, _ = train(seqs.where("not held_out"), table.mass, states, rounds)
    model = Shared(spark, (hmm, np.log10(np.maximum(table.mass, 1e-300))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, log_mass = model.value
        for batch in batches:
            classes = [np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]
            gain = forward(hmm, classes) - np.array([log_mass[c].sum() for c in classes])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain)], ["row", "gain"])

    unseen = float(np.log10(0.5 / table.total))
    tail = seqs.select("row", F.explode("tail").alias("token")).join(counts.select("token", "c"), "token", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNull(), F.lit(unseen)).otherwise(F.log10((F.col("c") + 0.5) / table.total))).alias("tail_score"),
        F.count("c").alias("tail_known"),
    )
    gains = seqs.select("row", "classes").mapInArrow(lean(run), "row long, gain double")
    rows = seqs.drop("classes", "tail").join(gains, "row").join(tail, "row", "left")
    base = F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score")
    )


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_hmm_lm": op5_hmm_lm}
ORACLES: dict[str, str] = {}
