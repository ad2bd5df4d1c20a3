"""Token counts under a unigram tokenizer, by trie-shared dynamic programming.

A text's pre-tokens are its words (runs of bytes other than white space), each with
the word mark before it. A pre-token's pieces are those of its most probable
segmentation, among equally probable ones of one with the fewest pieces; a character
that no piece covers falls back to one token per byte; equal scores and counts are one
result, whichever segmentation they come from. The counts belong to the unigram
tokenizer over the pieces of a public vocabulary file. Such a file ranks its pieces and
has no probabilities, and tokenizers aren't trained here, so these are given by the
Zipf-Mandelbrot law: the i-th piece's is proportional to 1 / (i + ``SHIFT``). The file's
path is a parameter; only the driver reads it, and its pieces (a fixed number) are
broadcast.

Distinct pre-tokens are put into a trie; the forward score of a prefix (its best log
probability and piece count) is computed once, when its node is made, from the scores
on the path to it, and the count of a terminal node is stored by pre-token. Which
pieces end at a node comes from an automaton over all pieces whose state the node
holds. Trie and counts are kept over a task's batches up to ``NODES`` nodes and ``KEPT``
pre-tokens and then begun anew. A pre-token of more than ``LONG`` characters shares next to
nothing: its forward scores run through an array as long as the longest piece, and no node
is made. So memory is bounded, however long a text or word is.

A null text counts as empty and has 0 tokens. Repeated rows get repeated results, an
empty table an empty one; columns besides doc_id and text aren't read, whatever their
names.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.textbytes import lean, slices, tables, word_hashes, words
from stratalith.storage import Shared

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHIFT = 2.7
BYTE_COST = 12.0  # nats over the rarest piece, for a byte that stands alone
KEPT = 1 << 19
NODES = 1 << 20
LONG = 64


def read_pieces(path: str) -> list[str]:
    """The pieces of a vocabulary file in the order of their rank, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k) or model.is_unused(k)))
    return [model.id_to_piece(k) for k in keep]


def log_probabilities(pieces: list[str]) -> dict[str, float]:
    total = sum(1 / (k + SHIFT) for k in range(len(pieces)))
    return {p: -math.log((k + SHIFT) * total) for k, p in enumerate(pieces)}


class Pieces:
    """An automaton over all pieces: a state's ``out`` are the (length, score) of the pieces that end there."""

    def __init__(self, scores: dict[str, float]):
        self.go: list[dict[str, int]] = [{}]
        self.out: list[list[tuple[int, float]]] = [[]]
        for piece, score in scores.items():
            at = 0
            for ch in piece:
                then = self.go[at].get(ch)
                if then is None:
                    then = self.go[at][ch] = len(self.go)
                    self.go.append({})
                    self.out.append([])
                at = then
            if at:
                self.out[at].append((len(piece), score))
        self.back = [0] * len(self.go)  # the state of the longest proper suffix
        todo = list(self.go[0].values())
        for at in todo:
            for ch, then in self.go[at].items():
                self.back[then] = self.step(self.back[at], ch)
                todo.append(then)
            self.out[at] = self.out[at] + self.out[self.back[at]]
        self.floor = min(scores.values(), default=0.0) - BYTE_COST
        self.longest = max(map(len, scores), default=1)

    def step(self, at: int, ch: str) -> int:
        while ch not in self.go[at]:
            if not at:
                return 0
            at = self.back[at]
        return self.go[at][ch]


class Trie:
    """Pre-tokens as paths; a node is (children, score, count, state of the automaton)."""

    def __init__(self):
        self.top: dict = {}
        self.nodes = 0


def _count_long(token: str, pieces: Pieces) -> int:
    """The piece count of one token, with the forward scores of its last characters only."""
    floor, step, ends, room = pieces.floor, pieces.step, pieces.out, pieces.longest + 1
    scores, counts, state = [0.0] * room, [0] * room, 0
    for i, ch in enumerate(token, 1):
        state = step(state, ch)
        width = len(ch.encode("utf-8", "surrogatepass"))
        best, count = scores[(i - 1) % room] + floor * width, counts[(i - 1) % room] + width
        for length, score in ends[state]:
            at = (i - length) % room
            score += scores[at]
            if score > best or score == best and counts[at] + 1 < count:
                best, count = score, counts[at] + 1
        scores[i % room], counts[i % room] = best, count
    return counts[len(token) % room]


def count_pieces(tokens: list[str], pieces: Pieces, trie: Trie) -> list[int]:
    """Piece counts of ``tokens``; ``trie`` grows by the short ones, and begins anew where it is full."""
    out, floor, step, ends = [], pieces.floor, pieces.step, pieces.out
    for token in tokens:
        if len(token) > LONG:
            out.append(_count_long(token, pieces))
            continue
        if trie.nodes > NODES:
            trie.top, trie.nodes = {}, 0
        children, state, scores, counts = trie.top, 0, [0.0], [0]
        for i, ch in enumerate(token):
            node = children.get(ch)
            if node is None:
                then = step(state, ch)
                width = len(ch.encode("utf-8", "surrogatepass"))
                best, count = scores[i] + floor * width, counts[i] + width
                for length, score in ends[then]:
                    score += scores[i + 1 - length]
                    if score > best or score == best and counts[i + 1 - length] + 1 < count:
                        best, count = score, counts[i + 1 - length] + 1
                node = children[ch] = ({}, best, count, then)
                trie.nodes += 1
            children, best, count, state = node
            scores.append(best)
            counts.append(count)
        out.append(counts[-1])
    return out


SCHEMA = "doc_id long, n_words long, n_tokens long"


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``SCHEMA`` for every row of ``docs``; no exchange."""
    scores = log_probabilities(read_pieces(path))
    shared = Shared(docs.sparkSession, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a trie has no cycles, and looking for them costs as much as building it
        pieces, trie = Pieces(shared.value), Trie()
        tab, cache = tables() | {"lower": np.arange(256, dtype=np.uint8)}, {}
        kept: dict[int, int] = {}
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column(1)):
                start, end, row = words(buf, offsets, tab)
                distinct, first, back = np.unique(word_hashes(buf, start, end, tab, cache), return_index=True, return_inverse=True)
                keys = distinct.tolist()
                new = [k for k, h in enumerate(keys) if h not in kept]
                body = buf.tobytes()
                tokens = [MARK + body[start[first[k]] : end[first[k]]].decode("utf-8", "surrogatepass") for k in new]
                if len(kept) + len(new) > KEPT:
                    kept = {h: kept[h] for h in keys if h in kept}
                for k, n in zip(new, count_pieces(tokens, pieces, trie), strict=True):
                    kept[keys[k]] = n
                count = np.array([kept[h] for h in keys], np.int64)
                total = np.bincount(row, count[back], hi - lo).astype(np.int64) if len(row) else np.zeros(hi - lo, np.int64)
                n_words = np.bincount(row, minlength=hi - lo) if len(row) else total
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(total)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_trie_token_counts": op10_trie_token_counts}
ORACLES: dict[str, str] = {}
