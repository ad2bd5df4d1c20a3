"""TF-IDF retrieval with access filtering, vector retrieval, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.storage import Shared, materialize

#: Words that carry no meaning for a search. Fixed values.
STOP_WORDS = "a an and are as at be by did do does for from how in is it of on or the this to was were what when where which who why with".split()


def tokens(text: Column) -> Column:
    """Words of ASCII letters and digits in lower case, repeated ones kept, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)"""
    return rows.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def inverse_frequency(counts: DataFrame, key: str, n: int) -> DataFrame:
    """(term, df, idf) with idf = ln((n + 1) / (df + 1)) + 1."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0)


def weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w): (1 + ln tf) * idf, an unknown term's idf being 1, over the vector's length."""
    w = counts.join(idf.select("term", "idf"), "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0)))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, key).select(key, "term", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"), "norm")


class TfidfIndex:
    """Weights of all chunks (id, text, and access if asked for), written once, as a table by term, for all searches."""

    def __init__(self, chunks: DataFrame, key: str = "id", text: str = "text", access: str | None = None):
        self.key, self.access = key, access
        counts = materialize(term_counts(chunks, key, text), "terms")
        self.n = chunks.count()
        self.idf = materialize(inverse_frequency(counts, key, self.n), "idf")
        self.weights = materialize(weights(counts, self.idf, key).select(key, "term", "w"), "weights")
        self.groups = chunks.select(key, access) if access else None

    def search(self, queries: DataFrame, query_key: str, query_text: str, top: int = 3, allowed: tuple[str, ...] | None = None) -> DataFrame:
        """(query, key, score, rank): the ``top`` chunks of positive cosine, ties by key.

        Chunks that share no group with ``allowed`` are left out before anything is scored.
        """
        q = weights(term_counts(queries, query_key, query_text), self.idf, query_key).select(query_key, "term", F.col("w").alias("qw"))
        q = materialize(q, "query-terms")  # its size is known then: few queries are broadcast, many are joined by term
        own = self.weights
        if allowed is not None and self.groups is not None:
            own = own.join(self.groups.where(F.arrays_overlap(F.col(self.access), F.array(*[F.lit(a) for a in allowed]))).select(self.key), self.key, "left_semi")
        scores = own.join(q, "term").groupBy(query_key, self.key).agg(F.round(F.sum(F.col("w") * F.col("qw")), 9).alias("score")).where("score > 0")
        rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), self.key))
        return scores.withColumn("rank", rank).where(F.col("rank") <= top)


def hit_rate(hits: DataFrame, chunks: DataFrame, answers: DataFrame, query_key: str, key: str = "id", text: str = "text", k: int = 5) -> DataFrame:
    """(questions, hits): questions with the answer's text in one of the first k chunks."""
    got = hits.where(F.col("rank") <= k).join(chunks.select(key, F.col(text).alias("__t")), key).join(answers.select(query_key, "answer"), query_key)
    found = got.where(F.instr("__t", F.col("answer")) > 0).select(query_key).distinct()
    marked = answers.select(query_key).join(found.withColumn("__hit", F.lit(1)), query_key, "left")
    return marked.agg(F.count("*").alias("questions"), F.count("__hit").alias("hits"))


#: Queries whose vectors are broadcast at once, by a hash of their key: with 1,000 dimensions about 32 MB.
QUERY_BLOCK = 4096


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str, vector: str, top: int) -> DataFrame:
    """(query, key, score, rank): the ``top`` rows of ``vectors`` by cosine for each query, but itself.

    Queries go through in blocks of ``QUERY_BLOCK``; each partition keeps its own best
    for each query, and only these meet in a shuffle.
    """
    listed = materialize(queries.select(key, vector).where(F.col(vector).isNotNull()), "queries")
    blocks = -(-listed.count() // QUERY_BLOCK)
    out = None
    for block in range(blocks):
        some = listed.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).toPandas()
        if some.empty:
            continue
        q = np.stack(some[vector].to_numpy()).astype(float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = Shared(vectors.sparkSession, (some[key].to_numpy(), q))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for batch in batches:
                batch = batch[batch[vector].notna()]
                if batch.empty:
                    continue
                ids, m = batch[key].to_numpy(), np.stack(batch[vector].to_numpy()).astype(float)
                score = np.round(q @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T, 9)
                score[names[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :top]
                best = np.take_along_axis(score, order, axis=1)
                yield pd.DataFrame({"query": np.repeat(names, order.shape[1]), key: ids[order].reshape(-1), "score": best.reshape(-1)})

        part = vectors.select(key, vector).mapInPandas(run, f"query long, {key} long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], f"query long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return out.where("score > double('-infinity')").withColumn("rank", rank).where(F.col("rank") <= top)
