"""Mixing sources to target weights by Pareto order sampling.

The targets: sources, in code point order with null last, weigh ``WEIGHTS`` in
turn and share ``SHARE`` times all words by weight; a source's target stops at
``MAX_COPIES`` times its words, and what is over goes to the others by weight
until none is above. Sorted by words over weight, the sources that stop are a
prefix, so one pass of running sums over the table of sources finds the level.

The sample: a document of a source is wanted target / words times. The whole
part is certain: that many copies are taken. The rest is an inclusion
probability p, and documents are ranked by their random odds u / (1 - u) over
their inclusion odds p / (1 - p), u being a hash of seed and doc_id. In that order
they are taken until the source's words are full. The sample's fixed size is
counted in words, so the document at the edge is taken in part. Weights by
document make p unequal within a source; sources differ in any case. A document
is taken at most once beyond its certain copies, so strong weights near the cap can
leave a source short of its target; equal weights can't.

Ranking a source in one task would put a third of all rows there. Ranks are cut
into ``BUCKETS`` ranges of equal expected size instead; a table of words per
(source, range), pre-aggregated before its shuffle, gives what goes before each
range, and a running sum in each range does the rest.

A null text has no words, and a document without words is taken 0 times. Null is
a source like any other. Repeated rows are sampled as separate rows; a null doc_id
is hashed as the word null. Documents of equal rank go by doc_id, then by size. Texts of
any length are counted whole. An empty table gives an empty result. Only the named columns
are read, whatever else there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.llm.rowsets import free_name, row_key
from stratalith.llm.textbytes import WORD
from stratalith.storage import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BUCKETS = 1024
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_no, source_size, target, mean_weight for (source, size, weight) rows.

    One row per source goes through the windows here, not one per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("weighed"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    named = totals.withColumn("source_no", F.row_number().over(order)).withColumn("w", F.element_at(turn, ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    named = named.withColumn("cap", F.col("source_size") * max_copies).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    named = named.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))
    named = named.withColumn("fit", F.min(fits).over(every)["level"])
    return named.select(
        "source", "source_no", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("fit") * F.col("w")), F.col("cap").cast("double")).alias("target"), (F.col("weighed") / F.col("source_size")).alias("mean_weight")
    )


def uniform(doc_id: Column, seed: str) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _odds(c: Column) -> Column:
    return F.when(c <= 0, F.lit(1e-12)).when(c >= 1, F.lit(1e12)).otherwise(c / (1 - c))


def _ranked(sizes: DataFrame, targets: DataFrame, max_copies: int, seed: str, doc_id: str = "doc_id", size: str = "size", source: str = "source", weight: Column | None = None) -> DataFrame:
    """Adds a struct ``__plan`` to rows of documents: source_no, source_size, target, whole copies, p, base_p, rank and the words at stake (part)."""
    t = targets.select(F.struct("source", "source_no", "source_size", "target", "mean_weight").alias("__t"))
    rows = sizes.join(t, F.col(source).eqNullSafe(F.col("__t.source")))
    mean = F.coalesce(F.col("__t.target") / F.col("__t.source_size"), F.lit(0.0))
    wanted = F.coalesce(F.col("__t.target") / F.col("__t.source_size") * ((F.lit(1.0) if weight is None else weight) / F.col("__t.mean_weight")), F.lit(0.0))
    whole = F.least(F.floor(wanted), F.lit(max_copies)).cast("long")
    p = F.least(wanted - whole, F.lit(1.0))
    rank = _odds(uniform(F.col(doc_id), seed)) / _odds(p)
    part = F.when(whole < max_copies, F.col(size)).otherwise(F.lit(0).cast("long"))
    plan = F.struct("__t.source_no", "__t.source_size", "__t.target", whole.alias("whole"), p.alias("p"), (mean - F.floor(mean)).alias("base_p"), rank.alias("rank"), part.alias("part"))
    return rows.withColumn("__plan", plan).drop("__t")


def _sampled(rows: DataFrame) -> DataFrame:
    """Adds ``sampled``: the words taken of each row beyond its certain copies, by rank until its source's words are full."""
    even = F.col("rank") * _odds(F.col("base_p"))  # u's own odds where all documents weigh the same
    rows = rows.withColumn("range", F.least(F.floor(even / (1 + even) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    held = rows.groupBy("source_no", "range").agg(F.sum("part").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
    source = Window.partitionBy("source_no")
    held = held.select(
        F.col("source_no").alias("held_no"),
        F.col("range").alias("held_range"),
        F.coalesce(F.sum("words").over(source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("certain").over(source).alias("certain"),
    )
    rows = rows.join(held, (F.col("source_no") == F.col("held_no")) & (F.col("range") == F.col("held_range")))
    up_to = Window.partitionBy("source_no", "range").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.round("target").cast("long") - F.col("certain") - F.col("before") - F.coalesce(F.sum("part").over(up_to), F.lit(0))
    return rows.withColumn("sampled", F.greatest(F.least(F.col("part"), room), F.lit(0)))


def _words() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _sizes(docs: DataFrame, weights: tuple[int, ...], share: float, max_copies: int, by: Column) -> tuple[DataFrame, DataFrame]:
    """(sizes, targets), both written."""
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words().alias("size"), by.alias("weight")), "sizes")
    return sizes, materialize(source_targets(sizes, weights, share, max_copies), "targets", 1)  # the windows have it in one task


def mix_sources(docs: DataFrame, weight: str | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, whole_copies, inclusion for every row.

    ``weight`` names a column of positive document weights (null: 1).
    """
    by = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    sizes, targets = _sizes(docs, weights, share, max_copies, by)
    rows = _sampled(_ranked(sizes, targets, max_copies, seed, weight=F.col("weight")).select("doc_id", "size", "__plan.*"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("sampled")).alias("taken"), F.col("whole").alias("whole_copies"), F.col("p").alias("inclusion"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents that the mix takes words of, with all columns, and mix_taken, mix_whole_copies, mix_size, mix_target.

    A source is taken in the order of its ranks up to one document, so that a row's
    own rank and its source's last one say what is taken of it, and no text is moved.
    Repeated rows have one rank and get one decision. Columns that have such names
    already stay, and the new ones get underscores behind theirs.
    """
    named = docs.select(row_key().alias("doc_id"), "source", "text")
    sizes, targets = _sizes(named, WEIGHTS, SHARE, MAX_COPIES, F.lit(1.0))
    planned = _sampled(_ranked(sizes, targets, MAX_COPIES, seed).select("doc_id", "size", "__plan.*"))
    last = planned.where("sampled > 0").groupBy("source_no").agg(F.max(F.struct("rank", "doc_id", "size", "sampled")).alias("last"))
    last = materialize(last.select(F.col("source_no").alias("last_no"), "last"), "last-ranks", 1 << 16)

    own = {name: free_name(name, docs.columns) for name in ("__key", "__size", "__source")}
    rows = docs.withColumn(own["__key"], row_key()).withColumn(own["__size"], _words()).withColumn(own["__source"], F.col("source").cast("string"))
    rows = rows.select(F.struct(*docs.columns).alias("__row"), *[F.col(v).alias(k) for k, v in own.items()])
    rows = _ranked(rows, targets, MAX_COPIES, seed, "__key", "__size", "__source").join(last, F.col("__plan.source_no") == F.col("last_no"), "left")
    at = F.struct(F.col("__plan.rank"), F.col("__key"), F.col("__size"))
    edge = F.struct(F.col("last.rank"), F.col("last.doc_id"), F.col("last.size"))
    part = F.when(F.col("last").isNull(), 0).when(at < edge, F.col("__plan.part")).when(at == edge, F.col("last.sampled")).otherwise(0)
    taken = F.col("__plan.whole") * F.col("__size") + part
    more = {"mix_taken": taken, "mix_whole_copies": F.col("__plan.whole"), "mix_size": F.col("__size"), "mix_target": F.col("__plan.target")}
    return rows.where(taken > 0).select("__row.*", *[c.alias(free_name(name, docs.columns)) for name, c in more.items()])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("inclusion")


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLES = {
    "op1_mix_sources": r"""
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                   (('0x' || substr(sha256('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
            from documents
        ), s as (
            select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as source_no from d group by source
        ), w as (
            select *, [5, 2, 1][((source_no - 1) % 3 + 1)::int] as w, source_size * 2 as cap from s
        ), l as (
            select *, cap / w as ratio,
                   (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, source_no rows between unbounded preceding and 1 preceding), 0))
                   / (sum(w) over () - coalesce(sum(w) over (order by cap / w, source_no rows between unbounded preceding and 1 preceding), 0)) as lev
            from w
        ), f as (select arg_min(lev, ratio) as fit from l where lev <= ratio),
        t as (select source, source_no, source_size, least(cap::double, fit * w) as target from l, f),
        r as (
            select doc_id, size, source_no, source_size, target, u, coalesce(target / nullif(source_size, 0), 0) as wanted from d join t on d.source is not distinct from t.source
        ), p as (
            select *, least(floor(wanted), 2)::bigint as whole, least(wanted - least(floor(wanted), 2), 1.0::double) as p from r
        ), q as (
            select *, (u / (1 - u)) / (case when p <= 0 then 1e-12::double when p >= 1 then 1e12::double else p / (1 - p) end) as rk,
                   case when whole < 2 then size else 0 end as part
            from p
        )
        select doc_id, size, source_size, target, whole as whole_copies,
               (whole * size + greatest(least(part, round(target)::bigint - (sum(whole * size) over (partition by source_no))::bigint
                   - coalesce(sum(part) over (partition by source_no order by rk, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint), 0))::bigint as taken
        from q
    """
}
