"""How well an import kept its source: lost and glued words, repeated lines, cuts, fragments."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.columns import rstrip
from stratalith.operators.structure import reading_order

#: What a sentence ends with. Fixed value.
SENTENCE_END = r"[.!?:;\"”’)\]—…]$"
#: Types that are no running body.
BESIDE = ("noise", "image", "caption")


def words(text: Column) -> Column:
    """Words of letters, inner apostrophes allowed, in lower case; hyphens don't part them."""
    plain = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    return F.regexp_extract_all(plain, F.lit(r"\p{L}+(?:['’]\p{L}+)?"), F.lit(0))


def word_counts(rows: DataFrame, text: str = "md") -> DataFrame:
    """(doc, word, n)"""
    return rows.select("doc", F.explode(words(F.col(text))).alias("word")).groupBy("doc", "word").agg(F.count("*").alias("n"))


def _cuts(word: Column, first: int, last: Column) -> Column:
    """(a, b) for each cut behind ``first`` to ``last`` characters."""
    at = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.struct(k.alias("k"), F.substr(word, F.lit(1), k).alias("a"), F.substr(word, k + 1).alias("b")))


def words_lost(source: DataFrame, output: DataFrame) -> DataFrame:
    """(doc, word, lost): how often a word of the source counts (doc, word, n) is missing in the output.

    A missing word that is two words of the output put together isn't lost.
    """
    both = source.join(output.withColumnRenamed("n", "kept"), ["doc", "word"], "left")
    lost = both.withColumn("lost", F.col("n") - F.coalesce("kept", F.lit(0))).where("lost > 0").select("doc", "word", "lost")
    split = lost.select("doc", "word", F.explode(_cuts(F.col("word"), 1, F.length("word") - 1)).alias("x")).select("doc", "word", "x.a", "x.b")
    known = output.select("doc", F.col("word").alias("a"))
    explained = split.join(known, ["doc", "a"], "left_semi").join(known.withColumnRenamed("a", "b"), ["doc", "b"], "left_semi").select("doc", "word").distinct()
    return lost.join(explained, ["doc", "word"], "left_anti")


def bigrams(elements: DataFrame, text: str = "md") -> DataFrame:
    """(doc, a, b, n): neighbouring words in reading order, across elements."""
    seq = elements.select("doc", "pos", F.posexplode(words(F.col(text))).alias("k", "a"))
    seq = seq.withColumn("b", F.lead("a").over(Window.partitionBy("doc").orderBy("pos", "k")))
    return seq.where("b is not null").groupBy("doc", "a", "b").agg(F.count("*").alias("n"))


def glued_words(elements: DataFrame, text: str = "md", rare: int = 2, frequent: int = 20, together: int = 5) -> DataFrame:
    """(doc, word, a, b): a rare word of five letters or more that is two frequent words which often stand together.

    A document's text is moved once and its words are counted in one place; words, pairs
    and cuts aren't sent anywhere. Of several cuts the first counts, each part having two
    letters or more. A null doc has no words.
    """
    rows = elements.where("doc is not null").select("doc", "pos", F.col(text).alias("text")).repartition("doc").sortWithinPartitions("doc", "pos")

    def glued(doc, seq):
        counts = Counter(seq)
        some = {w for w, n in counts.items() if n <= rare and len(w) >= 5}
        often = {w for w, n in counts.items() if n >= frequent and len(w) >= 2}
        pairs = Counter((a, b) for a, b in zip(seq, seq[1:], strict=False) if a in often and b in often)
        first: dict = {}
        for (a, b), n in pairs.items():
            if n >= together and a + b in some and len(a) < len(first.get(a + b, (a + b,))[0]):
                first[a + b] = (a, b)
        return [(doc, w, a, b) for w, (a, b) in first.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(4)], ["doc", "word", "a", "b"])

        doc, seq = None, []
        for batch in batches:
            found, at = [], 0
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).tolist()
            for d, n in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().fill_null(0).to_pylist(), strict=True):
                if d != doc:
                    found += glued(doc, seq)
                    doc, seq = d, []
                seq += flat[at : at + n]
                at += n
            yield batch_of(found)
        yield batch_of(glued(doc, seq))

    return rows.select("doc", words(F.col("text")).alias("words")).mapInArrow(run, "doc string, word string, a string, b string")


def repeated_lines(elements: DataFrame, least: int = 3, shorter_than: int = 80) -> DataFrame:
    """(doc, key, pages): short paragraphs that stand on ``least`` pages or more, by their letters a to z only."""
    short = elements.where((F.col("type") == "paragraph") & (F.length("md") < shorter_than)).select("doc", F.regexp_replace(F.lower("md"), "[^a-z]+", "").alias("key"), "page").where("key <> ''")
    return short.groupBy("doc", "key").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least)


def _cut_pairs(elements: DataFrame) -> DataFrame:
    """Neighbouring body paragraphs of which the first doesn't end a sentence and the second begins in lower case."""
    wd = reading_order()
    body = elements.where(~F.col("type").isin(*BESIDE))
    ahead = [F.lead(c).over(wd).alias(f"next_{c}") for c in ("id", "type", "page", "md", *(["continues"] if "continues" in elements.columns else []))]
    pairs = body.select("*", *ahead)
    return pairs.where((F.col("type") == "paragraph") & (F.col("next_type") == "paragraph") & ~rstrip(F.col("md")).rlike(SENTENCE_END) & F.col("next_md").rlike(r"^\p{javaLowerCase}"))


def split_mid_sentence(elements: DataFrame) -> DataFrame:
    """(doc, id, next_id): a sentence cut in two on one page."""
    return _cut_pairs(elements).where(F.col("page").eqNullSafe(F.col("next_page"))).select("doc", "id", "next_id")


def page_break_cuts(elements: DataFrame) -> DataFrame:
    """(doc, id, next_id): a sentence cut by a page's end whose second part isn't marked as going on."""
    pairs = _cut_pairs(elements).where("next_page = page + 1")
    if "next_continues" in pairs.columns:
        pairs = pairs.where("next_continues is null")
    return pairs.select("doc", "id", "next_id")


def short_fragments(elements: DataFrame, most: int = 2) -> DataFrame:
    """(doc, id, n_words): paragraphs of ``most`` words or fewer."""
    n = F.size(F.filter(F.split("md", r"\s+"), lambda w: w != ""))
    return elements.where("type = 'paragraph'").select("doc", "id", n.alias("n_words")).where(F.col("n_words") <= most)


def odd_headings(elements: DataFrame) -> DataFrame:
    """(doc, id): headings that are very short, very long, or end like a sentence."""
    text = F.regexp_replace("md", r"^#+\s*", "")
    return elements.where("type = 'heading'").where((F.length(text) < 3) | (F.length("md") > 120) | F.col("md").rlike("[a-z][.,;]$")).select("doc", "id")


def flat_structure(elements: DataFrame, least_pages: int = 20, share: float = 0.5) -> DataFrame:
    """(doc, parent, children, elements): documents of more than ``least_pages`` pages with most elements under one parent."""
    counts = elements.groupBy("doc", "parent").agg(F.count("*").alias("children"))
    whole = elements.groupBy("doc").agg(F.count("*").alias("elements"), F.count_distinct("page").alias("pages"))
    first = Window.partitionBy("doc").orderBy(F.desc("children"), F.col("parent").asc_nulls_first())
    top = counts.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return top.join(whole, "doc").where((F.col("pages") > least_pages) & (F.col("children") > F.col("elements") * share)).select("doc", "parent", "children", "elements")
