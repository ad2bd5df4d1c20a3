"""Benchmark decontamination by template canonicalisation.

Texts become templates: runs of letters and digits in lower case, with placeholders
for numbers, for units behind numbers, and for names (capitalised words inside a
sentence). An item gives two templates, one of its text as it stands and one of its
text in lower case, so that leaks that lost their case match as well.

A second reading takes a run of capitalised words, at the beginning of a sentence too,
as one name, and a number with its unit as one number, so that a slot whose value
changes its number of words ("Berlin", "New York"; "5km", "5 km") or stands first in a
sentence stays one slot. Documents and items have both readings.

A leak begins with a run of words that agree: ``WIDTH`` of them for items of 13 words and
more, for shorter ones as many (``SHORT_WIDTH`` at least) as are left beside one changed
word, and the whole item where it has under ``WIDTH`` words, one of them at least being no
placeholder. Runs are found by windows. Any ``WIDTH`` words in a row hold a window of one
word less at an even place, so that much of an item is hashed at every place and of a
document at every second one, and no run is lost; shorter runs are hashed at every place.
A bitmap of fixed size holds the items' hashes as a literal and sifts a document's windows
inside the row; only what passes is hash-joined with the items' windows, exactly, with the
words round the hit and not with the whole text. Each run is then laid over the whole item.
Runs at different shifts, up to the item's length apart, are chained in order (the longest
common subsequence of their agreeing words), so words may be inserted or left out between
them. A document holds the item if ``COVERAGE`` of the item's words agree (``CLOSE`` if no
``WIDTH`` of them in a row do), or ``LONG`` words in a row with their values, if
``LITERALS`` of them, or as many as the item has, are no placeholders, and if the slots are
consistent: equal values in the item have equal values in the document and different ones
different ones. Numbers and names that differ all the same way make a re-parameterised
question; values that don't fit make another text.

Items under ``SHORTEST`` words, and those of placeholders alone, are held by what has all
their words in a row, values included; items under ``SHORT_WIDTH`` words only by a text that
says nothing else. An item without words is held by nothing. The items' tables are broadcast
up to ``BROADCAST_ROWS`` windows, and shuffled beyond.

Result: one row per doc_id and item_id that match, with the best alignment (ties: the
first reading, the fewest changed slots); null texts match nothing, repeated rows of one
doc_id give one row, empty tables an empty result. Texts of any length are searched whole.
Only doc_id, item_id and the texts are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.llm.rowsets import bit_test, bitmap_bytes, row_key, without_rows
from stratalith.storage import materialize

WIDTH = 6
#: Words between the places at which a document's windows are hashed, where a run holds a word more than its window.
STRIDE = 2
SHORT_WIDTH = 3
SHORTEST = 4
COVERAGE = 0.5
CLOSE = 0.75
#: The usual length of a run that gives a text away.
LONG = 13
LITERALS = 4
BITS = 1 << 20
BROADCAST_ROWS = 1 << 18
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: Units that count as such behind a number.
UNITS = (
    "km m cm mm kg g mg t lb lbs oz mile miles mi metre metres meter meters hour hours h hr hrs minute minutes min second seconds sec s day days week weeks month months year years yr "
    "dollar dollars euro euros cent cents pound pounds usd eur gbp percent degree degrees litre litres liter liters l ml gallon gallons feet foot ft inch inches yard yards mph kmh kph w kw v hz gb mb kb tb"
).split()


_SIGN = rf"\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}"
#: A number begins behind no letter or digit; that is tested on digits only, as most places aren't.
_NUMBER = r"[0-9](?<![\p{L}0-9][0-9])[0-9]*(?:[.,][0-9]+)*"


def template_words(text: Column) -> Column:
    """The text's template: runs of letters, digits and placeholders, in lower case."""
    out = F.regexp_replace(text, r"\p{Lu}(?<=[^.!?:\s][ \t]\p{Lu})\p{Ll}\p{L}*", NAME)
    units = NUMBER + r"( ?)(?i:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + rf")(?![{_SIGN}])"
    numbered = F.regexp_replace(F.regexp_replace(out, _NUMBER, NUMBER), units, NUMBER + "$1" + UNIT)
    out = F.when(text.rlike("[0-9]"), numbered).otherwise(out)
    return F.array_remove(F.split(F.lower(out), f"[^{_SIGN}]+", -1), "")


def plain_words(text: Column) -> Column:
    """The words that ``template_words`` has, at the same places, with their values."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:[.,][0-9]+)*[\p{L}\p{N}]*|[\p{L}\p{N}]+"), F.lit(0))


#: Letters and digits; the dot is what a capital I with a dot leaves in lower case.
_WORD = r"\p{L}\p{N}\u0307"
_NUMBERS = rf"(?<![{_WORD}])[0-9]++(?:[.,][0-9]++)*+(?: ?(?i:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + rf"))?(?![{_WORD}])"
_CAPITALS = rf"\p{{Lu}}\p{{Ll}}\p{{L}}*+(?![{_WORD}])"
_NAMES = rf"(?<![{_WORD}]){_CAPITALS}(?:[ \t]{_CAPITALS})*+"


def slot_words(text: Column) -> Column:
    """The template's second reading: a run of capitalised words is one name, a number with its unit one number."""
    numbered = F.when(text.rlike("[0-9]"), F.regexp_replace(text, _NUMBERS, NUMBER)).otherwise(text)
    return F.array_remove(F.split(F.lower(F.regexp_replace(numbered, _NAMES, NAME)), f"[^{_SIGN}\\u0307]+", -1), "")


def slot_values(text: Column) -> Column:
    """The words that ``slot_words`` has, at the same places, with their values."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{_NUMBERS}|{_NAMES}|[{_WORD}]+"), F.lit(0)), F.lower)


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~w.rlike(f"[{NAME}{NUMBER}{UNIT}]")))


def window_hash(words: str, at: Column, size: int) -> Column:
    """The hash of ``size`` words of the array ``words`` from place ``at`` (0: the first), null where fewer are left.

    The words are taken by their places, which compiled code does where they lie; lambda
    functions over the array aren't compiled, and box and write the hashes of every place.
    """
    return F.when(at + size <= F.size(words), F.xxhash64(*[F.get(words, at + k) for k in range(size)], F.lit(size)))


def width_of(n: Column) -> Column:
    """Words of the run with which a leak of an item of n words begins; one changed word leaves a whole one in items of WIDTH words and more."""
    return F.when(n < WIDTH, n).otherwise(F.least(F.lit(WIDTH), F.greatest(F.lit(SHORT_WIDTH), F.floor((n - 1) / 2)))).cast("int")


#: The variant of items that are matched with their values.
EXACT = 4


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, variant, t, v, n, literals, width): the items' templates in their readings, or their words where these are too few."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = benchmark.select(F.col("item_id").cast("long").alias("item"), text.alias("text"))
    both = base.withColumn("variant", F.lit(0)).union(base.select("item", F.lower("text").alias("text"), F.lit(1).alias("variant")))
    items = both.select("item", "variant", template_words(F.col("text")).alias("t"), plain_words(F.col("text")).alias("v"))
    slots = both.select("item", (F.col("variant") + 2).alias("variant"), slot_words(F.col("text")).alias("t"), slot_values(F.col("text")).alias("v"))
    items = items.union(slots).where((F.size("t") >= SHORTEST) & (_literals(F.col("t")) > 0))
    short = (F.size("v") < SHORTEST) | (_literals(template_words(F.col("text"))) == 0)
    exact = base.select("item", F.lit(EXACT).alias("variant"), plain_words(F.col("text")).alias("t"), plain_words(F.col("text")).alias("v"), short.alias("short")).where("short and size(v) > 0").drop("short")
    items = items.union(exact).withColumn("n", F.size("t")).withColumn("literals", _literals(F.col("t")))
    items = items.withColumn("width", F.when(F.col("variant") == EXACT, F.least("n", F.lit(WIDTH))).otherwise(width_of(F.col("n"))))
    return materialize(items.dropDuplicates(["item", "t", "v"]), "items", 5 * benchmark.count())


def _hashed(width: int) -> tuple[int, int]:
    """(words of the windows that find runs of ``width`` words, places between a document's windows)."""
    return (width - 1, STRIDE) if width == WIDTH else (width, 1)


def benchmark_windows(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """The items' windows (h, begin, item, variant, off, step, prev) and the widths of the items' runs."""
    plan = sorted(r.width for r in items.select("width").distinct().collect())  # WIDTH at most
    parts = []
    least = min((_hashed(w)[0] for w in plan), default=WIDTH)
    for width in plan:
        size, step = _hashed(width)
        off = F.col("off")
        offs = items.where(F.col("width") == width).select("item", "variant", "t", F.posexplode("t").alias("off", "x"))
        offs = offs.where((off + size <= F.size("t")) & ((F.col("variant") != EXACT) | (off < step)))

        def telling(off, width=width, step=step):  # a run with this window in it has a word that is no placeholder
            first = F.greatest(off - (step - 1), F.lit(0))
            return (F.col("variant") == EXACT) | (_literals(F.slice(F.col("t"), first + 1, off - first + width)) > 0)

        before = F.when(off >= step, telling(F.greatest(off - step, F.lit(0)))).otherwise(F.lit(False))
        hashes = [window_hash("t", off, size).alias("h"), window_hash("t", off, least).alias("begin")]
        parts.append(offs.where(telling(off)).select(*hashes, "item", "variant", "off", F.lit(step).alias("step"), before.alias("prev")))
    if not parts:
        return items.selectExpr("0L h", "0L begin", "item", "variant", "0 off", "1 step", "false prev"), plan
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.union(part)
    return materialize(windows, "windows"), plan


_POINT = "struct<k:int,p:int,t:string,dv:string,iv:string>"


def _chain(points: Column) -> Column:
    """The longest sequence of points that rises in k and in p."""
    begin = F.array().cast(f"array<struct<p:int,path:array<{_POINT}>>>")

    def step(ends: Column, x: Column) -> Column:  # ends[m]: the chain of m + 1 points that ends first
        at = F.size(F.filter(ends, lambda y: y["p"] < x["p"]))
        path = F.when(at > 0, F.get(ends, at - 1)["path"]).otherwise(F.array().cast(f"array<{_POINT}>"))
        new = F.struct(x["p"].alias("p"), F.concat(path, F.array(x)).alias("path"))
        return F.concat(F.slice(ends, 1, at), F.array(new), F.slice(ends, at + 2, F.greatest(F.size(ends) - at - 1, F.lit(0))))

    order = lambda a, b: F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(b["p"] - a["p"])
    return F.aggregate(F.array_sort(points, order), begin, step, lambda ends: F.element_at(ends, -1)["path"])


def _runs(points: Column) -> Column:
    """Longest run of points side by side (best), of such with equal values (exact), and of such with a word that is no placeholder (telling)."""
    zero = F.struct(*[F.lit(x).alias(n) for n, x in (("k", -2), ("p", -2), ("run", 0), ("best", 0), ("same", 0), ("exact", 0), ("said", 0), ("telling", 0))])

    def step(s: Column, x: Column) -> Column:
        on = (x["k"] == s["k"] + 1) & (x["p"] == s["p"] + 1)
        run = F.when(on, s["run"] + 1).otherwise(1)
        same = F.when(x["dv"] != x["iv"], 0).when(on, s["same"] + 1).otherwise(1)
        said = F.when(on, s["said"]).otherwise(0) + F.when(_is_slot(x), 0).otherwise(1)
        telling = F.greatest(s["telling"], F.when(said > 0, run).otherwise(0))
        return F.struct(x["k"].alias("k"), x["p"].alias("p"), run.alias("run"), F.greatest(s["best"], run).alias("best"), same.alias("same"), F.greatest(s["exact"], same).alias("exact"), said.alias("said"), telling.alias("telling"))

    return F.aggregate(points, zero, step)


def _is_slot(point: Column) -> Column:
    return point["t"].rlike(f"[{NAME}{NUMBER}{UNIT}]")


def _hits(rows: DataFrame, windows: DataFrame, plan: list[int]) -> DataFrame:
    """``rows`` with (i, h): the places and hashes of the windows of ``w`` that an item may have."""
    begins, known = (bit_test(bitmap_bytes(windows, c, BITS), BITS) for c in ("begin", "h"))
    steps: dict[int, int] = {}
    for size, step in map(_hashed, plan):
        steps[size] = min(step, steps.get(size, step))
    sizes = sorted(steps.items())
    least, step = sizes[0][0], min(steps.values())
    own, at = rows.columns, F.col("at")
    # outer, as an inner one would have the words computed twice, to filter and to emit
    rows = rows.select(*own, F.posexplode_outer("w").alias("at", "x")).where(at % step == 0)
    # exploded, as a filter would sink below a projection and have the hash computed once more for each use
    rows = rows.select(*own, "at", F.explode_outer(F.array(window_hash("w", at, least))).alias("h")).where(begins(F.col("h")))
    if len(sizes) == 1:
        return rows.select(*own, (at + 1).alias("i"), "h")
    # where no least window begins, no other is looked for
    each = F.array(*[F.when(at % step == 0, window_hash("w", at, size)) for size, step in sizes])
    return rows.select(*own, (at + 1).alias("i"), F.explode(each).alias("h")).where(F.col("h").isNotNull() & known(F.col("h")))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, matched, slots, changed_slots for each document that holds an item."""
    items = benchmark_items(benchmark)
    windows, plan = benchmark_windows(items)
    small = F.broadcast if windows.count() <= BROADCAST_ROWS else (lambda df: df)
    exact = not items.where(F.col("variant") == EXACT).isEmpty()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("first", template_words(F.col("text"))).withColumn("second", slot_words(F.col("text")))
    readings = [F.col("first"), F.when(F.col("second") != F.col("first"), F.col("second")), *([plain_words(F.col("text"))] if exact else [])]
    # outer, as an inner one would have the arrays computed twice, to filter and to emit
    rows = rows.select("doc_id", "text", F.posexplode_outer(F.array(*readings)).alias("reading", "w"))
    found = _hits(rows, windows, plan) if plan else rows.select("*", F.lit(0).alias("i"), F.lit(0).cast("long").alias("h")).limit(0)
    found = found.join(small(windows.drop("begin")), "h").join(small(items.withColumnRenamed("v", "iv")), ["item", "variant"])
    # the values count for items that are matched with them, and for these only
    found = found.where((F.col("variant") == EXACT) == (F.col("reading") == 2))
    # where the words before agree too, an earlier window of the same run stands for this one
    before = lambda c, at: F.slice(c, F.greatest(at, F.lit(1)), F.col("step"))
    found = found.where(~(F.col("prev") & (F.col("i") > F.col("step")) & (before("w", F.col("i") - F.col("step")) == before("t", F.col("off") - F.col("step") + 1))))
    values = F.when(F.col("reading") == 1, slot_values(F.col("text"))).otherwise(plain_words(F.col("text")))
    # of the text only what the item can reach round the hit goes on; passed counts the words before
    passed = F.greatest(F.col("i") - 1 - F.col("n"), F.lit(0))
    near = lambda c, name: F.slice(c, passed + 1, 2 * F.col("n") + WIDTH).alias(name)
    found = found.select("doc_id", F.xxhash64("text").alias("row"), "reading", "item", "variant", "n", "width", "literals", "t", "iv", "off", F.size("w").alias("words"), passed.alias("passed"), near("w", "w"), near(values, "v"), (F.col("i") - passed).alias("i"))
    found = found.withColumn("shift", F.col("i") - 1 - F.col("off"))
    found = found.withColumn("skip", F.greatest(-F.col("shift"), F.lit(0))).withColumn("from", F.greatest("shift", F.lit(0)) + 1)
    part = lambda c, at: F.slice(F.col(c), at, F.col("n") - F.col("skip"))
    laid = F.arrays_zip(part("w", F.col("from")).alias("w"), part("t", F.col("skip") + 1).alias("t"), part("v", F.col("from")).alias("dv"), part("iv", F.col("skip") + 1).alias("iv"))
    point = lambda x, i: F.struct((F.col("skip") + i).alias("k"), (F.col("passed") + F.col("from") - 1 + i).alias("p"), x["w"].alias("w"), x["t"].alias("t"), x["dv"].alias("dv"), x["iv"].alias("iv"))
    same = F.transform(F.filter(F.transform(laid, point), lambda x: x["w"] == x["t"]), lambda x: x.dropFields("w"))
    key = ["doc_id", "row", "reading", "item", "variant"]
    shift = F.col("passed") + F.col("shift")
    # exploded, as the filter behind it would sink into the join and have the values of a whole text read for each window, agreeing or not
    one = F.explode_outer(F.array(same.cast(f"array<{_POINT}>"))).alias("one")
    found = found.select(*key, "n", "width", "literals", "words", shift.alias("shift"), (shift / F.col("n")).alias("at"), one)
    found = found.where((_runs(F.col("one"))["telling"] >= F.col("width")) | (F.col("variant") == EXACT))
    order = Window.partitionBy(*key).orderBy("at")
    found = found.withColumn("last", F.lag("shift").over(order)).where("last is null or last != shift")
    # a slot whose neighbours don't agree may be any other name or number
    firm = F.filter("one", lambda x: ~_is_slot(x) | F.exists("one", lambda y: F.abs(y["k"] - x["k"]) == 1))
    found = found.withColumn("firm", firm).withColumn("near", F.collect_list("firm").over(order.rangeBetween(0, 1)))
    found = found.withColumn("ways", F.when((F.size("near") > 1) & (F.col("variant") != EXACT), F.array(F.col("one"), _chain(F.flatten("near")))).otherwise(F.array("one")))
    found = found.select("doc_id", "item", "variant", "reading", "n", "literals", "words", F.explode_outer("ways").alias("same")).where("same is not null")
    found = found.withColumn("slots", F.filter("same", _is_slot)).withColumn("matched", F.size("same")).withColumn("runs", _runs(F.col("same")))
    distinct = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(*[x[n].alias(n) for n in names]))))
    consistent = (distinct("dv", "iv") == distinct("dv")) & (distinct("dv", "iv") == distinct("iv"))
    covers = (F.col("matched") >= F.col("n") * COVERAGE) & (F.col("runs.best") >= WIDTH) | (F.col("matched") >= F.col("n") * CLOSE) | (F.col("runs.exact") >= LONG)
    holds = covers & (F.col("matched") - F.size("slots") >= F.least(F.lit(LITERALS), "literals")) & consistent
    whole = (F.col("matched") == F.col("n")) & ((F.col("n") >= SHORT_WIDTH) | (F.col("words") == F.col("n")))
    holds = F.when(F.col("variant") == EXACT, whole).otherwise(holds)
    changed = F.size(F.filter("slots", lambda x: x["dv"] != x["iv"]))
    best = F.struct((F.col("matched") / F.col("n")).alias("coverage"), (-F.col("reading")).alias("plain"), (-changed).alias("less"), "matched", F.size("slots").alias("slots"))
    # the test stands in the aggregate: as a filter it would sink below the projections and have them computed again
    out = found.groupBy("doc_id", F.col("item").alias("item_id")).agg(F.max(F.when(holds, best)).alias("b")).where("b is not null")
    return out.select("doc_id", "item_id", "b.coverage", F.col("b.matched").cast("long").alias("matched"), F.col("b.slots").cast("long").alias("slots"), (-F.col("b.less")).cast("long").alias("changed_slots"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    named = docs.select(row_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    return without_rows(docs, materialize(find_leaks(named, benchmark).select(F.col("doc_id").alias("key")), "leaks"))


def op7_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)


QUERIES = {"op7_template_decontam": op7_template_decontam}
ORACLES: dict[str, str] = {}
