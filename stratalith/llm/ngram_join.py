"""N-gram Jaccard self-join: links between documents whose shingle sets overlap.

A document's set holds the 64-bit hashes of its distinct shingles. Equal sets are
one class with one representative, so copies are never compared or expanded.

Which classes meet: each class has the ``KEYS`` least hashes of its set as keys. In
the union of two sets with Jaccard similarity t or more, hashes fall in random
order, so that no common one is among the first k with a chance of (1 - t)**k at
most; k is set for a chance below 1e-10 a pair (a set of k shingles or fewer has
them all as keys). ``exact_keys`` takes instead the keys that no linked pair can do
without: of a set of n the n - ceil(t n) + 1 least.

A key of more than ``BLOCK_CLASSES`` classes, such as a shingle of a line that many texts
have, is common. Classes with such a key take as keys their least hashes that aren't
common, so that they don't all meet: where a share h of a pair's union is common, the other
hashes have a similarity of (t - h) / (1 - h) at least, and the number of keys follows from
that. h is at most the share of either set. Sets with so much in common that twice the
keys wouldn't do, or with half of their first keys (near copies of one text, which have to
meet), keep these keys, ahead of the others.
A pair of which only one set has other keys still shares one that isn't common. New
keys may turn out to be common, which is looked at ``ROUNDS`` times.

Sizes fall into bands that grow by 1/t, so that linked sets are in one band or in
neighbouring ones. A tile is a key and a band: the classes of the key in that band, and
as visitors those of the next. A pair belongs to the tile of its least common key and of
its smaller set's band, so it is looked at once. A tile whose classes all share a lesser
key is dropped unread. Where most do, these meet the others only and not each other. A
tile of more than ``BLOCK_SHINGLES`` hashes or ``BLOCK_CLASSES`` classes is cut into
blocks, and each pair of blocks that may hold a pair of its own is a cell: a task's work,
so memory is bounded and no pair is lost.

Within a cell only sizes that can reach t are compared. Bitmaps of hashed shingles
bound each overlap from above: a bit that is set in one bitmap and not in the other
stands for at least one shingle that the other lacks. The first pass over the cells
carries bitmaps only, some bits per shingle, and drops every class that no other in
its cell can reach; shingles are fetched for the rest. Then pairs that pass the
bound are intersected exactly as sorted arrays. A cell returns how many rows each class
links with, and a forest of links, at most one per class, that connects what the links
connect; pairs aren't emitted. Where only components are asked for, pairs that are
known to be connected are skipped.

A document without words or text has an empty set and is linked with nothing; its
component is itself. Repeated rows (same doc_id) are rows of their own and linked. The
component is the least doc_id in it; a null doc_id is passed over, unless there is
no other. Equal sizes and equal hashes need no order: counts and components don't depend
on any. Texts of any length are read whole. An empty table gives an empty result. Columns
besides doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.components import components
from stratalith.llm.rowsets import bitmap_bytes, keep_rows, row_key
from stratalith.llm.textbytes import lean, shingle_sets, slices, tables, word_hashes, words
from stratalith.storage import materialize

BLOCK_SHINGLES = 1 << 20
BLOCK_CLASSES = 512
ROUNDS = 3
_CANDIDATES = 8388593  # a prime; bits of the bitmap of candidates, 1 MB


def keys_for(percent: int) -> int:
    """How many least hashes are keys, for a chance of 1e-10 to miss a pair at the threshold."""
    return math.ceil(10 / -math.log10(1 - percent / 100)) if percent < 100 else 1


def uncommon_keys(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The keys of the sorted set ``s``, those of the sorted array ``common`` coming first, if it keeps any.

    (1 - t) / (1 - h) is the chance that the least of a pair's other hashes isn't in both.
    """
    least = keys_for(percent)
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    known = common[at] == s
    differ = (1 - percent / 100) / max(1 - known.mean(), 1e-9)
    if differ <= math.sqrt(1 - percent / 100) and 2 * np.count_nonzero(known[:least]) <= min(least, len(s)):
        return s[~known][: math.ceil(10 / -math.log10(differ))]
    return np.concatenate([s[:least][known[:least]], s[~known][: 2 * least]])


def band_starts(percent: int, most: int = 1 << 40) -> list[int]:
    """The least size of each band; sets that link are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < most and percent < 100:
        out.append(100 * out[-1] // percent + 1)
    return out


def _sets(batch: pa.RecordBatch, width: int, tab: dict, cache: dict):
    """(first row, end row, shingle sets) for slices of the batch's text column."""
    for lo, hi, buf, offsets in slices(batch.column(1)):
        start, end, row = words(buf, offsets, tab)
        yield lo, hi, shingle_sets(word_hashes(buf, start, end, tab, cache), row, hi - lo, width)


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> bytes:
    """A bitmap of the hashes, with 2 to 4 bits for each."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    flat = np.zeros(bits, np.uint8)
    flat[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flat).tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps cut to ``size`` bytes, a power of two, by laying their parts over each other."""
    out = np.empty((len(maps), size // 8), np.uint64)
    for k, m in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, size // 8))
    return out


def document_sets(docs: DataFrame, width: int, percent: int, exact_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, sid (null for an empty set), keys, band and bitmap for every row."""
    some, starts = keys_for(percent), np.array(band_starts(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, cache = tables(), {}
        for batch in batches:
            for lo, hi, sets in _sets(batch, width, tab, cache):
                sids = [_set_id(s) if len(s) else None for s in sets]
                n = np.array([len(s) for s in sets], np.int64)
                band = (np.searchsorted(starts, n, "right") - 1 if percent < 100 else n).astype(np.int32)
                keys = [s[: len(s) - -(-percent * len(s) // 100) + 1 if exact_keys else some].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(band), pa.array([signature(s) for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "sid", "keys", "band", "bitmap"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, sid binary, keys array<long>, band int, bitmap binary")


def _parsed(docs: DataFrame, wanted: DataFrame, width: int, schema: str, of: Callable) -> DataFrame:
    """The batches that ``of`` makes of (doc_ids, sets) for rows that may be the representatives of ``wanted`` (sid, rep).

    A bitmap of doc_ids, of fixed size, keeps other rows from being parsed again.
    """
    spark = docs.sparkSession
    bits = np.frombuffer(bitmap_bytes(wanted.select(F.coalesce("rep", F.lit(0)).alias("rep")), "rep", _CANDIDATES), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, cache, held = tables(), {}, shared.value
        for batch in batches:
            at = batch.column(0).fill_null(0).to_numpy() % _CANDIDATES
            batch = batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for lo, hi, sets in _sets(batch, width, tab, cache):
                yield of(batch.column(0).slice(lo, hi - lo), sets)

    return docs.mapInArrow(lean(run), schema)


def _of_candidates(docs: DataFrame, wanted: DataFrame, width: int, column: str, of: Callable) -> DataFrame:
    """(sid, ``column``) for the classes of ``wanted`` (sid, rep): what ``of`` makes of their sets, from their representatives' texts."""
    name, kind = column.split()
    arrow = pa.binary() if kind == "binary" else pa.list_(pa.int64())

    def batch_of(doc_ids, sets):
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([of(s) for s in sets], arrow)], ["doc_id", "sid", name])

    found = _parsed(docs, wanted, width, f"doc_id long, sid binary, {column}", batch_of)
    return found.join(wanted, "sid").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("sid", name).dropDuplicates(["sid"])


def candidate_arrays(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, shingles) for the classes of ``wanted`` (sid, rep)."""
    return _of_candidates(docs, wanted, width, "shingles binary", np.ndarray.tobytes)


def repeated_hashes(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, count) of hashes that the sets of ``wanted`` (sid, rep) have, keys or not, counted where a batch has one twice."""

    def batch_of(doc_ids, sets):
        key, count = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key[count > 1].view(np.int64)), pa.array(count[count > 1])], ["key", "count"])

    return _parsed(docs, wanted, width, "key long, count long", batch_of).groupBy("key").agg(F.sum("count").alias("count"))


def _key_counts(classes: DataFrame) -> DataFrame:
    """(key, count) of the keys that several classes have."""
    return materialize(classes.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1"), "keys")


def spread_keys(docs: DataFrame, reps: DataFrame, width: int, percent: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(sid, n, band, copies, keys) of the classes, with other keys where theirs are common, and the keys' counts."""
    classes = reps.select("sid", "n", "band", "copies", "keys")
    counts, common = _key_counts(classes), np.empty(0, np.uint64)
    often = lambda found: found.where(F.col("count") > BLOCK_CLASSES).select("key").toArrow().column(0).to_numpy().view(np.uint64)
    for k in range(ROUNDS if percent < 100 else 0):
        found = often(counts)
        if np.isin(found, common).all():
            break
        common = np.union1d(common, found)
        wanted = _having(reps, common, rows)
        if k == 0:  # the other hashes of what they have in common, before they become keys
            common = np.union1d(common, often(repeated_hashes(docs, wanted, width)))
            wanted = _having(reps, common, rows)
        shared = docs.sparkSession.sparkContext.broadcast(common)

        def keys_of(s: np.ndarray, shared=shared) -> np.ndarray:
            return uncommon_keys(s, shared.value, percent).view(np.int64)

        other = _of_candidates(docs, wanted, width, "new array<long>", keys_of)
        classes = reps.select("sid", "n", "band", "copies", "keys").join(other, "sid", "left")
        classes = materialize(classes.select("sid", "n", "band", "copies", F.coalesce("new", "keys").alias("keys")), "spread", rows)
        counts = _key_counts(classes)
    return classes, counts


def _having(reps: DataFrame, common: np.ndarray, rows: int) -> DataFrame:
    """(sid, rep) of the classes with a key of ``common``."""
    shared = reps.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, size = batch.column(2).flatten().to_numpy().view(np.uint64), batch.column(2).value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)[np.isin(keys, shared.value)]
            yield batch.select([0, 1]).take(pa.array(np.unique(row)))

    return materialize(reps.select("sid", "rep", "keys").mapInArrow(lean(run), "sid binary, rep long"), "common", rows)


def overlaps(a: np.ndarray, many: list[np.ndarray]) -> list[int]:
    """Exact sizes of the intersections of sorted ``a`` with each of ``many``, none of them empty."""
    if not many:
        return []
    flat = np.concatenate(many)
    at = np.searchsorted(a, flat)
    at[at == len(a)] = 0
    ends = np.cumsum([len(b) for b in many])
    return np.add.reduceat(a[at] == flat, ends - [len(b) for b in many], dtype=np.int64).tolist()


def bound(maps: np.ndarray, size: np.ndarray, i: int, some: np.ndarray) -> np.ndarray:
    """No set of ``some`` shares more shingles with set i than this."""
    return np.minimum(
        size[some] - np.bitwise_count(maps[some] & ~maps[i]).sum(axis=1, dtype=np.int64),
        size[i] - np.bitwise_count(maps[i] & ~maps[some]).sum(axis=1, dtype=np.int64),
    )


def reachable(size: np.ndarray, maps: list[bytes], block: np.ndarray | None, percent: int) -> np.ndarray:
    """Which sets of a tile another one can reach, going by the bitmaps."""
    order = np.argsort(size, kind="stable")
    size, maps = size[order], [maps[k] for k in order.tolist()]
    block = block[order] if block is not None else None
    live = np.zeros(len(size), bool)
    done = 0
    while done < len(size):  # runs of sets whose bitmaps are of one length, and those below that they can reach
        run = done
        while run < len(size) and len(maps[run]) == len(maps[done]):
            run += 1
        lowest = int(np.searchsorted(size, -(-percent * int(size[done]) // 100)))
        cut = folded(maps[lowest:run], min(len(m) for m in maps[lowest:run]))
        part = size[lowest:run]
        for i in range(done, run):
            lo = int(np.searchsorted(size, -(-percent * int(size[i]) // 100)))
            for at in range(i, lo, -256):  # nearest sizes first
                some = np.arange(max(lo, at - 256), at)
                if live[i]:
                    some = some[~live[some]]
                if block is not None:
                    some = some[block[some] != block[i]]
                if len(some):
                    need = -(-percent * (size[some] + size[i]) // (100 + percent))
                    fit = some[bound(cut, part, i - lowest, some - lowest) >= need]
                    if len(fit):
                        live[i] = True
                        live[fit] = True
        done = run
    out = np.zeros(len(size), bool)
    out[order] = live
    return out


def cell_links(cell: list[tuple], key: int, crossed: bool, percent: int, count: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(rows that each class of a cell links with, a forest of links) from classes (block, visitor, copies, keys, shingles).

    crossed: only classes of different blocks are compared.
    """
    sets = [np.frombuffer(c[4], np.uint64) for c in cell]
    order = sorted(range(len(cell)), key=lambda k: (len(sets[k]), cell[k][1]))
    sets, cell = [sets[k] for k in order], [cell[k] for k in order]
    size = np.array([len(x) for x in sets])
    block, visitor, copies = (np.array([c[k] for c in cell]) for k in range(3))
    first = np.array([c[3][0] for c in cell])
    first = np.where(first == key, -np.arange(1, len(cell) + 1), first)  # no lesser key
    apart = np.array([c[3][0] == key for c in cell])
    lesser = [frozenset(c[3][: list(c[3]).index(key)]) for c in cell]
    maps = [signature(x) for x in sets]
    maps = folded(maps, min(map(len, maps)))
    links, root, forest = np.zeros(len(cell), np.int64), np.arange(len(cell)), []
    for i in range(1, len(cell)):
        lo = int(np.searchsorted(size, -(-percent * int(size[i]) // 100)))
        may = ~visitor[lo:i]
        if crossed:
            may &= block[lo:i] != block[i]
        if not apart[i]:  # classes with one least key have met in that key's tile
            may &= apart[lo:i] | (first[lo:i] != first[i])
        if not count:
            may &= root[lo:i] != root[i]
        other = np.flatnonzero(may) + lo
        for at in range(0, len(other), 256):
            some = other[at : at + 256]
            if not count:
                some = some[root[some] != root[i]]
            need = -(-percent * (size[some] + size[i]) // (100 + percent))
            fit = bound(maps, size, i, some) >= need
            some, need = some[fit], need[fit]
            if lesser[i]:
                fresh = np.array([lesser[i].isdisjoint(lesser[j]) for j in some.tolist()], bool)
                some, need = some[fresh], need[fresh]
            linked = some[np.array(overlaps(sets[i], [sets[j] for j in some.tolist()]), np.int64) >= need]
            if not len(linked):
                continue
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            new, which = np.unique(root[linked], return_index=True)
            for r, w in zip(new.tolist(), which.tolist(), strict=True):
                if r != root[i]:
                    forest.append((order[int(linked[w])], order[i]))
                    root[root == r] = root[i]
    back = np.empty(len(cell), np.int64)
    back[order] = links
    return back, forest


#: Rows of a tile that share no lesser key with most of the others, and those that do, in blocks.
_BLOCKS = "greatest(1, ceil({rows} / {classes}D), ceil({shingles} / {most}D))"


def _cells(shared: DataFrame, *columns: str) -> DataFrame:
    """The rows (key, tile, first, sid, n) with the cells (pairs of blocks) that they take part in, most tiles being one cell.

    Classes with the tile's most common lesser key (``major``) have met in that key's
    tile: their blocks meet the others' blocks only.
    """
    each = shared.groupBy("key", "tile", "first").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.sum((~F.col("visitor")).cast("int")).alias("residents"))
    lesser = F.when(F.col("first") != F.col("key"), F.struct("rows", "shingles", "first"))
    tiles = each.groupBy("key", "tile").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.sum("residents").alias("residents"), F.max(lesser).alias("major"))
    tiles = tiles.where("rows > 1 and residents > 0 and (major is null or major.rows < rows)")
    hot = f"rows > {BLOCK_CLASSES} or shingles > {BLOCK_SHINGLES}"
    blocks = lambda rows, shingles: F.expr(_BLOCKS.format(rows=rows, shingles=shingles, classes=BLOCK_CLASSES, most=BLOCK_SHINGLES)).cast("int")
    tiles = tiles.withColumn("major", F.when(F.expr(hot), F.col("major")))
    tiles = tiles.withColumn("others", blocks("(rows - coalesce(major.rows, 0))", "(shingles - coalesce(major.shingles, 0))"))
    tiles = tiles.withColumn("majors", F.when(F.col("major").isNull(), F.lit(0)).otherwise(blocks("major.rows", "major.shingles")))
    # written, so that the join has exchanges of its own and Spark can split a hot tile's rows
    tiles = materialize(tiles.select("key", "tile", "others", "majors", F.col("major.first").alias("major")), "tiles")
    rows = shared.join(tiles, ["key", "tile"])
    most = F.coalesce(F.col("first") == F.col("major"), F.lit(False))
    number = F.when(most, F.col("others") + F.pmod(F.xxhash64("sid"), F.greatest("majors", F.lit(1)))).otherwise(F.pmod(F.xxhash64("sid"), "others")).cast("int")
    rows = rows.withColumn("block", number).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(most, F.col("others") - 1).otherwise(F.col("others") + F.col("majors") - 1))))
    return rows.select("key", "tile", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"), "block", "sid", *columns)


def _by_cell(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` gets the rows of one cell, without its name, and returns rows for ``schema``."""
    cell_of = ["key", "tile", "c1", "c2"]
    rows = rows.repartition(*cell_of).sortWithinPartitions(*cell_of)
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64() if part.split()[1] == "long" else pa.binary() for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            found = []
            for key, tile, c1, c2, *rest in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if (key, tile, c1, c2) != cell:
                    found += work(cell, held) if held else []
                    held, cell = [], (key, tile, c1, c2)
                held.append(rest)
            yield batch_of(found)
        if held:
            yield batch_of(work(cell, held))

    return rows.mapInArrow(lean(run), schema)


def _live(cells: DataFrame, percent: int) -> DataFrame:
    """(key, tile, sid) of the members that another of their cell can reach."""

    def work(cell, held):
        block = np.array([r[0] for r in held]) if cell[2] != cell[3] else None
        live = reachable(np.array([r[2] for r in held]), [r[3] for r in held], block, percent)
        return [(cell[0], cell[1], held[k][1]) for k in np.flatnonzero(live).tolist()]

    return _by_cell(cells, work, "key long, tile long, sid binary").distinct()


def _links(cells: DataFrame, percent: int, count: bool) -> DataFrame:
    """(a, b, links) found in the cells: links between classes, and with b null the rows that class a links with."""

    def work(cell, held):
        if len(held) < 2:
            return []
        rows = [(r[0], r[2], r[3], r[4], r[5]) for r in held]
        links, forest = cell_links(rows, cell[0], cell[2] != cell[3], percent, count)
        counted = [(held[k][1], None, int(links[k])) for k in np.flatnonzero(links).tolist()] if count else []
        return counted + [(held[i][1], held[j][1], None) for i, j in forest]

    return _by_cell(cells, work, "a binary, b binary, links long")


def jaccard_links(docs: DataFrame, width: int, percent: int, count: bool = True, exact_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs``.

    Two documents link when 100 * |A and B| >= percent * |A or B|. n_links is how many
    other rows a row links with; null without ``count``.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sets = materialize(document_sets(docs, width, percent, exact_keys), "sets")
    rows = sets.count()  # from the files' footers
    reps = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("keys", "keys"), ("band", "band"), ("bitmap", "bitmap"))])
    reps = materialize(reps, "classes", rows)
    if exact_keys:
        classes, several, keyed = reps.select("sid", "n", "band", "copies", "keys"), _key_counts(reps), None
    else:
        classes, several = spread_keys(docs, reps, width, percent, rows)
        keyed = 2 * rows * keys_for(percent)
    every = classes.select("sid", "n", "band", F.get("keys", F.lit(0)).alias("first"), F.explode("keys").alias("key"))
    # most keys are of one class alone and go before the classes are sent to their tiles
    every = materialize(every.join(several.select("key"), "key"), "keyed")
    # each class in its own band's tile, and in the one below as a visitor
    every = every.select("key", "first", "sid", "n", F.posexplode(F.array("band", F.col("band") - 1)).alias("visits", "at")).select("key", F.col("at").cast("long").alias("tile"), (F.col("visits") == 1).alias("visitor"), "first", "sid", "n")
    tiles = every.groupBy("key", "tile").agg(F.count("*").alias("in_tile"), F.min("first").alias("lo"), F.max("first").alias("hi"), F.min("visitor").alias("only_visitors"))
    tiles = tiles.where("in_tile > 1 and not only_visitors and (lo <> hi or lo = key)").select("key", "tile")
    shared = materialize(every.join(materialize(tiles, "tiles"), ["key", "tile"]), "shared", keyed)
    live = _live(_cells(shared, "n").join(reps.select("sid", "bitmap"), "sid").select("key", "tile", "c1", "c2", "block", "sid", "n", "bitmap"), percent)
    members = materialize(shared.join(live, ["key", "tile", "sid"]), "members", keyed)
    wanted = members.select("sid").distinct().join(reps.select("sid", "rep"), "sid")
    arrays = candidate_arrays(docs, materialize(wanted, "wanted", rows), width)
    arrays = materialize(arrays.join(classes.select("sid", "copies", "keys"), "sid"), "arrays")
    cells = _cells(members, "visitor").join(arrays, "sid").select("key", "tile", "c1", "c2", "block", "sid", "visitor", "copies", "keys", "shingles")
    links = materialize(_links(cells, percent, count), "links", 2 * rows)
    roots = components(materialize(links.where("b is not null").select("a", "b").distinct(), "forest", rows))

    nodes = roots.withColumnRenamed("node", "sid").join(reps.select("sid", "rep"), "sid")
    least = nodes.groupBy("root").agg(F.min("rep").alias("least"))
    named = reps.select("sid", "rep", "copies").join(nodes.select("sid", "root").join(least, "root").select("sid", "least"), "sid", "left")
    partners = links.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1) if count else F.lit(None).cast("long")
    named = materialize(named.join(partners, "sid", "left").select("sid", F.coalesce("least", "rep").alias("component_id"), n_links.alias("n_links")), "components", rows)
    full = sets.where("sid is not null").select("doc_id", "n_shingles", "sid").join(named, "sid", "left").select("doc_id", "n_shingles", "component_id", "n_links")
    none = F.lit(0 if count else None).cast("long")
    empty = sets.where("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), none.alias("n_links"))
    return full.union(empty)


def jaccard_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return jaccard_links(docs, width, percent, count=False).drop("n_links")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked documents."""
    named = docs.select(row_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = jaccard_components(named, width, percent)
    return keep_rows(docs, materialize(found.select(F.col("doc_id").alias("key"), (F.col("doc_id") == F.col("component_id")).alias("kept")), "kept", docs.count()))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
