"""Benchmark decontamination: SimHash of item-sized windows, found through multi-index Hamming blocks.

A document is contaminated by a benchmark item if a window of as many words as
the item has a fingerprint within ``radius`` bits of the item's and a weighted
shingle similarity (sum of minima over sum of maxima of the shingle counts) of at
least ``similarity``.  Fingerprints are cut into blocks; of two within the radius
one block differs in at most radius // blocks bits, so items are indexed under all
such variants of every block and windows look up their own blocks: none is missed.

With n shingles on either side the similarity s needs 2 n s / (1 + s) shared ones,
so only windows that hold so many shingles of an item are fingerprinted; this
sieve loses nothing, and most documents have no such window.

Words are runs of letters and digits, lower-case.  Defined results: items and
documents with fewer words than a shingle match nothing; null texts are empty; a
document shorter than the item is one window; among equal similarities the
earliest window is reported; repeated rows are reported once.
An empty table on either side matches nothing; a very long text is one row, its windows a stream; columns other than
doc_id, item_id and text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import checkpointed

NOT_WORD = "[^\\p{L}\\p{N}]+"
BITS = 64


@dataclass(frozen=True)
class Windows:
    """Shingle size, least similarity, Hamming radius, blocks (dividing 64), and the most index rows that are broadcast."""

    shingle: int = 5
    similarity: float = 0.8
    radius: int = 20
    blocks: int = 8
    broadcast_rows: int = 2_000_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: Column | str, size: int) -> Column:
    """Array of shingle hashes of an array of word hashes, equal to those of the rows."""
    hashes = F.col(hashes) if isinstance(hashes, str) else hashes
    starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(0), F.size(hashes) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))


def simhash(shingles: str) -> Column:
    """Signed 64-bit fingerprint of an array of hashes: a bit is 1 if set in over half of them."""
    ones = f"aggregate({shingles}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1 as int))"
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (fp, b) -> fp | shiftleft(if(2 * {ones} > size({shingles}), 1L, 0L), b))")


def common_shingles(a: str, b: str) -> Column:
    """Sum of minima of the counts of two arrays of shingles; counting is only needed where one repeats."""
    counted = F.expr(f"aggregate(array_distinct({a}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")
    return F.when(F.size(F.array_distinct(a)) == F.size(a), F.size(F.array_intersect(a, b))).otherwise(counted)


def _with_blocks(rows: DataFrame, fp: str, how: Windows) -> DataFrame:
    width = BITS // how.blocks
    numbered = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(how.blocks - 1))))
    return numbered.withColumn("value", F.expr(f"shiftrightunsigned({fp}, block * {width}) & {(1 << width) - 1}"))


def _index(items: DataFrame, how: Windows) -> DataFrame:
    """Items under every block variant within the block radius."""
    width, radius = BITS // how.blocks, how.radius // how.blocks
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)]
    rows = _with_blocks(items, "item_fp", how).withColumn("mask", F.explode(F.lit(masks)))
    return rows.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows()) -> DataFrame:
    """doc_id, text_hash, item_id, start (word), n_words, hamming, similarity of every document and item that match."""
    size = how.shingle
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("hashes")).where(F.size("hashes") >= size)
    items = items.select("item_id", F.size("hashes").alias("size"), "hashes", _shingles("hashes", size).alias("item_shingles"))
    items = checkpointed(items.withColumn("item_fp", simhash("item_shingles")))
    numbers = items.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0)).alias("shingles"), F.count(F.lit(1)).alias("items")).first()

    def sized(df: DataFrame, rows: int) -> DataFrame:
        """Broadcast what has been counted to be small; anything larger is joined by shuffle, with the skew split."""
        return F.broadcast(df) if rows <= how.broadcast_rows else df

    seeds = items.select("item_id", "size", F.explode(F.array_distinct("item_shingles")).alias("h"))
    texts = docs.select(_key(), F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("hashes"))
    rows = texts.select("key", "text_hash", F.size("hashes").alias("words"), F.posexplode(_zipped("hashes", size)).alias("pos", "w"))
    rows = rows.where(F.col(f"w.w{size - 1}").isNotNull()).select("key", "text_hash", "words", "pos", F.xxhash64(*[f"w.w{i}" for i in range(size)]).alias("h"))
    met = rows.join(sized(seeds, numbers["shingles"]), "h")
    places = met.groupBy("key", "text_hash", "words", "item_id", "size").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    wanted = places.select("key", "text_hash", "size", F.explode(_starts(how)).alias("start")).distinct()
    wanted = checkpointed(wanted.groupBy("key", "text_hash").agg(F.collect_list(F.struct("start", "size")).alias("windows")))

    full = docs.select("doc_id", _key(), F.xxhash64("text").alias("text_hash"), "text")
    hit = full.join(sized(wanted, wanted.count()), ["key", "text_hash"])
    hit = hit.select("doc_id", "key", "text_hash", word_hashes(F.col("text")).alias("hashes"), "windows")
    windows = hit.select("doc_id", "key", "text_hash", "hashes", F.explode("windows").alias("at"))
    windows = windows.select("doc_id", "key", "text_hash", F.col("at.start").alias("start"), F.col("at.size").alias("size"), _shingles(F.slice("hashes", F.col("at.start") + 1, F.col("at.size")), size).alias("shingles"))
    windows = checkpointed(windows.withColumn("fp", simhash("shingles")))

    # Narrow rows go through the blocks; only pairs within the radius get their shingles back.
    index = _index(items.select("item_id", "size", "item_fp"), how)
    variants = numbers["items"] * how.blocks * _ball_size(BITS // how.blocks, how.radius // how.blocks)
    place = ["key", "text_hash", "start", "size"]
    looked_up = _with_blocks(windows.select(*place, "fp"), "fp", how).join(sized(index, variants), ["size", "block", "value"])
    near = looked_up.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= how.radius)
    near = near.select(*place, "item_id", "hamming").distinct()
    pairs = windows.dropDuplicates(place).join(near, place).join(sized(items.select("item_id", "item_shingles"), numbers["shingles"]), "item_id")
    both = pairs.select("doc_id", "text_hash", "item_id", "start", "hamming", F.size("shingles").alias("n"), F.size("item_shingles").alias("m"), common_shingles("shingles", "item_shingles").alias("common"))
    alike = both.withColumn("similarity", F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).where(F.col("similarity") >= how.similarity)
    best = alike.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("late"), (-F.col("hamming")).alias("far"), "n")).alias("b"))
    return best.select(
        "doc_id", "text_hash", "item_id", (-F.col("b.late")).alias("start"), (F.col("b.n") + size - 1).alias("n_words"),
        (-F.col("b.far")).alias("hamming"), F.col("b.similarity").alias("similarity"))


def _key() -> Column:
    """doc_id as a join key; null has a key of its own."""
    return F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key")


def _starts(how: Windows) -> Column:
    """Starts of all windows of ``size`` words that hold enough of ``places``, the sorted places of shared shingles.

    Such a window holds that many consecutive places.  A text shorter than the item is a window itself.
    """
    n = F.col("size") - (how.shingle - 1)
    in_window = F.least(F.col("words"), F.col("size")) - (how.shingle - 1)
    least = F.ceil((in_window + n) * F.lit(how.similarity / (1 + how.similarity)) - 1e-9).cast("int")

    def around(i: Column) -> Column:
        first, last = F.get("places", i), F.get("places", i + least - 1)
        low, high = F.greatest(F.lit(0), last - n + 1), F.least(first, F.greatest(F.lit(0), F.col("words") - F.col("size")))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    runs = F.when(F.size("places") >= least, F.sequence(F.lit(0), F.size("places") - least)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(runs, around)))


def _zipped(hashes: str, size: int) -> Column:
    """Array of structs w0.. of consecutive words; the last ones are cut short by nulls."""
    return F.arrays_zip(*[F.slice(hashes, i + 1, F.greatest(F.size(hashes), F.lit(1))).alias(f"w{i}") for i in range(size)])


def _ball_size(bits: int, radius: int) -> int:
    return sum(1 for r in range(radius + 1) for _ in combinations(range(bits), r))


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows()) -> DataFrame:
    """The rows without a match to any item, columns unchanged; the join is by doc_id and text hash, nulls equal."""
    found = checkpointed(contaminated(docs, benchmark, how).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    found = F.broadcast(found) if found.count() <= how.broadcast_rows else found
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__hash"]), "left_anti")
