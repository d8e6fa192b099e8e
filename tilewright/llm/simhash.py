"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common variant
within half the radius of both; so every fingerprint emits its ball of variants,
variants are shuffled, and fingerprints that meet at one are linked.  A ball of
radius 2 has 2,081 variants, and most fingerprints have no neighbour at all.
A lossless sieve of the same kind goes first: cut into three parts, two
fingerprints within four bits differ in at most two bits outside the part that
differs most, so their projections without that part meet in balls of radius 1
(at most 44 variants, three projections).  Only fingerprints that meet another
one there emit the full ball, whose meetings need no further proof.

Every step is linear in the number of distinct fingerprints: no pairs within a
group, no group in one task, only chains of neighbours within a variant.

Defined results: equal fingerprints are one node, whatever the texts; null and
blank texts have fingerprint zero; repeated rows stay repeated; a null doc_id
never becomes a component id unless the component has no other.

:func:`keep_checked` takes its links from the same balls and drops only what an
exact comparison of five-word shingles has confirmed.  :func:`keep_verified` does
so too, but bands of minimum hashes find the pairs to compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import checkpointed, in_batches, stored, unused
from tilewright.operators.components import connect
from tilewright.operators.scale import attach

SEED = 42
AT_ONCE = 1 << 16
BITS = 64


@dataclass(frozen=True)
class Verified:
    """Shingle size and least Jaccard similarity of copies; bands of minimum hashes that find them.

    A pair with similarity s meets in no band with chance (1 - s ** rows) ** bands: 3 in a million at 0.8.  Texts in a band of
    more than ``crowd`` meet in finer bands instead, with chance 8 in a million of none at 0.8.  ``leaders`` of a band are
    compared with the rest of it in a round; ``ranges`` counts of hashes bound what two sets can have in common.
    ``words`` and ``radius`` are those of the fingerprints (of distinct shingles) where balls find the pairs.
    """

    size: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4
    crowd: int = 64
    fine_bands: int = 64
    fine_rows: int = 8
    leaders: int = 16
    ranges: int = 64
    words: int = 3
    radius: int = 4


def word_shingles(text: str | None, size: int) -> Iterator[bytes] | None:
    """Runs of ``size`` lower-case words, one shorter run for a shorter text; None without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return None
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    return map(joined.__getitem__, map(slice, starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist()))


def fingerprint(text: str | None, size: int = 4, seed: int = SEED, distinct: bool = False) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included unless ``distinct``; 0 without words."""
    shingles = word_shingles(text, size)
    if shingles is None:
        return 0
    if distinct:
        shingles = iter(set(shingles))
    digest, ones, n = xxhash.xxh64_digest, np.zeros(BITS, dtype=np.int64), 0
    while some := [digest(x, seed) for x in islice(shingles, AT_ONCE)]:
        bits = np.unpackbits(np.frombuffer(b"".join(some), dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, size: int = 4, distinct: bool = False) -> DataFrame:
    """doc_id, text_hash, fp (signed 64-bit) of every row, checkpointed: it is narrow and read several times."""
    def work(rows):
        return {"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "fp": [_signed(fingerprint(t, size, distinct=distinct)) for t in rows["text"]]}

    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return checkpointed(in_batches(narrow, work, "doc_id long, text_hash long, fp long"))


def ball(bits: list[int], radius: int) -> list[int]:
    """XOR masks of all sets of at most ``radius`` of the bits."""
    return [_signed(sum(1 << b for b in chosen)) for r in range(radius + 1) for chosen in combinations(bits, r)]


def _neighbours(rows: DataFrame) -> DataFrame:
    """fp, before, after: the next fingerprints that share the variant; a stream over a sorted shuffle."""
    order = Window.partitionBy("variant").orderBy("fp")
    return rows.select("fp", F.lag("fp").over(order).alias("before"), F.lead("fp").over(order).alias("after"))


def parts_of(radius: int) -> list[list[int]]:
    """Bits cut into radius // 2 + 1 consecutive parts of nearly equal size."""
    n = radius // 2 + 1
    return [list(range(BITS * i // n, BITS * (i + 1) // n)) for i in range(n)]


def sieve(nodes: DataFrame, radius: int) -> DataFrame:
    """Fingerprints (distinct ``fp``) that may have a neighbour; none with one is left out.

    Without its most different part a pair differs in at most ``radius - ceil(radius / parts)`` bits.
    """
    parts = parts_of(radius)
    rest = (radius - -(-radius // len(parts)) + 1) // 2
    masks = []
    for part in parts:
        kept = [b for b in range(BITS) if b not in part]
        away = _signed(sum(1 << b for b in kept))
        masks.append((away, ball(kept, rest)))
    frames = [
        nodes.select("fp", F.explode(F.lit(ring)).alias("mask")).select(F.col("fp").bitwiseAND(F.lit(away)).bitwiseXOR(F.col("mask")).alias("variant"), "fp")
        for away, ring in masks]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionAll(frame)
    # The same projection of one fingerprint can meet itself only in another part: such rows are not neighbours.
    met = _neighbours(rows).where((F.col("before") != F.col("fp")) | (F.col("after") != F.col("fp")))
    return met.select("fp").distinct()


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``radius`` bits; only such pairs, not all of them."""
    live = checkpointed(sieve(nodes, radius))
    masks = ball(list(range(BITS)), radius // 2)
    rows = live.select("fp", F.explode(F.lit(masks)).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    edges = _neighbours(rows).where(F.col("before").isNotNull()).select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()
    return edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(found: DataFrame, radius: int = 4) -> DataFrame:
    """fp and component_id (smallest doc_id of all rows reachable by links) of every distinct fingerprint.

    Only linked fingerprints are shuffled by component, and salted where they get its id back.  The result is written, so
    that the join of all rows to it reads two plain shuffles, which the skew split can cut at a fingerprint many rows share.
    """
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return named(nodes, links(nodes.select("fp"), radius))


def named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fp and component_id of the nodes (fp, first), joined by the edges (a, b)."""
    roots = connect(edges, []).select(F.col("node").alias("fp"), "root")
    members = roots.union(roots.select(F.col("root").alias("fp"), "root").distinct())
    least = nodes.join(members, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = attach(members, least, "root").select("fp", "component_id")
    return checkpointed(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))


def simhash_groups(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    ``radius`` is even.  A fingerprint that very many rows share is salted in the join to its component.
    """
    if radius % 2:
        raise ValueError("radius must be even: a ball has half of it")
    found = fingerprints(docs, size)
    joined = attach(found, components(found, radius), "fp", "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, found: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; found: doc_id, text_hash, fp of every row, groups: fp, component_id."""
    grouped = attach(found, groups, "fp", "left")
    # Components are named by a doc_id; without one the fingerprint names it.
    name = F.when(F.col("component_id").isNull(), F.col("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    stay = grouped.groupBy("component_id", name.alias("nameless")).agg(first.alias("s"))
    key, digest = unused(docs, "row_key"), unused(docs, "row_hash")
    stay = stay.select(F.coalesce(F.col("s.doc_id").cast("string"), F.lit("")).alias(key), F.col("s.text_hash").alias(digest))
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest: F.xxhash64("text")})
    return rows.dropDuplicates([key, digest]).join(stay, [key, digest], "left_semi").select(*docs.columns)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; empty without words."""
    shingles, parts = word_shingles(text, size), [np.empty(0, dtype="<u8")]
    while shingles and (some := [xxhash.xxh64_digest(x, SEED) for x in islice(shingles, AT_ONCE)]):
        parts.append(np.unique(np.frombuffer(b"".join(some), dtype="<u8")))
    return np.unique(np.concatenate(parts))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed key per band, equal for sets with the same minimum hashes there."""
    draw = np.random.default_rng([SEED, rows])
    n = bands * rows
    flip, factor = draw.integers(0, 1 << 64, n, dtype=np.uint64), draw.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
    least, step = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64), max(1, (1 << 19) // n)
    for at in range(0, len(hashes), step):
        mixed = (hashes[at:at + step, None] ^ flip) * factor
        least = np.minimum(least, mixed.min(axis=0))
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), rows << 16 | i)) for i, band in enumerate(least.reshape(bands, rows))]


def banded(docs: DataFrame, how: Verified) -> DataFrame:
    """doc_id, text_hash, fp (of the set of shingles, 0 without words), n_shingles, keys, counts by hash range of every row, stored."""
    def work(rows):
        sets = [shingle_set(t, how.size) for t in rows["text"]]
        width = np.uint64((1 << 64) // how.ranges)
        return {
            "doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "fp": [_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) if len(s) else 0 for s in sets],
            "n_shingles": [len(s) for s in sets], "keys": [band_keys(s, how.bands, how.rows) if len(s) else [] for s in sets],
            "counts": [np.bincount((s // width).astype(np.int64), minlength=how.ranges) for s in sets]}

    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return stored(in_batches(narrow, work, "doc_id long, text_hash long, fp long, n_shingles long, keys array<long>, counts array<int>"))


def memberships(nodes: DataFrame, sets: DataFrame, how: Verified) -> DataFrame:
    """key and fp of every node (fp, keys) in every band it shares, crowded bands replaced by finer ones of the sets (fp, shingles)."""
    rows = nodes.select("fp", F.explode("keys").alias("key"))
    sized = attach(rows, rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    sized = stored(sized)
    crowded = sized.where(F.col("n") > how.crowd).select("fp").distinct()

    def finer(rows):
        return {"fp": rows["fp"], "keys": [band_keys(np.array(s, dtype="<i8").view("<u8"), how.fine_bands, how.fine_rows) for s in rows["shingles"]]}

    fine = in_batches(sets.join(crowded, "fp"), finer, "fp long, keys array<long>").select(F.explode("keys").alias("key"), "fp")
    return sized.where(F.col("n") <= how.crowd).select("key", "fp").union(fine)


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, how: Verified) -> DataFrame:
    """The pairs (leader, fp) whose sets have at least the similarity.

    A bound from the counts of each set, which no common number exceeds, rejects most others before sets are moved; then the
    set of ``fp`` goes to its leader's, which is repeated by salt, not by pair.
    """
    def enough(common, one, two):
        return common >= F.lit(how.similarity) * (one + two - common) - 1e-9

    facts = nodes.select("fp", "n_shingles", "counts")
    ahead = facts.toDF("leader", "n_leader", "counts_leader")
    both = attach(pairs.join(facts, "fp"), ahead, "leader")
    most = F.aggregate(F.zip_with("counts", "counts_leader", lambda a, b: F.least(a, b)), F.lit(0), lambda s, n: s + n)
    likely = stored(both.where(enough(most, F.col("n_shingles"), F.col("n_leader"))).select("leader", "fp"))
    met = attach(likely.join(sets, "fp"), sets.toDF("leader", "shingles_leader"), "leader")
    common = F.size(F.array_intersect("shingles", "shingles_leader"))
    return met.where(enough(common, F.size("shingles"), F.size("shingles_leader"))).select(F.col("leader").alias("a"), F.col("fp").alias("b"))


def verified_links(docs: DataFrame, found: DataFrame, how: Verified) -> DataFrame:
    """Edges (a, b) between sets of shingles with at least the similarity, enough to join all that bands show to be joined.

    Rounds: some members of each band, unjoined ones first, lead, are compared with all others not yet joined to them, and leave it.  A band whose
    members are all joined, or that has no two left, is done; rounds go on until all are, so every two members of a band
    are compared or joined by a chain.
    """
    nodes = found.where(F.col("fp") != 0).groupBy("fp").agg(*[F.first(c).alias(c) for c in ("n_shingles", "keys", "counts")], F.min("text_hash").alias("text_hash"))
    nodes = stored(nodes)
    shared = nodes.select("fp", F.explode("keys").alias("key")).groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("key")
    wanted = attach(nodes.select("fp", F.explode("keys").alias("key")), shared, "key").select("fp").distinct()
    wanted = stored(nodes.join(wanted, "fp", "left_semi"))
    texts = docs.groupBy(F.xxhash64("text").alias("text_hash")).agg(F.first("text").alias("text")).join(wanted.select("fp", "text_hash"), "text_hash")

    def work(rows):
        return {"fp": rows["fp"], "shingles": [shingle_set(t, how.size).view("<i8") for t in rows["text"]]}

    sets = stored(in_batches(texts.select("fp", "text"), work, "fp long, shingles array<long>"))
    left, roots = stored(memberships(wanted, sets, how)), stored(wanted.select("fp", F.col("fp").alias("root")))
    return settled(left, roots, wanted.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0), wanted, sets, how)


def settled(left: DataFrame, roots: DataFrame, links: DataFrame, nodes: DataFrame, sets: DataFrame, how: Verified) -> DataFrame:
    """``links`` and those that join the members (fp) of each group (key) of ``left``, in rounds of leaders; roots: fp and the name it has so far."""
    while True:
        left = left.join(roots, "fp")
        mixed = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        left = stored(attach(left, mixed, "key"))
        if left.isEmpty():
            return links
        slot = F.pmod(F.xxhash64("key", "fp"), F.lit(how.leaders))
        first = F.min(F.struct((F.col("root") != F.col("fp")).alias("joined"), F.xxhash64("fp").alias("h"), "fp", "root"))  # the unjoined lead first
        ahead = stored(left.groupBy("key", slot.alias("slot")).agg(first.alias("f")).select("key", F.col("f.fp").alias("leader"), F.col("f.root").alias("leader_root")))
        pairs = attach(left, ahead, "key").where("root <> leader_root").select("leader", "fp").distinct()
        links = stored(links.union(confirmed(pairs, nodes, sets, how)))
        # One step of the least name along all links: enough to skip most pairs already joined, and never joins others.
        both = links.union(links.select("b", "a"))
        offered = both.join(roots.toDF("a", "offered"), "a").groupBy(F.col("b").alias("fp")).agg(F.min("offered").alias("offered"))
        roots = stored(roots.join(offered, "fp", "left").select("fp", F.least("root", F.coalesce("offered", "root")).alias("root")))
        left = left.drop("root").join(ahead.select("key", F.col("leader").alias("fp")), ["key", "fp"], "left_anti")


def checked_links(docs: DataFrame, found: DataFrame, how: Verified) -> DataFrame:
    """Edges (a, b) between texts (text_hash) whose fingerprints are within ``radius`` bits and whose sets of shingles have the similarity.

    Texts that meet at a variant are a group, as in :func:`links`.  Neighbours in it are compared first.  Where all of these are
    joined the group is done; the others are known by two neighbours that are not, and are settled in rounds, so every two texts
    of a group are compared or joined by a chain.  Groups of the same members count once.
    """
    nodes = stored(found.select("fp", "text_hash").distinct())
    shared = nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    live = stored(sieve(nodes.select("fp").distinct(), how.radius).union(shared).distinct())
    near = stored(nodes.join(live, "fp", "left_semi").select("text_hash", "fp"))
    digest = F.xxhash64("text")
    texts = docs.select(digest.alias("fp"), "text").join(near.select(F.col("text_hash").alias("fp")), "fp", "left_semi").dropDuplicates(["fp"])
    width = np.uint64((1 << 64) // how.ranges)

    def work(rows):
        sets = [shingle_set(t, how.size) for t in rows["text"]]
        return {
            "fp": rows["fp"], "n_shingles": [len(s) for s in sets], "shingles": [s.view("<i8") for s in sets],
            "counts": [np.bincount((s // width).astype(np.int64), minlength=how.ranges) for s in sets]}

    facts = stored(in_batches(texts, work, "fp long, n_shingles long, shingles array<long>, counts array<int>"))
    sets, masks = facts.select("fp", "shingles"), ball(list(range(BITS)), how.radius // 2)
    rows = near.select("text_hash", F.col("fp").alias("at"), F.explode(F.lit(masks)).alias("mask")).select(
        F.col("at").bitwiseXOR(F.col("mask")).alias("key"), F.col("text_hash").alias("fp"))
    order = Window.partitionBy("key").orderBy("fp")
    tried = stored(rows.select(F.lag("fp").over(order).alias("leader"), "fp").where("leader is not null").distinct())
    links = stored(confirmed(tried, facts, sets, how))
    joined = connect(links, []).select(F.col("node").alias("fp"), "root")
    roots = stored(near.select(F.col("text_hash").alias("fp")).join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    ends = near.toDF("fp", "at").join(roots, "fp")
    apart = tried.join(ends, "fp").join(ends.toDF("leader", "leader_at", "leader_root"), "leader").where("root <> leader_root").select("at", "leader_at")
    met = apart.distinct().select("at", "leader_at", F.explode(F.lit(masks)).alias("mask")).select("leader_at", F.col("at").bitwiseXOR(F.col("mask")).alias("key"))
    met = stored(met.where(F.bit_count(F.col("key").bitwiseXOR(F.col("leader_at"))) <= how.radius // 2).select("key").distinct())
    left = stored(rows.join(met, "key", "left_semi"))
    alike = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("h")).groupBy("n", "h").agg(F.min("key").alias("key"))
    return settled(attach(left, alike.select("key"), "key"), roots, links, facts, sets, how)


def keep_verified(docs: DataFrame, how: Verified = Verified()) -> DataFrame:
    """One row of every group of copies, the one with the smallest doc_id (then text hash), columns unchanged.

    Only texts whose sets of ``size``-word shingles have at least the Jaccard similarity are linked, directly or in a
    chain; texts without words are one group.  Equal sets are one node.
    """
    found = banded(docs, how)
    narrow = found.select("doc_id", "text_hash", "fp")
    nodes = narrow.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return first_of_each(docs, narrow, named(nodes, verified_links(docs, found, how)))


def keep_checked(docs: DataFrame, how: Verified = Verified()) -> DataFrame:
    """One row of every group of near-duplicates, the one with the smallest doc_id (then text hash), columns unchanged.

    Two texts are linked if their fingerprints of ``words``-word shingles differ in at most ``radius`` bits, found by ball hashing,
    and their sets of ``size``-word shingles have at least the Jaccard similarity; a row goes only with such a link, or a chain of them, to the one that stays.
    """
    if how.radius % 2:
        raise ValueError("radius must be even: a ball has half of it")
    found = fingerprints(docs, how.words, distinct=True)
    narrow = found.select("doc_id", "text_hash", F.col("text_hash").alias("fp"))
    nodes = narrow.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return first_of_each(docs, narrow, named(nodes, checked_links(docs, found, how)))
