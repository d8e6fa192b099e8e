"""Repeated passages: words inside a window whose word sequence starts anywhere else are located and removed.

Candidates.  Of every ``size`` consecutive words the run of a few words with the least hash (the last of equal ones) is
the window's anchor.  Equal windows have equal anchors, and a text has few, so only anchors are shuffled: a window whose
anchor occurs once in all texts cannot recur.  The consecutive windows with one anchor make a segment of less than
2 * size words.  Segments of recurring anchors are cut out; equal ones are merged.

Confirmation.  Windows of distinct segments are counted by 128-bit hash, weighted by how often the segment occurs.
A window counted twice is a phrase, kept once.

Location.  Phrases are dealt to shards by anchor and compiled to Aho-Corasick automata over words, one an anchor; the
distinct segments of all texts are streamed through the automaton of their anchor, which finds every place of every
phrase, since equal windows have equal anchors.  A shard with too many phrases is cut into several, one with too many
segments into several streams, by counted sizes.

Equal texts are worked on once; a text that occurs twice and is long enough goes as a whole.  No step holds pairs of
texts, and what is gathered a row is bounded by the text itself.

Defined results: a null text has no words; texts shorter than a window, also repeated ones, keep all words; repeated
rows stay repeated and their words go; equal ids are not merged; no other column is read or returned, so any name may
clash; an empty table gives an empty one.  A very long text is one row and one task.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import in_batches, stored
from tilewright.operators.scale import attach, spread_for_python

TEXT = ["text_1", "text_2"]
ROW = ["text_1", "row"]
SEGMENT = ["segment_1", "segment_2"]
FACTOR = np.uint64(0x9E3779B97F4A7C15)
POSITION = 24  # bits of a sliding minimum that carry a position


@dataclass(frozen=True)
class Repeats:
    """Words of a window; most windows of one anchor; phrases an automaton and segments a stream should hold."""

    size: int = 35
    windows: int = 28
    phrases: int = 20_000
    segments: int = 50_000

    @property
    def reach(self) -> int:
        return min(self.size, self.windows)


class _Codes:
    """A number for each word, by its bytes (by a digest where there are more than ``most``); ``at_once`` words are worked on together."""

    most, at_once = 64, 1 << 13
    powers = np.multiply.accumulate(np.full(at_once * (most + 1), FACTOR))
    inverse = np.multiply.accumulate(np.full(at_once * (most + 1), np.uint64(pow(int(FACTOR), -1, 1 << 64))))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        found = []
        for first in range(0, len(words), self.at_once):
            part = words[first:first + self.at_once]
            data, starts, ends = self._laid(part)
            if (ends - starts).max() > self.most:
                data, starts, ends = self._laid([w if len(w) <= self.most else xxhash.xxh3_128_hexdigest(w).encode() for w in part])
            # The sum of byte times power of its place in the word.
            sums = np.add.reduceat(self.powers[:len(data)] * data, starts) * self.inverse[starts]
            found.append((sums ^ (sums >> np.uint64(29))) * FACTOR)
        return np.concatenate(found)

    @staticmethod
    def _laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the words with a space after each; where words start and end."""
        data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.zeros(len(ends), dtype=np.int64)
        starts[1:] = ends[:-1] + 1
        return data, starts, ends


def _least(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Place of the least hash of every ``reach`` consecutive ones, the last of equal ones."""
    low = np.uint64((1 << POSITION) - 1)
    found, step = [], 1 << (POSITION - 1)
    for first in range(0, len(hashes) - reach + 1, step):
        part = hashes[first:first + step + reach - 1]
        place = np.arange(len(part), dtype=np.uint64)
        keys, width = (part & ~low) | (low - place), 1
        while width < reach:
            more = min(width, reach - width)
            keys = np.minimum(keys[:len(keys) - more], keys[more:])
            width += more
        found.append((low - (keys & low)).astype(np.int64) + first)
    return np.concatenate(found)


def anchors(words: list[bytes], how: Repeats, codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, first and last window start that has it, by place."""
    if len(words) < how.size:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    coded = codes(words)
    grams = how.size - how.reach + 1
    n = len(words) - grams + 1
    hashes = np.zeros(n, dtype=np.uint64)
    for i in range(grams):
        hashes = hashes * FACTOR + coded[i:i + n]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * FACTOR
    place = _least(hashes, how.reach)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return hashes[place[first]].view(np.int64), first, np.append(first[1:], len(place)) - 1


def _signed(data: bytes) -> tuple[int, int]:
    return struct.unpack(">qq", xxhash.xxh3_128_digest(data))


def _starts(words: list[bytes]) -> list[int]:
    """Where each word begins in the words joined by one space, and where a further one would."""
    return [0, *accumulate(len(w) + 1 for w in words)]


def _columns(names: tuple[str, ...], rows: list[tuple]) -> dict[str, list]:
    return dict(zip(names, map(list, zip(*rows)))) if rows else {name: [] for name in names}


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with keys of the text and of the row; only rows with equal id and text share the latter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumns({TEXT[0]: F.xxhash64("text"), TEXT[1]: F.xxhash64(F.lit(1), F.col("text"))})
    return rows.withColumn("row", F.xxhash64("doc_id", "text_2", "text_1"))


def anchored(docs: DataFrame, how: Repeats) -> DataFrame:
    """doc_id, keys, n_words, digest of all words, anchors (in order) of every row, stored."""
    def work(rows):
        codes = _Codes()
        texts = [(t or "").encode().split() for t in rows["text"]]
        return {
            "doc_id": rows["doc_id"], **{k: rows[k] for k in (*TEXT, "row")}, "n_words": [len(t) for t in texts],
            "all_sha256": [hashlib.sha256(b" ".join(t)).digest() for t in texts], "anchors": [anchors(t, how, codes)[0] for t in texts]}

    return stored(in_batches(_keyed(docs), work, "doc_id long, text_1 long, text_2 long, row long, n_words long, all_sha256 binary, anchors array<long>"))


def recurring(rows: DataFrame, how: Repeats) -> DataFrame:
    """Row keys and numbers of the anchors that occur again, in the same or another distinct text; one row stands for equal texts."""
    texts = rows.where(F.col("n_words") >= how.size).groupBy(*TEXT).agg(F.min("row").alias("row"), F.first("anchors").alias("anchors"))
    occurring = texts.select(*ROW, F.posexplode("anchors").alias("number", "anchor"))
    again = stored(occurring.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    return stored(occurring.join(again, "anchor").groupBy(*ROW).agg(F.collect_list("number").alias("numbers")))


def segments(texts: DataFrame, how: Repeats) -> DataFrame:
    """Every occurrence of a segment: row keys, start (word), segment keys, anchor; its words once a few hundred texts."""
    def work(rows):
        codes, seen, found = _Codes(), set(), []
        for one, two, text, numbers in zip(*(rows[c] for c in (*ROW, "text", "numbers"))):
            words = text.encode().split()
            hashes, first, last = (x.tolist() for x in anchors(words, how, codes))
            joined, at = b" ".join(words), _starts(words)
            for i in numbers:
                part = joined[at[first[i]]:at[last[i] + how.size] - 1]
                key = _signed(part)
                found.append((one, two, first[i], *key, hashes[i], None if key in seen else part.decode()))
                seen.add(key)
        return _columns((*ROW, "start", *SEGMENT, "anchor", "words"), found)

    return stored(in_batches(texts, work, "text_1 long, row long, start long, segment_1 long, segment_2 long, anchor long, words string"))


def phrases(distinct: DataFrame, how: Repeats) -> DataFrame:
    """anchor, words and mask of segments: the bits of those of its windows that are confirmed phrases, each phrase once."""
    def work(rows):
        found = []
        for one, two, text, n in zip(*(rows[c] for c in (*SEGMENT, "words", "n"))):
            joined = text.encode()
            at = _starts(joined.split(b" "))
            found += [(*_signed(joined[a:b - 1]), one, two, i, n) for i, (a, b) in enumerate(zip(at, at[how.size:]))]
        return _columns(("window_1", "window_2", *SEGMENT, "at", "n"), found)

    windows = in_batches(distinct.select(*SEGMENT, "words", "n"), work, "window_1 long, window_2 long, segment_1 long, segment_2 long, at int, n long")
    counted = windows.groupBy("window_1", "window_2").agg(F.sum("n").alias("n"), F.min(F.struct(*SEGMENT, "at")).alias("first")).where("n > 1")
    of = counted.groupBy(*[F.col(f"first.{k}").alias(k) for k in SEGMENT]).agg(F.bit_or(F.expr("shiftleft(1L, first.at)")).alias("mask"))
    return stored(distinct.join(of, SEGMENT).select(*SEGMENT, "anchor", "words", "mask"))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return 0


def _compiled(known: list[tuple[str, int]], size: int):
    """Automaton of the phrases of one anchor (words and mask of segments), and the numbers of their words, 0 for all others."""
    number = _Numbers()
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for words, mask in known:
        ids = tuple(number.setdefault(w, len(number) + 1) for w in words.split(" "))
        for at in range(len(ids) - size + 1):
            if mask >> at & 1:
                found.add_word(ids[at:at + size])
    found.make_automaton()
    return found, number


def _streamed(left: pd.DataFrame, right: pd.DataFrame, size: int) -> pd.DataFrame:
    """Keys and mask of the segments ``right`` whose anchor has phrases in ``left``."""
    known: dict[int, list] = {}
    for anchor, *one in zip(left["anchor"], left["words"], left["mask"]):
        known.setdefault(anchor, []).append(one)
    right = right[right["anchor"].isin(known.keys())].sort_values("anchor")
    masks, last = [], None
    for anchor, words in zip(right["anchor"], right["words"]):
        if anchor != last:
            (automaton, number), last = _compiled(known[anchor], size), anchor
        mask = 0
        for end, _ in automaton.iter(tuple(map(number.__getitem__, words.split(" ")))):
            mask |= 1 << (end - size + 1)
        masks.append(mask)
    return right[SEGMENT].assign(mask=pd.Series(masks, index=right.index, dtype="int64"))


def located(known: DataFrame, distinct: DataFrame, how: Repeats) -> DataFrame:
    """Segment keys and mask: the bits of all windows that are phrases, found by the automata."""
    total = known.agg(F.sum(F.bit_count("mask"))).first()[0] or 0
    # Half full on average: a shard beyond ``phrases`` is cut, and all its segments are streamed once more.
    shard = F.pmod(F.xxhash64("anchor"), F.lit(1 + 2 * total // how.phrases)).alias("shard")
    left, right = known.select(*SEGMENT, "anchor", "words", "mask", shard), distinct.select(*SEGMENT, "anchor", "words", shard)
    parts = left.groupBy("shard").agg(F.ceil(F.sum(F.bit_count("mask")) / how.phrases).alias("automata"))
    streams = right.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / how.segments).alias("streams"))
    sizes = parts.join(streams, "shard")

    def dealt(rows: DataFrame, own: str, other: str, of: str, over: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(own), *SEGMENT), F.col(of)).alias(own)
        return spread_for_python(attach(rows, sizes, "shard").select(*rows.columns, mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(over) - 1)).alias(other)), "shard", "automaton", "stream")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _streamed(left, right, how.size)

    keys = ["shard", "automaton", "stream"]
    left = dealt(left, "automaton", "stream", "automata", "streams").toDF(*SEGMENT, "anchor", "words", "mask", *keys)
    right = dealt(right, "stream", "automaton", "streams", "automata").toDF(*SEGMENT, "anchor", "words", "shard", "stream", "automaton")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, "segment_1 long, segment_2 long, mask long")
    return found.where("mask <> 0").groupBy(*SEGMENT).agg(F.bit_or("mask").alias("mask"))


def _stripped(texts: DataFrame, how: Repeats) -> DataFrame:
    """Row keys, removed spans (words, end exclusive), digest and text of the words that stay; ``texts`` has text and places (start, mask)."""
    def work(rows):
        found = {name: [] for name in (*ROW, "spans", "kept_sha256", "kept")}
        for one, two, text, places in zip(*(rows[c] for c in (*ROW, "text", "places"))):
            words = text.encode().split()
            change = np.zeros(len(words) + 1, dtype=np.int64)
            at = np.concatenate([p["start"] + np.flatnonzero([p["mask"] >> b & 1 for b in range(p["mask"].bit_length())]) for p in places])
            np.add.at(change, at, 1)
            np.add.at(change, at + how.size, -1)
            gone = np.cumsum(change[:-1]) > 0
            borders = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            spans = [{"start": int(a), "end": int(b)} for a, b in borders]
            for name, value in zip(found, (one, two, spans, hashlib.sha256(kept).digest(), kept.decode())):
                found[name].append(value)
        return found

    return in_batches(texts, work, "text_1 long, row long, spans array<struct<start: long, end: long>>, kept_sha256 binary, kept string")


def strip_repeats(docs: DataFrame, how: Repeats = Repeats(), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words, end exclusive), kept_sha256 of every row of ``docs`` (doc_id, text).

    Every word of a window of ``size`` words whose sequence starts anywhere else goes, by the windows of the input.
    ``with_text`` adds ``kept``, the words that stay, joined by one space.
    """
    rows, texts = anchored(docs, how), _keyed(docs).select(*ROW, "text")
    # A join may meet rows of equal id and text more than once: their windows recur anyway, so counts stay right.
    occurring = segments(texts.join(recurring(rows, how), ROW), how)
    distinct = stored(occurring.groupBy(*SEGMENT).agg(F.first("anchor").alias("anchor"), F.first("words", ignorenulls=True).alias("words"), F.count(F.lit(1)).alias("n")))
    masks = stored(located(phrases(distinct, how), distinct, how))
    places = attach(occurring.select(*ROW, "start", *SEGMENT), masks, SEGMENT).groupBy(*ROW).agg(F.collect_set(F.struct("start", "mask")).alias("places"))
    changed = _stripped(texts.join(stored(places), ROW), how).drop(*(() if with_text else ("kept",))).dropDuplicates(ROW)
    whole = rows.where(F.col("n_words") >= how.size).groupBy(*TEXT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*TEXT, F.lit(True).alias("whole"))
    # The texts that stay as they are need no join: their digest is there.
    rows = attach(rows.drop("anchors"), whole, TEXT, "left").join(changed, ROW, "left")
    span = "array<struct<start: long, end: long>>"
    spans = F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", F.array().cast(span))).alias("spans")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed")
    digest = F.lower(F.hex(F.when(F.col("whole"), F.lit(hashlib.sha256(b"").digest())).otherwise(F.coalesce("kept_sha256", "all_sha256")))).alias("kept_sha256")
    if not with_text:
        return rows.select("doc_id", "n_words", spans, digest).select("doc_id", "n_words", removed, "spans", "kept_sha256")
    plain = attach(rows, in_batches(texts, _plain, "text_1 long, row long, plain string").dropDuplicates(ROW), ROW)
    kept = F.when(F.col("whole"), F.lit("")).otherwise(F.coalesce("kept", "plain")).alias("kept")
    return plain.select("doc_id", "n_words", spans, digest, kept).select("doc_id", "n_words", removed, "spans", "kept_sha256", "kept")


def _plain(rows):
    return {**{k: rows[k] for k in ROW}, "plain": [b" ".join((t or "").encode().split()).decode() for t in rows["text"]]}


def repeats_sql(size: int = 35) -> str:
    """The same by counting all windows."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT r, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM d WHERE len(w) >= {size}),
    g AS (SELECT r, i, array_to_string(list_slice(w, i, i + {size - 1}), ' ') AS g FROM s),
    m AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
    x AS (SELECT DISTINCT r, unnest(range(i, i + {size})) AS i FROM m),
    c AS (SELECT r, list(i) AS gone, count(*) AS n FROM x GROUP BY r),
    k AS (SELECT d.r, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS i FROM d JOIN c USING (r)),
    t AS (SELECT k.r, string_agg(k.word, ' ' ORDER BY k.i) AS kept FROM k ANTI JOIN x ON k.r = x.r AND k.i = x.i GROUP BY k.r)
    SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed,
        sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
    FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
