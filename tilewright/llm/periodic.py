"""Periodic runs of words, by internal pattern matching.

A run of period q and at least four periods contains an aligned block of 2**k words, q < 2**k <= 2q, and the block
occurs again exactly q words to one side of it: occurrences of a block in a neighbouring window of twice its length are
a progression whose step is the block's own period.  So for every dyadic block of every text the next and the previous
occurrence are looked up - a range successor in the block's interval of the suffix array, answered by a wavelet matrix -
and the step is a candidate period, confirmed by comparing words around the block.  Confirmed stretches of one period
that touch are one run.  n words need fewer than n blocks and O(n log n) work, whatever they repeat.

Texts of a batch share one suffix array, with a separator of its own after each; a longer text is a batch alone.

Defined results: a null text has no words and no runs; short and blank texts have none; repeated rows stay repeated;
no column but doc_id and text is read or returned, so other names may clash; an empty table gives an empty one.
A very long text costs some hundred bytes a word in one task.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import in_batches

LEAST, TIMES = 6, 4  # words and periods a run has at least
WORDS_AT_ONCE = 1 << 16
CELLS = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"


class WaveletMatrix:
    """Counts and order statistics of values below 2**bits over index ranges, many queries at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        pad = -len(values) % 64 + 64
        for level in reversed(range(self.bits)):
            one = (values >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([one, np.zeros(pad, dtype=bool)]), bitorder="little").view(np.uint64)
            ranks = np.zeros(len(packed), dtype=np.int64)
            np.cumsum(np.bitwise_count(packed)[:-1], out=ranks[1:])
            self.levels.append((packed, ranks, len(values) - int(one.sum())))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(packed, ranks, i):
        word = i >> 6
        return ranks[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def below(self, low, high, x):
        """How many values of each index range are less than x."""
        count = np.zeros(len(low), dtype=np.int64)
        for level, (packed, ranks, zeros) in zip(reversed(range(self.bits)), self.levels):
            a, b = self._ones(packed, ranks, low), self._ones(packed, ranks, high)
            right = (x >> level & 1).astype(bool)
            count += np.where(right, high - low - b + a, 0)
            low, high = np.where(right, zeros + a, low - a), np.where(right, zeros + b, high - b)
        return count

    def at_rank(self, low, high, rank):
        """The value of this rank (0: the least) in each index range."""
        value = np.zeros(len(low), dtype=np.int64)
        for level, (packed, ranks, zeros) in zip(reversed(range(self.bits)), self.levels):
            a, b = self._ones(packed, ranks, low), self._ones(packed, ranks, high)
            left = high - low - b + a
            right = rank >= left
            rank = np.where(right, rank - left, rank)
            value |= right.astype(np.int64) << level
            low, high = np.where(right, zeros + a, low - a), np.where(right, zeros + b, high - b)
        return value


def _blocks(symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray):
    """Suffix array (by as many words as blocks have) and the blocks that occur twice: level, start, interval in the array."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(first, append=n)
    rank, size = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    rank[order], size[order] = np.repeat(first, sizes), np.repeat(sizes, sizes)
    found, level, reach = [], 0, 1
    while 4 * reach <= lengths.max(initial=0):
        slots = np.flatnonzero(size[order] > 1)
        if not len(slots):
            break
        live = order[slots]
        after = live + reach
        key = rank[live] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        live, key = live[by], key[by]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(new, append=len(live))
        order[slots] = live
        rank[live], size[live] = np.repeat(slots[new], sizes), np.repeat(sizes, sizes)
        level, reach = level + 1, 2 * reach
        live = live[size[live] > 1]
        text = np.searchsorted(begins, live, side="right") - 1
        inside = live - begins[text]
        live = live[(inside % reach == 0) & (inside + reach <= lengths[text]) & (2 * reach <= lengths[text])]
        found.append((np.full(len(live), level), live, rank[live], rank[live] + size[live]))
    return order, [np.concatenate(x) for x in zip(*found)] if found else None


def _equal_steps(symbols: np.ndarray, start: np.ndarray, period: np.ndarray, step: int, width: int) -> np.ndarray:
    """For how many words from ``start`` on, at most ``width``, each equals the word a period later."""
    n, out = len(symbols), np.empty(len(start), dtype=np.int64)
    steps = np.arange(width) * step
    for at in range(0, len(start), max(1, CELLS // width)):
        rows = slice(at, at + max(1, CELLS // width))
        here = start[rows, None] + steps
        there = here + period[rows, None]
        differ = (here < 0) | (there >= n)
        differ |= symbols[np.clip(here, 0, n - 1)] != symbols[np.clip(there, 0, n - 1)]
        out[rows] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return out


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) by start, then period, for each array of word numbers."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    symbols = np.concatenate([np.append(t, top + i) for i, t in enumerate(texts)]).astype(np.int64)
    none = np.empty((0, 3), dtype=np.int64)
    order, blocks = _blocks(symbols, begins, lengths)
    if blocks is None or not len(blocks[0]):
        return [none] * len(texts)
    level, start, low, high = blocks
    tree = WaveletMatrix(order)
    rank = tree.below(low, high, start)
    starts, periods, levels = [], [], []
    for side in (1, -1):
        other = rank + side
        some = np.flatnonzero((other >= 0) & (other < high - low))
        distance = (tree.at_rank(low[some], high[some], other[some]) - start[some]) * side
        some, distance = some[(d := distance >> (level[some] - 1)) == 1], distance[d == 1]
        starts.append(start[some] - (distance if side < 0 else 0))
        periods.append(distance)
        levels.append(level[some])
    start, period, level = np.concatenate(starts), np.concatenate(periods), np.concatenate(levels)
    stretches = [none.T]
    for k in np.unique(level):
        of, size = level == k, 1 << int(k)
        s, p = start[of], period[of]
        left = _equal_steps(symbols, s - 1, p, -1, 4 * size)
        right = _equal_steps(symbols, s + size, p, 1, 4 * size)
        good = left + size + right + p >= np.maximum(LEAST, TIMES * p)
        stretches.append(np.stack([p, s - left, s + size + right])[:, good])
    period, start, end = np.concatenate(stretches, axis=1)
    by = np.lexsort((start, period))
    period, start, end = period[by], start[by], end[by]
    if not len(period):
        return [none] * len(texts)
    # Ends grow along a period's stretches only up to the widest so far; shifting periods apart keeps the running maximum theirs.
    shift = period * (2 * len(symbols))
    widest = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > widest[:-1]]))
    last = np.append(new[1:], len(period)) - 1
    runs = np.stack([start[new], (widest - shift)[last] - start[new] + period[new], period[new]], axis=1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs[:, 0] -= begins[text]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [runs[cuts[i]:cuts[i + 1]] for i in range(len(texts))]


def _groups(sizes: list[int]):
    """Ranges of consecutive texts with at most WORDS_AT_ONCE words together, a longer text alone."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > WORDS_AT_ONCE:
            yield first, i
            first, total = i, 0
        total += size
    if sizes:
        yield first, len(sizes)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period), collapsed (text without words any run repeats) of every row.

    ``docs`` has doc_id and text; a run keeps its first period in the collapsed text unless another run drops it.
    """
    def work(rows):
        texts = [(t or "").encode().split() for t in rows["text"]]
        runs, collapsed = [], []
        for first, last in _groups([len(t) for t in texts]):
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            coded = [np.fromiter(map(number.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts[first:last]]
            for words, found in zip(texts[first:last], find_runs(coded)):
                keep = np.ones(len(words), dtype=bool)
                for start, length, period in found:
                    keep[start + period:start + length] = False
                runs.append([dict(zip(("start", "length", "period"), map(int, r))) for r in found])
                collapsed.append(b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode() if len(found) else b" ".join(words).decode())
        return {"doc_id": rows["doc_id"], "runs": runs, "collapsed": collapsed}

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(narrow, work, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of a tenth of the texts, drawn by id, repeat from some word on (a null id: none)."""
    drawn = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words, g = F.col("_words"), F.floor(F.col("_h") / 10)
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))

    def source(i: Column) -> Column:
        return F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))

    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), source), " ")
    hit = F.pmod(F.col("_h"), F.lit(10)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", drawn.alias("_h"))
    rows = rows.withColumn("_words", F.when(hit, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    return rows.select("doc_id", F.when(hit & (F.size("_words") > 0), repeated).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per row of :func:`periodic_runs`: number of runs, the longest one, digests of all runs and of the collapsed text."""
    found = periodic_runs(docs)
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = F.array_max(order)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    lines = F.concat_ws("", F.transform("runs", line))
    start, length, period = -best["s"], best["length"], -best["p"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        ((1000 * length - F.pmod(1000 * length, period)) / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
