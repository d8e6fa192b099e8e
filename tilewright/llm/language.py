"""Language identification by error-correcting output codes.

Every language has a codeword; for every bit a binary n-gram classifier (weights
are log odds of hashed letter pairs and triples between the languages with bit 1
and those with bit 0) predicts that bit.  Decoding sums a logistic loss over the
bits, weighted by how well each bit's sides can be told apart, and takes the
language with the nearest codeword; close seconds are flagged as ambiguous.

The counts behind the weights come from a bounded sample of the labelled rows
(``per_language`` expected rows each, chosen by a hash of doc_id) and are summed
by Spark; only the finished table (languages times ``buckets``) reaches the driver.

Defined results: a null text, or one without a letter, gets ``und`` and score 0;
without any labelled row every text does; with one learned language every other
text gets it with score 1.  Repeated rows are predicted one by one.
An empty table gives an empty one; a very long text is read in pieces of one row; columns other than doc_id, text and lang
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import checkpointed, in_batches
from tilewright.llm.quality import CLASS_AT, TABLE_END

UNKNOWN = "und"
LETTER_CLASSES = 2  # classes 0..2 of the character table are letters; 7 (beyond the table) counts as letter too
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Training:
    """Bounds and parameters: expected sample rows per language, hash buckets (a power of two)."""

    per_language: int = 4000
    buckets: int = 1 << 15
    smoothing: float = 0.5
    sharpness: float = 12.0
    ambiguous_below: float = 0.6


def grams(text: str, buckets: int) -> np.ndarray:
    """Bucket numbers of letter pairs and triples of the lower-case text; runs of other characters are one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    kinds = CLASS_AT[np.minimum(codes, TABLE_END)]
    letter = (kinds <= LETTER_CLASSES) | (kinds == 7)
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate([[np.uint32(32)], codes[keep]]).astype(np.uint32)
    pairs = codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) ^ codes[2:] * np.uint32(0x27D4EB2F)
    mixed = np.concatenate([pairs, triples])
    return ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of 0/1 bits: all splits of the languages for up to seven, else the best of some seeded random codes."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))  # the last language is always 0, so no split comes twice
        return ((splits[None, :] >> np.arange(n)[:, None]) & 1).astype(np.int8)
    bits, draw = int(np.ceil(12 * np.log2(n))), np.random.default_rng(7)
    tried = [draw.integers(0, 2, (n, bits), dtype=np.int8) for _ in range(50)]

    def worst(code: np.ndarray) -> int:
        ones = code.astype(np.float32)
        apart = ones.sum(axis=1)[:, None] + ones.sum(axis=1)[None, :] - 2 * ones @ ones.T + bits * np.eye(n, dtype=np.float32)
        sides = np.minimum(code.sum(axis=0), n - code.sum(axis=0))
        return int(apart.min()) if sides.min() else -1

    return max(tried, key=worst)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray
    how: Training

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the second-best codeword is nearly as close."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        found = grams(text, self.how.buckets)
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = sum(self.weights[found[at:at + AT_ONCE]].sum(axis=0) for at in range(0, len(found), AT_ONCE)) / len(found)
        signs = 2 * self.code - 1
        loss = (np.logaddexp(0, -signs * margin * self.how.sharpness / 4) * self.bit_weights).sum(axis=1)
        chance = np.exp(loss.min() - loss)
        chance /= chance.sum()
        best = int(np.argmax(chance))
        return self.languages[best], float(chance[best]), bool(chance[best] < self.how.ambiguous_below)


def learned(counts: dict[str, np.ndarray], how: Training) -> Model:
    """Model from gram counts per language."""
    languages = sorted(counts)
    code = codewords(len(languages))
    table = np.array([counts[x] for x in languages], dtype=float).reshape(len(languages), how.buckets)
    share = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
    floor = how.smoothing / max(table.sum() / max(len(languages), 1), 1.0)
    weights, apart = np.zeros((how.buckets, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1])
    for bit in range(code.shape[1]):
        one, zero = share[code[:, bit] == 1].mean(axis=0) + floor, share[code[:, bit] == 0].mean(axis=0) + floor
        odds = np.log(one / zero)
        weights[:, bit] = odds
        apart[bit] = ((one - zero) * odds).sum()
    return Model(languages, code, weights, apart / max(apart.sum(), 1e-12) * 4, how)


def train(labelled: DataFrame, how: Training = Training()) -> Model:
    """Learns from rows (doc_id, text, lang) with a label; every language with such a row is learned."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = checkpointed(labelled.groupBy("lang").count())
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limit = F.ceil(F.lit(how.per_language * (1 << 20)) / F.col("count"))
    sampled = labelled.join(F.broadcast(counts.select("lang", limit.alias("limit"))), "lang").where(draw < F.col("limit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                kept = sums.setdefault(lang.as_py(), np.zeros(how.buckets, dtype=np.int64))
                kept += np.bincount(grams(text.as_py(), how.buckets), minlength=how.buckets)
        for lang, kept in sums.items():
            on = np.flatnonzero(kept)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(on), pa.string()), "gram": pa.array(on, pa.int64()), "n": pa.array(kept[on], pa.int64())})

    parts = sampled.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    table: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().itertuples():
        table.setdefault(row.lang, np.zeros(how.buckets))[row.gram] = row.n
    return learned(table, how)


def predict_languages(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """doc_id, any further columns, lang_pred, score, ambiguous of every row (doc_id, text)."""
    rows = docs.select("doc_id", *more, "text")
    kept = rows.schema.fields[:-1]

    def work(values):
        found = [model.predict(t) for t in values["text"]]
        return {f.name: values[f.name] for f in kept} | {n: [f[i] for f in found] for i, n in enumerate(("lang_pred", "score", "ambiguous"))}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double, ambiguous boolean"])
    return in_batches(rows, work, schema)


def held_out(doc_id: Column) -> Column:
    """Fixed fold: the rows nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """Trains on the rows outside the held-out fold and predicts every row."""
    model = train(docs.where(~held_out(F.col("doc_id"))), how)
    return predict_languages(docs, model, held_out(F.col("doc_id")).alias("held_out"))
