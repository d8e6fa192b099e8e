"""Quality rules: counts per text and the divergence of its histograms from language references.

A text is kept when it passes the base rules and its two histograms (character
classes, common words) lie near those of at least one language.  References are
the summed histograms of all rows of a language, so they follow the corpus.

Defined results: a null text counts as no words; a text without words fails the
base rules; histograms shorter than the minimum lengths are not judged.  Without
any labelled language one pooled reference is used.  Repeated rows are judged
one by one; other columns of the input are passed through or ignored.
An empty table gives an empty one; a very long text is counted in one row.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import checkpointed, in_batches

# Common function words of English, French, German and Spanish, and the symbol set.
COMMON_WORDS = (
    "the of and to in a is that for it was with as on be at by this are or from an not "
    "de la le et les des un une du que qui dans est en pour par sur au avec pas ne "
    "el y los se del las no con su lo al "
    "der die und das von zu den mit ist auf für im nicht ein eine sich es dem"
).split()
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"

WORD_AT = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
OTHER_WORD = len(WORD_AT)
CLASSES = 8
REFERENCES_AT_ONCE = 32


def _class_of(code: int) -> int:
    """0 lower, 1 upper, 2 other letter or mark, 3 number, 4 white space, 5 common punctuation, 6 the rest; 7 beyond the table."""
    char = chr(code)
    kind = unicodedata.category(char)
    if kind in ("Ll", "Lu"):
        return 0 if kind == "Ll" else 1
    if kind[0] in "LM":
        return 2
    if kind[0] == "N":
        return 3
    if kind[0] == "Z" or 9 <= code <= 13:
        return 4
    return 5 if char in PUNCTUATION else 6


TABLE_END = 0x3000
CLASS_AT = np.array([_class_of(i) for i in range(TABLE_END)] + [7], dtype=np.int8)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.  Distances are Jensen-Shannon distances (base 2, 0 to 1)."""

    char_distance: float = 0.25
    word_distance: float = 0.42
    min_chars: int = 200
    min_words: int = 100


def base_counts(text: str) -> dict[str, int]:
    """Word, symbol, repeated-line and repeated-word counts of one text."""
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    n_dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            n_dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words), "word_chars": len(text) - sum(text.count(w) for w in " \t\n\x0b\x0c\r"),
        "n_symbols": sum(text.count(s) for s in SYMBOLS), "n_dup_lines": n_dup, "n_repeat_words": repeated_words(words)}


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    twice = np.fromiter((counts[w] >= 2 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(twice)] |= twice
    return int(covered.sum())


def histograms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character-class counts and common-word counts (last: all other words)."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    chars = np.bincount(CLASS_AT[np.minimum(codes, TABLE_END)], minlength=CLASSES)
    counts = Counter(text.lower().encode().split())
    words = np.fromiter((counts.get(w, 0) for w in WORD_AT), dtype=np.int64, count=OTHER_WORD)
    return chars, np.append(words, counts.total() - words.sum())


def nearest_js(rows: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Smallest Jensen-Shannon distance of every row histogram to any reference; NaN for empty rows or no reference."""
    if not len(references):
        return np.full(len(rows), np.nan)
    if len(references) > REFERENCES_AT_ONCE:  # so memory does not follow their number
        parts = [nearest_js(rows, references[at:at + REFERENCES_AT_ONCE]) for at in range(0, len(references), REFERENCES_AT_ONCE)]
        return np.min(parts, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (rows / rows.sum(axis=1, keepdims=True))[:, None, :]
        q = (references / references.sum(axis=1, keepdims=True))[None, :, :]
        m = (p + q) / 2
        parts = [np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=2) for x in (p, q)]
    found = np.sqrt(np.maximum(0.0, (parts[0] + parts[1]) / 2)).min(axis=1)
    return np.where(rows.sum(axis=1) > 0, found, np.nan)


def language_references(docs: DataFrame, rules: Rules = Rules()) -> list[tuple[np.ndarray, np.ndarray]]:
    """Summed histograms of every language with a labelled row, however few; each is some seventy numbers."""
    def work(rows):
        sums: dict = {}
        for lang, text in zip(rows["lang"], rows["text"]):
            chars, words = histograms(text or "")
            kept = sums.setdefault(lang, [0, np.zeros(CLASSES, np.int64), np.zeros(OTHER_WORD + 1, np.int64)])
            kept[0] += 1
            kept[1] += chars
            kept[2] += words
        return {"lang": list(sums), "n": [s[0] for s in sums.values()], "h": [np.concatenate(s[1:]).tolist() for s in sums.values()]}

    parts = in_batches(docs.select("lang", "text"), work, "lang string, n long, h array<long>")
    width = CLASSES + OTHER_WORD + 1
    summed = parts.groupBy("lang").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("h")[i]) for i in range(width)]).alias("h"))
    summed = checkpointed(summed)
    labelled = summed.where(F.col("lang").isNotNull()).collect()
    if not labelled and not summed.isEmpty():
        pooled = summed.agg(*[F.sum(F.col("h")[i]) for i in range(width)]).first()
        arrays = [np.array(list(pooled), dtype=np.int64)]
    else:
        arrays = [np.array(r["h"], dtype=np.int64) for r in sorted(labelled, key=lambda r: r["lang"])]
    return [(a[:CLASSES], a[CLASSES:]) for a in arrays if a[:CLASSES].sum() and a[CLASSES:].sum()]


def judge(texts: list[str | None], references, rules: Rules = Rules()) -> dict[str, list]:
    """All counts, both distances (null where not judged) and the verdict of every text."""
    texts = [t or "" for t in texts]
    counts = [base_counts(t) for t in texts]
    out = {name: [c[name] for c in counts] for name in (NAMES[:5])}
    out["base_failed"] = [n < 50 or 100 * r > 50 * n for n, r in zip(out["n_words"], out["n_repeat_words"])]
    found = [histograms(t) for t in texts]
    for at, (name, sizes, least) in enumerate((
            ("char_distance", [len(t) for t in texts], rules.min_chars), ("word_distance", out["n_words"], rules.min_words))):
        near = nearest_js(np.array([f[at] for f in found]), np.array([r[at] for r in references]))
        out[name] = [None if n < least or np.isnan(d) else float(d) for n, d in zip(sizes, near)]
    far = [(c or 0) > rules.char_distance or (w or 0) > rules.word_distance for c, w in zip(out["char_distance"], out["word_distance"])]
    out["kept"] = [not (b or f) for b, f in zip(out["base_failed"], far)]
    return out


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double")
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document (doc_id, text, lang): counts, distances and ``kept``."""
    references = language_references(docs, rules)

    def work(rows):
        return {"doc_id": rows["doc_id"]} | judge(rows["text"], references, rules)

    return in_batches(docs.select("doc_id", "text"), work, f"doc_id long, {SCHEMA}")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows the rules keep, all columns unchanged, without a join or shuffle."""
    references = language_references(docs, rules)

    def work(rows):
        kept = judge(rows["text"], references, rules)["kept"]
        return {name: [v for v, k in zip(values, kept) if k] for name, values in rows.items()}

    return in_batches(docs, work, docs.schema)
