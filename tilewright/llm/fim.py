"""Fill-in-the-middle: texts cut at two unit ranks, found in an indexable skip list.

The list holds one node per unit (a code point, or a match of ``unit``).  A link of a lane says how many units and how
many code points it skips; a search walks the highest lane as long as the units skipped stay within the rank wanted,
then goes down a lane, so it ends at the unit of that rank and has summed the code points before it.

Defined results: a null text is an empty one; empty texts and texts that contain a mark are ``plain`` and come out
unchanged; without a match the whole text is one unit; code points no unit matches belong to the unit before them
(leading ones to the first); a null doc_id draws as an empty one; repeated rows stay repeated and equal ids draw alike;
of the other columns none is read and none returned, so any name may clash; an empty table gives an empty one.
A text of any length is one row: the lists of a batch are built one after another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import in_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STEP = 1 << 20


@dataclass(frozen=True)
class Fim:
    """Seed of the draws, percent of texts transformed, percent of those with the suffix first, pattern of a unit (None: a code point)."""

    seed: int = 1
    rate: int = 90
    spm: int = 20
    unit: str | None = None


def _rises(positions: np.ndarray, lane: int) -> np.ndarray:
    """Nodes of a lane that are in the next one: a quarter, evenly spread, the first always, the same for the same position."""
    with np.errstate(over="ignore"):
        return np.flatnonzero(positions.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) < np.uint64(1 << (62 - 2 * lane)))


class SkipList:
    """Units of given code-point widths; ``widths`` None means ``n`` units of one code point, whose lowest lane is not stored."""

    def __init__(self, n: int, widths: np.ndarray | None = None):
        self.n = n
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units skipped, code points skipped, node below
        self.base = widths
        if n == 0:
            return
        at = nodes = np.concatenate([start + _rises(np.arange(start, min(n, start + STEP)), 0) for start in range(0, n, STEP)])
        units = np.diff(at, append=n)
        chars = units if widths is None else np.add.reduceat(widths, at)
        self.lanes.append((units, chars, at))
        while len(nodes) > 4:
            at = _rises(nodes, len(self.lanes))
            nodes, units, chars = nodes[at], np.add.reduceat(units, at), np.add.reduceat(chars, at)
            self.lanes.append((units, chars, at))

    def chars_before(self, rank: int) -> int:
        """Code points before the unit of this rank, 0 to n."""
        passed = chars = node = 0
        for units, widths, below in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed, chars, node = passed + int(units[node]), chars + int(widths[node]), node + 1
            if node == len(units):
                return chars
            node = int(below[node])
        if self.base is None:
            return chars + rank - passed
        while passed < rank:
            passed, chars, node = passed + 1, chars + int(self.base[node]), node + 1
        return chars


def unit_list(text: str, unit: str | None) -> SkipList:
    if unit is None:
        return SkipList(len(text))
    starts = [m.start() for m in regex.finditer(unit, text) if m.end() > m.start()]
    if not text:
        return SkipList(0)
    starts = np.array(starts or [0], dtype=np.int64)
    starts[0] = 0
    return SkipList(len(starts), np.diff(starts, append=len(text)))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, how: Fim = Fim()) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output of every row of ``docs`` (doc_id, text)."""
    def work(rows):
        found = {name: [] for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")}
        for doc, text, h1, h2, h3, h4 in zip(*(rows[c] for c in ("doc_id", "text", "h1", "h2", "h3", "h4"))):
            units = unit_list(text, how.unit)
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= how.rate:
                form, first, second, output = "plain", None, None, text
            else:
                low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
                first, second = units.chars_before(low), units.chars_before(high)
                prefix, middle, suffix = text[:first], text[first:second], text[second:]
                form = "spm" if h4 % 100 < how.spm else "psm"
                output = "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
                second -= first
            for name, value in zip(found, (doc, units.n, form, first, second, output)):
                found[name].append(value)
        return found

    seeds = [x.alias(f"h{i + 1}") for i, x in enumerate(_draws(F.col("doc_id"), how.seed))]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *seeds)
    return in_batches(narrow, work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The original text from a transformed one; marks cannot stand in the parts, so each is found where it was put."""
    def after(mark: str) -> Column:
        return F.position(F.lit(mark), output)

    def between(first: str, second: Column) -> Column:
        start = after(first) + len(first)
        return F.substr(output, start, second - start)

    end = F.char_length(output) + 1
    psm = F.concat(between(PREFIX, after(SUFFIX)), between(MIDDLE, end), between(SUFFIX, after(MIDDLE)))
    spm = F.concat(between(PREFIX, after(MIDDLE)), between(MIDDLE, end), between(SUFFIX, after(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_digests(docs: DataFrame, how: Fim = Fim()) -> DataFrame:
    """:func:`fill_in_middle` with digests of the output and of the text restored from it in place of the output."""
    made = fill_in_middle(docs, how)
    digest = F.sha2("output", 256).alias("output_sha256")
    back = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest, back)


def fim_sql() -> str:
    """The same by plain substrings, for code-point units."""
    draw = ", ".join(f"('0x' || substr(s, {1 + 8 * i}, 8))::bigint AS h{i + 1}" for i in range(4))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::varchar, '')) AS s FROM documents),
    h AS (SELECT doc_id, text, length(text)::bigint AS n, {draw} FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
    FROM p"""
