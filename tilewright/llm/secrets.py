"""Secret scan: fixed patterns plus random strings found by their token efficiency.

A string that a public vocabulary needs many tokens for (few characters per
token) is unlike any text the vocabulary was made from.  Digests of known
lengths, UUIDs and plain numbers are excluded: they are random but identify
things.  What the fixed patterns find always stays.

Defined results: a null or empty text has no spans (the digest is that of the
empty string); spans are in code points with exclusive ends; overlapping spans
of different kinds are all reported; redaction merges them first.
Repeated rows stay repeated and an empty table gives an empty one; a very long text is one row, tokenised run by run;
redaction passes all columns through, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from tilewright.llm.common import in_batches

# Kinds in their order of report, the patterns and their least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the least length may stand in the pattern
LEAST_VALUE, LEAST_ACCESS = 6, 20

# Shapes of identifiers that are no secrets.
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")
DIGEST = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]+(?![A-Za-z0-9])")


@dataclass(frozen=True)
class Efficiency:
    """Parameters of the token test: candidate length and characters per token below which it is random."""

    least: int = 20
    ratio: float = 2.0
    vocabulary: str = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(vocabulary), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=8)
def _candidates(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{least},}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the fixed patterns find."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_identifier(run: str) -> bool:
    """Digests, UUIDs and numbers are not tested; words, of whatever letter case, are told by their ratio alone."""
    core = run.strip("-_=+/")
    if UUID.fullmatch(core) or HEX_ONLY.fullmatch(core) and len(core) in DIGEST_LENGTHS:
        return True
    return not any(c.isalpha() for c in core)


def _low(text: str, test: Efficiency) -> bool:
    return len(text) < test.ratio * len(_encoding(test.vocabulary).encode_ordinary(text))


def _stretches(part: str, test: Efficiency) -> list[tuple[int, int]]:
    """Merged stretches of whole tokens, of the candidate length or just above it, that are random by themselves."""
    encoding = _encoding(test.vocabulary)
    sizes = [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(part)]
    ends = list(accumulate(sizes))
    found: list[tuple[int, int]] = []
    last = 0
    for first, end in enumerate(ends):
        start = end - sizes[first]
        while last < len(ends) and ends[last] - start < test.least:
            last += 1
        if last == len(ends):
            break
        if ends[last] - start < test.ratio * (last - first + 1) and not is_identifier(part[start:ends[last]]):
            if found and start <= found[-1][1]:
                start = found.pop()[0]
            found.append((start, ends[last]))
    return found


def _around(run: str, start: int, end: int) -> tuple[int, int]:
    """A hexadecimal stretch and what touches it without a separator."""
    if not (run[start - 1:start].isalnum() or run[end:end + 1].isalnum()):
        return start, end
    while start and (run[start - 1].isalnum() or run[start - 1] in "+/"):
        start -= 1
    while end < len(run) and (run[end].isalnum() or run[end] in "+/"):
        end += 1
    return start, end


def random_spans(text: str, base: list[tuple[int, int, int]], test: Efficiency) -> list[tuple[int, int, int]]:
    """Spans of low token efficiency outside what the fixed patterns have found.

    What is left of a run between base spans and identifiers is tested as a whole, then in sliding stretches, so
    words before or after a random string do not hide it.  Text that touches a hexadecimal span is tested with it.
    """
    found = []
    for match in _candidates(test.least).finditer(text):
        run, at = match[0], match.start()
        inner = [(max(s - at, 0), min(e - at, len(run)), k) for s, k, e in base if s < match.end() and at < e]
        if not inner and is_identifier(run):
            continue
        if not inner and _low(run, test):
            found.append((at, 3, match.end()))
            continue
        named = [m.span() for m in UUID.finditer(run)]
        named += [m.span() for m in DIGEST.finditer(run) if m.end() - m.start() in DIGEST_LENGTHS]
        for start, end in ((s, e) for s, e, k in inner if k == 2 and not any(o != k and a < e and s < b for a, b, o in inner)):
            wide = _around(run, start, end)
            if wide != (start, end) and _low(run[wide[0]:wide[1]], test):
                found.append((at + wide[0], 3, at + wide[1]))
                named.append(wide)
        left = 0
        for start, end in [*sorted([*named, *((s, e) for s, e, _ in inner)]), (len(run), len(run))]:
            part = run[left:start]
            if len(part) >= test.least and not is_identifier(part):
                spans = [(0, len(part))] if inner and _low(part, test) else _stretches(part, test)
                found += [(at + left + s, 3, at + left + e) for s, e in spans]
            left = max(left, end)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str | None, test: Efficiency = Efficiency()) -> dict:
    text = text or ""
    base = base_spans(text)
    extra = random_spans(text, base, test)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return {
        "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(),
        "spans": _joined(sorted(base + extra)), "n_random": len(extra)}


NAMES = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def secret_scan(docs: DataFrame, test: Efficiency = Efficiency()) -> DataFrame:
    """One row per document (doc_id, text) with its counts and spans."""
    def work(rows):
        found = [scan(t, test) for t in rows["text"]]
        return {"doc_id": rows["doc_id"]} | {n: [f[n] for f in found] for n in NAMES}

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return in_batches(docs.select("doc_id", "text"), work, schema)


def redacted(text: str, test: Efficiency = Efficiency(), mark: str = "[SECRET]") -> str:
    """The text with every merged span replaced by the mark."""
    base = base_spans(text)
    parts, at = [], 0
    for start, _, end in sorted(base + random_spans(text, base, test)):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, test: Efficiency = Efficiency()) -> DataFrame:
    """All rows and columns, secrets in ``text`` replaced; ``n_chars`` follows a changed text."""
    def work(rows):
        texts = [None if t is None else redacted(t, test) for t in rows["text"]]
        if "n_chars" in rows:
            rows = rows | {"n_chars": [n if new == old else len(new) for n, new, old in zip(rows["n_chars"], texts, rows["text"])]}
        return rows | {"text": texts}

    return in_batches(docs, work, docs.schema)
