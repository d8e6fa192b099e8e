"""Periodic runs and fill-in-the-middle against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import fim, periodic


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i:j + q]
            if length >= max(6, 4 * q) and not any(q % d == 0 and all(part[x] == part[x + d] for x in range(length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def as_tuples(found):
    return [tuple(map(int, r)) for r in found]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=80), min_size=1, max_size=5))
def test_runs_of_few_symbols(texts):
    arrays = [np.array(t, dtype=np.int64) for t in texts]
    assert [as_tuples(r) for r in periodic.find_runs(arrays)] == [brute_runs(t) for t in texts]


def test_runs_of_planted_periods():
    draw = random.Random(5)
    for _ in range(60):
        words = []
        for _ in range(draw.randint(1, 6)):
            words += [draw.randrange(30) for _ in range(draw.randint(0, 40))]
            unit = [draw.randrange(draw.choice((2, 30))) for _ in range(draw.randint(1, 33))]
            words += (unit * 9)[:draw.randint(3 * len(unit), 9 * len(unit))]
        assert as_tuples(periodic.find_runs([np.array(words, dtype=np.int64)])[0]) == brute_runs(words)


def test_range_successor_matches_sorting():
    draw = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 300):
        values = draw.permutation(n)
        tree = periodic.WaveletMatrix(values)
        low = draw.integers(0, n, 200)
        high = np.array([draw.integers(a + 1, n + 1) for a in low])
        x = draw.integers(0, n, 200)
        assert tree.below(low, high, x).tolist() == [int((values[a:b] < y).sum()) for a, b, y in zip(low, high, x)]
        rank = np.array([draw.integers(0, b - a) for a, b in zip(low, high)])
        assert tree.at_rank(low, high, rank).tolist() == [int(np.sort(values[a:b])[r]) for a, b, r in zip(low, high, rank)]


def planted(doc, text):
    words = (text or "").encode().split()
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digests(doc, text):
    words = planted(doc, text)
    runs = brute_runs(words) if len(words) < 3000 else as_tuples(periodic.find_runs([np.unique(words, return_inverse=True)[1]])[0])
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_digests_match_brute_force(docs, texts, odd, none):
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    short = docs.where("length(text) < 4000")
    for frame in (short, odd):
        rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        found = periodic.run_digests(periodic.with_planted_repeats(frame)).select(*columns).collect()
        assert sorted(map(tuple, found), key=repr) == sorted((brute_digests(*r) for r in rows), key=repr)
        assert any(r["n_runs"] for r in found)
    assert periodic.run_digests(periodic.with_planted_repeats(none)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 4000), st.integers(0, 10_000))
def test_code_points_before_a_rank(n, seed):
    plain = fim.SkipList(n)
    widths = np.random.default_rng(seed).integers(1, 9, n)
    wide = fim.SkipList(n, widths)
    for rank in {0, n, n // 2, seed % (n + 1)}:
        assert plain.chars_before(rank) == rank
        assert wide.chars_before(rank) == int(widths[:rank].sum())


def brute_cut(doc, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    spm = h4 % 100 < 20
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if spm else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return (doc, n, "spm" if spm else "psm", a, b - a, sha(out), sha(text))


def test_cuts_match_plain_slices(spark, docs, odd, none):
    marked = spark.createDataFrame([(i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<", "<P", "P><S<M", "🙂<S>ü", "ab" * 50, "<S" * 40, "M>" * 40] * 12)], "doc_id long, text string")
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    for frame in (docs, odd, marked):
        rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        found = [tuple(r) for r in fim.fim_digests(frame).select(*columns).collect()]
        assert sorted(found, key=repr) == sorted((brute_cut(*r) for r in rows), key=repr)
    assert fim.fim_digests(none).count() == 0


@pytest.mark.parametrize("unit", [r"[^\x20\x09-\x0D]+", r"\X", r"\n"])
def test_cuts_at_units_restore_the_text(odd, docs, unit):
    for frame in (odd, docs.limit(200)):
        from pyspark.sql import functions as F

        made = fim.fill_in_middle(frame, fim.Fim(seed=3, rate=100, unit=unit))
        back = made.select("doc_id", F.md5(fim.restored(F.col("output"), F.col("form"))).alias("m"))
        wanted = frame.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m"))
        assert back.exceptAll(wanted).isEmpty() and wanted.exceptAll(back).isEmpty()
        assert {r["form"] for r in made.collect()} >= {"psm", "spm"} or frame is odd


def test_cuts_fall_on_unit_borders(spark):
    frame = spark.createDataFrame([(i, f"one two  three {i} four") for i in range(200)], "doc_id long, text string")
    for r in fim.fill_in_middle(frame, fim.Fim(rate=100, unit=r"[a-z0-9]+")).collect():
        text = f"one two  three {r['doc_id']} four"
        starts = {m for m in range(len(text)) if (m == 0 or text[m - 1] == " ") and text[m] != " "} | {0, len(text)}
        assert r["n"] == 5 and r["prefix_chars"] in starts and r["prefix_chars"] + r["middle_chars"] in starts
