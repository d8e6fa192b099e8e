"""Repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd

from tilewright.llm import passages
from tilewright.llm.passages import Repeats


def brute(rows, size):
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    counts = Counter(tuple(w[i:i + size]) for _, w in split for i in range(len(w) - size + 1))
    out = []
    for doc, w in split:
        gone = {j for i in range(len(w) - size + 1) if counts[tuple(w[i:i + size])] > 1 for j in range(i, i + size)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def found(frame, how):
    rows = passages.strip_repeats(frame, how, with_text=True).collect()
    for r in rows:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"])
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in rows), key=repr)


def mixed(seed, texts=60, words=40):
    draw = random.Random(seed)
    lines = [[f"w{draw.randrange(words)}" for _ in range(draw.randint(3, 60))] for _ in range(8)]
    rows = []
    for i in range(texts):
        parts = []
        for _ in range(draw.randint(0, 6)):
            part = list(draw.choice(lines)) if draw.random() < 0.6 else [f"w{draw.randrange(words)}" for _ in range(draw.randint(1, 50))]
            if draw.random() < 0.3:
                part[draw.randrange(len(part))] = f"edit{i}"
            parts += part * draw.choice((1, 1, 1, 3))
        rows.append((draw.choice((i, i, None)), draw.choice((" ", "\n", " \t")).join(parts) or draw.choice((None, "", "one"))))
    return rows + rows[:5]


def test_removed_words_match_brute_force(spark):
    rows = mixed(1)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for how in (Repeats(), Repeats(size=5), Repeats(size=1), Repeats(size=12, windows=3, phrases=7, segments=3)):
        assert found(frame, how) == brute(rows, how.size), how


def test_odd_rows_and_whole_table(docs, texts, odd, none):
    assert found(docs, Repeats()) == brute(texts, 35)
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert found(odd, Repeats()) == brute(rows, 35)
    assert passages.strip_repeats(none).count() == 0


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(3)
    for symbols in (1, 2, 50):
        words = [b"%d" % x for x in draw.integers(0, symbols, 400)]
        for how in (Repeats(), Repeats(size=7), Repeats(size=9, windows=4)):
            hashes, first, last = passages.anchors(words, how, passages._Codes())
            assert first[0] == 0 and last[-1] == len(words) - how.size and (first[1:] == last[:-1] + 1).all()
            assert (last - first < how.reach).all()
            of = {}
            for i, (a, b) in enumerate(zip(first, last)):
                for at in range(a, b + 1):
                    assert of.setdefault(tuple(words[at:at + how.size]), hashes[i]) == hashes[i]


def test_least_is_the_last_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(passages, "POSITION", 6)
    draw = np.random.default_rng(4)
    hashes = draw.integers(0, 3, 500).astype(np.uint64) << np.uint64(50)
    for reach in (1, 2, 5, 28):
        wanted = [i + reach - 1 - int(hashes[i:i + reach][::-1].argmin()) for i in range(len(hashes) - reach + 1)]
        assert passages._least(hashes, reach).tolist() == wanted


def test_segments_pass_only_the_phrases_of_their_anchor(monkeypatch):
    calls = []
    kept = passages._compiled
    monkeypatch.setattr(passages, "_compiled", lambda known, size: calls.append(known) or kept(known, size))
    left = pd.DataFrame({"segment_1": [1, 2, 3], "segment_2": 0, "anchor": [7, 7, 9], "words": ["a b c d", "c d e", "x y z"], "mask": [2, 1, 1]})
    right = pd.DataFrame({
        "segment_1": [4, 5, 6, 7, 8], "segment_2": 0, "anchor": [7, 9, 7, 5, 7], "words": ["q b c d e", "w x y z", "b c q", "x y z", "b c d c d e"]})
    found = passages._streamed(left, right, 3)
    assert dict(zip(found["segment_1"], found["mask"])) == {4: 6, 5: 2, 6: 0, 8: 9}
    assert calls == [[["a b c d", 2], ["c d e", 1]], [["x y z", 1]]]


def test_words_are_coded_together_and_by_their_bytes_alone(monkeypatch):
    long = [b"a" * n for n in (1, 63, 64, 65, 66, 5000)]
    words = [b"a", b"b", b"ab", b"ba", *long, "\u00e4\u00a0x".encode(), b"b", *long, b"\x00", b"\x00\x00"] * 3
    whole = passages._Codes()(words).tolist()
    monkeypatch.setattr(passages._Codes, "at_once", 5)
    assert passages._Codes()(words).tolist() == whole
    assert len(set(zip(words, whole))) == len(set(words)) == len(set(whole))
