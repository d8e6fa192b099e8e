"""SimHash groups, sharding and decontamination against brute force."""

import hashlib
import random
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from tilewright.llm import contamination, sharding, simhash


def brute_fingerprint(text, size=4, distinct=False):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    shingles = set(shingles) if distinct else shingles
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    """doc_id -> smallest doc_id reachable, over (doc_id, fingerprint)."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, f"{fp:016x}", least.get(find(i))) for i, (doc, fp) in enumerate(rows)]


def as_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_groups_match_brute_force(docs, texts, odd):
    for frame, rows in ((docs, texts), (odd, [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])):
        wanted = brute_components([(d, brute_fingerprint(t)) for d, t in rows])
        assert as_rows(simhash.simhash_groups(frame), "doc_id", "fingerprint", "component_id") == sorted(wanted, key=repr)


def test_links_lose_nothing_at_any_distance(spark):
    base = [0x0123456789ABCDEF, 0xFFFF0000FFFF0000, 0]
    flips = [(0,), (0, 63), (1, 30, 62), (0, 20, 21, 42), (5, 6, 7, 8), (40, 41, 42, 43), (0, 1, 2, 3, 4), (9, 30, 31, 50, 51, 52)]
    fps = sorted({simhash._signed(b ^ sum(1 << i for i in f)) for b in base for f in [(), *flips]})
    nodes = spark.createDataFrame([(i, fp) for i, fp in enumerate(fps)], "doc_id long, fp long")
    found = dict(map(tuple, simhash.components(nodes).select("fp", "component_id").collect()))
    wanted = {simhash._signed(int(fp, 16)): c for _, fp, c in brute_components([(i, fp & (1 << 64) - 1) for i, fp in enumerate(fps)])}
    assert found == wanted


def test_empty_table_has_no_groups(none):
    assert simhash.simhash_groups(none).count() == 0


def position(text, bits):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) >> (32 - bits)


def brute_shards(rows, ring):
    """Keys walk the ring one by one, in ring order."""
    points = {}
    for shard in range(ring.shards):
        for point in range(ring.points):
            at = position(f"shard:{shard}:{point}", ring.bits)
            points[at] = min(points.get(at, shard), shard)
    points = sorted(points.items())
    keyed = []
    for doc, text in rows:
        raw = (text or "").encode()
        unit = (doc, len(raw) + 1, zlib.crc32(raw))
        at = position("|".join(("-" if doc is None else str(doc), str(unit[1]), str(unit[2]))), ring.bits)
        arc = sum(p < at for p, _ in points) % len(points)
        keyed.append((arc, at, (doc is not None, doc or 0), unit[1:], unit))
    keyed.sort(key=lambda k: k[:4])
    n = len(keyed)
    free = [n // ring.shards + (s < n % ring.shards) if not ring.slack else -(-n * (1 + ring.slack) // ring.shards) for s in range(ring.shards)]
    used = [0] * ring.shards
    out = []
    for arc, _, _, _, unit in keyed:
        shard = next(s for s in [points[(arc + i) % len(points)][1] for i in range(len(points))] if free[s] > used[s])
        out.append((*unit, shard, used[shard]))
        used[shard] += 1
    return sorted(out, key=repr)


def test_shards_match_a_walk_around_the_ring(docs, texts, odd, none):
    columns = ("doc_id", "size", "text_crc32", "shard", "slot")
    for ring in (sharding.Ring(), sharding.Ring(shards=5, points=8, bits=10, slack=0.25)):
        assert as_rows(sharding.shard_documents(docs, ring), *columns) == brute_shards(texts, ring)
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert as_rows(sharding.shard_documents(odd), *columns) == brute_shards(rows, sharding.Ring())
    assert sharding.shard_documents(none).count() == 0


def test_slack_limits_movement(docs):
    def shards(n):
        return {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, sharding.Ring(shards=n, slack=0.5)).collect()}

    before, after = shards(8), shards(9)
    assert sum(before[d] != after[d] for d in before) < len(before) / 2


def spark_hash(values):
    """Spark's xxhash64 over several longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def words_of(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in out]


def shingles(words, k=5):
    return [signed(spark_hash(words[i:i + k])) for i in range(len(words) - k + 1)]


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_contaminated(rows, items, how):
    from collections import Counter

    found = set()
    for item, text in items:
        wanted = words_of(text)
        b = Counter(shingles(wanted))
        if not b:
            continue
        for doc, words in rows:
            for start in range(max(1, len(words) - len(wanted) + 1)):
                a = Counter(shingles(words[start:start + len(wanted)]))
                common = (a & b).total()
                if a and common / (a.total() + b.total() - common) >= how.similarity - 1e-12 and (
                        majority(list(a.elements())) ^ majority(list(b.elements()))).bit_count() <= how.radius:
                    found.add((doc, item))
    return found


def test_decontamination_matches_brute_force(spark, docs, odd, none):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(6)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    one, two = items[0][1].split(), items[1][1].split()
    made = [
        (1, " ".join(one)), (2, "before it " + " ".join(one).upper() + " and after"), (3, " ".join(one[:-3])), (4, " ".join(one[3:10])),
        (5, " ".join(["x"] * 5 + two[:10] + ["new"] + two[10:] + ["y"] * 40)), (6, " ".join(two[:8] + ["a"] + two[9:20] + ["b"] + two[21:])), (7, None), (8, "")]
    made += [(r["doc_id"] + 100, r["text"]) for r in docs.select("doc_id", "text").limit(25).collect()]
    frame = spark.createDataFrame(made, "doc_id long, text string").withColumn("item_id", F.lit(0))
    how = contamination.Windows()
    wanted = brute_contaminated([(d, words_of(t)) for d, t in made], items, how)
    assert {(1, items[0][0]), (2, items[0][0])} <= wanted
    for limit in (how.broadcast_rows, 0):  # with and without broadcasts
        found = contamination.contaminated(frame, benchmark, contamination.Windows(broadcast_rows=limit))
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == wanted
    left = {r["doc_id"] for r in contamination.decontaminate(frame, benchmark).collect()}
    assert left == {d for d, _ in made} - {d for d, _ in wanted}
    assert contamination.decontaminate(odd, benchmark).count() == odd.count()
    assert contamination.decontaminate(none, benchmark).count() == 0 and contamination.decontaminate(odd, benchmark.limit(0)).count() == odd.count()


def test_only_verified_copies_go(spark, docs, odd, none):
    """One document for each component of five-word Jaccard 0.8; word order alone makes no copies."""
    def sets(text):
        words = (text or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    words = [f"w{i}" for i in range(60)]
    made = [(900_001, " ".join(words)), (900_002, " ".join(reversed(words))), (900_003, " ".join([*words[:30], "new", *words[31:]])), (900_004, " ".join([*words[:57], "x"]))]
    made = spark.createDataFrame(made, "doc_id long, text string")
    for frame in (docs.select("doc_id", "text").union(made), odd):
        rows = [(r["doc_id"], sets(r["text"])) for r in frame.select("doc_id", "text").collect()]
        group = list(range(len(rows)))
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows[:i]):
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
        least = {}
        for g, (doc, _) in zip(group, rows):
            least[g] = min(filter(lambda d: d is not None, (least.get(g), doc)), default=None)
        kept = simhash.keep_verified(frame)
        assert kept.columns == frame.columns
        assert sorted(map(str, (r["doc_id"] for r in kept.select("doc_id").collect()))) == sorted(map(str, least.values()))
    assert {900_001, 900_002} <= {r["doc_id"] for r in simhash.keep_verified(made).collect()}
    assert simhash.keep_verified(none).count() == 0


def test_crowded_bands_lose_no_copy(spark):
    """Hundreds of copies around the limit, and texts that only share a passage: rounds and finer bands find what all pairs show."""
    draw = random.Random(7)
    base = [f"w{draw.randrange(4000)}" for _ in range(150)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(draw.choice((1, 2, 2, 3))):
            words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([f"x{draw.randrange(10**6)}" for _ in range(60)] + passage)) for i in range(90)]
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for one in sets:
        for two in sets:
            if one < two and len(sets[one] & sets[two]) >= 0.8 * len(sets[one] | sets[two]):
                parent[max(root(one), root(two))] = min(root(one), root(two))
    wanted = {root(d) for d in sets}
    assert 90 < len(wanted) < 200
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for how in (simhash.Verified(), simhash.Verified(crowd=16, leaders=4)):
        assert {r["doc_id"] for r in simhash.keep_verified(frame, how).select("doc_id").collect()} == wanted


def test_the_pipeline_links_by_fingerprints_and_checks_each_link(spark, docs, odd, none):
    """Brute force over all pairs: at most four differing bits and five-word Jaccard 0.8; groups of copies with and without it."""
    import corpus_pipeline

    draw = random.Random(11)
    made = []
    for base in range(6):
        words = [f"w{draw.randrange(3000)}" for _ in range(80)]
        for _ in range(12):
            copy = list(words)
            for _ in range(draw.choice((0, 1, 1, 2, 3, 4))):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            made.append((900_000 + len(made), " ".join(copy)))
    far = 0
    for frame in (docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")), odd):
        rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        fps = [brute_fingerprint(t, 3, True) for _, t in rows]
        sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
        group = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
                if (fps[i] ^ fps[j]).bit_count() <= 4 and alike:
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
                elif alike:
                    far += 1
        least = {}
        for g, (doc, _) in zip(group, rows):
            least[g] = min(filter(lambda d: d is not None, (least.get(g), doc)), default=None)
        kept = corpus_pipeline.near_duplicates(spark, frame, "")
        assert kept.columns == frame.columns
        assert sorted(map(str, (r["doc_id"] for r in kept.select("doc_id").collect()))) == sorted(map(str, least.values()))
    assert far and corpus_pipeline.near_duplicates(spark, none, "").count() == 0
