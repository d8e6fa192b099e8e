"""Scans, histories, selection and other table operators against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import scalar as s
from tilewright.operators import dataset as ds
from tilewright.operators import history as hi
from tilewright.operators import metrics as m
from tilewright.operators import neighbours as nb
from tilewright.operators import scale
from tilewright.operators import segments as sg
from tilewright.operators import tiling as t


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,expected", [(None, 7), ("", 7), ("3.9", 3), ("-1", 3), ("1e9", 12), ("nan", 7), ("inf", 12), ("1d", 7), (" 5 ", 5), ("x", 7)])
def test_bounded_int(spark, text, expected):
    assert one(spark, s.bounded_int(F.lit(text).cast("string"), 7, 3, 12)) == expected


@pytest.mark.parametrize("text,expected", [("nan", 2.0), ("-5", 0.0), ("0.5", 0.5), (None, 1.0)])
def test_bounded_float(spark, text, expected):
    assert one(spark, s.bounded_float(F.lit(text).cast("string"), 1.0, 0.0, 2.0)) == expected


def test_verdict_borders(spark):
    rows = [one(spark, s.verdict(F.lit(a), F.lit(b))) for a, b in ((0.10, 0.50), (0.1000001, 0.9), (0.1, 0.4999))]
    assert rows == [s.VERDICT_DIFFICULT, s.VERDICT_TALC, s.VERDICT_ORDINARY]


@pytest.mark.parametrize("length", [5, 512, 513, 704, 705, 1000])
def test_window_starts(spark, length):
    got = one(spark, g.window_starts(F.lit(length), 512, 192))
    expected = [0] if length <= 512 else list(range(0, length - 511, 192))
    if expected[-1] != max(length - 512, 0):
        expected.append(length - 512)
    assert got == expected


@pytest.mark.parametrize("size,before,after", [(1, 2, 3), (2, 5, 4), (5, 2, 2), (7, 20, 3)])
def test_mirrored_targets_match_numpy_reflection(spark, size, before, after):
    padded = np.pad(np.arange(size), (before, after), mode="reflect") if size > 1 else np.zeros(size + before + after, dtype=int)
    for i in range(size):
        got = one(spark, g.mirrored_targets(F.lit(i), F.lit(before), F.lit(after), F.lit(size)))
        assert sorted(got) == np.flatnonzero(padded == i).tolist()


@pytest.mark.parametrize("total,limit", [(3, 5), (10, 5), (7, 1), (64, 64), (65, 64)])
def test_even_picks(spark, total, limit):
    expected = list(range(total)) if total <= limit else np.linspace(0, total - 1, limit).round().astype(int).tolist()
    assert one(spark, t.even_picks(F.lit(total), limit)) == expected


def test_ranks_and_percentiles_survive_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"g{i % 17}", round(rng.random() ** 3, 3), i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k string, v double, i int")
    ranked = scale.rank_rows(frame, "k", ["v", "i"], scale.value_bins(frame, "v")).collect()
    for key in ("hot", "g1"):
        ordered = sorted((r["v"], r["i"]) for r in ranked if r["k"] == key)
        assert [r["rank"] for r in sorted((r for r in ranked if r["k"] == key), key=lambda r: (r["v"], r["i"]))] == list(range(1, len(ordered) + 1))
    found = {r["k"]: r for r in scale.exact_percentiles(frame, "k", "v", {"a": 0.1, "b": 0.95}).collect()}
    for key, row in found.items():
        values = [v for k, v, _ in rows if k == key]
        assert np.allclose([row["a"], row["b"]], np.percentile(values, [10, 95]))


def test_auc_of_one_class_and_of_ties(spark):
    single = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y_true int, prob double")
    assert tuple(m.ranking_metrics(single).first()) == (0.0, 0.0)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y_true int, prob double")
    assert m.ranking_metrics(tied).first()["roc_auc"] == 0.5


def test_single_record_goes_to_both_splits(spark):
    lone = spark.createDataFrame([("a",)], "sha256 string")
    assert {r["split"] for r in ds.train_val_split(lone, "sha256", 0.2, 1).collect()} == {"train", "val"}


def test_split_is_complete_disjoint_and_repeatable(spark):
    rows = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"), (F.col("id") % 4 == 0).cast("int").alias("label_id"))
    first, second = ds.stratified_split(rows), ds.stratified_split(rows.repartition(3))
    assert first.count() == 500 and first.select("sha256").distinct().count() == 500
    assert first.join(second, ["sha256", "split"]).count() == 500


def stopped(values, delta, patience):
    best, at = -math.inf, 0
    for e, v in enumerate(values, 1):
        if v >= best + delta:
            best, at = v, e
        elif e - at >= patience:
            return at, e, "early_stopping"
    return at, len(values), "max_epochs"


@pytest.mark.parametrize("delta", [0.0, 0.05])
def test_early_stopping_replays_the_loop(spark, monkeypatch, delta):
    monkeypatch.setattr(hi, "EPOCHS_PER_BIN", 7)
    rng = random.Random(1)
    runs = {i: [round(rng.random(), 1 if i % 2 else 3) for _ in range(3 + 7 * i)] for i in range(12)}
    rows = spark.createDataFrame([(i, e, v) for i, vs in runs.items() for e, v in enumerate(vs, 1)], "run int, epoch int, v double")
    found = {r["run"]: (r["best_epoch"], r["completed_epochs"], r["stopped_reason"]) for r in hi.early_stopping(rows, "run", "v", delta, 6).collect()}
    assert found == {i: stopped(vs, delta, 6) for i, vs in runs.items()}


def test_checkpoint_fallbacks(spark):
    rows = spark.createDataFrame([(1, e, 0.5, f, 0.9) for e, f in ((1, 0.8), (2, 0.9), (3, 0.9))], "run int, epoch int, val_auc double, val_f1 double, drift double")
    last, best = (hi.checkpoints(rows, "run", 0.03, how).first() for how in ("last", "best"))
    assert (last["best_epoch"], last["recommended_epoch"], best["recommended_epoch"]) == (2, 3, 2)


def test_nearest_endpoints_in_a_dense_cluster(spark):
    rng = random.Random(9)
    dense = {(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(250)} | {(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(40)}
    rows = [(1, f"e_{x}_{y}", float(x), float(y), i) for i, (x, y) in enumerate(sorted(dense))]
    points = spark.createDataFrame(rows, "image_id int, endpoint_id string, x double, y double, seq int")
    found = {}
    for r in nb.nearest(points, 4, 300.0).collect():
        found.setdefault(r["a"], []).append((r["rank"], r["b"]))
    for _, name, x, y, _ in rows:
        others = sorted((math.hypot(x - q[2], y - q[3]), q[4], q[1]) for q in rows if q[1] != name and math.hypot(x - q[2], y - q[3]) <= 300)
        assert [b for _, b in sorted(found.get(name, []))] == [o[2] for o in others[:4]]


def test_density_clusters_find_separate_groups():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in (0, 5, 9)])
    labels = sg.density_labels(points, 5, 3)
    assert sorted(np.bincount(labels[labels >= 0]).tolist()) == sorted(np.bincount(labels[labels >= 0]).tolist())
    groups = [set(labels[i:i + 20].tolist()) - {-1} for i in (0, 20, 40)]
    assert all(len(group) == 1 for group in groups) and len(set.union(*groups)) == 3


def test_perfect_parameter_set_stops_the_search(spark):
    columns = "image_id int, sweep_order int, supplemental_count long, outside_selected long, selected_count long, required long, selected_clusters long"
    rows = [(1, 0, 1, 0, 3, 3, 3), (1, 1, 0, 0, 3, 3, 1), (1, 2, 0, 0, 3, 3, 3)]
    assert sg.best_parameters(spark.createDataFrame(rows, columns)).first()["sweep_order"] == 1


def _tied_tiles(spark):
    """Tiles of 300 images in seven partitions; in each image one lies at half of the mean, as far as the order of additions lets it."""
    rng = random.Random(4)
    images = []
    while len(images) < 300:
        shares = [rng.randrange(15, 35), *(rng.randrange(100) for _ in range(22))]
        last = 48 * shares[0] - sum(shares)
        if 0 <= last < 100:
            images.append(rng.sample([*shares, last], 24))
    rows = [(i, t * 300 + i, k / 100.0, (t % 10) / 10.0, True) for i, shares in enumerate(images) for t, k in enumerate(shares)]
    table = spark.createDataFrame(rows, "image_id long, tile_id long, ore_ratio double, prob double, centre_inside boolean")
    wanted = {}
    for i, shares in enumerate(images):
        total = 0.0
        for k in shares:
            total += k / 100.0
        wanted[i] = total / len(shares)
    return rows, table.repartition(7, "tile_id"), wanted


def test_the_mean_tiles_are_held_against_is_added_in_tile_order(spark):
    from tilewright.operators import blending as b

    rows, tiles, wanted = _tied_tiles(spark)
    shares = b.ore_shares(tiles)
    assert {r["image_id"]: r["ore_share"] for r in shares.collect()} == wanted
    chosen = {r["tile_id"] for r in b.accepted_tiles(tiles, shares, 2.0).collect()}
    assert chosen == {t for i, t, ratio, _, _ in rows if ratio >= wanted[i] / 2.0}
    assert b.ore_shares(spark.createDataFrame([(1, 2, None), (1, 3, 0.5), (2, 1, None)], "image_id long, tile_id long, ore_ratio double")).orderBy("image_id").collect() == [(1, 0.5), (2, None)]


def test_difficulty_and_verdicts_take_the_tiles_accepted_in_that_order(spark):
    from tilewright.plans import inference

    rows, tiles, wanted = _tied_tiles(spark)
    probs = {}
    for i, _, ratio, prob, _ in rows:
        if ratio >= wanted[i] / 2.0:
            probs.setdefault(i, []).append(prob)
    found = {r["image_id"]: r["difficulty"] for r in inference.verdicts_from_tiles(tiles, 2.0).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[i] - sum(p) / len(p)) < 1e-12 for i, p in probs.items())
