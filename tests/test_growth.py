"""Steps that must not grow faster than their input: what is broadcast, spread into rows or held by one task."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.q_raster import lab_pixels
from checks.q_segments import mask, segments
from checks.q_sketch import drawn
from checks.views import Tables
from tilewright.operators import history, illumination, raster, scale, tiling
from tilewright.operators import segments as sg
from tilewright.operators import sketch as sk
from tilewright.streaming import jobs


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_a_mask_hold_the_same_centres_as_its_pixels(spark):
    boxes = spark.createDataFrame([(1, -5, 0, 70, 3), (1, 60, 2, 130, 66), (2, 63, 63, 65, 65), (2, 9, 9, 9, 20)], "image_id long, x0 long, y0 long, x1 long, y1 long")
    pixels = boxes.where("x0 < x1").selectExpr("image_id", "explode(sequence(y0, y1 - 1)) as y", "x0", "x1").selectExpr("image_id", "y", "explode(sequence(x0, x1 - 1)) as x")
    centres = spark.range(0, 2 * 70 * 14).selectExpr("id % 2 + 1 as image_id", "id as k", "double(id div 140) * 1.0 as cy", "double((id div 2) % 70) * 2.5 - 4 as cx")
    found = [sorted(r["k"] for r in sg.centres_in_mask(centres, m, F.lit(120.0), F.lit(64.0)).collect()) for m in (boxes, pixels)]
    assert found[0] == found[1] and found[0]


def test_the_segment_mask_is_one_row_a_segment_and_nothing_of_it_is_broadcast(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    rows = tables.segments()
    assert mask(tables).count() <= rows.count()
    centres = sg.cluster_centres(rows.where("cluster >= 0"), ["image_id", "cluster"])
    assert "BroadcastHashJoin" not in _plan(sg.centres_in_mask(centres, mask(tables), F.lit(1300.0), F.lit(1000.0)))


def test_one_tree_a_sample_count_gives_the_labels_of_single_calls(monkeypatch):
    points = np.round(np.random.default_rng(5).normal(size=(40, 3)), 1)
    sets = [(size, samples) for size in sg.CLUSTER_SIZES if size <= 40 for samples in sg.SAMPLES[size]]
    alone = [sg.density_labels(points, *s) for s in sets]
    trees = []
    kept = sg._dendrogram
    monkeypatch.setattr(sg, "_dendrogram", lambda *a: trees.append(1) or kept(*a))
    assert all(np.array_equal(a, b) for a, b in zip(alone, sg.density_label_sets(points, sets)))
    assert len(trees) == len({samples for _, samples in sets}) < len(sets)


def test_pixels_made_by_explode_are_not_broadcast(spark):
    lines = spark.range(40).selectExpr("id as image_id", "explode(sequence(0, 30)) as y").selectExpr("image_id", "y", "y % 3 as x")
    links = sk.pixel_links(lines.withColumn("a", F.lit(1)), lines.withColumn("b", F.lit(2)), "image_id", "a", "b")
    chain = scale.attach(lines, lines.groupBy("image_id", "y").agg(F.max("x").alias("top")), ["image_id", "y"], grown=True)
    assert "BroadcastHashJoin" not in _plan(links) + _plan(chain)


def _compare(spark, name, folder):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for file in folder.iterdir():
        con.execute(f"create view {file.stem} as select * from '{file}'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    rows = [tuple(map(float, r)) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()]
    assert sorted(rows) == sorted(tuple(map(float, r)) for r in result.fetchall()) and rows


def test_images_smaller_than_the_side_are_placed_as_in_the_sql(spark, tmp_path):
    import duckdb

    duckdb.sql(f"copy (select * from '/root/testdata/sf0.01/embeddings.parquet' where vec_id < 18 or vec_id = 32) to '{tmp_path}/embeddings.parquet' (format parquet)")
    _compare(spark, "f28_area_downscale", tmp_path)


def test_a_sample_in_the_last_half_second_of_a_slot_counts_as_in_the_sql(spark, tmp_path):
    import duckdb

    duckdb.sql(f"""copy (select * replace (case when event_id % 2 = 0 then timestamp '2024-01-01 05:59:59.7' else timestamp '2024-01-01 05:59:59.2' end as ts)
        from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet' (format parquet)""")
    _compare(spark, "a28_gpu_baseline", tmp_path)


def test_tiles_of_an_image_with_absent_pixels_are_scored_as_in_the_sql(spark, tmp_path):
    import duckdb

    duckdb.sql(f"copy (select * from '/root/testdata/sf0.01/embeddings.parquet' where vec_id < 22) to '{tmp_path}/embeddings.parquet' (format parquet)")
    _compare(spark, "a06_tile_ore_ratio", tmp_path)


def test_a_job_costs_no_pandas_concat_or_sort(monkeypatch):
    state = type("State", (), {"exists": False, "hasTimedOut": False, "update": lambda s, v: setattr(s, "kept", v),
                               "getCurrentWatermarkMs": lambda s: 0, "setTimeoutTimestamp": lambda s, t: setattr(s, "timer", t)})()
    moments = pd.to_datetime([5000, None, 10, 400], unit="s")
    rows = pd.DataFrame({"job_id": 7, "seq": [3, 9, 1, 2], "ts": moments, "status": ["finished", "queued", "queued", "started"]})
    for name in ("concat",):
        monkeypatch.setattr(jobs.pd, name, None)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    out = list(jobs._lifecycle((7,), iter([rows[:2], rows[2:]]), state, 300, 3600))[0]
    assert out["status"].tolist() == ["queued", "started", "failed"] and out["reason"].tolist() == [None, None, "timeout"]
    assert out["since"].astype("int64").tolist() == [10_000_000, 400_000_000, 700_000_000] and state.kept == ("failed", 700.0, 3)


def test_groups_meet_whole_and_many_at_a_time(spark):
    rows = spark.range(3000).selectExpr("if(id % 7 = 0, null, id % 7) as k", "id div 900 as part", "id")

    def work(frame, group):
        sizes = frame.assign(g=group).groupby("g").agg(k=("k", "first"), part=("part", "first"), n=("id", "size"), total=("id", "sum"))
        return sizes.assign(calls=len(sizes))

    for at_once in (1, 50, 10000):
        found = scale.in_groups(rows, ["k", "part"], work, "k double, part long, n long, total long, calls long", at_once)
        wanted = rows.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
        as_rows = lambda df: sorted(str(tuple(r)) for r in df.selectExpr("cast(k as int)", "part", "n", "total").collect())
        assert as_rows(found.withColumn("k", F.nanvl("k", F.lit(None).cast("double")))) == as_rows(wanted)
    assert found.agg(F.max("calls")).first()[0] > 1


def test_no_python_call_for_every_chunk(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    from tilewright.operators import components as co
    from tilewright.operators import morphology as mo
    from tilewright.operators import relax

    def refused(*_):
        raise AssertionError("one call a group")

    monkeypatch.setattr(GroupedData, "applyInPandas", refused)
    pixels = spark.range(5 * 40 * 40).selectExpr("id div 1600 as image_id", "int(id % 1600 div 40) as y", "int(id % 40) as x").where("(y * 7 + x * 5) % 11 > 2")
    one = co.label_components(pixels, chunk=8).groupBy("image_id").agg(F.count_distinct("label").alias("n"))
    assert len({r["n"] for r in one.collect()}) == 1 and one.count() == 5
    seeded = pixels.withColumns({"seed": F.when((F.col("y") == 0) & (F.col("x") < 20), F.col("x")), "g": (F.col("x") % 3).cast("double"), "m": F.col("x") % 2})
    whole, cut = (sorted(map(tuple, relax.flood(seeded, "seed", "g", chunk=c).select("image_id", "y", "x", "label", "cost").collect())) for c in (64, 8))
    assert whole == cut and whole
    whole, cut = (sorted(map(tuple, mo.open_close(seeded, "m", 1, "v", chunk=c).select("image_id", "y", "x", "v").collect())) for c in (64, 8))
    assert whole == cut and whole
    assert mo.squared_distances(seeded, "m").where("d2 = 1").count() > 0


def test_lambdas_work_out_what_they_share_once(spark):
    from tilewright.functions import geometry as g

    rows = spark.range(3).selectExpr("transform(sequence(0, 4), i -> struct(double(i * id) as x, double(i) as y)) as p")
    assert str(g.polyline_midpoint(F.col("p"))).count("arrays_zip") == 1
    assert [tuple(r["m"]) for r in rows.select(g.polyline_midpoint(F.col("p")).alias("m")).collect()] == [(0.0, 2.0), (2.0, 2.0), (4.0, 2.0)]


def test_scores_of_clusters_are_those_of_all_sets_times_all_segments(spark):
    import inspect

    tables = Tables(spark, "/root/testdata/sf0.001")
    rows, size = segments(tables).where("image_id < 2"), (F.lit(1300.0), F.lit(1000.0))
    label = lambda p, size, samples: (np.arange(len(p)) * samples) % (size + 1) - 1
    variants = sg.feature_variants(sg.segment_features(rows, *size))
    long = sg.candidate_counts(sg.score_candidates(sg.density_sweep(variants, label), rows, mask(tables), *size))
    taken = sg.taken_clusters(sg.swept_sets(variants, label), rows, mask(tables), *size)
    short = sg.taken_counts(taken, rows)
    found = [sorted(map(tuple, t.select(*long.columns).collect())) for t in (long, short)]
    assert found[0] == found[1] and len(found[0]) > 50
    assert "score_candidates" not in inspect.getsource(sg.select_segments)


def test_pairs_of_scores_are_followed_inside_bins_before_any_pointer_is_doubled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(run, e, a, b) for run, n in ((1, 1), (2, 60), (3, 700), (4, 2500)) for e, (a, b) in enumerate(
        zip(np.cumsum(rng.normal(0.002, 0.02, n)).round(3).tolist(), rng.random(n).round(2).tolist()), 1)]
    rows = [(run, e, None if (run, e) == (2, 7) else a, None if e == 9 else b) for run, e, a, b in rows]
    table = spark.createDataFrame(rows, "run long, epoch long, f double, g double")
    expected = {}
    for run in (1, 2, 3, 4):
        mine = [r for r in rows if r[0] == run]
        at, (_, best, a, b) = 0, mine[0]
        for _, e, x, y in mine[1:]:
            if e - best > 40:
                break
            if None not in (x, a) and (x >= a + 0.05 or abs(x - a) < 0.05 and None not in (y, b) and y > b):
                best, a, b = e, x, y
        expected[run] = (best, a, b)
    kept, cuts = history.cut_lineage, []
    monkeypatch.setattr(history, "cut_lineage", lambda df: cuts.append(1) or kept(df))
    for size, most in ((1024, None), (100, None), (4096, 1)):
        cuts.clear()
        monkeypatch.setattr(history, "EPOCHS_PER_BIN", size)
        out = history.early_stopping_pairs(table, "run", "f", "g", 0.05, 40).collect()
        assert {r["run"]: (r["best_epoch"], r["best_first"], r["best_second"]) for r in out} == expected
        assert most is None or len(cuts) == most


def test_strokes_are_dealt_to_all_tasks_before_they_become_pixels(spark):
    plan = _plan(drawn(Tables(spark, "/root/testdata/sf0.001")))
    assert "Exchange" in plan[plan.index("Generate"):] and plan.count("Exchange hashpartitioning") == 1


def test_edge_aware_means_of_many_images_take_few_calls_and_no_padded_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    images = {n: rng.integers(0, 100, (h, w)).astype(float) for n, (h, w) in enumerate([(1, 1), (1, 6), (3, 4), (9, 14), (9, 14), (30, 11)])}
    gone = {(3, 2, 5), (5, 0, 0), (5, 20, 10)}
    rows = [(n, y, x, *a.shape, float(a[y, x])) for n, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1]) if (n, y, x) not in gone]
    table = spark.createDataFrame(rows, "image_id long, y int, x int, h int, w int, v double")
    turned = lambda p, n: 0 if n == 1 else min(p % (2 * (n - 1)), 2 * (n - 1) - p % (2 * (n - 1)))
    expected = {}
    for n, y, x, h, w, v in rows:
        total = weight = 0.0
        for dy in range(-5, 6):
            for dx in range(-5, 6):
                qy, qx = turned(y + dy, h), turned(x + dx, w)
                if dy * dy + dx * dx <= 25 and (n, qy, qx) not in gone:
                    q = images[n][qy, qx]
                    share = np.exp(-(dy * dy + dx * dx) / 50 - (q - v) ** 2 / 800)
                    total, weight = total + share * q, weight + share
        expected[n, y, x] = total / weight
    sent = []
    kept = illumination.in_groups
    monkeypatch.setattr(illumination, "in_groups", lambda rows, *a: sent.append(rows.count()) or kept(rows, *a))
    for chunk in (256, 8):
        out = {(r["image_id"], r["y"], r["x"]): r["s"] for r in illumination.bilateral(table, "v", 5, 20.0, 5.0, "s", chunk=chunk).collect()}
        assert out.keys() == expected.keys() and all(abs(out[k] - v) < 1e-9 for k, v in expected.items())
    assert sent[0] == len(rows)


def test_a_salt_is_not_asked_for_below_the_projections_it_is_made_of(spark):
    rows = lab_pixels(Tables(spark, "/root/testdata/sf0.001"))
    plan = _plan(tiling.with_size(rows))
    assert "xxhash64" in plan and not any("isnotnull" in line and "xxhash64" in line for line in plan.splitlines())


def test_what_a_worker_holds_of_a_stored_table_is_bounded_by_bytes(spark):
    import pyarrow.parquet as pq

    def sizes(frames):
        for frame in frames:
            yield pd.DataFrame({"rows": [len(frame)], "data": [b"".join(frame["data"])]})

    def noise(frames):
        for frame in frames:
            for i in frame["id"]:
                yield pd.DataFrame({"id": [i], "data": [np.random.default_rng(i).bytes(512 << 10)]})

    wide = spark.range(64).coalesce(1).mapInPandas(noise, "id long, data binary")
    before = [spark.conf.get(name) for name in (scale.BATCH, scale.READ)]
    batches = scale.stored(wide.mapInPandas(sizes, "rows long, data binary"))
    assert batches.agg(F.sum("rows")).first()[0] == 64 and batches.agg(F.max("rows")).first()[0] * (512 << 10) <= 2 * scale.BYTES_AT_ONCE
    assert [spark.conf.get(name) for name in (scale.BATCH, scale.READ)] == before
    files = [pq.ParquetFile(f.replace("file://", "")) for f in scale.stored(wide).inputFiles()]
    assert max(f.metadata.row_group(i).total_byte_size for f in files for i in range(f.metadata.num_row_groups)) <= 2 * scale.BYTES_AT_ONCE


def test_maps_and_a_table_after_one_another_are_one_python_stage(spark):
    pixels = spark.range(40).selectExpr("id % 2 as image_id", "int(id div 8) as y", "int(id div 2 % 4) as x", "5 as h", "4 as w", "double(id) as v")
    start = raster.to_chunks(pixels, ["v"]).settled()
    doubled = start.map(lambda b: {"u": b["v"] * 2}, "u")
    both = doubled.map(lambda b: {"v": b["v"] + b["u"]}, "v", keep=["u"])
    other = doubled.map(lambda b: {"v": -b["u"]}, "v")
    assert _plan(both.frame).count("MapInPandas") == 1 and _plan(both.table(lambda b: {"s": [b["v"].sum()]}, "s double")).count("MapInPandas") == 1
    found = {(r["image_id"], r["y"], r["x"]): (r["v"], r["u"]) for r in both.pixels("v", "u").collect()}
    assert len(found) == 40 and all(v == u * 1.5 and u == 2.0 * (i + 8 * y + 2 * x) for (i, y, x), (v, u) in found.items())
    assert {r["v"] + r["u"] for r in other.pixels("v", "u").collect()} == {0.0}
    narrowed = both.pick("v").map(lambda b: {"n": b["v"] * 0 + len(b.channels)}, "n")
    assert narrowed.channels == ("v", "n") and {r["n"] for r in narrowed.pixels("n").collect()} == {1.0}


def test_two_step_classes_are_made_on_chunks_with_the_counts_of_the_pixel_rows(spark, tmp_path, monkeypatch):
    import duckdb

    import __spark_entry__ as entry
    from checks.q_segments import SMALL
    from tilewright.operators import cluster

    duckdb.sql(f"copy (select * from '/root/testdata/sf0.01/embeddings.parquet' where vec_id < 40) to '{tmp_path}/embeddings.parquet' (format parquet)")
    lab = tiling.with_size(lab_pixels(Tables(spark, str(tmp_path))).select("image_id", "y", "x", "lab_l", "lab_a", "lab_b"))
    wanted = cluster.two_step_classes(lab, SMALL).groupBy("image_id", "code").agg(F.count(F.lit(1)).alias("n"))
    wanted = sorted((r["image_id"], int(r["code"]), r["n"]) for r in wanted.collect())
    for name in ("cut_lineage", "postprocess"):
        monkeypatch.setattr(cluster, name, None)
    found = entry.queries()["c03_two_step_classes"](spark, str(tmp_path)).collect()
    assert sorted((r["image_id"], r["code"], r["n"]) for r in found) == wanted and wanted


def test_a_flood_of_images_of_one_chunk_is_one_python_stage(spark):
    from tilewright.operators import raster_classes as rc

    pixels = spark.range(40).selectExpr("id % 2 as image_id", "int(id div 8) as y", "int(id div 2 % 4) as x", "5 as h", "4 as w", "if(id < 4, double(id), null) as s", "double(id % 3) as g", "1.0D as m")
    flood = rc.flooded(raster.to_chunks(pixels, ["s", "g", "m"]).settled(), "s", "g", "m", "basin")
    assert _plan(flood.frame).count("MapInPandas") == 1
    assert flood.pixels("basin").where("basin is null").isEmpty() and flood.pixels("basin").count() == 40
