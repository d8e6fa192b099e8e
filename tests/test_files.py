"""File sources and sinks on a small folder written by the test."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tilewright.operators import dataset as ds
from tilewright.plans.dataset_build import build_dataset, write_build
from tilewright.sources import images as im
from tilewright.sources import masks as ms
from tilewright.sources import tables as tb


def png(pixels: np.ndarray) -> bytes:
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(0)
    for label in ("ordinary", "difficult"):
        (root / label / "deep").mkdir(parents=True)
    pictures = [rng.integers(0, 256, (4, 6, 3)) for _ in range(6)]
    for i, picture in enumerate(pictures[:3]):
        (root / "ordinary" / f"a{i}.png").write_bytes(png(picture))
    (root / "ordinary" / "deep" / "B.PNG").write_bytes(png(pictures[3]))
    (root / "ordinary" / "copy.png").write_bytes(png(pictures[0]))
    (root / "difficult" / "same.png").write_bytes(png(pictures[1]))
    (root / "difficult" / "d.png").write_bytes(png(pictures[4]))
    (root / "difficult" / "notes.txt").write_text("no image")
    (root / "difficult" / "broken.png").write_bytes(b"not a png")
    return root, pictures


def sources(spark, root):
    return im.discover_images(spark, {"ordinary": [str(root / "ordinary")], "difficult": [str(root / "difficult")]})


def test_discovery_dedupe_and_conflicts(spark, folder):
    root, _ = folder
    found = sources(spark, root).cache()
    assert found.count() == 8
    assert ds.deduplicate(found).count() == 5
    assert {r["source_path"].rsplit("/", 1)[1] for r in ds.conflicts(found).collect()} == {"a1.png", "same.png"}
    assert ds.duplicate_counters(found).first().asDict() == {"same_label_duplicates": 1, "conflicting_files": 2, "conflicting_hash_groups": 1}


def test_missing_directory_fails_but_missing_listing_is_empty(spark, folder):
    root, _ = folder
    with pytest.raises(AnalysisException):
        im.discover_images(spark, {"ordinary": [str(root / "nowhere")]}).count()
    assert im.list_images(spark, str(root / "nowhere")).count() == 0
    assert [r["name"] for r in im.list_images(spark, str(root / "ordinary")).collect()] == ["a0.png", "a1.png", "a2.png", "copy.png"]


def test_decoded_pixels_have_the_written_colours(spark, folder):
    root, pictures = folder
    rows = im.decode_pixels(spark, str(root / "ordinary" / "a2.png"), rows_per_batch=3).collect()
    assert len(rows) == 24
    for r in rows:
        assert [r["r"], r["g"], r["b"]] == pictures[2][r["y"], r["x"]].tolist()
    assert im.undecodable(spark, str(root / "difficult" / "broken.png")).count() == 1


def test_masks_and_their_quarantine(spark, tmp_path):
    good = np.arange(12, dtype=np.uint8).reshape(3, 4)
    np.save(tmp_path / "good.npy", good)
    np.save(tmp_path / "wide.npy", good.astype(np.int16))
    np.save(tmp_path / "deep.npy", good.reshape(3, 2, 2))
    (tmp_path / "junk.npy").write_bytes(b"junk")
    read = ms.read_masks(spark, str(tmp_path)).cache()
    assert {(r["y"], r["x"]): r["code"] for r in ms.usable(read).collect()} == {(y, x): int(v) for (y, x), v in np.ndenumerate(good)}
    errors = {r["mask_file"]: r["error"] for r in ms.quarantined(read).collect()}
    assert errors == {"wide.npy": "not_uint8", "deep.npy": "not_2d", "junk.npy": "not_npy"}


def test_dataset_build_round_trip(spark, folder, tmp_path):
    root, _ = folder
    build = build_dataset(sources(spark, root), "/data")
    write_build(build, str(tmp_path))
    back = tb.read_manifest(spark, f"{tmp_path}/manifest.csv")
    assert back.schema["label_id"].dataType.simpleString() == "int"
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, build.manifest.select(*back.columns).collect()))
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select(F.col("path").alias("source_path"), "content")
    tb.write_dataset(build.manifest, contents, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_history_files_keep_all_columns(spark, tmp_path):
    parts = [spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), spark.createDataFrame([(2, 0.7)], "epoch int, iou double")]
    tb.write_history(parts, str(tmp_path / "h"))
    back = tb.read_history(spark, str(tmp_path / "h"), ["iou"])
    assert back.columns == ["epoch", "loss", "iou"] and sorted((r["epoch"], r["iou"]) for r in back.collect()) == [("1", None), ("2", 0.7)]


def test_artifacts_load_by_key_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "s", 0, 0, 1), ("k1", "t", 0, 0, 2), ("k2", "s", 0, 0, 3)], "key string, settings_json string, y int, x int, code int")
    tb.save_artifacts(rows, str(tmp_path / "a"))
    wanted = spark.createDataFrame([("k1", "s"), ("k2", "t")], "key string, settings_json string")
    assert [r["code"] for r in tb.load_artifacts(spark, str(tmp_path / "a"), wanted).collect()] == [1]


def test_files_larger_than_one_value_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    import hashlib

    rng = np.random.default_rng(6)
    noise = rng.bytes(9000)
    contents = {
        "a.png": noise, "b c%41.png": noise + b"\n", "d.png": b"\n" + noise + b"\r\n\n\n", "deep/e.png": noise.replace(b"\n", b"."), "f.png": b"\xef\xbb\xbf" + noise,
        "g.png": b"\xef\xbb\xbf" + noise + b"\n", "h.png": b"\xef\xbb\xbf" + noise.replace(b"\n", b"\r"), "i.png": b"\n" * 7000, "k.png": noise[:1500], "l.txt": noise, "m.png": noise[:4000] + b"\0" * 4000}
    (tmp_path / "deep").mkdir()
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(im, "WHOLE_BYTES", 1500)
    monkeypatch.setattr(im, "PIECE_BYTES", 700)
    settings = {"spark.sql.sources.binaryFile.maxLength": "1500", "spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = im.discover_images(spark, {"ordinary": [str(tmp_path)]}).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["source_path"].split(f"{tmp_path}/")[1]: r["sha256"] for r in found} == {n: hashlib.sha256(d).hexdigest() for n, d in contents.items() if n.endswith(".png")}
