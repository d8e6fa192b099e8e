"""Image files: discovery, listing, upload checks and decoding to pixels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.scale import spread_for_python

# Accepted extensions, content types and upload limit.
DATASET_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")
LISTING_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")
CONTENT_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/tif": ".tif", "image/tiff": ".tiff", "image/webp": ".webp"}
UPLOAD_EXTENSIONS = {".jpeg": ".jpg", ".jpg": ".jpg", ".png": ".png", ".tif": ".tif", ".tiff": ".tiff", ".webp": ".webp"}
MAX_UPLOAD_BYTES = 2 * 1024**3
LABEL_IDS = {"ordinary": 0, "difficult": 1}
WHOLE_BYTES = 32 << 20  # files up to this size are hashed as one value, larger ones in pieces
PIECE_BYTES = 1 << 20
BOM = b"\xef\xbb\xbf"


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, size, start of the split, value) put together to numbered pieces, each line with its line end."""
    now, held, n = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((*now, n, b"".join(held)), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["file", "size", "start", "n", "piece"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lines = pc.binary_join_element_wise(batch["value"], b"", b"\n")
        ends = {int(e) for c in ("file", "start") for e in pc.run_end_encode(batch[c]).run_ends.to_numpy()}
        a = 0
        for b in sorted(ends):
            here = tuple(batch[c][a].as_py() for c in ("file", "size", "start"))
            if here != now:
                if held:
                    yield piece()
                now, held, n = here, [], 0
            edges = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset:lines.offset + len(lines) + 1]
            data = memoryview(lines.buffers()[2])[edges[a]:edges[b]]
            for at in range(0, len(data), PIECE_BYTES):
                held.append(bytes(data[at:at + PIECE_BYTES]))
                if sum(map(len, held)) >= PIECE_BYTES:
                    yield piece()
                    held, n = [], n + 1
            a = b
    if held:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its pieces in order; a size that does not come out is an error."""
    def finished(file: str, size: int, seen: int, last: bytes, digests: dict) -> pa.RecordBatch:
        # The reader gives no line end for the end of the file, which here has one too many then, and skips a byte order mark.
        for mark, digest in digests.items():
            if len(mark) + seen == size:
                digest.update(last)
            elif len(mark) + seen - 1 != size:
                continue
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()])], ["file", "sha256"])
        raise OSError(f"{file}: {size} bytes, of which its lines have {seen}")

    now = None
    for batch in batches:
        for file, size, data in zip(batch["file"].to_pylist(), batch["size"].to_pylist(), batch["piece"]):
            if now is None or now[0] != file:
                if now is not None:
                    yield finished(*now)
                now = [file, size, 0, b"", {mark: hashlib.sha256(mark) for mark in (b"", BOM)}]
            view = memoryview(data.as_buffer())
            for digest in now[4].values():
                digest.update(now[3])
                digest.update(view[:-1])
            now[2:4] = now[2] + len(view), bytes(view[-1:])
    if now is not None:
        yield finished(*now)


def _large_hashes(spark: SparkSession, folders: list[str], extensions) -> DataFrame:
    """file (as in ``_metadata.file_path``) and sha256 of files over ``WHOLE_BYTES``, whatever their size.

    Spark reads a file's bytes in parts only as lines, so all tasks read lines of splits and put them together to pieces;
    pieces meet sorted at the one task that hashes their file, which holds a few of them.
    """
    lines = spark.read.format("text").option("recursiveFileLookup", "true").option("lineSep", "\n").load(folders)
    lines = lines.where((F.col("_metadata.file_size") > WHOLE_BYTES) & suffix(F.col("_metadata.file_name")).isin(*extensions))
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_size", "size"), ("file_block_start", "start"))]
    pieces = lines.select(*meta, F.col("value").cast("binary").alias("value")).mapInArrow(_pieces, "file string, size long, start long, n long, piece binary")
    return spread_for_python(pieces, "file").sortWithinPartitions("file", "start", "n").mapInArrow(_hashes, "file string, sha256 string")


def discover_images(spark: SparkSession, sources: Mapping[str, Sequence[str]], extensions=DATASET_EXTENSIONS) -> DataFrame:
    """Recursive scan of label directories: label, label_id, source_path, sha256.

    A missing directory raises, as any unreadable Spark path does.
    """
    frames = []
    for number, (label, folders) in enumerate(sources.items()):
        folders = list(folders)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).where(suffix(F.col("path")).isin(*extensions))
        place = [F.lit(label).alias("label"), F.lit(LABEL_IDS.get(label, number)).alias("label_id"), F.col("path").alias("source_path")]
        frames.append(files.where(F.col("length") <= WHOLE_BYTES).select(*place, F.sha2("content", 256).alias("sha256")))
        large = files.where(F.col("length") > WHOLE_BYTES).select(*place, F.col("_metadata.file_path").alias("file"))
        hashes = _large_hashes(spark, folders, extensions)
        frames.append(large.join(hashes, "file", "left").select("label", "label_id", "source_path", "sha256"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def list_images(spark: SparkSession, root: str, extensions=LISTING_EXTENSIONS) -> DataFrame:
    """Files directly under ``root`` ordered by lower-cased name; a missing root lists nothing."""
    try:
        files = spark.read.format("binaryFile").load(root).select("path", "length", "modificationTime")
    except AnalysisException:
        files = spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(suffix(F.col("name")).isin(*extensions)).orderBy(F.lower("name"), "name")


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def check_uploads(uploads: DataFrame, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds ``extension`` and ``reason`` (NULL = accepted) from content_type, file name and size.

    The content type decides; only without a known one does the file name.
    """
    by_name = _lookup(suffix(F.col("name")), UPLOAD_EXTENSIONS)
    extension = F.coalesce(_lookup(F.col("content_type"), CONTENT_TYPES), by_name)
    reason = F.when(extension.isNull(), "unsupported type").when(F.col("size") > limit, "too large")
    return uploads.withColumn("extension", extension).withColumn("reason", reason)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull())


def decode_pixels(spark: SparkSession, paths, rows_per_batch: int = 64) -> DataFrame:
    """Decoded images as pixels (source_path, h, w, y, x, r, g, b); undecodable files give none.

    The image source stores B, G, R(, A) bytes row by row; slabs of rows leave the
    worker one at a time, so a large image never becomes one big frame.
    """
    decoded = spark.read.format("image").option("dropInvalid", "true").load(paths).select(
        F.col("image.origin").alias("source_path"), "image.height", "image.width", "image.nChannels", "image.data")
    schema = "source_path string, h int, w int, y int, x int, r int, g int, b int"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for record in frame.itertuples(index=False):
                h, w, depth = record.height, record.width, record.nChannels
                raster = np.frombuffer(record.data, dtype=np.uint8).reshape(h, w, depth)
                for top in range(0, h, rows_per_batch):
                    slab = raster[top:top + rows_per_batch]
                    blue, green, red = (slab[..., min(i, depth - 1)].ravel() for i in range(3))
                    yy, xx = np.divmod(np.arange(slab.shape[0] * w), w)
                    yield pd.DataFrame({
                        "source_path": record.source_path, "h": h, "w": w, "y": yy + top, "x": xx, "r": red.astype("int32"),
                        "g": green.astype("int32"), "b": blue.astype("int32")})

    return decoded.mapInPandas(unpack, schema)


def undecodable(spark: SparkSession, paths) -> DataFrame:
    """Quarantine: files the decoder rejects."""
    decoded = spark.read.format("image").option("dropInvalid", "false").load(paths)
    return decoded.where(F.col("image.height") < 0).select(F.col("image.origin").alias("source_path"), F.lit("not decodable").alias("error"))
