"""Class masks stored as raw ``.npy`` arrays."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_masks(spark: SparkSession, path: str, rows_per_batch: int = 64) -> DataFrame:
    """Mask pixels (mask_file, h, w, y, x, code) plus one row with ``error`` per unusable file."""
    return unpack_masks(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content"), rows_per_batch)


def unpack_masks(files: DataFrame, rows_per_batch: int = 64) -> DataFrame:
    """``files``: path, content.  ``error`` is the reason why a file is no mask: not_npy, not_uint8, not_2d or cut_short."""
    schema = "mask_file string, h int, w int, y int, x int, code int, error string"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                name = path.rsplit("/", 1)[-1]
                mask, reason = parse_mask(content)
                if mask is None:
                    yield pd.DataFrame([{"mask_file": name, "h": None, "w": None, "y": None, "x": None, "code": None, "error": reason}]).astype(
                        {c: "Int32" for c in ("h", "w", "y", "x", "code")})
                    continue
                h, w = mask.shape
                for top in range(0, h, rows_per_batch):
                    slab = mask[top:top + rows_per_batch]
                    yy, xx = np.divmod(np.arange(slab.size), w)
                    yield pd.DataFrame({
                        "mask_file": name, "h": h, "w": w, "y": yy + top, "x": xx, "code": slab.ravel().astype("int32"), "error": None})

    return files.mapInPandas(unpack, schema)


def parse_mask(content: bytes) -> tuple[np.ndarray | None, str | None]:
    """The array behind a ``.npy`` header of a two-dimensional uint8 array, or the reason why there is none."""
    stream = io.BytesIO(content)
    try:
        version = np.lib.format.read_magic(stream)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, columns_first, kind = header(stream)
    except ValueError:
        return None, "not_npy"
    if kind != np.dtype(np.uint8):
        return None, "not_uint8"
    if len(shape) != 2:
        return None, "not_2d"
    body = content[stream.tell():]
    if len(body) < shape[0] * shape[1]:
        return None, "cut_short"
    return np.frombuffer(body, dtype=np.uint8, count=shape[0] * shape[1]).reshape(shape, order="F" if columns_first else "C"), None


def usable(masks: DataFrame) -> DataFrame:
    return masks.where(F.col("error").isNull()).drop("error")


def quarantined(masks: DataFrame) -> DataFrame:
    return masks.where(F.col("error").isNotNull()).select("mask_file", "error")
