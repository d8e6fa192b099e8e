"""Manifests, conflicts, histories, summaries and artefact stores as Spark tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.scale import names, union_all

MANIFEST_SCHEMA = "split string, label string, label_id int, sha256 string, source_path string, dataset_path string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("header", "true").option("escape", '"').csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_conflicts(conflicts: DataFrame, path: str) -> None:
    """Conflicts in (sha256, label_id, source_path) order; a range sort, so files follow that order."""
    ordered = conflicts.select("sha256", "label", "label_id", "source_path").orderBy("sha256", "label_id", "source_path")
    ordered.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_dataset(manifest: DataFrame, contents: DataFrame, path: str) -> None:
    """Image bytes with their manifest row, partitioned by split and label (``contents``: source_path, content)."""
    manifest.join(contents.select("source_path", "content"), "source_path").write.mode("overwrite").partitionBy("split", "label").parquet(path)


def as_json(columns: Sequence[str]) -> Column:
    """Canonical JSON of columns in key order."""
    return F.to_json(F.struct(*sorted(columns)))


def merge_latest(updates: DataFrame, by, order: str, value: str) -> DataFrame:
    """Summary merge: the latest value per key wins."""
    return updates.groupBy(*names(by)).agg(F.max_by(value, order).alias(value))


def summary_documents(updates: DataFrame, document: str, key: str, order: str, value: str) -> DataFrame:
    """One JSON object per document from its merged keys (a handful per document, in key order)."""
    merged = merge_latest(updates, [document, key], order, value)
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return merged.groupBy(document).agg(F.to_json(F.map_from_entries(entries)).alias("summary"))


def combine_histories(parts: Sequence[DataFrame]) -> DataFrame:
    """Epoch rows of all stages; columns in first-seen order, absent ones NULL."""
    return union_all(list(parts))


def write_history(parts: Sequence[DataFrame], path: str) -> None:
    combine_histories(parts).write.mode("overwrite").option("header", "true").csv(path)


def read_history(spark: SparkSession, path: str, numeric: Sequence[str] = ()) -> DataFrame:
    """History as text, with the named columns cast (unparsable text becomes NULL)."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.withColumns({c: F.col(c).try_cast("double") for c in numeric if c in rows.columns})


def save_artifacts(pixels: DataFrame, path: str) -> None:
    """Colour artefacts (key, settings_json, y, x, r, g, b, code) in hash buckets of their key."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(64)).cast("int")
    pixels.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(path)


def load_artifacts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Stored pixels of the wanted (key, settings_json) only."""
    return spark.read.parquet(path).join(wanted.select("key", "settings_json").distinct(), ["key", "settings_json"], "left_semi").drop("bucket")
