"""Labelled image sets: dedupe, conflicts, counts, splits and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.operators.scale import attach, hash_bins, names, rank_rows, value_bins

LABELS = ("ordinary", "difficult")  # fixed values, in id order


def content_groups(sources: DataFrame) -> DataFrame:
    """One row per content hash; partial aggregation keeps a hot hash to one row per map task."""
    return sources.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("files"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.min_by(F.struct("label", "label_id", "source_path"), "source_path").alias("kept"))


def deduplicate(sources: DataFrame) -> DataFrame:
    """Hashes with one label, represented by their smallest path."""
    return content_groups(sources).where(F.col("low") == F.col("high")).select("kept.*", "sha256")


def conflicts(sources: DataFrame) -> DataFrame:
    """All files of hashes that appear under more than one label."""
    mixed = content_groups(sources).where(F.col("low") != F.col("high")).select("sha256")
    return attach(sources, mixed, "sha256")


def duplicate_counters(sources: DataFrame) -> DataFrame:
    mixed = F.col("low") != F.col("high")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return content_groups(sources).agg(
        zero(F.sum(F.when(~mixed, F.col("files") - 1))).alias("same_label_duplicates"),
        zero(F.sum(F.when(mixed, F.col("files")))).alias("conflicting_files"),
        F.count_if(mixed).alias("conflicting_hash_groups"))


def label_counts(rows: DataFrame, by=(), labels=LABELS) -> DataFrame:
    """Zero-filled counts per label, one column each."""
    return rows.groupBy(*names(by)).agg(*[F.count_if(F.col("label") == label).alias(label) for label in labels])


def dataset_summary(sources: DataFrame, split: DataFrame) -> DataFrame:
    """Counts of all stages as (section, ordinary, difficult, total) rows."""
    total = F.col("ordinary") + F.col("difficult")
    parts = [
        label_counts(sources).select(F.lit("source").alias("section"), *LABELS),
        label_counts(split).select(F.lit("usable").alias("section"), *LABELS),
        label_counts(split, "split").select(F.concat(F.lit("split_"), "split").alias("section"), *LABELS),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("total", total)


def _allocate(counts: DataFrame, size: str, wanted: str, name: str) -> DataFrame:
    """Share ``wanted`` over classes by largest remainder (ties to the smaller label id).

    The window runs over one row per class, a fixed handful.
    """
    everyone = Window.partitionBy(F.lit(1))
    exact = F.col(size) * F.col(wanted) / F.sum(size).over(everyone)
    floors = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_rest"), "label_id")
    more = F.col(wanted) - F.sum("_floor").over(everyone)
    return floors.withColumn(
        name, (F.col("_floor") + F.when(F.row_number().over(order) <= more, 1).otherwise(0)).cast("bigint")).drop("_floor", "_rest")


def split_sizes(records: DataFrame, train: float, val: float) -> DataFrame:
    """Rows per class in train and val; the rest is test."""
    counts = records.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    everyone = Window.partitionBy(F.lit(1))
    sized = counts.withColumn("_train", F.floor(F.sum("n").over(everyone) * F.lit(train)))
    sized = _allocate(sized, "n", "_train", "n_train").withColumn("_left", F.col("n") - F.col("n_train"))
    sized = sized.withColumn("_val", F.floor(F.sum("_left").over(everyone) * F.lit(val / (1.0 - train))))
    return _allocate(sized, "_left", "_val", "n_val").select("label_id", "n_train", "n_val")


def stratified_split(records: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``split`` with exact class counts; membership follows a seeded content hash."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    hashed = records.withColumn("_h", F.xxhash64(F.lit(seed), F.col("sha256")))
    ranked = rank_rows(hashed, "label_id", ["_h", "sha256"], hash_bins(F.col("_h")), "_rank")
    placed = attach(ranked, split_sizes(records, train, val), "label_id")
    split = (
        F.when(F.col("_rank") <= F.col("n_train"), "train")
        .when(F.col("_rank") <= F.col("n_train") + F.col("n_val"), "val").otherwise("test"))
    return placed.withColumn("split", split).drop("_h", "_rank", "n_train", "n_val")


def train_val_split(records: DataFrame, key: str, val_ratio: float, seed: int) -> DataFrame:
    """Adds ``split``; val gets max(1, round(n * ratio)) rows, and a single record goes to both."""
    total = records.count()
    if total <= 1:
        return records.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("val"))))
    wanted = max(1, round(total * val_ratio))
    hashed = records.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    ranked = rank_rows(hashed, [], ["_h", key], hash_bins(F.col("_h")), "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= wanted, "val").otherwise("train")).drop("_h", "_rank")


def limit_per_group(rows: DataFrame, by, order, limit: int) -> DataFrame:
    """First ``limit`` rows per group; Spark keeps at most ``limit`` per group and map task before the shuffle."""
    window = Window.partitionBy(*names(by)).orderBy(*names(order))
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= limit).drop("_n")


def manifest(split: DataFrame, root: str) -> DataFrame:
    """Manifest rows with the target path ``root/split/label/<sha16>_<safe name>``."""
    from tilewright.functions.scalar import safe_file_name

    file = F.element_at(F.split("source_path", "/"), -1)
    target = F.concat_ws(
        "/", F.lit(root), F.col("split"), F.col("label"), F.concat(F.substring("sha256", 1, 16), F.lit("_"), safe_file_name(file)))
    return split.select("split", "label", "label_id", "sha256", "source_path", target.alias("dataset_path"))


def queue_positions(jobs: DataFrame, order: list[str], clock: str) -> DataFrame:
    """1-based place of each queued job; ``clock`` is the numeric first ordering column."""
    return rank_rows(jobs, [], order, value_bins(jobs, clock), "queue_position")
