"""Source images to a deduplicated, split and documented dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tilewright.operators import dataset as ds
from tilewright.sources import tables


@dataclass(frozen=True)
class DatasetBuild:
    manifest: DataFrame
    conflicts: DataFrame
    counters: DataFrame
    summary: DataFrame


def build_dataset(sources: DataFrame, root: str, train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DatasetBuild:
    """``sources``: label, label_id, source_path, sha256."""
    split = ds.stratified_split(ds.deduplicate(sources), train, val, test, seed)
    return DatasetBuild(ds.manifest(split, root), ds.conflicts(sources), ds.duplicate_counters(sources), ds.dataset_summary(sources, split))


def write_build(build: DatasetBuild, root: str) -> None:
    tables.write_manifest(build.manifest, f"{root}/manifest.csv")
    tables.write_conflicts(build.conflicts, f"{root}/conflicts.csv")
    build.summary.write.mode("overwrite").json(f"{root}/summary.json")
