"""GPU sample summaries and worker capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.scale import names


def gpu_summary(samples: DataFrame, by=()) -> DataFrame:
    """Count, mean, nearest-rank p95 and peak per resource."""
    p95 = {n: F.expr(f"percentile_disc(0.95) within group (order by {n})").alias(f"p95_{n}") for n in ("sm", "mem")}  # at most 101 values each
    return samples.groupBy(*names(by)).agg(
        *p95.values(), F.count(F.lit(1)).alias("sample_count"), F.avg("sm").alias("avg_sm"), F.max("sm").alias("peak_sm"), F.avg("mem").alias("avg_mem"),
        F.max("mem").alias("peak_mem"), F.avg("fb_mb").alias("avg_fb_mb"), F.max("fb_mb").alias("peak_fb_mb"))


def gpu_baseline(samples: DataFrame, workers: DataFrame, by=(), pid: str = "pid") -> DataFrame:
    """Load of processes that are not ours; percentages are capped at 100, memory is not."""
    others = samples.join(workers.select(pid).distinct(), pid, "left_anti")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return others.groupBy(*names(by)).agg(
        F.least(total("sm"), F.lit(100.0)).alias("sm"), F.least(total("mem"), F.lit(100.0)).alias("mem"), total("fb_mb").alias("fb_mb"))


SCENARIOS = {"ideal": (0, 0, 0), "background_sm": (1, 0, 0), "background_mem": (0, 1, 0), "background_fb": (0, 0, 1)}


def capacities(summary: DataFrame, safety: float = 0.8, reserve_fb_mb: float = 2048.0, max_workers: int = 16) -> DataFrame:
    """Workers per scenario and the recommended number.

    ``summary`` has peak_sm, peak_mem, peak_fb_mb, total_mb and the baseline sm, mem, fb_mb.
    """
    def bounded(usable: Column, peak: Column) -> Column:
        ratio = F.when(peak > 0, F.greatest(usable, F.lit(0.0)) / peak).otherwise(F.lit(float(max_workers)))
        return F.greatest(F.lit(1), F.least(F.lit(max_workers), F.floor(ratio).cast("int")))

    def fields(name: str) -> list[Column]:
        use_sm, use_mem, use_fb = SCENARIOS[name]
        by_sm = bounded(F.lit(100.0 * safety) - F.col("sm") * use_sm, F.col("peak_sm"))
        by_mem = bounded(F.lit(100.0 * safety) - F.col("mem") * use_mem, F.col("peak_mem"))
        by_fb = bounded(F.col("total_mb") - reserve_fb_mb - F.col("fb_mb") * use_fb, F.col("peak_fb_mb"))
        return [by_sm, by_mem, by_fb]

    chosen = [fields("background_sm")[0], fields("background_mem")[1], fields("background_fb")[2], F.lit(max_workers)]
    rows = []
    for name in SCENARIOS:
        by_sm, by_mem, by_fb = fields(name)
        rows.append(F.struct(
            F.lit(name).alias("scenario"), by_sm.alias("by_sm"), by_mem.alias("by_mem"), by_fb.alias("by_fb"),
            F.greatest(F.lit(1), F.least(by_sm, by_mem, by_fb, F.lit(max_workers))).alias("recommended"),
            F.greatest(F.lit(1), F.least(*chosen)).alias("current_recommended")))
    return summary.select(F.inline(F.array(*rows)))
