"""Building blocks that keep hot groups, orderings and iterations distributed.

Every ordered operator of the library (ranks, curves, percentiles, running
best) is built on :func:`running_totals`: a group is cut into value bins, bins
are summed, bin offsets are scanned, and only the rows of one bin meet in one
task.  A group that holds a third of all rows is therefore spread over about a
third of all bins.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Rows may be chunks of half a megabyte a channel: what a Python worker, a writer and a reader's batch hold of them is bounded by bytes.
BYTES_AT_ONCE, ROWS_READ = 8 << 20, 64
BATCH, READ = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
ROW_GROUPS = {"parquet.block.size": str(BYTES_AT_ONCE), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of the cluster (a private one in local tests)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            context.setCheckpointDir(shared)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`, but as a compressed table, whose plan and size say nothing of what came before."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    kept = {name: spark.conf.get(name) for name in (BATCH, READ)}
    try:
        for name, value in ((BATCH, BYTES_AT_ONCE), (READ, ROWS_READ)):
            spark.conf.set(name, str(value))
        df.write.options(**ROW_GROUPS).parquet(path)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    return spark.read.parquet(path)


def names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def attach(rows: DataFrame, facts: DataFrame, on, how: str = "inner", salts: int = 8, grown: bool = False) -> DataFrame:
    """Join one-row-per-key ``facts`` to many ``rows``; a hot key is split over ``salts`` tasks.

    AQE may still turn this into a broadcast join once it has measured ``facts``;
    ``grown`` facts are many an image (lines, components) and always sorted.
    """
    keys = names(on)
    spread_by = [c for c in rows.columns if c not in keys] or keys
    # Never NULL to the planner: it would ask that of the salt below the rows' own projections, with all their columns' expressions in it.
    salted = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"), F.lit(0)))
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (sorted_join(salted, spread, [*keys, "_salt"], how) if grown else salted.join(spread, [*keys, "_salt"], how)).drop("_salt")


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the pixels or rows of the images.

    The planner takes a table made by ``explode`` for no larger than its source and
    would send millions of rows to the driver as a broadcast, so both sides are sorted.
    """
    return left.join(right.hint("merge"), on, how)


def edges_to_bin(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open interval holding ``value``: a balanced CASE tree, so it stays in codegen."""
    edges = list(edges)
    if not edges:
        return F.lit(0)

    def build(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(edges[middle]), build(low, middle)).otherwise(build(middle + 1, high))

    return build(0, len(edges))


def value_bins(rows: DataFrame, value: str, bins: int = 64) -> Column:
    """Bin expression with literal edges near the pooled quantiles of ``value``.

    One bounded row (``bins - 1`` numbers) reaches the driver.  Literal edges
    make the binning repeatable when an executor is lost and tasks run again.
    """
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(F.percentile_approx(F.col(value).cast("double"), shares, 1000).alias("e")).first()["e"]
    return edges_to_bin(F.col(value).cast("double"), sorted(set(found or [])))


def hash_bins(hashed: Column, bits: int = 10) -> Column:
    """Order-preserving bin of a signed 64-bit hash; uniform, so no pass over the data is needed."""
    return F.shiftright(hashed, 64 - bits).cast("int")


def _with_offsets(rows: DataFrame, by, values, bin_column: str, combine, start) -> DataFrame:
    keys = names(by)
    summed = rows.groupBy(*keys, bin_column).agg(*[combine(v).alias(f"_{v}_bin") for v in values])
    earlier = Window.partitionBy(*keys).orderBy(bin_column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = summed.select(
        *keys, bin_column,
        *[combine(f"_{v}_bin").over(earlier).alias(f"_{v}_off") for v in values],
    )
    return rows.join(offsets, [*keys, bin_column])


def running_totals(rows: DataFrame, by, order, values, bin_column: str) -> DataFrame:
    """Adds ``<v>_before``: the sum of ``v`` over earlier rows of the group.

    ``order`` must be unique inside a group and ``bin_column`` monotone in it.
    """
    keys, order, values = names(by), names(order), names(values)
    joined = _with_offsets(rows, keys, values, bin_column, F.sum, 0)
    inside = Window.partitionBy(*keys, bin_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = joined.select(
        *rows.columns,
        *[
            (F.coalesce(F.col(f"_{v}_off"), zero) + F.coalesce(F.sum(v).over(inside), zero)).alias(f"{v}_before")
            for v in values
        ],
    )
    return out.drop(bin_column)


def running_best(rows: DataFrame, by, order, value: str, bin_column: str) -> DataFrame:
    """Adds ``<value>_before``: the largest value over earlier rows of the group (NULL for the first)."""
    keys, order = names(by), names(order)
    joined = _with_offsets(rows, keys, [value], bin_column, F.max, None)
    inside = Window.partitionBy(*keys, bin_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.col(f"_{value}_off"), F.max(value).over(inside))
    return joined.select(*rows.columns, best.alias(f"{value}_before")).drop(bin_column)


def with_mean_in_order(rows: DataFrame, by, value: str, order, name: str) -> DataFrame:
    """Adds ``name``, the mean of ``value`` so far in ``order``, and ``_nth``, the row's 1-based place in its group.

    The last bit of a floating-point sum depends on the order of its additions.  A mean that is compared with single values
    must not take that order from splits and shuffles, so a group's rows are added one after another as they leave their
    sort: one task a group, and a window that spills.
    """
    so_far = Window.partitionBy(*names(by)).orderBy(*names(order), value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({name: F.avg(value).over(so_far), "_nth": F.count(F.lit(1)).over(so_far)})


def rank_rows(rows: DataFrame, by, order, bin_value: Column, name: str = "rank") -> DataFrame:
    """Exact 1-based row number inside each group without one task per group."""
    numbered = rows.withColumn("_one", F.lit(1).cast("long")).withColumn("_bin", bin_value)
    ranked = running_totals(numbered, by, order, ["_one"], "_bin")
    return ranked.withColumn(name, F.col("_one_before") + 1).drop("_one", "_one_before")


def exact_percentiles(
    rows: DataFrame, by, value: str, shares: dict[str, float], nearest_rank: bool = False, bins: int = 64
) -> DataFrame:
    """Exact percentiles per group; linear interpolation, or the smallest value of rank ceil(q*n)."""
    keys = names(by)
    counted = cut_lineage(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    binned = counted.withColumn("_bin", value_bins(counted, value, bins))
    ranked = running_totals(binned, keys, value, ["_n"], "_bin")
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = attach(ranked, totals, keys)

    def at(position: Column) -> Column:
        inside = (F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(inside, F.col(value)))

    picks, finals = [], []
    for name, share in shares.items():
        if nearest_rank:
            picks.append(at(F.greatest(F.ceil(F.col("_total") * F.lit(share)) - 1, F.lit(0))).alias(name))
            finals.append(F.col(name))
            continue
        position = (F.col("_total") - 1) * F.lit(float(share))
        picks += [
            at(F.floor(position)).alias(f"_{name}_lo"),
            at(F.ceil(position)).alias(f"_{name}_hi"),
            F.max(position - F.floor(position)).alias(f"_{name}_t"),
        ]
        low, high, part = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "t"))
        finals.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *finals)


def image_percentiles(rows: DataFrame, by, value: str, shares: dict[str, float], nearest_rank: bool = False) -> DataFrame:
    """Exact percentiles of groups no larger than an image: one aggregate over value counts, merged before the shuffle.

    NULLs do not count.  For unbounded groups there is :func:`exact_percentiles`.
    """
    keys = names(by)
    kind = "percentile_disc" if nearest_rank else "percentile_cont"
    picks = [F.expr(f"{kind}({float(share)}) within group (order by `{value}`)").alias(name) for name, share in shares.items()]
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(*picks)


def spread_for_python(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's full number of shuffle partitions.

    AQE merges partitions by bytes; Python work is bounded by CPU, so the count is
    fixed here.  A following ``groupBy`` on the same keys needs no further shuffle.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_groups(rows: DataFrame, by, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, at_once: int = 20000) -> DataFrame:
    """As ``groupBy(by).applyInPandas``, but ``work`` gets the rows of many small groups at a time and the number of each row's group.

    A task reads its sorted partition as a stream and cuts it between groups, so it holds ``at_once`` rows and one group.
    """
    keys = names(by)

    def first_rows(frame: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(frame), dtype=bool)
        new[0] = True
        for k in keys:
            here, last = frame[k], frame[k].shift()
            new |= ((here != last) & ~(here.isna() & last.isna())).to_numpy()
        return new

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if len(frame):
                held.append(frame)
            if sum(map(len, held)) < max(at_once, 2 * len(held[0]) if len(held) > 1 else 0):
                continue
            whole = pd.concat(held, ignore_index=True)
            new = first_rows(whole)
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield work(whole[:cut], np.cumsum(new[:cut]) - 1)
            held = [whole[cut:].reset_index(drop=True)]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield work(whole, np.cumsum(first_rows(whole)) - 1)

    return spread_for_python(rows, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def attach_measured(rows: DataFrame, facts: DataFrame, on, how: str = "inner", most: int = 20000) -> DataFrame:
    """Join with materialised ``facts``: broadcast up to ``most`` counted rows, salted shuffle beyond."""
    if facts.count() <= most:
        return rows.join(F.broadcast(facts), names(on), how)
    return attach(rows, facts, on, how)
