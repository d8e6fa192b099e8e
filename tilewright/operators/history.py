"""Decisions over training histories: early stopping, checkpoints, resume state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.operators.scale import cut_lineage, in_groups, names, running_best

EPOCHS_PER_BIN = 1024


def early_stopping(
    history: DataFrame, by, value: str, min_delta: float, patience: int, smaller: bool = False, start: float = float("-inf"),
    epoch: str = "epoch",
) -> DataFrame:
    """Best epoch, its value, the last epoch run and why training stopped.

    An epoch counts as better only against the last *accepted* best plus
    ``min_delta``.  Accepted epochs are always running records, so the history
    is first reduced to records by a binned, distributed running maximum; only
    those few rows per run are folded in order.
    """
    keys = names(by)
    signed = -F.col(value) if smaller else F.col(value)
    rows = history.select(*keys, F.col(epoch).cast("int").alias("_e"), signed.cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.max("_e").alias("_last"))
    best = running_best(rows.withColumn("_bin", F.floor(F.col("_e") / EPOCHS_PER_BIN)), keys, "_e", "_v", "_bin")
    before = F.coalesce(F.col("_v_before"), F.lit(float("-inf")))
    records = best.where(F.col("_v") > before if min_delta > 0 else F.col("_v") >= before)
    folded = records.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_e", "_v"))).alias("_records"))
    initial = F.struct(F.lit(float(start)).alias("best"), F.lit(0).alias("at"), F.lit(False).alias("stopped"))

    def step(state, record):
        late = state["stopped"] | (record["_e"] - state["at"] > patience)
        better = ~late & (record["_v"] >= state["best"] + F.lit(float(min_delta)))
        return F.struct(
            F.when(better, record["_v"]).otherwise(state["best"]).alias("best"),
            F.when(better, record["_e"]).otherwise(state["at"]).alias("at"), late.alias("stopped"))

    state = folded.withColumn("_s", F.aggregate("_records", initial, step)).join(ends, keys)
    stopped = F.col("_s.stopped") | (F.col("_last") - F.col("_s.at") >= patience)
    shown = -F.col("_s.best") if smaller else F.col("_s.best")
    return state.select(
        *keys, F.col("_s.at").alias("best_epoch"), shown.alias("best_value"),
        F.when(stopped, F.col("_s.at") + patience).otherwise(F.col("_last")).alias("completed_epochs"),
        F.when(stopped, "early_stopping").otherwise("max_epochs").alias("stopped_reason"))


def early_stopping_pairs(
    history: DataFrame, by, first: str, second: str, min_delta: float, patience: int, epoch: str = "epoch",
) -> DataFrame:
    """Early stopping on (first, second): ``second`` breaks near ties of ``first``.

    The accepted best may drop within ``min_delta``, so records do not help.
    Each epoch instead points to the next epoch it would accept, found among
    the following ``patience`` epochs.  Inside a bin of epochs the pointers are
    followed to their end; only the epochs a bin can be entered by leave it, and
    their pointers are doubled until they rest: log2(bins) rounds, none if no
    run leaves its first bin.
    """
    keys = names(by)
    size = max(EPOCHS_PER_BIN, patience)
    types = {f.name: f.dataType.simpleString() for f in history.schema.fields}
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    rows = history.select(*keys, F.col(epoch).cast("int").alias("e"), a.alias("a"), b.alias("b"), a.isNull().alias("no_a"), b.isNull().alias("no_b"))
    # A bin also receives the first ``patience`` epochs of its successor.
    homes = F.when(F.col("e") % size < patience, F.array(F.floor(F.col("e") / size), F.floor(F.col("e") / size) - 1)).otherwise(
        F.array(F.floor(F.col("e") / size)))
    below = lambda x, y: (x < y) | (np.isnan(y) & ~np.isnan(x))  # noqa: E731  NaN is the largest number, as in SQL

    def follow(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((frame["e"].to_numpy(), group))
        frame, group = frame.iloc[order].reset_index(drop=True), group[order]
        e, a, b, no_a, no_b = (frame[c].to_numpy() for c in ("e", "a", "b", "no_a", "no_b"))
        own = e // size == frame["bin"].to_numpy()
        at = np.arange(len(e))
        to = at.copy()
        for gap in range(1, min(patience, len(e) - 1) + 1):
            old, new = slice(None, -gap), slice(gap, None)
            near = (group[new] == group[old]) & (e[new] - e[old] <= patience) & ~no_a[new] & ~no_a[old]
            with np.errstate(invalid="ignore"):
                close = np.abs(a[new] - a[old]) < min_delta
            better = ~below(a[new], a[old] + min_delta) | (close & below(b[old], b[new]) & ~no_b[new] & ~no_b[old])
            to[old] = np.where(own[old] & (to[old] == at[old]) & near & better, at[new], to[old])
        while not np.array_equal(to, to[to]):
            to = to[to]
        lead = own & np.r_[True, (group[1:] != group[:-1]) | ~own[:-1]]
        last = np.zeros(int(group[-1]) + 1, dtype=e.dtype)
        np.maximum.at(last, group[own], e[own])
        out = frame.loc[lead | own & (e % size < patience), keys + ["e"]].copy()
        kept = to[out.index]
        return out.assign(to=e[kept], a=a[kept], b=b[kept], no_a=no_a[kept], no_b=no_b[kept], last=last[group[out.index]])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", e int, to int, a double, b double, no_a boolean, no_b boolean, last int"
    pointers = cut_lineage(in_groups(rows.withColumn("bin", F.explode(homes)), [*keys, "bin"], follow, schema))
    score = lambda c: F.when(~F.col(f"no_{c}"), F.coalesce(c, F.lit(float("nan")))).alias(c)
    ends = pointers.groupBy(*keys).agg(F.max("last").alias("last"), F.min("e").alias("first"))
    pointers = pointers.select(*keys, "e", "to", score("a"), score("b"))
    moved = not pointers.where(F.floor(F.col("e") / size) != F.floor(F.col("to") / size)).isEmpty()
    while moved:
        jumped = pointers.select(*keys, F.col("e").alias("to"), F.struct("to", "a", "b").alias("far"))
        found = pointers.withColumn("near", F.struct("to", "a", "b")).drop("a", "b").join(jumped, [*keys, "to"], "left")
        doubled = cut_lineage(found.select(
            *keys, "e", F.coalesce("far", "near").alias("near"), F.coalesce(F.col("far.to") != F.col("to"), F.lit(False)).alias("moved")))
        moved = not doubled.where("moved").isEmpty()
        pointers = doubled.select(*keys, "e", "near.*")
    best = pointers.join(ends, keys).where(F.col("e") == F.col("first"))
    stopped = F.col("last") - F.col("to") >= patience
    return best.select(
        *keys, F.col("to").alias("best_epoch"), F.col("a").alias("best_first"), F.col("b").alias("best_second"),
        F.when(stopped, F.col("to") + patience).otherwise(F.col("last")).alias("completed_epochs"),
        F.when(stopped, "early_stopping").otherwise("max_epochs").alias("stopped_reason"))


def checkpoints(
    history: DataFrame, by, drift_limit: float = 0.03, fallback: str = "last", score: tuple[str, str] = ("val_auc", "val_f1"),
    drift: str = "drift", epoch: str = "epoch",
) -> DataFrame:
    """Best epoch by (AUC, F1) and the recommended one among epochs with small drift.

    First wins on ties.  Without a qualifying epoch the ``fallback`` decides:
    ``last`` recommends the last epoch, ``best`` the best one.
    """
    ranked = F.struct(F.col(score[0]), F.col(score[1]), (-F.col(epoch)).alias("_e"))
    out = history.groupBy(*names(by)).agg(
        F.max(ranked).alias("_best"), F.max(F.when(F.col(drift) <= drift_limit, ranked)).alias("_safe"), F.max(epoch).alias("_last"))
    spare = F.col("_last") if fallback == "last" else -F.col("_best._e")
    return out.select(
        *names(by), (-F.col("_best._e")).alias("best_epoch"), F.coalesce(-F.col("_safe._e"), spare).alias("recommended_epoch"),
        F.col("_safe").isNotNull().alias("within_drift"))


def resume_state(history: DataFrame, by, value: str, target_epochs: int, epoch: str = "epoch") -> DataFrame:
    """Completed epochs, best row (first on ties) and epochs still to run."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("_e")))
    out = history.groupBy(*names(by)).agg(F.max(epoch).alias("completed_epochs"), best.alias("_b"))
    return out.select(
        *names(by), "completed_epochs", (-F.col("_b._e")).alias("best_epoch"), F.col("_b.v").alias("best_value"),
        F.greatest(F.lit(target_epochs) - F.col("completed_epochs"), F.lit(0)).alias("remaining_epochs"))
