"""Streams of GPU samples, job progress, edits, uploads and tile scores.

Aggregations run in update mode; keyed state uses ``applyInPandasWithState``.
Input timestamps are event times; rows later than the watermark are dropped by
Spark and counted in the query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilewright.functions.scalar import verdict
from tilewright.sources.images import check_uploads

# Seconds between progress saves, job timeout and result lifetime.
NO_TIME = np.iinfo(np.int64).min  # of a missing timestamp, in nanoseconds
SAVE_INTERVAL, JOB_TIMEOUT, RESULT_LIFETIME = 0.5, 1800, 86400
JOB_BITS = 8  # jobs in one state: a call and a stored state cost about the same for one as for hundreds


def gpu_windows(samples: DataFrame, length: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Count, mean, nearest-rank p95 and peak per tumbling window.

    Utilisation is a whole percentage, so the exact percentile keeps at most 101 counters per window.
    """
    return samples.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("sm").alias("avg_sm"), F.expr("percentile_disc(0.95) within group (order by sm)").alias("p95_sm"),
        F.max("sm").alias("peak_sm"), F.max("fb_mb").alias("peak_fb_mb")).select(F.col("w.start").alias("start"), "sample_count", "avg_sm", "p95_sm", "peak_sm", "peak_fb_mb")


def job_maxima(progress: DataFrame) -> DataFrame:
    """Live export progress: furthest processed count, total and latest item per job."""
    return progress.groupBy("job_id").agg(
        F.max("processed").alias("processed"), F.max("total").alias("total"), F.max_by("current", F.struct("processed", "ts")).alias("current"))


def _throttle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, interval: float) -> Iterator[pd.DataFrame]:
    last, processed, total = state.get if state.exists else (None, 0, None)
    kept = []
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
    for row in rows.itertuples(index=False):
        if not pd.isna(row.processed):
            processed = int(row.processed)
        if not pd.isna(row.total):
            total = int(row.total)
        now = row.ts.value / 1e9
        if not row.forced and last is not None and now - last < interval:
            continue
        last = now if last is None else max(last, now)  # an older forced row does not set the time back
        kept.append((key[0], row.seq, row.ts, row.stage, processed, total, row.percent))
    state.update((last, processed, total))
    yield pd.DataFrame(kept, columns=["job_id", "seq", "ts", "stage", "processed", "total", "percent"])


def throttled_progress(events: DataFrame, interval: float = SAVE_INTERVAL) -> DataFrame:
    """Progress rows worth saving: forced ones, and others at least ``interval`` seconds after the last.

    ``events``: job_id, seq, ts, stage, processed, total, percent, forced.  Tile
    counts carry over from earlier updates.  State is three numbers per job.
    """
    return events.groupBy("job_id").applyInPandasWithState(
        partial(_throttle, interval=interval), "job_id long, seq long, ts timestamp, stage string, processed long, total long, percent double",
        "last double, processed long, total long", "append", GroupStateTimeout.NoTimeout)


def _changes(rows: list[tuple]) -> pd.DataFrame:
    """Status rows with seconds turned into timestamps of one unit; one frame a job, so it is made of arrays at once."""
    job, status, since, reason = zip(*rows) if rows else ((), (), (), ())
    return pd.DataFrame({
        "job_id": np.array(job, dtype="int64"), "status": np.array(status, dtype=object),
        "since": (np.array(since, dtype="float64") * 1e6).round().astype("int64").view("datetime64[us]"), "reason": np.array(reason, dtype=object)}, copy=False)


def _in_order(batches: Iterator[pd.DataFrame]) -> list[tuple[int, int, str]]:
    """(nanoseconds, seq, status) of one key's rows by time, rows without one last."""
    rows = [r for f in batches for r in zip(f["ts"].to_numpy().astype("datetime64[ns]").astype("int64").tolist(), f["seq"].tolist(), f["status"].tolist())]
    return sorted(rows, key=lambda r: (r[0] == NO_TIME, r[0], r[1]))


def _advanced(job: int, rows: list[tuple[int, int, str]], known: tuple, timeout: int, out: list[tuple]) -> tuple:
    """(status, since, seq) of a job after ``rows`` in order, from ``known``; its changes are added to ``out``."""
    status, since, seq = known
    for moment, number, found in rows:
        now = moment / 1e9
        if status is not None and (now, number) <= (since, seq):  # older than what an earlier batch brought
            continue
        if status == "started" and now - since > timeout and found != "started":
            out.append((job, "failed", since + timeout, "timeout"))
            status, since, seq = "failed", since + timeout, number
            continue
        status, since, seq = found, now, number
        out.append((job, status, now, None))
    return status, since, seq


def _timer(status: str, since: float, timeout: int, lifetime: int, watermark: int) -> int:
    return max(watermark + 1, int((since + (timeout if status == "started" else lifetime)) * 1000))


def _timed_out(job: int, known: tuple, timeout: int, lifetime: int, watermark: int, out: list[tuple]) -> tuple | None:
    """A job's state and next timer after its timer ran out; nothing if its result expired."""
    status, since, seq = known
    if status != "started":
        out.append((job, "expired", since + lifetime, "lifetime"))
        return None
    out.append((job, "failed", since + timeout, "timeout"))
    return "failed", since, seq, max(watermark, int((since + timeout) * 1000)) + lifetime * 1000


def _lifecycle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, timeout: int, lifetime: int) -> Iterator[pd.DataFrame]:
    """One job a state; :func:`_lifecycles` is the same for many."""
    out: list[tuple] = []
    watermark = state.getCurrentWatermarkMs()
    if state.hasTimedOut:
        left = _timed_out(key[0], state.get, timeout, lifetime, watermark, out)
        if left is None:
            state.remove()
        else:
            state.update(left[:3])
            state.setTimeoutTimestamp(left[3])
    else:
        known = _advanced(key[0], _in_order(batches), state.get if state.exists else (None, None, None), timeout, out)
        state.update(known)
        state.setTimeoutTimestamp(_timer(*known[:2], timeout, lifetime, watermark))
    yield _changes(out)


def _by_job(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    """Each job of a group's rows, with its rows as :func:`_in_order` gives them."""
    frames = [f for f in batches if len(f)]
    if not frames:
        return
    job, seq = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("job_id", "seq"))
    moment = np.concatenate([f["ts"].to_numpy().astype("datetime64[ns]").astype("int64") for f in frames])
    status = np.concatenate([f["status"].to_numpy(dtype=object) for f in frames])
    order = np.lexsort((seq, moment, moment == NO_TIME, job))
    job = job[order]
    cuts = [*np.flatnonzero(np.diff(job, prepend=job[0] - 1)).tolist(), len(job)]
    rows = list(zip(moment[order].tolist(), seq[order].tolist(), status[order].tolist()))
    names = job.tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield names[a], rows[a:b]


def _lifecycles(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, timeout: int, lifetime: int) -> Iterator[pd.DataFrame]:
    """As :func:`_lifecycle` for the jobs of one state, each with a timer of its own; the state's timer is the earliest of them."""
    out: list[tuple] = []
    watermark = state.getCurrentWatermarkMs()
    jobs = {job: tuple(known) for job, *known in zip(*state.get)} if state.exists else {}
    met = set()
    if not state.hasTimedOut:
        for job, rows in _by_job(batches):
            known = _advanced(job, rows, jobs[job][:3] if job in jobs else (None, None, None), timeout, out)
            jobs[job] = (*known, _timer(*known[:2], timeout, lifetime, watermark))
            met.add(job)
    for job in [j for j, known in jobs.items() if known[3] < watermark and j not in met]:
        left = _timed_out(job, jobs[job][:3], timeout, lifetime, watermark, out)
        if left is None:
            del jobs[job]
        else:
            jobs[job] = left
    if jobs:
        state.update((list(jobs), *map(list, zip(*jobs.values()))))
        state.setTimeoutTimestamp(max(watermark + 1, min(known[3] for known in jobs.values())))
    elif state.exists:
        state.remove()
    yield _changes(out)


def job_lifecycle(events: DataFrame, delay: str = "1 minute", timeout: int = JOB_TIMEOUT, lifetime: int = RESULT_LIFETIME) -> DataFrame:
    """Status changes per job; started jobs fail after ``timeout`` and results expire after ``lifetime`` seconds.

    ``events``: job_id, seq, ts, status.  Timers run on event time.  The state keeps
    the newest (ts, seq), so an older row of a later batch changes nothing.  Up to
    ``2 ** JOB_BITS`` jobs of neighbouring numbers share a state and a Python call.
    """
    grouped = events.withColumn("_jobs", F.shiftright("job_id", JOB_BITS)).withWatermark("ts", delay).groupBy("_jobs")
    return grouped.applyInPandasWithState(
        partial(_lifecycles, timeout=timeout, lifetime=lifetime), "job_id long, status string, since timestamp, reason string",
        "job array<long>, status array<string>, since array<double>, seq array<long>, timer array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_status(changes: DataFrame) -> DataFrame:
    """Last status per job (batch or update-mode stream)."""
    return changes.groupBy("job_id").agg(F.max_by("status", F.struct("since", "status")).alias("status"), F.max("since").alias("since"))


def live_edits(log: DataFrame) -> DataFrame:
    """Last word per (image, segment) of an edit stream; ``op`` add means the segment lives."""
    edits = log.where(F.col("op").isin("add", "delete"))
    return edits.groupBy("image_id", "segment_id").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))


def fresh_uploads(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Accepted uploads, the first of each content hash within the watermark."""
    checked = check_uploads(uploads).where(F.col("reason").isNull()).drop("reason")
    return checked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha256"])


def running_verdicts(tiles: DataFrame, talc_ratio: str = "talc_ratio") -> DataFrame:
    """Verdict per image so far from accepted tiles (``accepted``, ``centre_inside``, prob, talc_ratio)."""
    counted = F.col("accepted") & F.col("centre_inside")
    scored = tiles.groupBy("image_id").agg(
        F.avg(talc_ratio).alias("talc_ratio"), F.coalesce(F.avg(F.when(counted, F.col("prob"))), F.lit(0.0)).alias("difficulty"), F.count(F.lit(1)).alias("tiles"))
    return scored.withColumn("verdict", verdict(F.col("talc_ratio"), F.col("difficulty")))


def _work_folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/streams-{spark.sparkContext.applicationId}"


def replay(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over everything available and returns its final table.

    Output goes to a table in the shared folder; update-mode rows carry their
    batch and the newest per key is kept.
    """
    spark = stream.sparkSession
    base = f"{_work_folder(spark)}/{uuid.uuid4().hex}"
    schema = stream.schema

    ran = []

    def save(batch: DataFrame, number: int) -> None:
        ran.append(number)
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if not ran:  # nothing was available
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(f"{base}/out").drop("b")
    if not keys:
        return rows.drop("_batch")
    row = F.struct(*[c for c in schema.names if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(row, "_batch").alias("_r")).select(*keys, "_r.*")
