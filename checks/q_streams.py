"""Streams over the event files, replayed to the end and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_tables import r6
from checks.registry import check
from tilewright.streaming import jobs as sj


def event_stream(spark, sf):
    """The events table as a file stream; its clock becomes a proper timestamp."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@check("x01_gpu_windows", """select epoch(time_bucket(interval '10 minutes', ts))::bigint start, count(*) sample_count, round(avg(sm),6) avg_sm, quantile_disc(sm,0.95) p95_sm, max(sm) peak_sm, round(max(fb_mb),6) peak_fb_mb from v_samples group by 1""")
def _(spark, sf):
    e = F.col("event_id")
    samples = event_stream(spark, sf).select("ts", (e * 13 % 101).cast("double").alias("sm"), (F.col("value") * 10).alias("fb_mb"))
    out = sj.replay(sj.gpu_windows(samples), "update", ("start",))
    return out.select(F.unix_timestamp("start").alias("start"), "sample_count", *r6("avg_sm"), "p95_sm", "peak_sm", *r6("peak_fb_mb"))


def _progress(stream):
    e = F.col("event_id")
    return stream.select(
        (F.col("user_id")).alias("job_id"), e.alias("seq"), "ts", F.col("event_type").alias("stage"), F.when(e % 3 != 0, e % 400).alias("processed"),
        F.when(e % 5 == 0, F.lit(400).cast("bigint")).alias("total"), (e % 101).cast("double").alias("percent"), (F.col("event_type") == "error").alias("forced"))


@check("x02_throttled_progress", """with e as (select user_id job, event_id seq, epoch_us(ts) t, event_type='error' f, row_number() over(partition by user_id order by ts, event_id) n from events),
    w as (select job, seq, t, n, t last, true keep from e where n=1 union all select e.job, e.seq, e.t, e.n, case when e.f or e.t-w.last>=600000000 then e.t else w.last end, e.f or e.t-w.last>=600000000 from w join e on e.job=w.job and e.n=w.n+1)
    select job job_id, seq from w where keep""")
def _(spark, sf):
    return sj.replay(sj.throttled_progress(_progress(event_stream(spark, sf)), 600.0), "append").select("job_id", "seq")


@check("x03_job_lifecycle")
def _(spark, sf):
    e = F.col("event_id")
    status = F.when(e % 3 == 0, "queued").when(e % 3 == 1, "started").otherwise("finished")
    events = event_stream(spark, sf).select(F.floor(e / 3).alias("job_id"), e.alias("seq"), "ts", status.alias("status"))
    changes = sj.replay(sj.job_lifecycle(events, timeout=300, lifetime=3600), "append")
    return changes.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@check("x04_export_progress", "select user_id job_id, max(event_id%400) processed, 400::bigint total from events group by 1")
def _(spark, sf):
    e = F.col("event_id")
    rows = event_stream(spark, sf).select(F.col("user_id").alias("job_id"), (e % 400).alias("processed"), F.lit(400).cast("bigint").alias("total"), F.concat(F.lit("i"), e.cast("string")).alias("current"), "ts")
    return sj.replay(sj.job_maxima(rows), "update", ("job_id",)).select("job_id", "processed", "total")


@check("x05_live_segments", """with l as (select user_id image_id, event_id%7 segment_id, arg_max(event_type, event_id) et, max(event_id) seq from events where event_type<>'error' group by 1,2) select image_id, segment_id, seq from l where et in ('view','click')""")
def _(spark, sf):
    kind = F.col("event_type")
    log = event_stream(spark, sf).select(
        F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("segment_id"),
        F.when(kind.isin("view", "click"), "add").when(kind == "error", "mode").otherwise("delete").alias("op"))
    return sj.replay(sj.live_edits(log), "update", ("image_id", "segment_id")).where("op = 'add'").select("image_id", "segment_id", "seq")


@check("x06_fresh_uploads", "select count(distinct md5(cast(user_id*100+event_id%10 as varchar))) uploads from events where event_type in ('view','click')")
def _(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "image/png").otherwise("text/html")
    rows = event_stream(spark, sf).select(
        "ts", kind.alias("content_type"), F.lit("upload").alias("name"), F.lit(10).cast("bigint").alias("size"),
        F.md5((F.col("user_id") * 100 + F.col("event_id") % 10).cast("string").cast("binary")).alias("sha256"))
    return sj.replay(sj.fresh_uploads(rows, "40 days"), "append").agg(F.count(F.lit(1)).alias("uploads"))


@check("x07_running_verdicts", """with s as (select user_id image_id, avg(cast(json_extract_string(props,'$.k') as double)/1000.0) talc, coalesce(avg(least(value/100.0,1.0)) filter(event_id%3<>0 and event_type<>'error'),0) d, count(*) tiles from events group by 1)
    select image_id, tiles, round(talc,6) talc_ratio, round(d,10) difficulty, case when talc>0.10 then 'оталькованная' when d>=0.5 then 'труднообогатимая' else 'рядовая' end verdict from s""")
def _(spark, sf):
    tiles = event_stream(spark, sf).select(
        F.col("user_id").alias("image_id"), (F.get_json_object("props", "$.k").cast("double") / 1000.0).alias("talc_ratio"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob"),
        (F.col("event_id") % 3 != 0).alias("accepted"), (F.col("event_type") != "error").alias("centre_inside"))
    out = sj.replay(sj.running_verdicts(tiles), "update", ("image_id",))
    return out.select("image_id", "tiles", F.round("talc_ratio", 6).alias("talc_ratio"), F.round("difficulty", 10).alias("difficulty"), "verdict")
