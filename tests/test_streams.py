import datetime as dt

from tilewright.streaming import jobs as sj


def test_an_older_row_of_a_later_batch_changes_nothing(spark, tmp_path):
    start = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda s: start + dt.timedelta(seconds=s)
    batches = [[(1, 2, at(20), "finished"), (2, 1, at(0), "started")], [(1, 1, at(10), "started"), (2, 2, at(30), "finished")], [(3, 1, at(40), "queued")]]
    schema = "job_id long, seq long, ts timestamp, status string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = sj.replay(sj.job_lifecycle(stream, timeout=300, lifetime=3600), "append")
    latest = {r["job_id"]: r["status"] for r in sj.latest_status(changes).collect()}
    assert latest == {1: "finished", 2: "finished", 3: "queued"}
    assert [r["status"] for r in changes.where("job_id = 1").collect()] == ["finished"]


def test_many_jobs_in_one_state_change_as_each_in_its_own():
    import random

    import pandas as pd

    class State:
        def __init__(self):
            self.value, self.timer, self.watermark, self.hasTimedOut = None, None, 0, False

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)
        getCurrentWatermarkMs = lambda self: self.watermark

        def update(self, value):
            self.value = value

        def remove(self):
            self.value = None

        def setTimeoutTimestamp(self, moment):
            assert moment > self.watermark
            self.timer = moment

    def replayed(step, key_of, batches):
        states, out, calls = {}, [], 0
        for watermark, rows in batches:
            keys = {}
            for row in rows:
                keys.setdefault(key_of(row[0]), []).append(row)
            late = [k for k, s in states.items() if k not in keys and s.exists and s.timer < watermark]
            for key in [*keys, *late]:
                state = states.setdefault(key, State())
                state.watermark, state.hasTimedOut = watermark, key not in keys
                frame = pd.DataFrame(keys.get(key, []), columns=["job_id", "seq", "ts", "status"]).astype({"job_id": "int64", "seq": "int64", "ts": "datetime64[us]"})
                calls += 1
                for changes in step((key,), iter([frame[:1], frame[1:]]), state, 300, 3600):
                    out += [tuple(map(str, r)) for r in changes.itertuples(index=False)]
        return sorted(out), calls

    rng, batches, seq = random.Random(11), [], 0
    for n in range(14):
        rows = []
        for _ in range(rng.choice((0, 5, 60))):
            seq += 1
            moment = pd.Timestamp(n * 700 + rng.randrange(-900, 900) + 5000, unit="s") if rng.random() > 0.03 else pd.NaT
            rows.append((rng.randrange(-3, 40), seq - rng.choice((0, 0, 7)), moment, rng.choice(("queued", "started", "started", "finished"))))
        batches.append((max(0, n * 700 + 4000) * 1000 if n else 0, rows))
    batches += [(40_000_000, []), (80_000_000, [])]
    alone, calls = replayed(sj._lifecycle, lambda job: job, batches)
    together, fewer = replayed(sj._lifecycles, lambda job: job >> 3, batches)
    assert alone == together and {r[3] for r in alone} == {"None", "timeout", "lifetime"} and fewer < calls / 2


def test_jobs_share_calls(spark, tmp_path, monkeypatch):
    schema = "job_id long, seq long, ts timestamp, status string"
    rows = spark.range(900).selectExpr("id div 3 as job_id", "id as seq", "timestamp_seconds(1000 + id) as ts", "'queued' as status")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    changes = sj.job_lifecycle(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    assert "_jobs" in changes._jdf.queryExecution().logical().toString()
    done = sj.replay(changes, "append")
    assert done.count() == 900 and done.select("job_id").distinct().count() == 300
