import datetime as dt
import random
from collections import deque

from lexspan.operators.limiter import admit
from lexspan.streaming import jobs

EPOCH = dt.datetime(2024, 1, 1)
SCHEMA = "client string, job_id string, kind string, requested_at timestamp"


def feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"in/b{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_rate_limit_over_batches(spark, tmp_path):
    rnd = random.Random(3)
    times = sorted(rnd.randrange(20_000) for _ in range(120))
    rows = [(rnd.choice("ab"), f"j{i:03d}", "create", EPOCH + dt.timedelta(seconds=t)) for i, t in enumerate(times)]
    got = {r.job_id: r.accepted for r in run(spark, jobs.rate_limited(feed(spark, tmp_path, [rows[:60], rows[60:]]), most=4), "limited", tmp_path)}
    logs, want = {}, {}
    for c, j, _, t in rows:
        want[j] = admit(logs.setdefault(c, deque()), int((t - EPOCH).total_seconds() * 1e6), 3_600_000_000, 4)
    assert got == want and not all(want.values())


def test_counts_duplicates_and_states(spark, tmp_path):
    rows = [("a", f"j{i}", "create" if i % 2 else "poll", EPOCH + dt.timedelta(minutes=20 * i)) for i in range(12)]
    stream = feed(spark, tmp_path, [rows + rows[:3]])
    counts = run(spark, jobs.windowed_counts(stream), "counts", tmp_path, "complete")
    assert sum(r.n for r in counts) == 15
    assert len(run(spark, jobs.once_each(stream, ["job_id", "kind"]), "once", tmp_path)) == 12
    states = run(spark, jobs.job_states(stream), "states", tmp_path, "complete")
    assert len(states) == 12 and {r.events for r in states} == {1, 2}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "table")
    write = jobs.append_versions(path)
    write(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, v int, w string"), 0)
    for _ in range(2):  # a batch tried again
        write(spark.createDataFrame([("a", 2, "y"), ("b", 0, "old")], "k string, v int, w string"), 1)
    rows = {(r.k, r.v, r.w) for r in jobs.current_versions(spark, path, ["k"], "v").collect()}
    assert rows == {("a", 2, "y"), ("b", 1, "x")}


def test_jobs_time_out_by_request_and_by_watermark(spark, tmp_path):
    schema = "job_id string, kind string, run_mode string, requested_at timestamp"
    at = lambda minutes: EPOCH + dt.timedelta(minutes=minutes)
    batches = [
        [("a", "create", "full", at(0)), ("a", "start", "full", at(1)), ("b", "create", "sections", at(0)), ("c", "create", None, at(0)), ("d", "cancel", "full", at(0)), ("e", "create", "full", at(0))],
        [("a", "complete", "full", at(5)), ("a", "cancel", "full", at(6)), ("b", "start", "sections", at(9)), ("e", "cancel", "full", at(3)), ("e", "cancel", "full", at(3))],
        [("z", "create", "full", at(600))],
        [("z", "start", "full", at(601))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    rows = run(spark, jobs.job_machine(stream, {"full": 12 * 60, "sections": 4 * 60}), "machine", tmp_path)
    got = {}
    for r in sorted(rows, key=lambda r: (r.at, r.state != "queued")):
        got.setdefault(r.job_id, []).append((r.state, (r.at - EPOCH).total_seconds() / 60))
    assert got["a"] == [("queued", 0), ("running", 1), ("completed", 5)]
    assert got["b"] == [("queued", 0), ("timed_out", 4)]  # seen by a later request
    assert got["c"] == [("queued", 0), ("timed_out", 12)]  # seen by the watermark
    assert "d" not in got and got["e"] == [("queued", 0), ("cancelled", 3)]
