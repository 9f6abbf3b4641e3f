"""Streams and stores: job states, resumed stages, transactions, replays, rejects."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gritstone.operators import rejects
from gritstone.sources.store import Conflict, Table, deliver, once
from gritstone.streaming import jobs, resume

EVENTS = "job_id string, seq long, status string, at timestamp, result string, error string"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ended(df, tmp_path, name, mode="update"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    return df.sparkSession.table(name)


def test_jobs_stream_equals_batch(rocks, tmp_path):
    """All orders of moves, late and unknown ones included, in files that come one after another."""
    r = random.Random(5)
    rows = [(f"j{r.randrange(40)}", i, r.choice(["queued", "running", "running", "done", "failed", "lost"]), f"2024-01-01 00:{r.randrange(60):02d}:00", f"r{i}", None) for i in range(400)]
    made = rocks.createDataFrame(rows, "job_id string, seq long, status string, t string, result string, error string").select("job_id", "seq", "status", F.to_timestamp("t").alias("at"), "result", "error").cache()
    for k in range(3):
        made.where(f"seq >= {k * 140} and seq < {(k + 1) * 140}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(next(p for p in sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime, reverse=True)), (1e9 + k, 1e9 + k))
    stream = rocks.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ended(jobs.job_stream(stream), tmp_path, "jobs_out").collect()
    last, n = {}, Counter()
    for x in sorted(out, key=lambda x: x.seq):
        n[x.job_id, x.outcome == "accepted"] += 1
        last[x.job_id] = (x.status, x.created_at, x.updated_at, x.result, x.error)
    batch = {x.job_id: x for x in jobs.job_table(made).collect()}
    assert set(batch) == set(last) and {x.outcome for x in out} == {"accepted", "illegal", "late", "unknown"}
    for j, x in batch.items():
        assert tuple(x)[1:6] == last[j] and (x.accepted, x.rejected) == (n[j, True], n[j, False]), j
    assert jobs.job_table(made.limit(0)).count() == 0


def test_jobs_are_forgotten(rocks, tmp_path):
    """A job that stands still beyond the time to live is gone by event time, one that moves on is not."""
    events = [("a", 0, "queued", "00:00"), ("b", 1, "queued", "00:00"), ("b", 2, "running", "00:30"), ("c", 3, "queued", "02:00"), ("d", 4, "queued", "02:01"), ("a", 5, "running", "02:02")]
    for k, part in enumerate((events[:2], events[2:3], events[3:4], events[4:5], events[5:])):
        rows = rocks.createDataFrame([(j, s, st, f"2024-01-01 {t}:00", None, None) for j, s, st, t in part], "job_id string, seq long, status string, t string, result string, error string")
        rows.select("job_id", "seq", "status", F.to_timestamp("t").alias("at"), "result", "error").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        newest = max((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)
        os.utime(newest, (1e9 + k, 1e9 + k))
    stream = rocks.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ended(jobs.job_stream(stream, ttl_ms=3_600_000, late="10 minutes"), tmp_path, "ttl_out").collect()
    assert {(x.job_id, x.status) for x in out if x.outcome == "expired"} == {("a", "queued"), ("b", "running")}
    assert [x.outcome for x in out if x.seq == 5] == ["unknown"]


def rows_of(spark, path):
    return Counter((r.n, r.v) for r in spark.read.parquet(path).select("n", "v").collect())


def test_a_stage_cut_in_two_equals_one_run(spark, tmp_path):
    records = spark.createDataFrame([(i, f"v{i}") for i in range(23)] + [(None, "x"), (-1, "y")], "n long, v string")
    stage = lambda df: df.where("n % 5 <> 0")
    run = lambda name, **k: resume.run_stage(records, "n", stage, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-c"), 4, **k)
    assert run("whole") == {"status": "completed", "next_offset": 23, "remaining": 0}
    first = run("cut", batches=2)
    assert first["status"] == "split" and 8 <= first["next_offset"] < 23 and first["remaining"] == 23 - first["next_offset"]
    assert run("cut") == {"status": "completed", "next_offset": 23, "remaining": 0}
    assert run("cut") == {"status": "completed", "next_offset": 23, "remaining": 0}
    want = Counter((i, f"v{i}") for i in range(23) if i % 5)
    assert rows_of(spark, str(tmp_path / "whole-out")) == rows_of(spark, str(tmp_path / "cut-out")) == want
    assert resume.run_stage(records.limit(0), "n", stage, str(tmp_path / "no-out"), str(tmp_path / "no-c"), 4)["status"] == "completed"


def test_transactions(spark, tmp_path):
    schema = spark.createDataFrame([], "doc string, id int, v string").schema
    t = Table(spark, str(tmp_path / "t"), schema, ["doc", "id"], "doc")
    df = lambda *rows: spark.createDataFrame(rows, "doc string, id int, v string, at int")
    now = lambda v=None: sorted(map(tuple, t.read(v).collect()), key=repr)
    assert now() == [] and t.version() == 0
    with t.begin() as x:
        x.upsert(df(("a", 1, "old", 1), ("a", 1, "new", 2), ("a", 2, "x", 1), ("b", 1, "y", 1), (None, 1, "n", 1)), "at")
    first = [("a", 1, "new"), ("a", 2, "x"), ("b", 1, "y"), (None, 1, "n")]
    assert now() == sorted(first, key=repr) and t.version() == 1
    with pytest.raises(ZeroDivisionError), t.begin() as x:  # an error on the way
        x.upsert(df(("a", 1, "lost", 3)))
        raise ZeroDivisionError
    boom = F.udf(lambda v: 1 // 0 and v or v)
    with pytest.raises(Exception, match="ZeroDivisionError"), t.begin() as x:  # a write that fails
        x.upsert(df(("a", 1, "lost", 3)).withColumn("v", boom("v")))
    assert now() == sorted(first, key=repr) and t.version() == 1
    with t.begin() as x:
        x.replace_part("a", df(("a", 7, "seven", 1)))
        x.delete(df((None, 1, "", 0)).select("doc", "id"))
    assert now() == [("a", 7, "seven"), ("b", 1, "y")] and now(1) == sorted(first, key=repr)
    one, two = t.begin(), t.begin()
    one.upsert(df(("b", 1, "one", 1)))
    two.upsert(df(("b", 1, "two", 1)))
    assert one.commit() == 3
    with pytest.raises(Conflict):
        two.commit()
    with pytest.raises(RuntimeError, match="ended"):
        one.commit()
    assert now() == [("a", 7, "seven"), ("b", 1, "one")]
    with t.begin() as x:
        x.delete(t.read().select("doc", "id"))
    assert now() == [] and t.version() == 4 and t.begin().commit() == 4


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, f"2024-01-01 00:0{i % 3}:00", i) for i in range(21)], "k int, t string, v int").select("k", F.to_timestamp("t").alias("at"), "v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = deliver(stream, ["k"], "at", str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    read = lambda: Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()))
    before = read()
    assert sorted(k for k, *_ in before) == list(range(7))
    once(str(tmp_path / "out"))(spark.createDataFrame(list(before), rows.schema), 0)
    assert read() == before


def test_rejects(spark):
    def parse(text):
        if "endmodule" not in text:
            raise SyntaxError("module never ends")
        return [(w, len(w)) for w in text.split() if w.startswith("m")]

    files = [(f"f{i}", "module m1 m22 endmodule" if i else "module m1") for i in range(10)] + [("null", None), ("none", "endmodule")]
    rows, bad, counts = rejects.parsed(spark.createDataFrame(files, "path string, content string").repartition(3), parse, "name string, size int", F.lit("now"))
    assert Counter(map(tuple, rows.collect())) == Counter((f"f{i}", w, len(w)) for i in range(1, 10) for w in ("module", "m1", "m22"))
    assert {tuple(r) for r in bad.collect()} == {("f0", "now", "SyntaxError: module never ends"), ("null", "now", "ValueError: no content")}
    assert counts == {"files": 12, "parsed": 10, "rejected": 2, "rows": 27}
