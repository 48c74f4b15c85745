import datetime
import random
import time

from pyspark.sql import functions as F

from answerlens.operators import conversations as C
from answerlens.plans.fixtures import Views
from answerlens.streaming import jobs

SF = "/root/testdata/sf0.001"


def files(spark, df, path, parts=3):
    """The rows in file order, one file per micro-batch."""
    df.repartitionByRange(parts, "created_at").sortWithinPartitions("created_at").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(path)


def shuffled(spark, df, at, path, last, parts=4, late=3000):
    """The rows in micro-batches whose times overlap by up to ``late`` seconds, and rows (``last``) that move the watermark on."""
    x = df.withColumn("o", F.unix_timestamp(F.col(at).cast("timestamp")) + F.pmod(F.xxhash64(*df.columns), F.lit(late)))
    cuts = x.approxQuantile("o", [i / parts for i in range(1, parts)], 0.0)
    group = sum(((F.col("o") > c).cast("int") for c in cuts), F.lit(0))
    for i in range(parts):
        x.filter(group == i).drop("o").orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read by their time
    for row in last:
        spark.createDataFrame([row], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_outcomes_equal_batch_whatever_order_batches_bring(spark, tmp_path):
    m = Views(spark, SF).messages.select("id", "session_id", "seq", "role", "content_text", "created_at").cache()
    far = [(10**9 + i, 10**9, i, "user", "x", datetime.datetime(2031 + i, 1, 1)) for i in range(2)]
    stream = jobs.stream_outcomes(shuffled(spark, m, "created_at", str(tmp_path / "in"), far))
    rows = jobs.run_available(stream, "outcomes", str(tmp_path)).collect()
    got = {(r.id, r.follow_up_type, r.was_rephrased, r.changed_topic) for r in rows if r.follow_up_type != "none"}
    assert got == {tuple(r) for r in C.outcomes(m).collect()} and got and len(rows) == len({r.id for r in rows})
    last = m.groupBy("session_id").agg(F.max(F.struct("seq", "role", "id")).alias("x")).filter("x.role = 'assistant'").select("x.id")
    assert {r.id for r in rows if r.follow_up_type == "none"} == {r.id for r in last.collect()}
    left = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/outcomes/state")
    assert left.count() <= 1  # of the far session at most


def test_windows_equal_batch(spark, tmp_path):
    logs = Views(spark, SF).retrieval_logs.cache()
    got = jobs.run_available(jobs.stream_windows(files(spark, logs, str(tmp_path / "in"))), "windows", str(tmp_path)).collect()
    want = {r.d: (r.n, r.low) for r in logs.groupBy(F.to_date("created_at").alias("d")).agg(F.count("*").alias("n"), F.count_if("is_low_confidence").alias("low")).collect()}
    assert got and all(want[r.start.date()] == (r.n, r.low) for r in got)
    assert len(got) >= len(want) - 1  # the last window stays open


def test_sessions(spark, tmp_path):
    logs = Views(spark, SF).retrieval_logs
    got = jobs.run_available(jobs.stream_sessions(files(spark, logs, str(tmp_path / "in"))), "sessions", str(tmp_path)).collect()
    assert got and all(r.n >= 1 and r.start < r.end for r in got)


def test_lockouts_equal_batch_whatever_order_batches_bring(spark, tmp_path):
    rng = random.Random(1)
    rows = [(u, i, 1e6 + i * 20 + u, rng.random() < 0.08) for u in range(6) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, seq long, at double, ok boolean")
    far = [(99, i, 1e9 + i * 1e8, True) for i in range(2)]
    got = jobs.run_available(jobs.stream_lockouts(shuffled(spark, df, "at", str(tmp_path / "in"), far, late=1500)), "locks", str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in jobs.batch_lockouts(df).collect()) and got
    assert spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/locks/state").count() <= 1


def test_lockout_rules(spark):
    schema = "user_id long, seq long, at double, ok boolean"
    one = spark.createDataFrame([(1, i, float(i), False) for i in range(8)] + [(1, 8, 10.0, True), (1, 9, 1000.0, False)], schema)
    assert [tuple(r)[1:] for r in jobs.batch_lockouts(one).orderBy("seq").collect()] == [(7, "locked"), (8, "blocked"), (9, "locked")]
    away = spark.createDataFrame([(1, i, float(i), False) for i in range(7)] + [(1, 8, 10_000.0, False)], schema)
    assert jobs.batch_lockouts(away, idle_minutes=60).count() == 0 and jobs.batch_lockouts(away).count() == 1


def test_log_hit_join(spark, tmp_path):
    v = Views(spark, SF)
    logs = v.retrieval_logs.select("id", "message_id", "created_at")
    twice = logs.unionByName(logs)
    hits = v.retrieval_chunk_hits.join(logs.select(F.col("id").alias("retrieval_log_id"), F.col("created_at").alias("hit_at")), "retrieval_log_id")
    twice.coalesce(1).write.parquet(str(tmp_path / "logs"))
    hits.coalesce(1).write.parquet(str(tmp_path / "hits"))
    s = jobs.stream_log_hits(spark.readStream.schema(twice.schema).parquet(str(tmp_path / "logs")), spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits")))
    assert jobs.run_available(s, "join", str(tmp_path)).count() == hits.count()


def test_judge():
    assert jobs.judge("gradient descent steps", "please a simpler gradient", None) == ("simpler", False, False)
    assert jobs.judge("gradient descent steps", "gradient descent steps", None)[0] == "rephrase"
