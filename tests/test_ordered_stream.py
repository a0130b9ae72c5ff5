"""Cases of a key that a queue brings out of order."""

import time

import pytest

from scorelake.streaming import ordered


@pytest.fixture
def state(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, path, rows):
    spark.createDataFrame(rows, "k string, n bigint, data map<string,string>").coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files are read by their times


def stream(spark, tmp_path, wait, seen):
    cases = spark.readStream.schema("k string, n bigint, data map<string,string>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "queue"))
    out = ordered.in_order(cases, "k", "n", 1, wait)
    write = lambda b, _: seen.append(sorted((r.k, r.n, r["__late"], r.data) for r in b.collect()))
    return out.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint"))


@pytest.fixture
def data_only(spark):
    """Streams end with their data: else timers keep them alive for ever."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_three_batches_out_of_order(spark, tmp_path, state, data_only):
    d = {"q": "naïve \"x\"", "none": None}
    path = str(tmp_path / "queue")
    put(spark, path, [("a", 3, d), ("b", 1, d), ("a", 4, d)])
    put(spark, path, [("a", 1, d), ("b", 3, d), ("a", 6, None)])
    put(spark, path, [("a", 2, d), ("b", 2, d), ("b", 2, d), ("c", 9, d)])
    seen = []
    q = stream(spark, tmp_path, 3600, seen).trigger(availableNow=True).start()
    assert q.awaitTermination(90), q.lastProgress
    batches = [[x[:3] for x in b] for b in seen if b]
    assert batches == [[("b", 1, False)], [("a", 1, False)], [("a", 2, False), ("a", 3, False), ("a", 4, False), ("b", 2, False), ("b", 2, False), ("b", 3, False)]]
    assert all(x[3] == d for b in seen for x in b)
    # the state outlives the query; what has gone by is late
    put(spark, path, [("a", 5, d), ("b", 1, d)])
    seen.clear()
    stream(spark, tmp_path, 3600, seen).trigger(availableNow=True).start().awaitTermination(90)
    assert [x[:3] for b in seen for x in b] == [("a", 5, False), ("a", 6, False), ("b", 1, True)]


def test_what_is_missing_is_waited_for_so_long_only(spark, tmp_path, state):
    put(spark, str(tmp_path / "queue"), [("a", 4, None), ("a", 2, None), ("a", 7, None)])
    seen = []
    q = stream(spark, tmp_path, 1, seen).trigger(processingTime="1 second").start()
    end = time.monotonic() + 60
    while not any(seen) and time.monotonic() < end:
        time.sleep(0.3)
    q.stop()
    assert [x[:3] for b in seen for x in b] == [("a", 2, False), ("a", 4, False), ("a", 7, False)]
