"""Counts that merge, and delta runs whose reports are made of them."""

import random

import pytest
from pyspark.sql import functions as F

from scorelake.model import RunConfig
from scorelake.operators import counting
from scorelake.streaming import delta

SCHEMA = "g string, api_success boolean, api_time_cost bigint, eval_success boolean, eval_time_cost bigint, score double, pass boolean, part int"


def made(spark, n, seed=3):
    draw = random.Random(seed)
    some = lambda f: None if draw.random() < 0.1 else f()
    rows = [(some(lambda: draw.choice("ab")), some(lambda: draw.random() < 0.8), draw.randint(0, 500), some(lambda: draw.random() < 0.7), draw.randint(0, 9), round(draw.uniform(-5, 100), 4), draw.random() < 0.5, draw.randint(0, 6)) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def near(a, b):
    return a == pytest.approx(b, abs=1e-6) if isinstance(b, float) else a == b


@pytest.mark.parametrize("dims", [(), ("g",)])
def test_merged_parts_equal_all_at_once(spark, dims):
    df = made(spark, 900)
    merged = {tuple(r[d] for d in dims): r.asDict() for r in counting.merged_counts(counting.partial_counts(df, "part", *dims), *dims).collect()}
    whole = {tuple(r[d] for d in dims): r.asDict() for r in df.groupBy(*dims).agg(*(c.alias(k) for k, c in counting.basic_metrics().items())).collect()}
    assert merged.keys() == whole.keys()
    for key, row in whole.items():
        assert merged[key].keys() == row.keys()
        for name, value in row.items():
            assert near(merged[key][name], value), (key, name)


def test_counts_of_nothing(spark):
    empty = made(spark, 1).limit(0)
    assert set(counting.merged_counts(counting.partial_counts(empty)).first().asDict().values()) == {0}
    none = made(spark, 5).withColumn("eval_success", F.lit(False)).withColumn("api_success", F.lit(None).cast("boolean"))
    merged, whole = counting.merged_counts(counting.partial_counts(none)).first(), none.agg(*(c.alias(k) for k, c in counting.basic_metrics().items())).first()
    assert merged.asDict() == pytest.approx(whole.asDict())


def test_sketches_of_many_values_are_near(spark):
    df = spark.range(200_000).selectExpr("'a' as g", "true as api_success", "(id * 7919) % 200000 as api_time_cost", "true as eval_success", "1L as eval_time_cost", "cast((id * 104729) % 200000 as double) as score", "true as pass", "cast(id % 13 as int) as part")
    row = counting.merged_counts(counting.partial_counts(df, "part")).first()
    assert all(abs(row[f"tp{p}_{x}"] - 2000 * p) < 0.005 * 200_000 for p in counting.PERCENTILES for x in ("api_time", "score"))


def test_reports_of_a_delta_run_are_merged(spark, tmp_path):
    items = made(spark, 230).withColumn("data_index", F.monotonically_increasing_id() % 1_000_000)
    items = items.unionByName(items.limit(20))
    seen, state = [], {"fail": True, "batches": 0, "rows": []}

    def evaluate(batch):
        state["batches"] += 1
        state["rows"].append(batch.count())
        if state["fail"] and state["batches"] == 3:
            raise RuntimeError("lost")
        return batch

    def run():
        return delta.DeltaRun(spark, str(tmp_path), evaluate, RunConfig(task_name="t", batch_size=20, thread_num=2), report=lambda df: seen.append(df.first()), partial=counting.partial_counts, merge=counting.merged_counts)

    first = run()
    first.load(items)
    with pytest.raises(Exception, match="lost"):
        first.run()
    state["fail"] = False
    out = run().run()
    whole = out.agg(*(c.alias(k) for k, c in counting.basic_metrics().items())).first().asDict()
    assert out.count() == 230 == whole["total_count"] and all(near(seen[-1][k], v) for k, v in whole.items())
    assert seen[0].total_count < 230 and max(state["rows"]) <= 40
    # a report reads a row for each batch
    assert spark.read.parquet(first.state).count() == len({p for p in (tmp_path / "t" / "state").iterdir() if p.name.startswith("batch_id")})
    with pytest.raises(ValueError):
        delta.DeltaRun(spark, str(tmp_path), evaluate, partial=counting.partial_counts)


def test_files_of_a_queue_have_no_more_cases_than_asked_for(spark, tmp_path, monkeypatch):
    """Also where there are many more files than tasks, and keys stay together in order."""
    monkeypatch.setattr(delta, "TASKS", 3)
    items = spark.range(500).select(F.col("id").alias("data_index"), (F.col("id") % 40).alias("k"), (-F.col("id")).alias("r"))
    plain = delta.DeltaRun(spark, str(tmp_path), lambda b: b, RunConfig(task_name="plain", batch_size=7))
    plain.load(items)
    sizes = [r.n for r in spark.read.parquet(plain.queue).select(F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 500 and max(sizes) <= 7 and len(sizes) >= 500 // 7
    keyed = delta.DeltaRun(spark, str(tmp_path), lambda b: b.withColumn("nth", F.monotonically_increasing_id()), RunConfig(task_name="keyed", batch_size=25, thread_num=4), key=F.col("k"), order=[F.col("r")])
    keyed.load(items)
    files = spark.read.parquet(keyed.queue).select("k", F.input_file_name().alias("f")).groupBy("k").agg(F.count_distinct("f").alias("n")).collect()
    assert {r.n for r in files} == {1} and len(files) == 40
    out = keyed.run()
    assert out.count() == 500 and "__file" not in out.columns
    by_key = {}
    for r in out.orderBy("nth").collect():
        by_key.setdefault(r.k, []).append(r.r)
    assert all(v == sorted(v) for v in by_key.values())
