"""Ranks and pages of whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import counting, ranks, rows


@pytest.mark.parametrize("values", [list(range(50)), [7] * 30, [-(1 << 63), (1 << 63) - 1, 0, -1, None, None, 5], [k * k * (-1) ** k for k in range(300)], [1 << 62, -(1 << 62)] * 9])
def test_places_are_those_of_a_sort(spark, values, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKETS", 4)
    df = spark.createDataFrame([(v,) for v in values], "k bigint").repartition(3)
    keys = ranks.whole_keys(df, ["k"])
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    for rank in {0, 1, len(values) // 2, len(values) - 1}:
        found = ranks.place(df, keys, rank)
        v = order[rank]
        assert found.keys == (v is not None, v or 0) and found.ties == order.count(v) and found.before == rank - order.index(v)
    assert ranks.place(df, keys, len(values)) is None and ranks.place(df.limit(0), keys, 0) is None


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(rows, "SMALL_PAGE", 0)
    monkeypatch.setattr(ranks, "BUCKETS", 8)


@pytest.mark.parametrize("order", [["a"], ["a", "b"], ["d", "a"], ["t"], ["s", "a"], ["f"]])
def test_pages_part_the_rows(spark, small, order):
    """All pages together have each row once, in the order of a sort, whatever the columns and ties."""
    draw = random.Random(4)
    data = [(k, draw.choice([None, *range(5)]), draw.randint(-50, 50)) for k in range(120)]
    df = spark.createDataFrame(data, "id bigint, a int, b bigint").selectExpr("*", "date_add(date'2020-01-01', a) as d", "timestamp_micros(b * 1000001) as t", "repeat('x', a) as s", "b / 7.0D as f", "id as place").repartition(4)
    df = rows.pinned(df)
    want = [tuple(r) for r in df.select(*order).orderBy(*order).collect()]
    seen = []
    for offset in range(0, 140, 35):
        page = rows.sliced(df, order, offset, 35)
        assert page.columns == df.columns
        got = page.collect()
        assert len(got) == len(want[offset : offset + 35])
        assert sorted(map(str, (tuple(r[c] for c in order) for r in got))) == sorted(map(str, want[offset : offset + 35]))
        seen += [r.id for r in got]
    assert sorted(seen) == list(range(120))


def test_large_pages_stay_in_several_partitions(spark):
    df = spark.range(0, 3_000_000, 1, 6).select(((F.col("id") * 7_919) % 3_000_000).alias("k"), "id")
    page = rows.sliced(df, ["k"], 1_000, 2_500_000)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan
    sizes = [r["count"] for r in page.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and sum(sizes) == 2_500_000 and page.agg(F.min("k"), F.max("k")).first() == (1_000, 2_500_999)


def test_equal_rows(spark, small):
    df = spark.createDataFrame([(1,)] * 40, "k int")
    assert rows.sliced(df, ["k"], 10, 15).count() == 15 and rows.sliced(df, ["k"], 30, 15).count() == 10 and rows.sliced(df, ["k"], 40, 5).count() == 0


def brute_percentiles(data, percents):
    out = {}
    for key in {r[0] for r in data}:
        x = sorted(v for k, v, ok in data if k == key and ok and v is not None)
        out[key] = tuple(x[max(0, -(-len(x) * p // 100) - 1)] if x else None for p in percents)
    return out


@pytest.mark.parametrize("held, accuracy", [(10_000, 10_000), (0, 100), (5, 20)])
def test_percentiles_against_sorting(spark, monkeypatch, held, accuracy):
    """Few values held and coarse sketches make many rounds; ties, extremes, a null key, and groups without values."""
    monkeypatch.setattr(ranks, "HELD", held)
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    monkeypatch.setattr(ranks, "CUTS", 8)
    draw = random.Random(6)
    shapes = {"ties": lambda: draw.choice([1.0, 1.0, 1.0, 2.5]), "wide": lambda: draw.choice([-1, 1]) * 10.0 ** draw.randint(-300, 300), None: lambda: draw.random(), "one": lambda: 7.0, "skew": lambda: 5.0 if draw.random() < 0.9 else draw.random()}
    data = [(k, f(), draw.random() < 0.9) for k, f in shapes.items() for _ in range(150)] + [("none", 1.0, False), ("nulls", None, True)]
    df = spark.createDataFrame(data, "k string, v double, ok boolean").repartition(4)
    percents = (1, 50, 60, 90, 99, 100)
    got = {r.k: tuple(r[f"tp{p}_v"] for p in percents) for r in ranks.percentiles(df, ["k"], {"v": ("v", "ok"), "twice": ("cast(v as float)", "true")}, percents).collect()}
    assert got == brute_percentiles(data, percents)


def test_percentiles_of_all_rows_and_of_none(spark):
    df = spark.range(100_000).selectExpr("id * 3 as x")
    assert ranks.percentiles(df, [], {"x": ("x", "x > 2")}, (50, 99)).first() == (150_000, 297_000)
    assert ranks.percentiles(df.limit(0), [], {"x": ("x", "true")}, (50,)).count() == 0
    assert ranks.percentiles(df.limit(0).withColumn("g", F.lit("a")), ["g"], {"x": ("x", "true")}, (50,)).count() == 0


def test_counts_by_cube_have_exact_percentiles(spark):
    draw = random.Random(2)
    data = [(draw.choice("ab"), draw.choice([None, 1]), draw.random() < 0.8, draw.randint(0, 50), draw.random() < 0.8, draw.randint(0, 9), draw.random(), draw.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, h int, api_success boolean, api_time_cost bigint, eval_success boolean, eval_time_cost bigint, score double, pass boolean")
    rows_ = counting.count_by(df, "g", "h", cube=True).collect()
    assert len(rows_) == 9
    want = df.cube("g", "h").agg(*(c.alias(k) for k, c in counting.basic_metrics().items()))
    assert sorted(map(str, rows_)) == sorted(map(str, want.collect()))
    assert counting.basic_count(df).first() == df.agg(*(c.alias(k) for k, c in counting.basic_metrics().items())).first()


def test_frequent_issues_of_many_names(spark):
    """Few tracked names, many rare ones: the frequent ones are found, with counts inside the stated bound."""
    often = {f"often{k}": 3000 - 200 * k for k in range(8)}
    rows_ = spark.createDataFrame([(n, c) for n, c in often.items()], "issue string, c int").select("issue", F.explode(F.sequence(F.lit(1), "c")).alias("data_index"))
    rare = spark.range(20_000).select(F.concat(F.lit("rare"), "id").alias("issue"), "id")
    found = rows_.union(rare).repartition(5, "data_index")
    got = counting.frequent_issues(found, 8, 1000).collect()
    assert {r.issue_name for r in got} == set(often)
    assert all(0 <= r.case_count - often[r.issue_name] <= r.error for r in got) and got[0].error < 200
    few = counting.frequent_issues(rows_.select("issue", "data_index"), 20)
    assert [(r.issue_name, r.case_count, r.error) for r in few.collect()] == sorted(((n, c, 0) for n, c in often.items()), key=lambda x: -x[1])
    assert counting.frequent_issues(found.limit(0)).count() == 0
    prompt = counting.synonym_prompt(rows_.select("issue", "data_index"), "group", 3)
    assert prompt.splitlines()[-3:] == ["often0", "often1", "often2"]
