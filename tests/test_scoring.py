import json

import pytest
from pyspark.sql import functions as F

from scorelake.model import SCORER_RESULTS
from scorelake.operators import checkers, external, scoring


def results(spark, rows):
    """rows: (data_index, pos, score, total, pass, success, star)."""
    full = [(i, p, f"m{p}", float(s), float(t), s / t if t else 0.0, 0.0, star, ok, good, f"r{p}", {}, 10 * p, 10 * p + 5, 5 + p) for i, p, s, t, ok, good, star in rows]
    return spark.createDataFrame(full, SCORER_RESULTS)


@pytest.mark.parametrize(
    ("name", "scores", "want"),
    [("sum", [-1, 2, 4], 5), ("avg", [-1, 2, 4], 3), ("min", [-1, 2, 4], -1), ("sum_rate", [-1, 2, 4], 1.25), ("avg_rate", [-1, 2, 4], 1.25 / 3), ("max_rate", [-1, 2, 4], 1), ("min_rate", [-1, 2, 4], -0.25), ("min", [1, 2, 4], 1), ("min_rate", [1, 2, 4], 0), ("min_rate_true", [1, 2, 4], 0.25), ("max", [1, 2, 4], 4)],
)
def test_strategies(spark, name, scores, want):
    r = results(spark, [(1, k, s, 4, True, True, False) for k, s in enumerate(scores)])
    assert scoring.final_score(r, name).first().score == pytest.approx(want)


@pytest.mark.parametrize(("flags", "prefix", "strict"), [([True, False], True, False), ([False, True], False, False), ([True, True], True, True)])
def test_success_fold(spark, flags, prefix, strict):
    r = results(spark, [(1, k, 1, 1, True, f, False) for k, f in enumerate(flags)])
    p, s = (scoring.verdicts(r, mode=m).first() for m in ("prefix", "strict"))
    assert (p.success, s.success) == (prefix, strict)
    if flags == [True, False]:
        assert (p.start_time, p.end_time, p.time_cost) == (0, 5, 5)
        assert (s.start_time, s.end_time, s.time_cost) == (0, 0, 0)


def test_star_scorer_vetoes_and_reasons_keep_their_order(spark):
    v = scoring.verdicts(results(spark, [(1, 1, 5, 1, True, True, False), (1, 0, 5, 1, False, True, True)]), "sum", 1).first()
    assert v.score == 10 and v["pass"] is False
    assert json.loads(v.reason) == [{"评估指标": "m0", "评估理由": "r0"}, {"评估指标": "m1", "评估理由": "r1"}]


def test_cases_without_results(spark):
    v = scoring.verdicts(results(spark, []), items=spark.range(2).withColumnRenamed("id", "data_index")).collect()
    assert [(r.score, r.success, r["pass"]) for r in v] == [(0.0, False, False)] * 2


def test_sum_and_star_over_a_run(spark):
    items = spark.range(102).withColumnRenamed("id", "data_index")
    s = [scoring.Scorer(F.lit(1.0)), scoring.Scorer(F.lit(1.0), star=True, threshold=1), scoring.Scorer(F.lit(0.0))]
    v = scoring.verdicts(scoring.score_items(items, s), "sum", 1)
    assert v.count() == 102 and v.where("score = 2 and pass and success").count() == 102


def test_failing_scorer(spark):
    items = spark.createDataFrame([(0, "query", "response")], "data_index bigint, query string, response string")
    s = [scoring.Scorer(F.lit(1.0)), scoring.vector_similarity(F.col("query"), F.col("response"), 0.5), scoring.Scorer(F.lit(7.0), error=F.lit("boom"))]
    r = scoring.score_items(items, s, "rate")
    rows = r.orderBy("scorer_pos").collect()
    assert [x.score for x in rows] == [1, 0, 0] and rows[2].reason == "Error: boom" and not rows[2].success and not rows[2]["pass"]
    v = scoring.verdicts(r, "max_rate", 1).first()
    assert (v.score, v["pass"], v.success) == (1.0, True, False)
    assert rows[1].reason == "相似度为0.0000，小于阈值0.5000"


def test_scorers_fuse_to_one_projection(spark):
    items = spark.range(10).withColumnRenamed("id", "data_index")
    plan = scoring.score_items(items, [scoring.Scorer(F.lit(1.0))] * 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("how", "want"), [("sum", 2.5), ("avg", 1.25), ("min", 0.5)])
def test_check_items(spark, how, want):
    items = [checkers.check_item("a", 1, weight=2), checkers.check_item("b", -1), checkers.check_item("c", 0.5)]
    assert one(spark, checkers.checker("k", items, how)["score"]) == want


def test_star_checker_veto(spark):
    star = checkers.checker("StarChecker", [checkers.check_item("s", 0, star=True, reason=F.lit("不通过")), checkers.check_item("n", 1)], star=True)
    m = checkers.merged([star, checkers.checker("NormalChecker", [checkers.check_item("n", 1)])])
    row = one(spark, m)
    assert (row.score, row.total, row.reason) == (0.0, 3.0, "StarChecker:不通过")
    r = scoring.score_items(spark.range(1).select(F.col("id").alias("data_index"), m.alias("m")), [scoring.Scorer(F.col("m.score"))], "rate")
    assert (r.first().score, r.first().total_score, r.first()["pass"]) == (0.0, 1.0, True)
    assert scoring.verdicts(r, "avg_rate", 0.5).first()["pass"] is False


def test_unsupported_star_checker(spark):
    c = [checkers.checker("a", [checkers.check_item("x", 1)], star=True, support=F.lit(False)), checkers.checker("b", [checkers.check_item("y", 1)])]
    assert one(spark, checkers.merged(c)["score"]) == 0
    assert one(spark, checkers.merged(c, skip_unsupported=True)["score"]) == 1


def test_unexecuted_items_and_validation(spark):
    a, b = one(spark, checkers.check_item("a", support=False, default=-1)), one(spark, checkers.check_item("b"))
    assert (a.score, a.reason, b.score, b.reason, b.executed) == (-1, "不支持检查", 0, "未执行检查", False)
    for bad in ({"name": " "}, {"name": "a", "total": 0}, {"name": "a", "method": "X"}):
        with pytest.raises(ValueError):
            checkers.check_item(**bad)


def test_long_form_agrees_with_arrays(spark):
    rows = [(1, "k", False, f"i{j}", s, 1.0, w, False, True, True, "RULE", "") for j, (s, w) in enumerate([(1.0, 2.0), (-1.0, 1.0), (0.5, 1.0)])]
    from scorelake.model import CHECK_ITEMS

    long = spark.createDataFrame(rows, CHECK_ITEMS)
    assert [checkers.long_item_scores(long, h).first().score for h in ("sum", "avg", "min")] == [2.5, 1.25, 0.5]


def test_llm_rounds_and_gsb(spark):
    assert one(spark, checkers.llm_rounds(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))) == 0.25
    assert one(spark, external.gsb_score(F.lit('{"accuracy":5,"relevance":4,"completeness":3,"fluency":4}'))) == 0.8
    r = one(spark, external.parsed_reply(F.lit('x ```json\n{"score": "0.8", "reason": "ok"}\n```')))
    assert (r.score, r.reason) == (0.8, "ok")
    assert one(spark, external.parsed_reply(F.lit("no json"))).score is None
