"""Mock rules as column expressions."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from scorelake.operators import mock

NOW = datetime(2024, 5, 6, 7, 8, 9)


def engine():
    return mock.Engine([mock.DateMocker(NOW), mock.HolidayMocker(date(2024, 5, 6)), mock.AddressMocker(), mock.PlaceMocker()])


RULES = [
    "date", "date yyyy/MM/dd", "future_date 2 4 yyyyMMdd", "past_date 3", "FUTURE_DATE 1 1", "holiday", "future_local_holiday 20241231", "between_holiday 20240101 20241231", "solr_term_holiday", "province", "city 广东省",
    "area 内蒙古", "street 北京市 北京市", "scenic 北京市 北京市", "scenic", "nothing at all", "", "old_date", "city nowhere",
]


def test_choices_are_the_values_of_the_row_wise_rules(spark):
    draws = [mock.Random(k) for k in range(400)]
    for rule in RULES:
        seen = {engine().value(rule, draw) for draw in draws}
        names = mock.choices(rule, engine())
        assert seen <= {*names, *([] if names else [""])} and (len(names) > 40 or seen == set(names) or not names)
    assert mock.choices("future_date 0 99999", engine()) is None
    for bad in ("date 1 2 3 4", "future_date 1.5", "future_date 5 2"):
        with pytest.raises(ValueError):
            mock.choices(bad, engine())


def test_known_rules_are_replaced_without_python(spark):
    df = spark.range(600).withColumn("text", F.concat(F.lit("a {{ city 广东省 }}, {{scenic 北京市 北京市}}{{nothing}} {{ }}{{unlisted}} "), F.col("id"), F.lit(" {{past_date 3}}")))
    made = lambda seed: df.select("id", mock.mock_known(F.col("text"), F.col("id"), RULES, seed, engine).alias("t"))
    assert "Python" not in made(1)._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.t for r in made(1).collect()}
    parts = [re.fullmatch(r"a (\S+), (\S+)  (\d+) (.{19})", t) for t in got.values()]
    assert [int(m[3]) for m in parts] == [*got]
    assert [{m[k] for m in parts} for k in (1, 2, 4)] == [set(mock.choices(r, engine())) for r in ("city 广东省", "scenic 北京市 北京市", "past_date 3")]
    assert got == {r.id: r.t for r in made(1).collect()} != {r.id: r.t for r in made(2).collect()}
    assert spark.range(1).select(mock.mock_known(F.lit(None).cast("string"), F.lit(1), []), mock.mock_known(F.lit("{{x"), F.lit(1), [])).first() == (None, "{{x")
    with pytest.raises(ValueError):
        mock.mock_known(F.col("t"), F.col("id"), ["future_date 0 99999"])


def test_mocked_in_columns(spark):
    rows = [(1, {"q": "{{city 广东省}} {{city 广东省}} {{city 广东省}}", "other": "{{city 广东省}}", "free": "{{city 广东省}}"}), (2, {"q": "{{date 1 2 3 4}} {{city 广东省}}", "other": "{{city 广东省}}"}), (3, {"q": "plain"}), (4, None), (5, {"q": None, "other": ""})]
    df = spark.createDataFrame(rows, "data_index bigint, input_item map<string,string>")
    cities = set(mock.choices("city 广东省", engine()))
    got = {r.data_index: r.input_item for r in mock.mocked_in_columns(df, ["q", "other"], 1, engine).collect()}
    assert set(got[1]["q"].split(" ")) <= cities and got[1]["other"] in cities and got[1]["free"] == "{{city 广东省}}"
    assert {k: got[k] for k in (2, 3, 4, 5)} == {k: v for k, v in rows if k > 1}
    same = {r.data_index: r.input_item for r in mock.mocked_in_columns(df, ["q", "other"], 1, engine, same=True).collect()}
    assert len({*same[1]["q"].split(" "), same[1]["other"]}) == 1
    # rules of a custom mocker go row by row

    class Twice:
        def support(self, rule, args):
            return rule == "twice"

        def mock(self, rule, args, draw):
            return str(2 * int(args[0]))

    custom = lambda: mock.Engine([Twice()])
    df = spark.createDataFrame([(1, {"q": "{{twice 4}}"})], "data_index bigint, input_item map<string,string>")
    assert mock.mocked_in_columns(df, ["q"], 0, custom).first().input_item == {"q": "8"}
    assert mock.rules_in(df, ["q"]) == ["twice 4"] and mock.rules_in(df, ["q"], 0) is None
