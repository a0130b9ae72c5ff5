import enum
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.functions import calendar, text, values
from scorelake.operators import counting, external, rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("offset", "limit", "want"), [(3, 4, [3, 4, 5, 6]), (3, -1, [*range(10)]), (3, 0, []), (20, 5, [])])
def test_slice(spark, offset, limit, want):
    assert sorted(r.id for r in rows.sliced(spark.range(10), ["id"], offset, limit).collect()) == want


def test_reindex_is_dense_and_ordered_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", (F.col("id") * 37) % 1000)
    out = sorted((r.data_index, r.k) for r in rows.reindexed(df, ["k"]).collect())
    assert out == [(i, i) for i in range(1000)]
    assert rows.reindexed(spark.range(0), ["id"]).count() == 0


def test_filter_counts_null_as_false(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, ok boolean")
    assert [r.id for r in rows.filter_all(df, [F.col("ok")]).collect()] == [2]


def test_shuffle_depends_on_the_seed_only(spark):
    order = lambda s, n: [r.id for r in rows.shuffled(spark.range(0, 50, 1, n), s).orderBy("order_key").collect()]
    assert order(1, 2) == order(1, 7) != order(2, 2)


def test_wrap_keeps_fields_that_fail(spark):
    df = spark.createDataFrame([(0, {"a": "x", "b": "y"})], "data_index bigint, input_item map<string,string>")
    out = rows.wrapped(rows.wrapped(df, ["a", "missing"], F.upper), ["b"], lambda c: F.lit(None).cast("string"))
    assert out.first().input_item == {"a": "X", "b": "y"}


def test_injected_index_must_be_a_number(spark):
    df = spark.createDataFrame([({"dataIndex": "x"},)], "input_item map<string,string>")
    with pytest.raises(Exception, match="data index"):
        rows.injected(df).collect()


def test_percentiles_and_deviation(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "x")
    got = df.agg(*(values.nearest_rank("x", p).alias(f"p{p}") for p in (50, 60, 70, 80, 90, 95, 99))).first()
    assert [*got] == [5, 6, 7, 8, 9, 10, 10]
    dev = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x double").agg(F.stddev_pop("x")).first()[0]
    assert dev == pytest.approx(2.0)


def test_basic_count_of_nothing(spark):
    df = spark.createDataFrame([], "api_success boolean, api_time_cost bigint, eval_success boolean, eval_time_cost bigint, score double, pass boolean")
    assert set(counting.basic_count(df).first().asDict().values()) == {0}


def test_attributes(spark):
    replies = spark.createDataFrame([(0, "慢#错"), (1, "慢"), (2, "")], "data_index bigint, reply string")
    synonyms = counting.synonym_table(spark, '{"延迟":["慢"],"错误":["错"]}')
    found = counting.issues(replies)
    strict = {r.issue_name: r.case_ids for r in counting.attribute_index(counting.normalized_issues(found, synonyms)).collect()}
    loose = {r.issue_name: r.case_ids for r in counting.attribute_index(counting.normalized_issues(found, synonyms, "keep_unmapped")).collect()}
    assert strict == {"延迟": [0, 1], "错误": [0]} and loose == strict | {"未知问题": [2]}
    assert counting.attribute_index(counting.normalized_issues(found, counting.synonym_table(spark, "nonsense"))).count() == 0


def test_text_functions(spark):
    assert one(spark, text.token_count(F.lit("你好ab"))) == 3
    assert one(spark, text.markdown_json(F.lit('x ```json {"score":1} ``` y'))) == '{"score":1}'
    assert one(spark, text.markdown_json(F.lit('{"score":1}'))) == '{"score":1}'
    assert one(spark, text.uuid3(F.lit("hello"))) == str(_uuid3(b"hello"))
    assert one(spark, text.from_hex(text.to_hex(F.lit("aé")))).decode() == "aé"
    with pytest.raises(Exception, match="hex"):
        one(spark, text.from_hex(F.lit("abc")))
    assert len(one(spark, text.nano_id(9))) == 9
    events = one(spark, text.sse_events(F.lit("event: a\ndata: 1\ndata: 2\n\ndata: x\n\n")))
    assert [(e.event, e.data) for e in events] == [("a", "1\n2"), (None, "x")]
    assert one(spark, text.tokens(F.lit("Hello 你好 World_1"))) == ["hello", "你", "好", "world_1"]


def _uuid3(name: bytes) -> uuid.UUID:
    import hashlib

    return uuid.UUID(bytes=hashlib.md5(name).digest(), version=3)


def test_cosine_of_empty_texts(spark):
    assert one(spark, text.tf_cosine(F.lit(""), F.lit("a"))) is None
    assert one(spark, text.similar_enough(text.tf_cosine(F.lit(""), F.lit("a")), 0.0)) == 0
    assert one(spark, text.tf_cosine(F.lit("a b b"), F.lit("b b a"))) == pytest.approx(1)


def test_cosine_against_counting(spark):
    from collections import Counter
    from math import sqrt

    pairs = [("a b a", "a c"), ("x", "y"), ("你 好 好", "好 a"), ("t " * 50, "t u")]
    df = spark.createDataFrame(pairs, "a string, b string").select(text.tf_cosine(F.col("a"), F.col("b")).alias("s"))
    for (a, b), r in zip(pairs, df.collect(), strict=True):
        x, y = Counter(a.split()), Counter(b.split())
        assert r.s == pytest.approx(sum(x[t] * y[t] for t in x) / sqrt(sum(v * v for v in x.values())) / sqrt(sum(v * v for v in y.values())))


def test_json_path_and_maps(spark):
    doc = '{"store":{"book":[{"title":"Book A","price":10},{"title":"Book B","price":20}]}}'
    assert one(spark, values.json_at(F.lit(doc), "$.store.book[0].price")) == "10"
    assert one(spark, values.json_at(F.lit(doc), "$.store.book[1].title")) == "Book B"
    assert one(spark, values.map_flatten(F.lit('{"alibaba":{"admin":{"age":20},"list":[1]}}'), "#")) == {"alibaba#admin#age": "20", "alibaba#list#0": "1"}


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1), st.dictionaries(st.text("xyz", min_size=1), st.integers(), min_size=1), min_size=1))
def test_flatten_and_back(value):
    assert values.nested(values.flat(value, "_"), "_") == value


class Color(enum.Enum):
    RED = 1


def test_enum_dates_conversions(spark):
    assert values.by_code(Color, 1) is Color.RED and values.by_code(Color, 2) is None
    assert values.is_date_pattern("yyyy-MM-dd'T'HH:mm:ss") and not values.is_date_pattern("yyyy-bb") and not values.is_date_pattern("'")
    assert one(spark, values.to_long(F.lit(" 12 "))) == 12 and one(spark, values.to_boolean(F.lit(" TRUE "))) is True
    with pytest.raises(Exception):
        one(spark, values.to_long(F.lit("x")))


def test_calendar():
    new_years = {2020: (1, 25), 2023: (1, 22), 2024: (2, 10), 2025: (1, 29), 2026: (2, 17), 2033: (1, 31), 2034: (2, 19)}
    for y, (m, d) in new_years.items():
        assert (calendar.months(y)[1].month, calendar.months(y)[1].day) == (m, d)
    by_name = {n: (d.month, d.day) for d, n, k in calendar.holidays(2024) if k == "chinese"}
    assert by_name["中秋节"] == (9, 17) and by_name["端午节"] == (6, 10)
    assert (calendar.term(2024, 23).day, calendar.term(2025, 6).day) == (21, 4)


class Flaky:
    def __init__(self):
        self.n = 0

    def __call__(self, prompt):
        self.n += 1
        if self.n < 3:
            raise RuntimeError("busy")
        return f"re {prompt}"


def test_llm_retries(spark):
    prompts = spark.createDataFrame([(1, "a")], "data_index bigint, prompt string")
    r = external.llm(prompts, Flaky, "m", retries=6, wait=0).first()
    assert (r.reply, r.attempts, r.error) == ("re a", 3, None)
    r = external.llm(prompts, Flaky, "m", retries=2, wait=0).first()
    assert (r.reply, r.attempts, r.error) == (None, 2, "busy")


def test_model_registry():
    external.register_model("flaky", Flaky)
    assert isinstance(external.chat_model("flaky"), Flaky)
    with pytest.raises(ValueError):
        external.chat_model("none")
