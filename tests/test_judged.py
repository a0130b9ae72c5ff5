import json

import pytest
from pyspark.sql import functions as F

from scorelake.operators import checkers, external, judged


class Judge:
    def __call__(self, prompt):
        text = prompt.split(external.INPUT_MARK)[1]
        if text == "bad":
            raise RuntimeError("busy")
        return "nothing" if text == "odd" else f'```json\n{{"score": "{len(text)}", "reason": "r {text}"}}\n```'


class Marks:
    def __call__(self, prompt):
        return '{"accuracy": 5, "relevance": 4, "completeness": 3, "fluency": 4}'


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, "good"), (1, "bad"), (2, "odd")], "data_index bigint, q string").withColumn("input_item", F.create_map(F.lit("q"), F.col("q")))


def test_prompt_scorer(items):
    rows = judged.prompt_scorer(items, external.prompt("judge", F.col("q")), Judge, retries=2, wait=0, metric="m", threshold=3).orderBy("data_index").collect()
    assert [(r.score, r.success, r["pass"], r.reason) for r in rows] == [(4.0, True, True, "r good"), (0.0, False, False, "Error: busy"), (0.0, False, False, "Error: the reply has no score")]
    assert rows[0].extra["prompt"].startswith("judge\n") and "score" in rows[0].extra["llmReply"]


def test_presets(items):
    assert judged.preset_scorer("gsb", items, [F.col("q"), F.col("q")], Marks).first().score == 0.8
    r = judged.preset_scorer("security", items.limit(1), [F.col("q")], Judge).first()
    assert (r.metric, r.score) == ("security", 4.0)


def test_next_queries(spark):
    df = spark.createDataFrame([(0, "1: hi\n"), (1, "bad")], "data_index bigint, c string")
    rows = judged.next_queries(df, F.col("c"), lambda: lambda p: " and then? " if p.endswith("hi\n") else " ", retries=2, wait=0).orderBy("data_index").collect()
    assert [r["query"] for r in rows] == ["and then?", None]


class Flow:
    def __call__(self, index, item):
        return {"mark": str(len(item["q"]))} if index else None


def test_workflow_and_python_scorers(items):
    rows = judged.workflow_scorer(items, Flow, lambda m: m["mark"].cast("double"), metric="w").orderBy("data_index").collect()
    assert [(r.score, r.success) for r in rows] == [(0.0, False), (3.0, True), (3.0, True)]
    rows = judged.python_scorer(items, ["q"], {"a": lambda r: (len(r["q"]), "n"), "b": lambda r: (1 / (len(r["q"]) - 3), "")}).orderBy("data_index", "scorer_pos").collect()
    assert [(r.metric, r.score, r.success) for r in rows] == [("a", 4, True), ("b", 1, True), ("a", 3, True), ("b", 0, False), ("a", 3, True), ("b", 0, False)]


def test_model_based_checkers(spark):
    replies = [json.dumps({"x": {"score": s, "reason": f"r{k}"}, "y": {"score": 1, "reason": ""}}) for k, s in enumerate((1, 0, 0))]
    df = spark.createDataFrame([(replies,)], "replies array<string>")
    c = checkers.checker("k", judged.checked_in_rounds(F.col("replies"), ["x", "y", "z"]), "sum")
    r = df.select(c.alias("c")).first().c
    assert [(i.score, i.reason) for i in r["items"]] == [(0.25, "r0 | r1 | r2"), (1.0, ""), (0.0, "未执行检查")] and r.score == 1.25
    one = df.select(F.array(*judged.checked_items(F.col("replies")[0], ["x"], weights=[2.0])).alias("i")).first().i[0]
    assert (one.score, one.weight, one.check_method) == (1.0, 2.0, "LLM")
    assert '"x"' in df.select(judged.check_prompt("check", {"x": "0 or 1"}, F.lit("data")).alias("p")).first().p


def test_chat_over_http():
    def post(url, body, headers, timeout):
        assert headers["Authorization"] == "Bearer k" and body["messages"][0]["content"] == "hi"
        if body["stream"]:
            return 'data: {"choices": [{"delta": {"content": "a"}}]}\n\ndata: {"choices": [{"delta": {"content": "b"}}]}\n\ndata: [DONE]\n'
        return '{"choices": [{"message": {"content": "ab"}}]}'

    for stream in (False, True):
        assert judged.HttpChat("http://x.example", "m", "k", stream, post=post)("hi") == "ab"
