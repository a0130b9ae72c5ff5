"""Calls over HTTP, mixed scorers, limits of runs, databases with a login, tables of places."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scorelake import model
from scorelake.functions import http
from scorelake.model import RunConfig
from scorelake.operators import checkers, counting, external, judged, mock, scoring
from scorelake.plans import flow
from scorelake.plans.catalog_io import service
from scorelake.sinks import reports
from scorelake.sources import files
from scorelake.streaming import delta


@pytest.fixture(scope="module")
def address():
    return service("127.0.0.1")


# --- HTTP ---------------------------------------------------------------------------------


def test_bodies():
    assert http.encoded({"a": "ä"}, "json") == ('{"a": "ä"}'.encode(), "application/json")
    assert http.encoded({"a": [1, 2], "b": "x y"}, "form")[0] == b"a=1&a=2&b=x+y"
    data, kind = http.encoded({"n": 1, "f": http.File('a"b.txt', b"\0\r\n", "text/plain")}, "multipart")
    mark = kind.partition("boundary=")[2].encode()
    assert data.count(mark) == 3 and b'name="f"; filename="a\\"b.txt"\r\nContent-Type: text/plain\r\n\r\n\0\r\n\r\n--' in data
    assert http.encoded(b"raw", "json") == (b"raw", None) and http.encoded(None, "json") == (None, None)
    with pytest.raises(ValueError):
        http.encoded({}, "other")
    with pytest.raises(ValueError, match="neither"):
        http.request("file:///etc/hosts")


@pytest.mark.parametrize(("encoding", "kind"), [("json", "application/json"), ("form", "application/x-www-form-urlencoded"), ("multipart", "multipart/form-data")])
def test_transport_hooks(address, encoding, kind):
    call = external.HttpTransport(address, body=lambda i, x: {"number": x["q"]}, params=lambda i, x: {"given": f"p{i}"}, headers=lambda i, x: {"X-Case": x["q"]}, encoding=encoding)
    assert call(3, {"q": "3"}) == {"reply": "3 p3 3", "kind": kind}
    assert call(5, {"q": "5"}) is None
    with pytest.raises(RuntimeError, match="503"):
        call(7, {"q": "7"})


def test_transport_parse_and_accepted_status():
    sent = []

    def send(url, method, **how):
        sent.append((method, how.get("body")))
        return http.Answer(404, b"gone")

    call = external.HttpTransport("http://x.example", "GET", parse=lambda a: {"status": a.status, "text": a.text}, accept=(404,), send=send)
    assert call(0, {"q": "1"}) == {"status": "404", "text": "gone"} and sent == [("GET", None)]
    assert external.HttpTransport("http://x.example", accept=(404,), send=send)(0, {}) == {"response": "gone"}


def test_workflow_client(address):
    client = external.WorkflowClient(address, "k", inputs=lambda x: {"number": x["q"]})
    assert client(0, {"q": "4"}) == {"double": "8"}
    with pytest.raises(RuntimeError, match="three"):
        client(0, {"q": "3"})


def test_http_json_fails_on_an_error(address):
    assert json.loads(files.http_json(address, "POST", body={"number": 1}))["reply"] == "1  "
    with pytest.raises(OSError, match="503"):
        files.http_json(address, "POST", body={"number": 7})


# --- mixed scorers and settings of a run ----------------------------------------------------


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(k, {"q": "x" * k}) for k in range(12)], "data_index bigint, input_item map<string,string>")


def test_columns_and_functions_score_together(items):
    size = F.length(F.col("input_item")["q"]).cast("double")

    def plain(rows, kind):
        return judged.python_scorer(rows.withColumn("n", F.length(F.col("input_item")["q"])), ["n"], {"a": lambda r: (r["n"] % 2, ""), "b": lambda r: (1 // (r["n"] - 4), "")}, kind)

    nodes = [flow.Score(scoring.Scorer(size, "size")), flow.Score(plain), flow.Score(scoring.Scorer(F.lit(1.0), "one"))]
    context = flow.FullRun(RunConfig(pass_score=3), lambda: items, nodes).run()
    got = {}
    for r in context.scored().orderBy("data_index", "scorer_pos").collect():
        got.setdefault(r.data_index, []).append((r.metric, r.success))
    assert got[4] == [("size", True), ("a", True), ("b", False), ("one", True)] and len(got) == 12
    v = {r.data_index: r for r in context.verdicts().collect()}
    assert v[5].score == 5 + 1 + 1 + 1 and v[5]["pass"] and not v[4].success and [x[k] for x in json.loads(v[5].reason) for k in x if k == scoring.METRIC_KEY] == ["size", "a", "b", "one"]


def test_only_functions_score(items):
    context = flow.FullRun(RunConfig(), lambda: items, [flow.Score(lambda rows, kind: judged.python_scorer(rows.withColumn("n", F.lit(2)), ["n"], {"a": lambda r: (r["n"], "")}, kind))]).run()
    assert {r.score for r in context.verdicts().collect()} == {2.0}


def test_offset_limit_and_threads_of_a_run(spark, items):
    seen = flow.FullRun(RunConfig(offset=3, limit=4, thread_num=3), lambda: items, [flow.Call(factory=lambda: lambda i, x: {"response": x["q"]})]).run()
    assert [(r.data_index, len(r.result_item["response"])) for r in seen.api_results.orderBy("data_index").collect()] == [(0, 3), (1, 4), (2, 5), (3, 6)]
    assert flow.FullRun(RunConfig(offset=3), lambda: items, []).run().items.count() == 12
    with pytest.raises(ValueError):
        flow.Call()


@pytest.mark.parametrize("mode", ["strict", "prefix"])
@pytest.mark.parametrize("by", sorted(scoring.STRATEGIES))
def test_folds_in_a_row_equal_folds_over_rows(spark, by, mode):
    rows = spark.createDataFrame([(k, float(k % 5 - 1), float(k % 3), "no" if k % 4 == 0 else None) for k in range(40)], "data_index bigint, x double, y double, e string")
    scorers = [
        scoring.Scorer(F.col("y"), "y", star=True, threshold=0.5, total_score=4, start_time=F.col("data_index") + 5, end_time=F.col("data_index") + 9),
        scoring.Scorer(F.col("x"), "x", error=F.col("e"), start_time=F.col("data_index"), end_time=F.col("data_index") * 2),
        scoring.Scorer(lambda v: v * 0.1, "v", reason=lambda v: v.cast("string"), extra=lambda v: F.create_map(F.lit("v"), v.cast("string")), value=F.col("x") + F.col("y")),
    ]
    over_rows = scoring.verdicts(scoring.score_items(rows, scorers, scoring.KINDS[by]), by, 0.4, mode)
    in_rows = scoring.item_verdicts(rows, scorers, by, 0.4, mode)
    assert in_rows.columns == over_rows.columns
    assert [tuple(r) for r in in_rows.orderBy("data_index").collect()] == [tuple(r) for r in over_rows.orderBy("data_index").collect()]
    assert "Exchange" not in in_rows._jdf.queryExecution().executedPlan().toString()


def test_a_similarity_is_computed_once(spark):
    rows = spark.createDataFrame([(0, "a b", "a c")], "data_index bigint, q string, r string")
    plan = scoring.item_verdicts(rows, [scoring.vector_similarity(F.col("q"), F.col("r"), 0.3)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_checkers_merged_several_ways(spark):
    some = [checkers.checker("a", [checkers.check_item("x", F.col("id").cast("double"))]), checkers.checker("b", [checkers.check_item("y", 2.0)])]
    r = spark.range(1, 2).select(checkers.merged_by(some, "sum", "avg", "min").alias("m")).first().m
    assert (r["sum"].score, r["avg"].score, r["min"].score, r["min"].total) == (3.0, 1.5, 1.0, 2.0)


def test_hooks_of_a_checker():
    run = checkers.checked(lambda row: row | {"n": row["n"] + 1}, lambda row: [10 // row["n"]], lambda row, items: items + [0], lambda row, e: [type(e).__name__])
    assert run({"n": 4}) == [2, 0] and run({"n": -1}) == ["ZeroDivisionError"]
    with pytest.raises(ZeroDivisionError):
        checkers.checked(None, lambda row: 1 / 0)({})


def test_issues_in_long_form(spark):
    found = counting.issues(spark.createDataFrame([(0, "slow#wrong"), (1, "slow"), (2, "")], "data_index bigint, reply string"))
    rows = sorted(tuple(r) for r in counting.attribute_cases(found).collect())
    assert rows == [("slow", 0, 2), ("slow", 1, 2), ("wrong", 0, 1), (counting.UNKNOWN_ISSUE, 2, 1)]
    assert [tuple(r) for r in counting.attribute_counts(found, 1).collect()] == [("slow", 2)]


def test_replies_carry_their_prompts(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "data_index bigint, prompt string")
    replies = external.llm(rows, lambda: lambda p: p + "!", "m", retries=1)
    assert sorted((r.data_index, r.prompt, r.reply) for r in replies.collect()) == [(0, "a", "a!"), (1, "b", "b!")]
    plan = external.llm_calls(replies, "m")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


# --- delta runs ---------------------------------------------------------------------------


def test_a_batch_that_takes_too_long_fails_and_is_resumed(spark, tmp_path):
    def slow(batch):
        return batch.mapInPandas(lambda parts: [(__import__("time").sleep(30), p)[1] for p in parts], batch.schema)

    items = spark.range(4).withColumnRenamed("id", "data_index")
    run = delta.DeltaRun(spark, str(tmp_path), slow, RunConfig(task_name="s", message_process_max_time=2))
    run.load(items)
    with pytest.raises(Exception, match="took more than 2 s"):
        run.run()
    assert run.tasks.get("s").status == delta.FAILED
    again = delta.DeltaRun(spark, str(tmp_path), lambda b: b, RunConfig(task_name="s"))
    assert again.run().count() == 4


def test_a_queue_that_nobody_loads(spark, tmp_path):
    run = delta.DeltaRun(spark, str(tmp_path), lambda b: b, RunConfig(task_name="none", receive_timeout=1))
    with pytest.raises(TimeoutError, match="no cases"):
        run.run()


def test_a_delta_run_pages_its_cases(spark, tmp_path):
    run = delta.DeltaRun(spark, str(tmp_path), lambda b: b, RunConfig(task_name="p", offset=2, limit=3))
    run.load(spark.range(10).select(F.col("id").alias("data_index"), (F.col("id") * 10).alias("x")))
    assert sorted((r.data_index, r.x) for r in run.run().collect()) == [(0, 20), (1, 30), (2, 40)]


# --- databases, files, places, environment --------------------------------------------------


def test_jdbc_report_with_a_login(spark, items, tmp_path):
    url, login = f"jdbc:derby:{tmp_path}/db;create=true", {"user": "owner", "password": "secret", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    cases = reports.nested_cases(items.limit(3))
    reports.jdbc_table(cases, url, "results", login)
    c = reports._connection(spark, url, {"user": "owner"})
    for key, value in (("derby.user.owner", "secret"), ("derby.connection.requireAuthentication", "true"), ("derby.authentication.provider", "BUILTIN")):
        c.createStatement().execute(f"call syscs_util.syscs_set_database_property('{key}', '{value}')")
    c.close()
    with pytest.raises(Exception):
        reports.jdbc_table(cases, url, "results")
    reports.jdbc_table(cases, url, "results", login)
    assert spark.read.jdbc(url, "results", properties=login).count() == 6


def test_a_file_behind_a_url(spark, tmp_path):
    import functools
    import threading
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    (tmp_path / "a.json").write_text('{"data": [{"q": "1"}, {"q": "2"}]}')
    quiet = type("Quiet", (SimpleHTTPRequestHandler,), {"log_message": lambda *_: None})
    with ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=str(tmp_path))) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_port}"
        assert [r.input_item for r in files.json_file(spark, f"{base}/a.json?x=1", "$.data").collect()] == [{"q": "1"}, {"q": "2"}]
        with pytest.raises(OSError, match="404"):
            files.resolved(spark, f"{base}/none.csv")
        server.shutdown()
    assert files.resolved(spark, "/a/b.csv") == "/a/b.csv"


def test_places_of_a_table(tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("street,province,city,area\ns1,P,C,A\ns2,P,C,B\n", encoding="utf-8")
    (tmp_path / "p.csv").write_text("province,city,place\nP,C,Tower\n", encoding="utf-8")
    monkeypatch.setenv("SCORELAKE_ADDRESS_TABLE", str(tmp_path / "a.csv"))
    monkeypatch.setenv("SCORELAKE_PLACE_TABLE", str(tmp_path / "p.csv"))
    mock._configured.cache_clear()
    try:
        e, draw = mock.Engine(), __import__("random").Random(1)
        assert e.value("street P C A", draw) == "s1" and e.value("scenic P", draw) == "Tower"
    finally:
        mock._configured.cache_clear()
    assert mock.matching(mock.ADDRESSES, province="新疆") == [{"province": "新疆维吾尔自治区", "city": "乌鲁木齐市", "area": "天山区", "street": "燕儿窝街道"}]
    with pytest.raises(ValueError):
        mock.matching(mock.ADDRESSES, country="x")


@pytest.mark.parametrize(
    ("args", "want"),
    [("", (0, 7, "yyyy-MM-dd HH:mm:ss")), ("3", (0, 3, "yyyy-MM-dd HH:mm:ss")), ("yyyy", (0, 7, "yyyy")), ("2 5", (2, 5, "yyyy-MM-dd HH:mm:ss")), ("5 MM", (0, 5, "MM")), ("2 5 dd", (2, 5, "dd"))],
)
def test_forms_of_date_rules(args, want):
    assert mock.DateMocker().parsed(args.split()) == want


@pytest.mark.parametrize("args", ["yyyy 3", "1 2 3", "1 2 yyyy 4", "1.5", "QQ", "x y"])
def test_no_forms_of_date_rules(args):
    with pytest.raises(ValueError, match="Error parsing args"):
        mock.DateMocker().parsed(args.split())


def test_environment_info():
    info = model.environment_info()
    assert info["pid"] == str(os.getpid()) and info["python"] and all(isinstance(v, str) for v in info.values())


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://x", "applicationId": "a"})

    with pytest.raises(ValueError, match="checkpoint"):
        model.scratch(Cluster, "x")
    assert model.scratch(spark, "x") != model.scratch(spark, "x")
