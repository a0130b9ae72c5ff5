import io
import json
from datetime import datetime
from random import Random

import pytest
from pyspark.sql import functions as F

from scorelake.functions.text import extract_all
from scorelake.model import RunConfig
from scorelake.operators import counting, external, mock, rows, scoring
from scorelake.plans import flow
from scorelake.sinks import reports
from scorelake.sources import files
from scorelake.streaming import delta


def inputs(df):
    return [r.input_item for r in df.orderBy("order_key").collect()]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('query,type\n"a, ""b""",1\nshort\n')
    assert inputs(files.csv(spark, str(tmp_path / "a.csv"))) == [{"query": 'a, "b"', "type": "1"}, {"query": "short", "type": ""}]
    (tmp_path / "b.csv").write_text("x;y\n")
    assert inputs(files.csv(spark, str(tmp_path / "b.csv"), ";", header=False)) == [{"0": "x", "1": "y"}]


def test_json(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"code": 0, "success": true, "data": {"query": "q",\n "type": "t"}}')
    assert len(inputs(files.json_file(spark, str(path)))) == 1
    assert inputs(files.json_file(spark, str(path), "$.data")) == [{"query": "q", "type": "t"}]
    assert inputs(files.json_text(spark, '{"data": [{"query": "1"}, {"query": "2"}]}', "$.data")) == [{"query": "1"}, {"query": "2"}]
    for text, at in (("[1]", "$"), ('{"a": 1}', "$.a"), ('{"a": 1}', "$.b")):
        with pytest.raises(Exception):
            files.json_text(spark, text, at).collect()


def test_xlsx_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    reports.write_xlsx(path, ["query", "", "n"], [["a <b>", "skipped", 1], [None, "", "2"]])
    assert inputs(files.xlsx(spark, path)) == [{"query": "a <b>", "n": "1"}, {"query": "", "n": "2"}]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    spark.createDataFrame([(1, "a"), (2, None)], "id int, query string").write.jdbc(url, "testcase")
    assert sorted(map(str, inputs(files.jdbc(spark, url, "select * from testcase")))) == sorted(map(str, [{"id": "1", "query": "a"}, {"id": "2", "query": None}]))


def test_api_and_pages(spark):
    seen = {}

    def transport(url, **call):
        seen.update(call, url=url)
        return '{"data": [{"q": "1"}]}'

    assert inputs(files.api(spark, "http://x.example", "$.data", transport, method="POST")) == [{"q": "1"}]
    assert seen == {"url": "http://x.example", "method": "POST"}

    class Pages(files.PagedSource):
        @classmethod
        def name(cls):
            return "test_pages"

        def fetch(self, page, options):
            return [{"q": f"{page}-{k}"} for k in range(2)]

    spark.dataSource.register(Pages)
    assert [x["q"] for x in inputs(spark.read.format("test_pages").option("pages", 2).load())] == ["0-0", "0-1", "1-0", "1-1"]


def test_load_pipeline(spark):
    source = files.generated(spark, 102, {"query": F.col("id"), "none": F.lit(None)})
    items = files.load(source, [F.col("input_item")["query"].cast("int") % 2 == 0], 1, 3).orderBy("data_index").collect()
    assert [(r.data_index, r.input_item["query"], r.input_item["none"]) for r in items] == [(0, "2", ""), (1, "4", ""), (2, "6", "")]
    assert sorted(r.data_index for r in files.load(source, shuffle_seed=5).collect()) == [*range(102)]
    with pytest.raises(ValueError, match="empty"):
        files.load(source.limit(0))


def test_multi_source(spark):
    a, b = (files.generated(spark, n, {"query": F.col("id")}) for n in (2, 100))
    out = rows.reindexed(rows.union_sources([a, None, b]), ["source_pos", "order_key"])
    assert out.count() == 102 and out.where("source_pos = 0").agg(F.max("data_index")).first()[0] == 1


def test_sessions(spark):
    s = files.sessions(spark, 5, 5, random_rounds=True, seed=1)
    rounds = {}
    for r in s.collect():
        rounds.setdefault(r.sessionId, []).append(r)
    assert len(rounds) == 5
    for found in rounds.values():
        found.sort(key=lambda r: r.round)
        assert [r.round for r in found] == [*range(1, len(found) + 1)] and len(found) <= 5
        assert found[0].contextDependency == "" and all(r.contextDependency == "".join(f"{x.round}: {x.query}\n" for x in found[: k]) for k, r in enumerate(found))


def test_replies_and_templates(spark):
    replies = spark.createDataFrame([("a\n\n b \n",)], "reply string")
    assert [x["query"] for x in inputs(files.from_replies(replies))] == ["a", " b "]
    assert all(x["query"].startswith("hi 20") for x in inputs(files.from_template(spark, "hi {{date yyyy}}", 3)))


# --- mock rules ---------------------------------------------------------------------------


@pytest.mark.parametrize("rule", ["future_date 15 365 yyyyMMdd", "past_date 15 365 yyyyMMdd"])
def test_date_ranges(rule):
    now, draw = datetime(2025, 6, 1, 12), Random(3)
    m = mock.DateMocker(now)
    name, *args = rule.split()
    for _ in range(100):
        days = abs((datetime.strptime(m.mock(name, args, draw), "%Y%m%d") - datetime(2025, 6, 1)).days)
        assert 15 <= days <= 365
    with pytest.raises(ValueError, match="Error parsing args"):
        m.mock("future_date", ["abc", "xyz"], draw)


def test_other_mockers():
    e, draw = mock.Engine(), Random(1)
    assert e.value("city 广东省", draw) in ("广州市", "深圳市") and e.value("street 新疆 乌鲁木齐市", draw) == "燕儿窝街道"
    assert e.value("scenic 北京市", draw) in ("故宫博物院", "颐和园") and e.value("unknown", draw) == ""
    assert mock.Engine(keep_unknown=True).value("unknown x", draw) == "{{unknown x}}"
    assert e.value("between_holiday 20250128 20250129", draw) == "除夕" and e.value("solr_term_holiday", draw)
    assert e.value("city 没有省", draw) == ""


def test_same_and_fresh_values(spark):
    df = spark.createDataFrame([(k, {"a": "{{holiday}} {{holiday}}", "b": "{{holiday}}{{ holiday }}"}) for k in range(20)], "data_index bigint, input_item map<string,string>")
    for r in mock.mocked(df, ["a", "b"], seed=1, same=True).collect():
        one = r.input_item["a"].split(" ")
        assert one[0] == one[1] and r.input_item["b"] == one[0] + "{{ holiday }}"
    fresh = [r.input_item["a"].split(" ") for r in mock.mocked(df, ["a"], seed=1).collect()]
    assert any(a != b for a, b in fresh) and fresh == [r.input_item["a"].split(" ") for r in mock.mocked(df.repartition(3), ["a"], seed=1).orderBy("data_index").collect()]


# --- calls --------------------------------------------------------------------------------


class Ordered:
    def __init__(self):
        self.seen = []

    def __call__(self, index, item):
        self.seen.append(item["query"])
        return {"order": ",".join(q for q in self.seen if q.startswith(item["caseId"]))}


def test_calls_of_a_key_are_in_order(spark):
    cases = [(k, {"caseId": c, "query": f"{c}query{n}"}) for k, (c, n) in enumerate([("1", 3), ("2", 1), ("3", 2), ("1", 1), ("2", 2), ("3", 1), ("1", 2)])]
    df = spark.createDataFrame(cases, "data_index bigint, input_item map<string,string>")
    out = external.ordered_completion(df, F.col("input_item")["caseId"], [F.col("input_item")["query"]], Ordered).collect()
    by = {r.data_index: r.result_item["order"] for r in out}
    assert by[0] == "1query1,1query2,1query3" and by[4] == "2query1,2query2" and all(r.success for r in out)


# --- sinks --------------------------------------------------------------------------------


@pytest.fixture
def run(spark):
    items = spark.createDataFrame([(k, {"query": f"q{k}"}, {"e": "x"}) for k in range(3)], "data_index bigint, input_item map<string,string>, extra map<string,string>")
    api = external.api_completion(items, lambda: lambda i, m: {"response": m["query"]} if i else None, clock=lambda: 5)
    results = scoring.score_items(items, [scoring.Scorer(F.col("data_index").cast("double"), "m", reason=F.lit("<b>"))])
    verdicts = scoring.verdicts(results, "sum", 1)
    counts = {"basic": counting.basic_count(counting.cases_of(api, verdicts, items)), "attribute": counting.attribute_index(spark.createDataFrame([(0, "slow")], "data_index bigint, issue string"))}
    return reports.nested_cases(items, api, verdicts, results).persist(), counts


def test_json_report_is_read_back(spark, run, tmp_path):
    path = reports.json_file(*run, str(tmp_path), "r")
    saved = json.loads(open(path).read())
    assert [d["dataIndex"] for d in saved["dataItems"]] == [0, 1, 2] and json.loads(saved["countResult"]["basic"])["pass_count"] == 2
    back = rows.injected(files.saved_report(spark, path)).orderBy("data_index").collect()
    assert [(r.data_index, r.eval_result["score"], r.eval_result["pass"], r.input_item["query"], r.api_result["success"]) for r in back] == [(0, 0.0, False, "q0", False), (1, 1.0, True, "q1", True), (2, 2.0, True, "q2", True)]
    assert back[1].eval_result["scorerResults"][0]["metric"] == "m"
    assert rows.injected(files.saved_report(spark, path, 1, 1, keep_verdicts=False)).first().eval_result is None


def test_csv_xlsx_html_and_console(spark, run, tmp_path):
    reports.csv_files(*run, str(tmp_path))
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "cases"))
    assert got.columns == ["dataIndex", "inputData", "apiCompletionResult", "evalResult", "extra"] and got.count() == 3
    paths = reports.xlsx_files(*run, str(tmp_path))
    assert len(inputs(files.xlsx(spark, paths[0]))) == 3 and len(reports.file_name()) == 8
    page = open(reports.html_file(*run, str(tmp_path), "p", "T<")).read()
    assert "T&lt;" in page and page.count('class="case pass"') == 2 and "slow" in page and "<b>" not in page
    out = io.StringIO()
    reports.console(*run, out)
    assert len(out.getvalue().splitlines()) == 4
    reports.json_lines(run[0], str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    reports.generated_cases(spark.range(2), str(tmp_path / "g.json"))
    assert json.loads((tmp_path / "g.json").read_text()) == [{"id": 0}, {"id": 1}]


def test_jdbc_report_is_whole_or_not_there(spark, run, tmp_path):
    url = f"jdbc:derby:memory:r{tmp_path.name};create=true"
    groups = [reports.jdbc_table(run[0], url, "results") for _ in range(2)]
    got = spark.read.jdbc(url, "results")
    assert got.count() == 6 and {r.group_id for r in got.select("group_id").collect()} == set(groups)


def test_failing_sink_is_logged():
    assert reports.report(lambda: 1 / 0) is False and reports.report(lambda: 1) is True


def test_http_report_calls_each_case(run, tmp_path):
    folder = str(tmp_path)

    def send(row):
        open(f"{folder}/{row['dataIndex']}", "w").close()

    reports.http_rows(run[0], send)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "1", "2"]


# --- workflows and runs -------------------------------------------------------------------


def test_workflow(spark):
    order = []
    nodes = [flow.Node(lambda c, k=k: (order.append(k), c.values.update({k: k})) and None, k) for k in "abcd"]
    w = flow.WorkflowBuilder().link(nodes[0], [nodes[1], nodes[2]], nodes[3]).build()
    assert len(w.execute().values) == 4 and w.status == flow.DONE and order == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="cycle"):
        flow.WorkflowBuilder().link(nodes[0], nodes[1]).link(nodes[1], nodes[0]).build()
    with pytest.raises(ValueError):
        flow.WorkflowBuilder().link()
    bad = flow.WorkflowBuilder().link(nodes[0], flow.Node(lambda c: 1 / 0)).build()
    with pytest.raises(ZeroDivisionError):
        bad.execute()
    assert bad.status == flow.FAILED and bad.clone().status == flow.INIT


def test_full_run(spark):
    seen = []
    evaluation = [
        flow.Call(lambda items: external.api_completion(items, lambda: lambda i, m: {"response": m["query"]})),
        [flow.Score(scoring.Scorer(F.lit(1.0))), flow.Score(scoring.Scorer(F.lit(1.0), star=True, threshold=1)), flow.Score(scoring.Scorer(F.lit(0.0)))],
        flow.Count("basic", lambda c: counting.basic_count(counting.cases_of(c.api_results, c.verdicts(), c.items))),
    ]
    run = flow.FullRun(RunConfig(pass_score=1), lambda: files.load(files.generated(spark, 102, {"query": F.col("id")})), evaluation, [flow.Report(lambda c: seen.append(c.verdicts().where("pass").count())), flow.End(lambda c: seen.append("end"))], {"before_load": lambda c: seen.append("hook")})
    context = run.run()
    r = context.counts["basic"].first()
    assert (r.total_count, r.pass_rate, r.stddev_score, r.completion_success_count) == (102, 1.0, 0.0, 102) and seen == ["hook", 102, "end"]


def _evaluate(batch):
    return batch.select("data_index", (F.col("data_index") * 2).alias("score"))


def test_delta_run_resumes(spark, tmp_path):
    items = spark.range(52).withColumnRenamed("id", "data_index")
    state = {"fail": True, "batches": 0}

    def evaluate(batch):
        state["batches"] += 1
        if state["fail"] and state["batches"] == 3:
            raise RuntimeError("lost")
        return _evaluate(batch)

    run = delta.DeltaRun(spark, str(tmp_path), evaluate, RunConfig(task_name="t"))
    assert run.load(items) and not run.load(items)
    with pytest.raises(Exception, match="lost"):
        run.run()
    assert run.tasks.get("t").status == delta.FAILED and 0 < run.progress()["processed"] < 52
    state["fail"] = False
    reported = []
    again = delta.DeltaRun(spark, str(tmp_path), evaluate, RunConfig(task_name="t"), report=lambda df: reported.append(df.count()))
    out = again.run()
    assert sorted((r.data_index, r.score) for r in out.collect()) == [(k, 2 * k) for k in range(52)]
    # two batches, the failed one, and again from there on: none of the first two again
    assert state["batches"] == 3 + 4 and reported[-1] == 52 and again.progress() == {"total": 52, "processed": 52, "remaining": 0}
    done = again.tasks.get("t")
    assert done.status == delta.FINISHED and done.finish_time
    fresh = delta.DeltaRun(spark, str(tmp_path), evaluate, RunConfig(task_name="t", enable_resume=False))
    assert fresh.load(items)


def test_ordered_delta_run(spark, tmp_path):
    sizes = {1: 2, 4: 20, 2: 10, 3: 20}
    cases = [(100 * c + r, {"caseId": str(c), "query": f"{c}q{r:02d}"}, r) for c, n in sizes.items() for r in range(n)]
    df = spark.createDataFrame(cases[::-1], "data_index bigint, input_item map<string,string>, round int")
    call = lambda b: external.api_completion(b, Ordered)
    run = delta.DeltaRun(spark, str(tmp_path), call, RunConfig(task_name="o"), key=F.col("input_item")["caseId"], order=[F.col("round")])
    run.load(df)
    for r in run.run().collect():
        seen = r.result_item["order"].split(",")
        assert seen == [f"{r.data_index // 100}q{k:02d}" for k in range(r.data_index % 100 + 1)]


def test_config_overrides(spark):
    c = RunConfig().overridden(spark, {"SCORELAKE_TASK_NAME": "n", "SCORELAKE_OFFSET": "10", "SCORELAKE_LIMIT": "100", "SCORELAKE_THREAD_NUM": "8", "SCORELAKE_PASS_SCORE": "0.85", "SCORELAKE_BATCH_SIZE": "1"})
    assert (c.task_name, c.offset, c.limit, c.thread_num, c.pass_score, c.batch_size) == ("n", 10, 100, 8, 0.85, 10)
    same = RunConfig(offset=3, limit=5).overridden(None, {"SCORELAKE_TASK_NAME": "", "SCORELAKE_OFFSET": "0", "SCORELAKE_LIMIT": "0"})
    assert (same.offset, same.limit) == (3, 0)
    for bad in ({"task_name": " "}, {"thread_num": 0}, {"batch_size": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            RunConfig(**bad)


def test_windows_in_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.range(100).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id") * 7)).alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = delta.windowed_counts(stream, "ts", "1 hour", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, delta.windowed_counts(events, "ts", "1 hour").collect()))


def test_patterns(spark):
    assert spark.range(1).select(extract_all(F.lit("a1b22"), "[0-9]+")).first()[0] == ["1", "22"]
