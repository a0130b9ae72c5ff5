"""Queries through files, databases, models and mock rules: what goes out comes back."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from functools import cache
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import text as tx
from scorelake.functions import values as vl
from scorelake.model import RunConfig, scratch
from scorelake.operators import checkers, counting, external, judged, ledger, mock, scoring
from scorelake.plans import catalog, flow, views
from scorelake.plans.catalog import query
from scorelake.plans.views import EVENT_CASES, table
from scorelake.sinks import reports
from scorelake.sources import files
from scorelake.streaming import ordered


class _Judge:
    """Marks a prompt by the length of its data; has no score for texts of one length, and fails for another."""

    def __call__(self, prompt):
        text = prompt.split(external.INPUT_MARK)[1]
        if len(text) % 11 == 0:
            raise RuntimeError("busy")
        return "no idea" if len(text) % 7 == 0 else f'```json\n{{"score": "{len(text)}", "reason": "length"}}\n```'


@query("""SELECT conv_id * 1000 + turn AS data_index, CASE WHEN length(text) % 11 = 0 OR length(text) % 7 = 0 THEN 0 ELSE length(text) END::DOUBLE AS score,
  NOT (length(text) % 11 = 0 OR length(text) % 7 = 0) AS success, NOT (length(text) % 11 = 0 OR length(text) % 7 = 0) AND length(text) >= 50 AS pass,
  CASE WHEN length(text) % 11 = 0 THEN 'Error: busy' WHEN length(text) % 7 = 0 THEN 'Error: the reply has no score' ELSE 'length' END AS reason FROM conversations""")
def q56_prompt_scorer(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("data_index"), "text")
    out = judged.prompt_scorer(items, external.prompt("mark", F.col("text")), _Judge, retries=2, wait=0, metric="length", threshold=50)
    return out.select("data_index", "score", "success", "pass", "reason")


_RUNS = """(SELECT 1 AS run, conv_id * 1000 + turn AS data_index, length(text) AS size FROM conversations
  UNION ALL SELECT 2, conv_id * 1000 + turn, length(text) + CASE WHEN turn % 3 = 0 THEN 5 ELSE 0 END FROM conversations) r"""
_BAD = "(size % 11 = 0 OR size % 7 = 0)"


@query(f"""WITH s AS (SELECT run, count(*) AS cases, sum(CASE WHEN {_BAD} THEN 0 ELSE size END)::DOUBLE AS score, count(*) FILTER (WHERE size % 11 <> 0) AS answered FROM {_RUNS} GROUP BY run),
  c AS (SELECT 1 AS run, count(*) AS asked FROM {_RUNS} WHERE run = 1
  UNION ALL SELECT 2, count(*) FROM {_RUNS} JOIN (SELECT data_index, length_1 FROM (SELECT data_index, size AS length_1 FROM {_RUNS} WHERE run = 1)) o USING (data_index) WHERE run = 2 AND (size <> length_1 OR length_1 % 11 = 0))
  SELECT run, cases, answered, asked, score FROM s JOIN c USING (run)""")
def q76_ledger_of_answers(spark, sf_dir):
    """Two runs over all turns, of which the second changes every third prompt: only these, and those that failed before, are asked again, though three readers count each run's results."""
    book = ledger.Ledger(spark, scratch(spark, "ledger"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("data_index"), "turn", "text")
    out = []
    for run in (1, 2):
        text = F.col("text") if run == 1 else F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
        scored = judged.prompt_scorer(turns, external.prompt("mark", text), _Judge, retries=1, wait=0, metric="length", ledger=book)
        counts = [F.count("*").alias("cases"), F.count_if(F.col("reason") != "Error: busy").alias("answered"), F.sum("score").alias("score")]
        parts = [scored.agg(c) for c in counts]
        out.append(parts[0].withColumn("run", F.lit(run)).join(parts[1].withColumn("run", F.lit(run)), "run").join(parts[2].withColumn("run", F.lit(run)), "run"))
    calls = book.calls("judge length", external.REPLIES).withColumnRenamed("n", "asked")
    return out[0].unionByName(out[1]).join(calls, "run").select("run", "cases", "answered", "asked", "score")


def _parity(row):
    if row["doc_id"] % 5 == 0:
        raise ValueError("five")
    return row["doc_id"] % 2, "parity"


@query("""SELECT metric, success, count(*) AS n, sum(score) AS score FROM (SELECT 'parity' AS metric, doc_id % 5 <> 0 AS success, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 ELSE 0 END::DOUBLE AS score FROM documents
  UNION ALL SELECT 'size', true, (n_chars % 100)::DOUBLE FROM documents) GROUP BY ALL""")
def q57_python_scorers(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_index"), "doc_id", "n_chars")
    out = judged.python_scorer(items, ["doc_id", "n_chars"], {"parity": _parity, "size": lambda r: (r["n_chars"] % 100, "")})
    return out.groupBy("metric", "success").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("SELECT event_id, ((floor(value) + 1) / 2 + event_id % 3) / 2 AS score FROM events")
def q58_llm_rounds(spark, sf_dir):
    reply = lambda c: F.concat(F.lit('{"x": {"score": '), c.cast("string"), F.lit(', "reason": "r"}}'))
    replies = F.array(reply(F.floor("value")), reply(F.lit(1)), reply(F.col("event_id") % 3))
    e = table(spark, sf_dir, "events").select("event_id", F.array(*judged.checked_in_rounds(replies, ["x"])).alias("items"))
    return e.select("event_id", checkers.item_score(F.col("items"), "sum").alias("score"))


@query("SELECT doc_id AS data_index, 'q' || doc_id AS query, n_chars::DOUBLE AS score, n_chars >= 500 AS pass FROM documents")
def q59_report_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_index"), F.create_map(F.lit("query"), F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("input_item"), "n_chars")
    results = scoring.score_items(docs, [scoring.Scorer(F.col("n_chars"), "size")])
    path = scratch(spark, "report")
    reports.json_lines(reports.nested_cases(docs, None, scoring.verdicts(results, "sum", 500), results), path)
    back = catalog.rows.injected(files.json_lines(spark, path))
    return back.select("data_index", vl.get_or(F.col("input_item"), "query").alias("query"), "eval_result.score", F.col("eval_result.pass"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q60_map_flatten(spark, sf_dir):
    nested = F.concat(F.lit('{"a": {"b": ['), F.col("props"), F.lit("]}}"))
    return table(spark, sf_dir, "events").select("event_id", vl.get_or(vl.map_flatten(nested, "#"), "a#b#0#k").alias("k"))


@query("SELECT c_custkey, c_name, coalesce(c_mktsegment, '') AS c_mktsegment FROM customer")
def q61_csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option("escape", '"').csv(path)
    item = lambda k: F.col("input_item")[k]
    return files.csv(spark, path).select(vl.to_long(item("c_custkey")).alias("c_custkey"), item("c_name").alias("c_name"), item("c_mktsegment").alias("c_mktsegment"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def q62_xlsx_round_trip(spark, sf_dir):
    """Spreadsheets written and read by executors."""
    books = catalog.rows.pinned(reports.workbooks(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 10))
    item = lambda k: F.col("input_item")[k]
    return files.sheet_rows(books).select(vl.to_long(item("n_nationkey")).alias("n_nationkey"), item("n_name").alias("n_name"))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def q63_jdbc_round_trip(spark, sf_dir):
    """Through a database in the driver's process: tasks of a cluster would each find an empty one in their executor's."""
    url = f"jdbc:derby:memory:catalog{uuid.uuid4().hex};create=true"
    reports.jdbc_by_driver(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), url, "region")
    rows = files.jdbc_by_driver(spark, url, "select * from region")
    return rows.select(vl.to_long(F.col("input_item")["r_regionkey"]).alias("r_regionkey"), F.col("input_item")["r_name"].alias("r_name"))


@query(f"WITH {EVENT_CASES} SELECT event_type, pass, count(*) AS n, count(*) FILTER (WHERE api_success) AS ok FROM event_cases GROUP BY CUBE (event_type, pass)")
def q64_count_cube(spark, sf_dir):
    return counting.count_by(views.event_cases(spark, sf_dir), "event_type", "pass", cube=True, metrics={"n": F.count("*"), "ok": F.count_if("api_success")})


@query(f"WITH {catalog._ISSUES} SELECT issue AS issue_name, count(*) AS case_count FROM issues GROUP BY issue ORDER BY case_count DESC, issue LIMIT 2")
def q65_top_issues(spark, sf_dir):
    return counting.attribute_counts(counting.issues(catalog._replies(spark, sf_dir)), top=2)


@query("SELECT doc_id, '燕儿窝街道 除夕 ' || lang AS text FROM documents")
def q66_mock_rules(spark, sf_dir):
    rules = "street 新疆 乌鲁木齐市", "between_chinese_holiday 20250128 20250129"
    template = F.concat(F.lit("".join("{{%s}} " % r for r in rules)), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", mock.mock_known(template, F.col("doc_id"), rules, 7).alias("text"))


@query("SELECT event_id, 2::BIGINT AS n, event_type AS event, props || chr(10) || 'more' AS data FROM events")
def q67_server_sent_events(spark, sf_dir):
    text = F.concat(F.lit("event: "), F.col("event_type"), F.lit("\ndata: "), F.col("props"), F.lit("\ndata: more\n\ndata: end\n\n"))
    e = table(spark, sf_dir, "events").select("event_id", tx.sse_events(text).alias("e"))
    return e.select("event_id", F.size("e").cast("bigint").alias("n"), F.col("e")[0]["event"].alias("event"), F.col("e")[0]["data"].alias("data"))


class _Chat:
    def __call__(self, prompt):
        chat = judged.HttpChat("http://model.example", "m", post=lambda url, body, headers, timeout: json.dumps({"choices": [{"message": {"content": body["messages"][0]["content"][:5]}}]}))
        return chat(prompt)


@query("SELECT item_id AS data_index, left(text, 5) AS reply, 1::INTEGER AS attempts FROM benchmark")
def q68_chat_completions(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("data_index"), F.col("text").alias("prompt"))
    return external.llm(rows, _Chat, "m", retries=1).select("data_index", "reply", "attempts")


@query("""SELECT count(*) AS n, 0::BIGINT AS least, count(*) - 1 AS most, count(*) AS different, count(DISTINCT doc_id) AS ids, sum(('0x' || substr(md5(doc_id || ' ' || coalesce(lang, '-')), 1, 8))::BIGINT)::BIGINT AS digest,
  count(*) > 2 AS moved FROM documents""")
def q69_shuffled_load(spark, sf_dir):
    docs = files.as_items(table(spark, sf_dir, "documents").select("doc_id", "lang"))
    rows = files.load(docs, shuffle_seed=11).select("data_index", F.col("input_item")["doc_id"].alias("doc_id"), F.coalesce(F.col("input_item")["lang"], F.lit("-")).alias("lang"))
    # every row is there once, under an index that follows neither the ids nor their reverse
    digest = F.conv(F.substring(F.md5(F.concat_ws(" ", "doc_id", "lang")), 1, 8), 16, 10).cast("bigint")
    trend = F.corr("data_index", F.col("doc_id").cast("double"))
    return rows.agg(
        F.count("*").alias("n"), F.min("data_index").alias("least"), F.max("data_index").alias("most"), F.count_distinct("data_index").alias("different"),
        F.count_distinct("doc_id").alias("ids"), F.sum(digest).alias("digest"), (F.abs(trend) < 0.5).alias("moved"),
    )


_UUID = "substr(h, 1, 12) || '3' || substr(h, 14, 3) || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18)"


@query(f"SELECT page_id, unhex(hex(url))::VARCHAR AS url, {_UUID} AS uuid, h AS digest FROM (SELECT *, md5(url) AS h FROM pages) WHERE length(url) > 20")
def q70_filters_and_ids(spark, sf_dir) -> DataFrame:
    pages = catalog.rows.filter_all(table(spark, sf_dir, "pages"), [F.length("url") > 20])
    return pages.select("page_id", tx.from_hex(tx.to_hex(F.col("url"))).cast("string").alias("url"), F.replace(tx.uuid3(F.col("url")), F.lit("-"), F.lit("")).alias("uuid"), F.md5("url").alias("digest"))


_CHOICES = {
    "{{area 北京市}}": ("东城区", "海淀区"), "{{street 广东省}}": ("石牌街道", "粤海街道"), "{{scenic 北京市 北京市}}": ("故宫博物院", "颐和园"), "{{between_local_holiday 20240930 20241002}}": ("国庆节",),
    "{{nothing}}": ("",),
}


@query(f"SELECT * FROM (VALUES {', '.join(f"('{rule}', '{value}', true)" for rule, values in _CHOICES.items() for value in values)}) t(rule, value, same_again)")
def q71_mock_choices(spark, sf_dir):
    """All values that rules with several give over the documents, and whether the same seed gives the same again."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, _CHOICES))).alias("rule"))
    key = F.xxhash64("doc_id", "rule")
    made = lambda: mock.mock_known(F.col("rule"), key, [r.strip("{}") for r in _CHOICES], 5)
    rows = rows.withColumn("value", made()).withColumn("again", made())
    return rows.groupBy("rule", "value").agg(F.bool_and(F.col("value") == F.col("again")).alias("same_again"))


@query("""SELECT issue_name, case_count, 0::BIGINT AS error FROM (SELECT p_type AS issue_name, count(*) AS case_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
  UNION ALL SELECT l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag) ORDER BY case_count DESC, issue_name LIMIT 12""")
def q78_frequent_issues(spark, sf_dir):
    """The most frequent names by a sketch that merges, over skewed names."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    names = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("p_type").alias("issue")).union(lines.select("l_returnflag"))
    return counting.frequent_issues(names, 12)


@query("SELECT item_id AS data_index, 'on 2024-01-0' || 1 || ' at ' || CASE WHEN text LIKE '%the%' THEN '除夕' ELSE '' END || ' {{date 1 2 3 4}}' AS kept, CASE WHEN text LIKE '%the%' THEN '除夕 and 除夕' ELSE 'plain' END AS text FROM benchmark")
def q79_mocked_in_columns(spark, sf_dir):
    """Rules in two fields of cases, replaced by column expressions; a field with a rule that fails keeps its case as it was."""
    rule = "{{between_chinese_holiday 20250128 20250129}}"
    has = F.col("text").like("%the%")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("data_index"), has.alias("has"), F.create_map(F.lit("text"), F.when(has, F.lit(f"{rule} and {rule}")).otherwise("plain")).alias("input_item"))
    some = mock.mocked_in_columns(items, ["text", "missing"], 3)
    bad = F.concat(F.lit("on 2024-01-01 at "), F.when(F.col("has"), "除夕").otherwise(""), F.lit(" {{date 1 2 3 4}}"))
    kept = mock.mocked_in_columns(items.withColumn("input_item", F.create_map(F.lit("text"), bad)), ["text"])
    both = some.join(kept.select("data_index", F.col("input_item")["text"].alias("kept")), "data_index")
    return both.select("data_index", "kept", F.col("input_item")["text"].alias("text"))


@query("SELECT conv_id, count(*) AS n, true AS in_order, 0::BIGINT AS late FROM conversations GROUP BY conv_id")
def q80_order_across_batches(spark, sf_dir):
    """Turns that three files bring out of order, released by conversation in their order, whatever batch they came in."""
    path = scratch(spark, "turns")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    turns.withColumn("file", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))).repartition(1, "file").write.partitionBy("file").parquet(f"{path}/queue")
    cases = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/queue")
    ordered.release_all(cases, "conv_id", "turn", 0, f"{path}/results", f"{path}/checkpoint")
    rows = spark.read.parquet(f"{path}/results")
    seen = F.array_sort(F.collect_list(F.struct("batch_id", "turn")))
    by_turn = F.transform(F.array_sort(F.collect_list(F.struct("turn", "batch_id"))), lambda x: F.struct(x["batch_id"], x["turn"]))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), (seen == by_turn).alias("in_order"), F.count_if("__late").alias("late"))


# --- over HTTP ----------------------------------------------------------------------------


class _Service(BaseHTTPRequestHandler):
    """Answers with what it was sent; 503 for every seventh number, nothing for every fifth."""

    protocol_version = "HTTP/1.1"

    def do_POST(self) -> None:
        kind, data = self.headers.get("Content-Type", ""), self.rfile.read(int(self.headers.get("Content-Length", 0)))
        if kind.startswith("multipart/"):
            parts = data.split(b"--" + kind.partition("boundary=")[2].encode())[1:-1]
            body = {p.partition(b'name="')[2].partition(b'"')[0].decode(): p.partition(b"\r\n\r\n")[2].removesuffix(b"\r\n").decode() for p in parts}
        elif kind.startswith("application/x-www-form-urlencoded"):
            body = {k: v[0] for k, v in parse_qs(data.decode()).items()}
        else:
            body = json.loads(data)
        given = parse_qs(urlsplit(self.path).query).get("given", [""])[0]
        number = int(body.get("number") or body["inputs"]["number"])
        text = json.dumps({"data": {"status": "succeeded" if number % 3 else "failed", "outputs": {"double": str(2 * number)}, "error": "three"}} if "inputs" in body else {"reply": f"{body['number']} {given} {self.headers.get('X-Case', '')}", "kind": kind.partition(";")[0]})
        out = b"" if number % 5 == 0 and "inputs" not in body else text.encode()
        self.send_response(503 if number % 7 == 0 and "inputs" not in body else 200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_) -> None: ...


@cache
def service(host: str) -> str:
    """The address of a service in this process, up to its end."""
    server = ThreadingHTTPServer((host, 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://{host}:{server.server_port}"


def _address(spark: SparkSession) -> str:
    return service(spark.conf.get("spark.driver.host", "127.0.0.1"))


@query("""SELECT item_id AS data_index, encoding, item_id % 7 <> 0 AND item_id % 5 <> 0 AS success,
  CASE WHEN item_id % 7 <> 0 AND item_id % 5 <> 0 THEN item_id || ' p' || item_id || ' h' || item_id ELSE 'none' END AS reply, CASE WHEN item_id % 7 <> 0 AND item_id % 5 <> 0 THEN kind ELSE 'none' END AS kind
  FROM benchmark, (VALUES ('json', 'application/json'), ('form', 'application/x-www-form-urlencoded'), ('multipart', 'multipart/form-data')) t(encoding, kind)""")
def q72_http_api(spark, sf_dir):
    address, out = _address(spark), []
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("data_index"), F.create_map(F.lit("number"), F.col("item_id").cast("string")).alias("input_item"))
    for encoding in ("json", "form", "multipart"):

        def made(encoding=encoding):
            return external.HttpTransport(address, body=lambda i, x: {"number": x["number"]}, params=lambda i, x: {"given": f"p{i}"}, headers=lambda i, x: {"X-Case": f"h{i}"}, encoding=encoding)

        rows = external.api_completion(items, made, threads=4, clock=catalog._clock)
        out.append(rows.select("data_index", F.lit(encoding).alias("encoding"), "success", *(vl.get_or(F.col("result_item"), k, "none").alias(k) for k in ("reply", "kind"))))
    return out[0].union(out[1]).union(out[2])


def _doubled(address: str):
    def score(rows: DataFrame, kind: str) -> DataFrame:
        return judged.workflow_scorer(rows, lambda: external.WorkflowClient(address, "key"), lambda x: x["double"].cast("double"), kind, metric="double", total_score=100, threshold=20)

    return score


def _odd(rows: DataFrame, kind: str) -> DataFrame:
    return judged.python_scorer(rows.withColumn("number", F.col("input_item")["number"]), ["number"], {"odd": lambda r: (int(r["number"]) % 2, "parity"), "one": lambda r: (1, "")}, kind)


@query("""WITH i AS (SELECT item_id AS n FROM benchmark ORDER BY item_id LIMIT 20 OFFSET 5),
  r AS (SELECT n, 0 AS pos, 'half' AS metric, n / 2.0::DOUBLE AS score, true AS success FROM i UNION ALL SELECT n, 1, 'double', CASE WHEN n % 3 <> 0 THEN 2 * n ELSE 0 END::DOUBLE, n % 3 <> 0 FROM i
  UNION ALL SELECT n, 2, 'odd', (n % 2)::DOUBLE, true FROM i UNION ALL SELECT n, 3, 'one', 1.0::DOUBLE, true FROM i UNION ALL SELECT n, 4, 'third', n / 4.0::DOUBLE, true FROM i)
  SELECT row_number() OVER (ORDER BY n) - 1 AS data_index, sum(score) FILTER (WHERE success)::DOUBLE AS score, bool_and(success) AS success, string_agg(metric, ',' ORDER BY pos) AS metrics FROM r GROUP BY n""")
def q73_mixed_scorers(spark, sf_dir):
    """A full run of twenty cases from the sixth on, as its config says: scorers in column form, a workflow over HTTP, and plain Python."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("data_index"), F.create_map(F.lit("number"), F.col("item_id").cast("string")).alias("input_item"))
    number = F.col("input_item")["number"].cast("double")
    nodes = [flow.Score(scoring.Scorer(number / 2, "half")), flow.Score(_doubled(_address(spark))), flow.Score(_odd), flow.Score(scoring.Scorer(number / 4, "third"))]
    context = flow.FullRun(RunConfig(offset=5, limit=20), lambda: items, nodes).run()
    names = context.scored().groupBy("data_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scorer_pos", "metric"))), lambda x: x["metric"]), ",").alias("metrics"))
    return context.verdicts(reasons=False).select("data_index", "score", "success").join(names, "data_index")


@query("SELECT item_id AS data_index, 'h' || item_id AS name FROM benchmark")
def q74_fetched_file(spark, sf_dir):
    """A file behind a URL, read by executors after the driver has fetched it."""
    ids = [r.item_id for r in table(spark, sf_dir, "benchmark").select("item_id").toLocalIterator()]  # a small table, to be a file
    text = "\n".join(["id,name", *(f"{i},h{i}" for i in ids)])

    class File(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_) -> None: ...

    with ThreadingHTTPServer(("127.0.0.1", 0), File) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        rows = files.csv(spark, f"http://127.0.0.1:{server.server_port}/cases.csv")
        server.shutdown()
    return rows.select(vl.to_long(F.col("input_item")["id"]).alias("data_index"), F.col("input_item")["name"].alias("name"))
