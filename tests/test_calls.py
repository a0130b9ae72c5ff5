"""Deadlines of calls, and the ledger of what has been answered."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from scorelake.model import RunConfig
from scorelake.operators import calls, external, judged, ledger, scoring
from scorelake.plans import flow
from scorelake.sinks import reports


def test_answers_in_order_and_so_many_at_a_time():
    lock, now, most = threading.Lock(), 0, 0

    def call(x):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.002 * (x % 5))
        with lock:
            now -= 1
        return x * x

    for threads in (1, 3, 8):
        most = 0
        assert list(calls.answers(range(60), call, threads)) == [x * x for x in range(60)] and most <= threads
    assert most == 8 and list(calls.answers([], call, 2)) == []


def test_late_calls_cost_their_own_row_only():
    hang = threading.Event()
    began = time.monotonic()
    got = list(calls.answers(range(40), lambda x: hang.wait(60) if x in (0, 7) else x, 2, 0.3, lambda x: ("late", x)))
    assert got == [("late", x) if x in (0, 7) else x for x in range(40)] and time.monotonic() - began < 5
    # one thread, all calls hang
    began = time.monotonic()
    assert list(calls.answers(range(4), lambda x: hang.wait(60), 1, 0.1)) == [None] * 4 and time.monotonic() - began < 3
    hang.set()


def test_input_is_read_as_calls_begin_and_errors_come_in_turn():
    read = []

    def source():
        for x in range(1000):
            read.append(x)
            yield x

    out = calls.answers(source(), lambda x: x, 2)
    assert next(out) == 0 and len(read) <= 2 * calls.AHEAD + 2
    with pytest.raises(ZeroDivisionError):
        list(calls.answers([1, 0, 2], lambda x: 1 / x, 2))


def test_a_hanging_api_and_a_hanging_model(spark):
    items = spark.range(12).select(F.col("id").alias("data_index"), F.create_map(F.lit("q"), F.col("id").cast("string")).alias("input_item")).coalesce(1)
    began = time.monotonic()
    got = {r.data_index: r.success for r in external.api_completion(items, lambda: lambda i, m: time.sleep(30) if i == 3 else {"a": m["q"]}, 2, timeout=0.5).collect()}
    assert got == {k: k != 3 for k in range(12)}
    rows = items.select("data_index", F.col("input_item")["q"].alias("prompt"))
    got = {r.data_index: (r.reply, r.error) for r in external.llm(rows, lambda: lambda p: time.sleep(30) if p == "5" else p, "m", retries=1, threads=2, timeout=0.5).collect()}
    assert got == {k: (str(k), None) if k != 5 else (None, "no reply in 0.5 s") for k in range(12)} and time.monotonic() - began < 25


class Noted:
    """A model that leaves a line for each call, and kills its worker once where it is told to."""

    def __init__(self, path, kill=None):
        self.path, self.kill = path, kill

    def __call__(self, prompt):
        flag = f"{self.path}.killed"
        if prompt == self.kill and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        with open(self.path, "a") as f:
            f.write(f"{prompt}\n")
        if prompt.endswith("bad"):
            raise RuntimeError("busy")
        return '{"score": 1, "reason": "fine"}'


def lines(path):
    return sorted(open(path).read().splitlines()) if os.path.exists(path) else []


def cases(spark, n=10):
    return spark.range(n).select(F.col("id").alias("data_index"), F.create_map(F.lit("q"), F.concat(F.lit("c"), F.col("id").cast("string"))).alias("input_item"))


def test_three_sinks_ask_once(spark, tmp_path):
    for book, rounds, want in ((None, 1, 10), (ledger.Ledger(spark, str(tmp_path / "book")), 2, 10)):
        path = str(tmp_path / f"calls-{rounds}")
        judge = lambda rows, kind: judged.prompt_scorer(rows, F.col("input_item")["q"], lambda: Noted(path), kind=kind, retries=1, wait=0, metric="m", ledger=book)
        for _ in range(rounds):
            seen = []
            reports = [flow.Report(lambda c: seen.append(c.verdicts().count())) for _ in range(3)]
            flow.FullRun(RunConfig(), lambda: cases(spark), [flow.Score(scoring.Scorer(F.lit(1.0), "one")), flow.Score(judge)], reports).run()
            assert seen == [10, 10, 10]
        assert len(lines(path)) == want


def test_api_results_are_asked_once_for_all_sinks_and_runs(spark, tmp_path):
    path, book = str(tmp_path / "calls"), ledger.Ledger(spark, str(tmp_path / "book"))
    for _ in range(2):
        context = flow.FullRun(RunConfig(), lambda: cases(spark), [flow.Call(factory=lambda: lambda i, m: {"a": Noted(path)(m["q"])})], ledger=book).run()
        assert context.api_results.where("success").count() == context.api_results.count() == 10
    assert lines(path) == sorted(f"c{k}" for k in range(10))
    # another input of a case is another question
    flow.FullRun(RunConfig(), lambda: cases(spark).withColumn("input_item", F.when(F.col("data_index") == 3, F.create_map(F.lit("q"), F.lit("new"))).otherwise(F.col("input_item"))), [flow.Call(factory=lambda: lambda i, m: {"a": Noted(path)(m["q"])})], ledger=book).run()
    assert lines(path) == sorted(["new", *(f"c{k}" for k in range(10))])


def test_a_killed_worker_loses_its_own_task_only(spark, tmp_path):
    path, book = str(tmp_path / "calls"), ledger.Ledger(spark, str(tmp_path / "book"), per_task=1)
    rows = cases(spark).select("data_index", F.col("input_item")["q"].alias("prompt"))
    ask = lambda: external.llm(rows, lambda: Noted(path, "c7"), "m", retries=1, wait=0, ledger=book)
    with pytest.raises(Exception, match="(?i)worker|crash|EOF"):
        ask().collect()
    before = len(lines(path))
    got = ask()
    assert {r.reply for r in got.collect()} == {'{"score": 1, "reason": "fine"}'} and got.count() == 10
    after = lines(path)
    assert set(after) == {f"c{k}" for k in range(10)} and before < 10
    # those whose tasks had ended aren't asked again; tasks that ran beside the killed one may be
    assert len(after) <= 10 + 4
    ask().count()
    assert lines(path) == after


def test_failed_answers_are_asked_again_and_repeated_cases_once(spark, tmp_path):
    path, book = str(tmp_path / "calls"), ledger.Ledger(spark, str(tmp_path / "book"))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b bad"), (1, "c")], "data_index bigint, prompt string")
    ask = lambda: sorted((r.data_index, r.prompt, r.error) for r in external.llm(rows, lambda: Noted(path), "m", retries=1, wait=0, ledger=book).collect())
    assert ask() == ask() == [(1, "a", None), (1, "a", None), (1, "c", None), (2, "a", None), (3, "b bad", "busy")]
    assert lines(path) == ["a", "a", "b bad", "b bad", "c"]
    assert sorted(map(tuple, book.calls("m", external.REPLIES).collect())) == [(1, 4), (2, 1)]
    assert external.llm(rows.limit(0), lambda: Noted(path), "other", ledger=book).count() == 0


def test_cases_are_delivered_once(spark, tmp_path):
    """Also after a failing receiver and a killed worker, and with changed cases."""
    path, book = str(tmp_path / "sent"), ledger.Ledger(spark, str(tmp_path / "book"), per_task=2)
    nested = lambda df: reports.nested_cases(df.withColumn("extra", F.create_map().cast("map<string,string>")))
    down = str(tmp_path / "down")
    open(down, "w").close()

    def send(case, key):
        index = case["dataIndex"]
        if index == 7 and os.path.exists(down):
            raise RuntimeError("not now")
        with open(path, "a") as f:
            f.write(f"{index} {key}\n")

    first = reports.delivered(nested(cases(spark)), send, book)
    assert sorted((r.data_index, r.sent, r.error) for r in first.collect()) == [(k, k != 7, "not now" if k == 7 else None) for k in range(10)]
    os.remove(down)
    assert reports.delivered(nested(cases(spark)), send, book).where("sent").count() == 10
    assert [x.split()[0] for x in lines(path)] == sorted(str(k) for k in range(10)) and len({x.split()[1] for x in lines(path)}) == 10
    changed = cases(spark).withColumn("input_item", F.when(F.col("data_index") == 2, F.create_map(F.lit("q"), F.lit("other"))).otherwise(F.col("input_item")))
    reports.delivered(nested(changed), send, book).count()
    assert len(lines(path)) == 11
    # another report sends its own
    reports.delivered(nested(cases(spark, 3)), send, book, "second").count()
    assert len(lines(path)) == 14
