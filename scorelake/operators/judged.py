"""Scorers and checkers that ask outside: model-judged prompts, workflows, and plain Python functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.http import request
from scorelake.functions.text import markdown_json
from scorelake.operators import checkers, external
from scorelake.operators.ledger import Ledger
from scorelake.operators.scoring import Scorer, score_items


def prompt_scorer(items: DataFrame, prompt: Column, factory: Callable[[], external.ChatModel], model: str = "judge", kind: str = "value", score: Callable[[Column], Column] | None = None, retries: int = 6, wait: float = 10.0, threads: int = 1, timeout: float | None = None, ledger: Ledger | None = None, **config) -> DataFrame:
    """Scorer results of one model-judged metric; config as for Scorer, the rest as for external.llm.

    Replies hold {"score": ..., "reason": ...}, in a code fence or not; ``score`` reads another form.
    A call without a good reply fails the scorer for its case. With a ledger, a case's prompt is asked
    once for each metric, whoever reads the result.
    """
    asked = items.select("data_index", prompt.alias("prompt"))
    replies = external.llm(asked, factory, model, retries, wait, threads=threads, timeout=timeout, ledger=ledger, scope=config.get("metric", ""))
    parsed = external.parsed_reply(F.col("reply"))
    mark = score(F.col("reply")) if score else parsed["score"]
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(mark.isNull(), F.lit("the reply has no score"))
    extra = F.create_map(F.lit("prompt"), F.col("prompt"), F.lit("llmReply"), F.col("reply"))
    one = Scorer(mark, reason=parsed["reason"], error=error, extra=extra, **config)
    return score_items(replies, [one], kind)


def preset_scorer(name: str, items: DataFrame, values: list[Column], factory, **how) -> DataFrame:
    """A preset of external.PRESETS as a scorer; gsb takes the mean of four marks."""
    if name == "gsb":
        how.setdefault("score", external.gsb_score)
    return prompt_scorer(items, external.preset_prompt(name, *values), factory, **{"metric": name} | how)


def next_queries(items: DataFrame, context: Column, factory: Callable[[], external.ChatModel], model: str = "user", retries: int = 6, wait: float = 10.0, ledger: Ledger | None = None) -> DataFrame:
    """The user's next question in each case, from the conversation so far: rows (data_index, query); null where the model has no answer."""
    asked = items.select("data_index", external.preset_prompt("next_query", context).alias("prompt"))
    replies = external.llm(asked, factory, model, retries, wait, valid=lambda reply: bool(reply.strip()), ledger=ledger, scope="next query")
    return replies.select("data_index", F.trim("reply").alias("query"))


def workflow_scorer(items: DataFrame, factory: Callable[[], external.Transport], score: Callable[[Column], Column], kind: str = "value", reason: Callable[[Column], Column] | None = None, threads: int = 1, timeout: float | None = None, ledger: Ledger | None = None, **config) -> DataFrame:
    """Scorer results from the outputs of an external workflow; score and reason read its map of outputs, the rest as for external.api_completion."""
    api = external.api_completion(items, factory, threads, timeout=timeout, ledger=ledger, scope=f"workflow {config.get('metric', '')}".strip()).withColumnRenamed("success", "ok")
    error = F.when(~F.col("ok"), F.lit("the workflow has no result"))
    one = Scorer(score(F.col("result_item")), reason=reason(F.col("result_item")) if reason else None, error=error, start_time=F.col("start_time"), end_time=F.col("end_time"), **config)
    return score_items(api, [one], kind)


def python_scorer(items: DataFrame, columns: list[str], functions: dict[str, Callable[[dict], tuple[float, str]]], kind: str = "value", config: dict[str, dict] | None = None) -> DataFrame:
    """Scorer results of Python functions of a row (score, reason), all in one pass; one that raises fails for its case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"data_index": b["data_index"]}
            rows = b[columns].to_dict("records")
            for k, f in enumerate(functions.values()):
                found = []
                for row in rows:
                    try:
                        found.append((*f(row), None))
                    except Exception as e:
                        found.append((0.0, "", str(e) or type(e).__name__))
                out |= {f"s{k}": [float(x[0]) for x in found], f"r{k}": [x[1] for x in found], f"e{k}": [x[2] for x in found]}
            yield pd.DataFrame(out)

    schema = "data_index bigint" + "".join(f", s{k} double, r{k} string, e{k} string" for k in range(len(functions)))
    scored = items.select("data_index", *columns).mapInPandas(run, schema)
    scorers = [Scorer(F.col(f"s{k}"), name, reason=F.col(f"r{k}"), error=F.col(f"e{k}"), **(config or {}).get(name, {})) for k, name in enumerate(functions)]
    return score_items(scored, scorers, kind)


def checked_items(reply: Column, names: list[str], weights: list[float] | None = None, stars: list[bool] | None = None) -> list[Column]:
    """Check items of a model's reply {name: {"score": ..., "reason": ...}}."""
    parsed = F.from_json(markdown_json(reply), "map<string,struct<score:string,reason:string>>")
    out = []
    for k, name in enumerate(names):
        one = F.try_element_at(parsed, F.lit(name))
        out.append(checkers.check_item(name, one["score"].try_cast("double"), weight=(weights or [1.0] * len(names))[k], star=(stars or [False] * len(names))[k], reason=one["reason"], method="LLM"))
    return out


def checked_in_rounds(replies: Column, names: list[str], **how) -> list[Column]:
    """Check items of an array of replies, one per round: running means of scores, reasons joined."""
    parsed = F.transform(replies, lambda r: F.from_json(markdown_json(r), "map<string,struct<score:string,reason:string>>"))
    named = lambda name: F.transform(parsed, lambda m: F.try_element_at(m, F.lit(name)))
    out = []
    for k, name in enumerate(names):
        marks = named(name)
        scores = F.filter(F.transform(marks, lambda x: x["score"].try_cast("double")), lambda x: x.isNotNull())
        reasons = F.array_join(F.filter(F.transform(marks, lambda x: x["reason"]), lambda x: x.isNotNull() & (x != "")), " | ")
        star = (how.get("stars") or [False] * len(names))[k]
        out.append(checkers.check_item(name, checkers.llm_rounds(scores), weight=(how.get("weights") or [1.0] * len(names))[k], star=star, reason=reasons, method="LLM"))
    return out


def check_prompt(instruction: str, items: dict[str, str], data: Column) -> Column:
    """Prompt of a model-based checker: instruction, form of the answer by item, and the case."""
    form = json.dumps({k: {"score": v, "reason": "理由"} for k, v in items.items()}, ensure_ascii=False)
    return external.prompt(f"{instruction}\n以JSON输出，不要输出其他内容: {form}", data)


@dataclass
class HttpChat:
    """Chat completions over HTTP, as plain JSON or server-sent events; ``post`` is the transport."""

    url: str
    model: str
    key: str = ""
    stream: bool = False
    timeout: float = 120
    headers: dict[str, str] = field(default_factory=dict)
    post: Callable[[str, dict, dict, float], str] | None = None

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "stream": self.stream, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}) | self.headers
        text = (self.post or _post)(self.url, body, headers, self.timeout)
        if not self.stream:
            return json.loads(text)["choices"][0]["message"]["content"]
        parts = []
        for line in text.splitlines():
            data = line.removeprefix("data:").strip()
            if line.startswith("data:") and data != "[DONE]":
                parts.append(json.loads(data)["choices"][0].get("delta", {}).get("content") or "")
        return "".join(parts)


def _post(url: str, body: dict, headers: dict, timeout: float) -> str:
    answer = request(url, "POST", body=body, headers=headers, read_timeout=timeout)
    if answer.status >= 400:
        raise RuntimeError(f"status {answer.status}")
    return answer.text
