"""Aggregated results of a run: rates, times, scores, dispersion, model usage and issue attribution."""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.values import nearest_rank
from scorelake.operators import ranks

PERCENTILES = (99, 95, 90, 80, 70, 60, 50)
UNKNOWN_ISSUE = "未知问题"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _mean(x: str, where: str) -> Column:
    """Mean over a decimal sum, so it doesn't depend on the order of rows."""
    return _zero(F.expr(f"cast(sum(cast({x} as decimal(18,6))) FILTER (WHERE {where}) as double) / nullif(count(*) FILTER (WHERE {where}), 0)"))


def rate_metrics() -> dict[str, Column]:
    """Counts and their shares of all cases; a case without API or eval result is neither success nor error."""
    count = lambda cond: F.count_if(F.expr(cond))
    counts = {
        "pass": "eval_success is not null and pass",
        "unpass": "eval_success is not null and not pass",
        "eval_success": "eval_success",
        "eval_error": "not eval_success",
        "completion_success": "eval_success is not null and api_success",
        "completion_error": "eval_success is not null and not api_success",
    }
    out = {"total_count": F.count("*")}
    out |= {f"{k}_count": count(v) for k, v in counts.items()}
    out |= {f"{k}_rate": _zero(F.try_divide(count(v), F.count("*"))) for k, v in counts.items()}
    return out


def time_metrics(x: str, where: str, name: str, percentiles: tuple[int, ...] = ()) -> dict[str, Column]:
    out = {f"avg_{name}": _mean(x, where)}
    out |= {f"{f}_{name}": _zero(F.expr(f"cast({f}({x}) FILTER (WHERE {where}) as double)")) for f in ("min", "max")}
    return out | {f"tp{p}_{name}": _zero(nearest_rank(x, p, where).cast("double")) for p in percentiles}


def score_metrics(exact: bool = True) -> dict[str, Column]:
    """exact: percentiles by nearest rank, from counts per different score; else approximate ones of bounded memory."""
    where = "eval_success"
    out = {f"{f}_score": _zero(F.expr(f"{f}(score) FILTER (WHERE {where})")) for f in ("min", "max")} | {"avg_score": _mean("score", where)}
    for p in PERCENTILES:
        out[f"tp{p}_score"] = _zero(nearest_rank("score", p, where) if exact else F.expr(f"approx_percentile(score, {p / 100}, 10000) FILTER (WHERE {where})"))
    return out | {"stddev_score": _zero(F.expr(f"stddev_pop(score) FILTER (WHERE {where})"))}


def basic_metrics(exact: bool = True) -> dict[str, Column]:
    """All metrics over rows (api_success, api_time_cost, eval_success, eval_time_cost, score, pass)."""
    return (
        rate_metrics()
        | time_metrics("api_time_cost", "api_success", "api_time", PERCENTILES)
        | time_metrics("eval_time_cost", "eval_success", "eval_time")
        | score_metrics(exact)
    )


#: Values of which there are percentiles: an expression and the condition under which it counts.
API_TIME, SCORE = {"api_time": ("api_time_cost", "api_success")}, {"score": ("score", "eval_success")}


def summarized(cases: DataFrame, dims: list[str], metrics: dict[str, Column], values: dict[str, tuple[str, str]], percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """Metrics by dimensions, and exact percentiles of the values in bounded memory (see ranks.percentiles), 0 where there are no values.

    Without dimensions it is one row, of zeros when there are no cases.
    """
    plain = cases.groupBy(*dims).agg(*(c.alias(k) for k, c in metrics.items()))
    found = ranks.percentiles(cases, dims, values, percents)
    names = [c for c in found.columns if c not in dims]
    keys = [f"__d{k}" for k in range(len(dims))]
    found = found.select(*(F.col(f"`{d}`").alias(k) for d, k in zip(dims, keys, strict=True)), *names)
    if not dims:  # a single row beside another one
        row = found.first()
        return plain.select("*", *(F.lit(row[c] if row else None).cast("double").alias(c) for c in names)).fillna(0.0, names)
    same = reduce(lambda a, b: a & b, (F.col(f"`{d}`").eqNullSafe(F.col(k)) for d, k in zip(dims, keys, strict=True)))
    return plain.join(found, same).drop(*keys).withColumns({c: _zero(F.col(c).cast("double")) for c in names})


def basic_count(cases: DataFrame, exact: bool = True) -> DataFrame:
    """One row; zeros when there are no cases. exact: percentiles by nearest rank; else approximate ones, all in one pass."""
    if not exact:
        return cases.agg(*(c.alias(k) for k, c in basic_metrics(False).items()))
    return summarized(cases, [], _plain_metrics(), API_TIME | SCORE).select(*basic_metrics())


def _plain_metrics() -> dict[str, Column]:
    return {k: c for k, c in basic_metrics().items() if not k.startswith("tp")}


def count_by(cases: DataFrame, *dims: str, rollup: bool = False, cube: bool = False, metrics: dict[str, Column] | None = None) -> DataFrame:
    """The same metrics by dimensions, with their subtotals for rollup or cube."""
    if metrics is None:
        return _basic_count_by(cases, [*dims], rollup, cube)
    grouped = cases.rollup(*dims) if rollup else cases.cube(*dims) if cube else cases.groupBy(*dims)
    return grouped.agg(*(c.alias(k) for k, c in metrics.items()))


def _basic_count_by(cases: DataFrame, dims: list[str], rollup: bool, cube: bool) -> DataFrame:
    """All basic metrics with exact percentiles, one grouping set after another."""
    sets = [c for n in range(len(dims), -1, -1) for c in combinations(dims, n)] if cube else [tuple(dims[:n]) for n in range(len(dims), -1, -1)] if rollup else [tuple(dims)]
    kinds, parts = dict(cases.dtypes), []
    for some in sets:
        rows = summarized(cases, [*some], _plain_metrics(), API_TIME | SCORE)
        rows = rows.withColumns({d: F.lit(None).cast(kinds[d]) for d in dims if d not in some})
        parts.append(rows.select(*dims, *basic_metrics()))
    return reduce(DataFrame.unionByName, parts)


# --- counts that merge ------------------------------------------------------------------

#: Accuracy of the sketches in mergeable counts: places are wrong by some 0.15 % at most, and right up to so many values.
SKETCH = 2000
_COUNTS = ("pass", "unpass", "eval_success", "eval_error", "completion_success", "completion_error")
_PARTS = {"api_time": ("api_time_cost", "api_success"), "eval_time": ("eval_time_cost", "eval_success"), "score": ("score", "eval_success")}
_SKETCHED = ("api_time", "score")


def partial_counts(cases: DataFrame, *dims: str) -> DataFrame:
    """What basic_metrics need of some cases, in a row of bounded size by dimensions: counts, decimal sums, ends and sketches.

    Such rows of disjoint sets of cases can be written, added to, and merged by merged_counts at any time. Scores count
    with six decimals in sums, as everywhere.
    """
    rates = rate_metrics()
    parts = {"total_count": rates["total_count"]} | {f"{k}_count": rates[f"{k}_count"] for k in _COUNTS}
    for name, (x, where) in _PARTS.items():
        kept = f"CASE WHEN {where} THEN {x} END"
        parts |= {f"n_{name}": F.expr(f"count_if({where})"), f"sum_{name}": F.expr(f"sum(cast({kept} as decimal(18,6)))"), f"min_{name}": F.expr(f"min({kept})").cast("double"), f"max_{name}": F.expr(f"max({kept})").cast("double")}
        if name in _SKETCHED:
            parts[f"sketch_{name}"] = F.expr(f"kll_sketch_agg_double(cast({kept} as double), {SKETCH})")
    parts["squares_score"] = F.expr("sum(cast(CASE WHEN eval_success THEN score END as decimal(12,6)) * cast(CASE WHEN eval_success THEN score END as decimal(12,6)))")
    return cases.groupBy(*dims).agg(*(c.alias(k) for k, c in parts.items()))


def merged_counts(partials: DataFrame, *dims: str) -> DataFrame:
    """All basic metrics from partial counts: rates, means, ends and deviation as of all cases at once, percentiles by sketch."""
    merged = {"total_count": F.sum("total_count")} | {f"{k}_count": F.sum(f"{k}_count") for k in _COUNTS}
    for name in _PARTS:
        merged |= {f"n_{name}": F.sum(f"n_{name}"), f"sum_{name}": F.sum(f"sum_{name}"), f"min_{name}": F.min(f"min_{name}"), f"max_{name}": F.max(f"max_{name}")}
        if name in _SKETCHED:
            merged[f"sketch_{name}"] = F.expr(f"kll_merge_agg_double(sketch_{name}, {SKETCH})")
    merged["squares_score"] = F.sum("squares_score")
    rows = partials.groupBy(*dims).agg(*(c.alias(k) for k, c in merged.items()))
    out = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total_count", *(f"{k}_count" for k in _COUNTS))}
    out |= {f"{k}_rate": _zero(F.try_divide(F.col(f"{k}_count"), F.col("total_count"))) for k in _COUNTS}
    for name in _PARTS:
        n = F.nullif(F.col(f"n_{name}"), F.lit(0))
        out |= {f"avg_{name}": _zero(F.col(f"sum_{name}").cast("double") / n), f"min_{name}": _zero(F.col(f"min_{name}")), f"max_{name}": _zero(F.col(f"max_{name}"))}
        if name in _SKETCHED:
            place = lambda p, name=name: F.when(F.col(f"n_{name}") > 0, F.expr(f"kll_sketch_get_quantile_double(sketch_{name}, {p / 100}D)"))
            out |= {f"tp{p}_{name}": _zero(place(p)) for p in PERCENTILES}
    n = F.col("n_score").cast("decimal(20,0)")
    squares = (n * F.col("squares_score").cast("decimal(30,12)") - F.col("sum_score").cast("decimal(20,6)") * F.col("sum_score").cast("decimal(20,6)")).cast("double")
    out["stddev_score"] = _zero(F.sqrt(F.greatest(squares, F.lit(0.0))) / F.nullif(F.col("n_score"), F.lit(0)))
    return rows.select(*dims, *(c.alias(k) for k, c in out.items())).select(*dims, *basic_metrics())


def cases_of(api_results: DataFrame, verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item for the metrics above, by left joins on data_index."""
    api = api_results.select("data_index", F.col("success").alias("api_success"), F.col("time_cost").alias("api_time_cost"))
    ev = verdicts.select("data_index", F.col("success").alias("eval_success"), F.col("time_cost").alias("eval_time_cost"), "score", "pass")
    return items.select("data_index").join(api, "data_index", "left").join(ev, "data_index", "left")


def llm_usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and prices by model; prices (model, in_price, out_price) are per million tokens."""
    used = calls.where("success").groupBy("model").agg(F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"))
    one = lambda c: F.round(F.col(c).cast("decimal(18,6)") / F.lit(1_000_000), 10).cast("decimal(20,10)")
    cost = lambda n, c: F.coalesce((F.col(n).cast("decimal(18,0)") * one(c)).cast("double"), F.lit(0.0))
    out = used.join(prices, "model", "left")
    return out.select("model", "in_tokens", "out_tokens", (F.col("in_tokens") + F.col("out_tokens")).alias("total_tokens"), cost("in_tokens", "in_price").alias("in_cost"), cost("out_tokens", "out_price").alias("out_cost"))


def issues(replies: DataFrame) -> DataFrame:
    """Issues of each case from replies (data_index, reply) with issues between #: rows (data_index, issue); an empty reply is the unknown issue."""
    named = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("reply", F.lit("")), "#"), lambda x: F.trim(x)), lambda x: x != ""))
    return replies.select("data_index", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(UNKNOWN_ISSUE)))).alias("issue"))


def _cases_by_issue(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("issue").alias("issue_name")).agg(F.count("*").alias("case_count"))


def attribute_counts(found: DataFrame, top: int | None = None) -> DataFrame:
    """Rows (issue_name, case_count), most cases first. found: rows (data_index, issue) without repeats, as issues gives them."""
    out = _cases_by_issue(found).orderBy(F.desc("case_count"), "issue_name")
    return out.limit(top) if top is not None else out


def attribute_cases(found: DataFrame) -> DataFrame:
    """Rows (issue_name, data_index, case_count): the cases of each issue in long form, so that no row holds all of one issue."""
    return found.select(F.col("issue").alias("issue_name"), "data_index").join(_cases_by_issue(found), "issue_name")


def attribute_index(found: DataFrame, top: int | None = None) -> DataFrame:
    """Rows (issue_name, case_ids, case_count), most cases first: for reports, as all ids of an issue are in one row."""
    out = found.groupBy(F.col("issue").alias("issue_name")).agg(F.array_sort(F.collect_set("data_index")).alias("case_ids"))
    out = out.withColumn("case_count", F.size("case_ids").cast("bigint")).orderBy(F.desc("case_count"), "issue_name")
    return out.limit(top) if top is not None else out


#: Issue names that a prompt lists at most, and names that a sketch of frequent ones keeps track of.
LISTED, TRACKED = 200, 10_000


def frequent_issues(found: DataFrame, top: int = LISTED, tracked: int = TRACKED) -> DataFrame:
    """Rows (issue_name, case_count, error): the most frequent issues by a mergeable sketch of bounded size, most cases first.

    Tasks keep ``tracked`` names at most and their sketches are merged, whatever the number of different names. A count is never
    too low, and too high by error at most, the share of 4 / tracked of all rows; with fewer names than three quarters of
    tracked all counts are exact. Ties go by name among those that the sketch gives.
    """
    if not 0 < top <= tracked:
        raise ValueError("top must be from 1 to tracked")
    sketch = found.agg(F.expr(f"approx_top_k(issue, {top}, {tracked})").alias("top"), F.count("issue").alias("n"), F.approx_count_distinct("issue").alias("names"))
    rows = sketch.select(F.explode("top").alias("x"), "n", "names").select(F.col("x.item").alias("issue_name"), F.col("x.count").alias("case_count"), "n", "names")
    error = F.when(F.col("names") < tracked // 2, F.lit(0)).otherwise(F.ceil(F.col("n") * 4 / tracked)).cast("bigint")
    return rows.select("issue_name", "case_count", error.alias("error")).orderBy(F.desc("case_count"), "issue_name")


def synonym_prompt(found: DataFrame, instruction: str, top: int = LISTED) -> str:
    """Prompt that asks a model to put the most frequent issue names together: {standard: [synonyms]}, which synonym_table reads. Its length is bounded."""
    names = [r.issue_name for r in frequent_issues(found, top).collect()]
    form = json.dumps({"标准名称": ["同义名称"]}, ensure_ascii=False)
    return f"{instruction}\n以JSON输出，不要输出其他内容: {form}\n" + "\n".join(names)


def normalized_issues(found: DataFrame, synonyms: DataFrame, mode: str = "strict") -> DataFrame:
    """Issues under their standard names; synonyms (standard, synonym). strict drops issues without one, keep_unmapped keeps them."""
    if mode not in ("strict", "keep_unmapped"):
        raise ValueError(f"mode must be strict or keep_unmapped: {mode}")
    out = found.join(synonyms, F.col("issue") == F.col("synonym"), "inner" if mode == "strict" else "left")
    return out.select("data_index", F.coalesce("standard", "issue").alias("issue")).distinct()


def synonym_table(spark, reply: str) -> DataFrame:
    """Rows (standard, synonym) of a model's reply {standard: [synonyms]}, in a code fence or not; none if it can't be parsed."""
    from scorelake.functions.text import markdown_json

    rows = spark.createDataFrame([(reply,)], "reply string").select(F.from_json(markdown_json(F.col("reply")), "map<string,array<string>>").alias("m"))
    return rows.select(F.explode("m").alias("standard", "list")).select("standard", F.explode("list").alias("synonym")).distinct()
