"""Scorers, final-score strategies and verdicts, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import text as tx
from scorelake.model import SCORER_RESULTS

# Names and words that results carry.
DEFAULT_METRIC = "未命名指标"
METRIC_KEY, REASON_KEY = "评估指标", "评估理由"
SIMILARITY_REASON, ABOVE, BELOW = "相似度为%.4f，%s阈值%.4f", "大于", "小于"


@dataclass
class Scorer:
    """A metric: score, reason and the rest are columns over a case's row.

    error, if given, is null or the message of a failure. total_score is the configured total; the
    column own_total counts instead when dynamic_total is set. With value, a column that is
    costly, score, reason and extra may be functions of it: it is evaluated once for all of them.
    """

    score: Column | Callable[[Column], Column]
    metric: str = DEFAULT_METRIC
    reason: Column | Callable[[Column], Column] | None = None
    total_score: float = 1.0
    threshold: float = 0.0
    star: bool = False
    dynamic_total: bool = False
    own_total: Column | None = None
    error: Column | None = None
    extra: Column | Callable[[Column], Column] | None = None
    start_time: Column | None = None
    end_time: Column | None = None
    value: Column | None = None

    def result(self, pos: int, kind: str) -> Column:
        """Struct of one scorer result."""
        if self.value is None:
            return self._result(pos, kind)
        of = lambda c, v: c(v) if callable(c) and not isinstance(c, Column) else c
        return tx.bound(self.value, lambda v: replace(self, value=None, score=of(self.score, v), reason=of(self.reason, v), extra=of(self.extra, v))._result(pos, kind))

    def _result(self, pos: int, kind: str) -> Column:
        failed = self.error.isNotNull() if self.error is not None else F.lit(False)
        fixed = F.lit(float(self.total_score))
        total = F.coalesce(self.own_total.cast("double"), fixed) if self.dynamic_total and self.own_total is not None else fixed
        score, empty = F.coalesce(self.score.cast("double"), F.lit(0.0)), F.create_map().cast("map<string,string>")
        start, end = (F.coalesce(t, F.lit(0)).cast("bigint") if t is not None else F.lit(0).cast("bigint") for t in (self.start_time, self.end_time))
        reason = F.coalesce(self.reason.cast("string"), F.lit("")) if self.reason is not None else F.lit("")
        rate = score_rate(score, total)
        return F.struct(
            F.lit(pos).alias("scorer_pos"),
            F.lit(self.metric).alias("metric"),
            F.when(failed, 0.0).otherwise(score).alias("score"),
            F.when(failed, fixed).otherwise(total).alias("total_score"),
            F.when(failed, 0.0).otherwise(rate).alias("score_rate"),
            F.lit(float(self.threshold)).alias("threshold"),
            F.lit(self.star).alias("star"),
            (~failed & scorer_pass(score, rate, F.lit(float(self.threshold)), kind)).alias("pass"),
            (~failed).alias("success"),
            F.when(failed, F.concat(F.lit("Error: "), self.error)).otherwise(reason).alias("reason") if self.error is not None else reason.alias("reason"),
            (F.coalesce(self.extra, empty) if self.extra is not None else empty).alias("extra"),
            F.when(failed, 0).otherwise(start).alias("start_time"),
            F.when(failed, 0).otherwise(end).alias("end_time"),
            F.when(failed, 0).otherwise(end - start).alias("time_cost"),
        )


def score_rate(score: Column, total: Column) -> Column:
    return F.when(total > 0, score / total).otherwise(0.0)


def scorer_pass(score: Column, rate: Column, threshold: Column, kind: str) -> Column:
    """Whether one scorer passes: by its score under strategies of kind value, by its rate under kind rate."""
    if kind not in ("value", "rate"):
        raise ValueError(f"neither a value nor a rate strategy: {kind}")
    return (score if kind == "value" else rate) >= threshold


def _all_results(scorers: list[Scorer], kind: str) -> Column:
    return F.array(*(s.result(k, kind) for k, s in enumerate(scorers)))


def score_items(items: DataFrame, scorers: list[Scorer], kind: str = "value") -> DataFrame:
    """Long scorer results of all scorers from one pass over the items: one projection, no join back."""
    out = items.select("data_index", F.inline(_all_results(scorers, kind)))
    return out.select(*(c.split()[0] for c in SCORER_RESULTS.split(", ")))


def vector_similarity(a: Column, b: Column, threshold: float, **config) -> Scorer:
    """1 if the term-frequency cosine of two texts exceeds the threshold; the cosine is computed once."""
    over = lambda sim: sim > threshold
    return Scorer(
        lambda sim: over(sim).cast("double"),
        reason=lambda sim: F.format_string(SIMILARITY_REASON, sim, F.when(over(sim), ABOVE).otherwise(BELOW), F.lit(threshold)),
        extra=lambda sim: F.create_map(F.lit("similarity"), sim.cast("string"), F.lit("similarityThreshold"), F.lit(str(threshold))),
        value=F.coalesce(tx.tf_cosine(a, b), F.lit(0.0)),
        **config,
    )


# --- final-score strategies --------------------------------------------------------------


def _sum(x: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(x.cast("decimal(18,6)")).cast("double")


@dataclass(frozen=True)
class Strategy:
    """kind: whether thresholds of scorers are for scores (value) or rates (rate)."""

    name: str
    kind: str
    total: Callable[[], Column]


def _if(where: Column, x: Column) -> Column:
    return F.when(where, x)


STRATEGIES: dict[str, Callable[[], Column]] = {
    "sum": lambda: F.coalesce(_sum(_if(F.col("success"), F.col("score"))), F.lit(0.0)),
    "avg": lambda: F.coalesce(F.try_divide(_sum(_if(F.col("score") >= 0, F.col("score"))), F.count_if(F.col("score") >= 0)), F.lit(0.0)),
    # starts with the first score even if it is negative
    "min": lambda: F.least(F.min_by("score", "scorer_pos"), F.min(_if(F.col("score") >= 0, F.col("score")))),
    "max": lambda: F.max("score"),
    "sum_rate": lambda: _sum(F.col("score_rate")),
    "avg_rate": lambda: _sum(F.col("score_rate")) / F.count("*"),
    "max_rate": lambda: F.greatest(F.lit(0.0), F.max("score_rate")),
    # starts from 0, so it is 0 unless a rate is negative
    "min_rate": lambda: F.least(F.lit(0.0), F.min("score_rate")),
    "min_rate_true": lambda: F.min("score_rate"),
}
KINDS = {name: "rate" if "rate" in name else "value" for name in STRATEGIES}


def strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"no such strategy: {name}; there are {', '.join(STRATEGIES)}")
    return Strategy(name, KINDS[name], STRATEGIES[name])


def final_score(results: DataFrame, by: str | Strategy) -> DataFrame:
    """data_index and score of each case."""
    by = strategy(by) if isinstance(by, str) else by
    return results.groupBy("data_index").agg(by.total().alias("score"))


# --- verdicts ----------------------------------------------------------------------------


def _ordered(*names: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("scorer_pos", *names)))


def reason_json() -> Column:
    """Aggregate: JSON array of metric and reason in the order of scorers."""
    return _reasons(_ordered("metric", "reason"))


def _reasons(results: Column) -> Column:
    entry = lambda x: F.create_map(F.lit(METRIC_KEY), x["metric"], F.lit(REASON_KEY), F.coalesce(x["reason"], F.lit("")))
    return F.to_json(F.transform(results, entry))


def _prefix(results: Column) -> Column:
    """Success and times as they are after the last scorer up to which all succeeded, of results in their order."""
    zero = F.lit(0).cast("bigint")
    first = F.struct(F.lit(True).alias("ok"), F.lit(False).alias("success"), zero.alias("start"), zero.alias("end"), zero.alias("cost"))

    def step(a: Column, x: Column) -> Column:
        ok, seen = a["ok"] & x["success"], a["success"]
        return F.struct(
            ok.alias("ok"),
            (a["success"] | ok).alias("success"),
            F.when(ok, F.when(seen, F.least(a["start"], x["start_time"])).otherwise(x["start_time"])).otherwise(a["start"]).alias("start"),
            F.when(ok, F.greatest(a["end"], x["end_time"])).otherwise(a["end"]).alias("end"),
            F.when(ok, F.greatest(a["cost"], x["time_cost"])).otherwise(a["cost"]).alias("cost"),
        )

    return F.aggregate(results, first, step)


def verdicts(results: DataFrame, by: str | Strategy = "sum", threshold: float = 0.0, mode: str = "strict", reasons: bool = True, items: DataFrame | None = None) -> DataFrame:
    """One verdict per case from its scorer results.

    A case passes if no star scorer fails and its final score reaches the threshold. In mode
    strict it succeeds if all scorers do, and has times only then; in mode prefix success and
    times are those of the longest run of successes from the first scorer. The time cost is the
    largest of the scorers'. With items, cases without results come along with score 0 and false.
    """
    by = strategy(by) if isinstance(by, str) else by
    if mode not in ("strict", "prefix"):
        raise ValueError(f"mode must be strict or prefix: {mode}")
    ok, zero = F.bool_and("success"), F.lit(0).cast("bigint")
    aggs = [by.total().alias("score"), F.bool_or(F.col("star") & ~F.col("pass")).alias("veto")]
    if reasons:
        aggs.append(reason_json().alias("reason"))
    if mode == "strict":
        aggs += [ok.alias("success"), F.when(ok, F.min("start_time")).otherwise(zero).alias("start_time"), F.when(ok, F.max("end_time")).otherwise(zero).alias("end_time"), F.when(ok, F.max("time_cost")).otherwise(zero).alias("time_cost")]
    else:
        aggs.append(_prefix(_ordered("success", "start_time", "end_time", "time_cost")).alias("p"))
    out = results.groupBy("data_index").agg(*aggs)
    if mode == "prefix":
        out = out.select("*", *(F.col(f"p.{a}").alias(b) for a, b in (("success", "success"), ("start", "start_time"), ("end", "end_time"), ("cost", "time_cost"))))
    if items is not None:
        out = items.select("data_index").join(out, "data_index", "left")
    limit = F.lit(float(threshold) if threshold > 0 else 0.0)
    score, none = F.coalesce("score", F.lit(0.0)), F.col("score").isNull()
    return out.select(
        "data_index",
        score.alias("score"),
        *([F.coalesce("reason", F.lit("")).alias("reason")] if reasons else []),
        *(F.coalesce(t, F.lit(0)).cast("bigint").alias(t) for t in ("start_time", "end_time", "time_cost")),
        F.coalesce("success", F.lit(False)).alias("success"),
        (~none & ~F.coalesce("veto", F.lit(False)) & (score >= limit)).alias("pass"),
        limit.alias("threshold"),
        F.lit(by.name).alias("strategy"),
    )


# --- the same folds inside a row ------------------------------------------------------------


def _total(values: Column) -> Column:
    dec = "decimal(28,6)"
    return F.aggregate(values, F.lit(0).cast(dec), lambda a, x: (a + F.coalesce(x, F.lit(0.0)).cast("decimal(18,6)")).cast(dec)).cast("double")


def _row_score(results: Column, by: str) -> Column:
    """Final score of an array of results, as the strategies give it over rows."""
    of = lambda rows, name: F.transform(rows, lambda r: r[name])
    score, rate, good = of(results, "score"), of(results, "score_rate"), F.filter(results, lambda r: r["score"] >= 0)
    return {
        "sum": lambda: _total(of(F.filter(results, lambda r: r["success"]), "score")),
        "avg": lambda: F.coalesce(F.try_divide(_total(of(good, "score")), F.size(good)), F.lit(0.0)),
        "min": lambda: F.least(F.get(score, F.lit(0)), F.array_min(of(good, "score"))),
        "max": lambda: F.array_max(score),
        "sum_rate": lambda: _total(rate),
        "avg_rate": lambda: _total(rate) / F.size(results),
        "max_rate": lambda: F.greatest(F.lit(0.0), F.array_max(rate)),
        "min_rate": lambda: F.least(F.lit(0.0), F.array_min(rate)),
        "min_rate_true": lambda: F.array_min(rate),
    }[by]()


def item_verdicts(items: DataFrame, scorers: list[Scorer], by: str = "sum", threshold: float = 0.0, mode: str = "strict", reasons: bool = True) -> DataFrame:
    """verdicts(score_items(items, scorers), by, ...) for items with one row per data_index, folded inside each row: no shuffle."""
    if mode not in ("strict", "prefix"):
        raise ValueError(f"mode must be strict or prefix: {mode}")
    limit, zero = F.lit(float(threshold) if threshold > 0 else 0.0), F.lit(0).cast("bigint")

    def fold(r: Column) -> Column:
        score, veto = _row_score(r, by), F.exists(r, lambda x: x["star"] & ~x["pass"])
        if mode == "strict":
            ok = F.forall(r, lambda x: x["success"])
            times = {t: F.when(ok, f(F.transform(r, lambda x: x[t]))).otherwise(zero) for t, f in (("start_time", F.array_min), ("end_time", F.array_max), ("time_cost", F.array_max))}  # noqa: B023
            return F.struct(score.alias("score"), veto.alias("veto"), *([_reasons(r).alias("reason")] if reasons else []), *(c.alias(t) for t, c in times.items()), ok.alias("success"))
        p = _prefix(r)
        return tx.bound(p, lambda p: F.struct(score.alias("score"), veto.alias("veto"), *([_reasons(r).alias("reason")] if reasons else []), *(p[b].alias(a) for a, b in (("start_time", "start"), ("end_time", "end"), ("time_cost", "cost"), ("success", "success")))))

    kind = strategy(by).kind
    out = items.select("data_index", tx.bound(_all_results(scorers, kind), fold).alias("v")).select("data_index", "v.*")
    return out.select(
        "data_index", "score", *(["reason"] if reasons else []), "start_time", "end_time", "time_cost", "success",
        (~F.col("veto") & (F.col("score") >= limit)).alias("pass"), limit.alias("threshold"), F.lit(by).alias("strategy"),
    )


def first_results(results: DataFrame) -> DataFrame:
    """The first result of each case and scorer, when a result was delivered more than once."""
    return results.dropDuplicates(["data_index", "scorer_pos"])
