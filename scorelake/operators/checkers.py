"""Checkers: weighted and must-pass check items folded to a checker's score, and checkers to a scorer's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import bound

# Reasons of check items without a check.
NOT_SUPPORTED, NOT_EXECUTED = "不支持检查", "未执行检查"
METHODS = ("LLM", "RULE", "NONE")


def check_item(name: str, score: Column | float | None = None, *, total: float = 1.0, weight: float = 1.0, star: bool = False, support: Column | bool = True, default: float = 0.0, reason: Column | None = None, method: str = "RULE") -> Column:
    """Struct of a check item; without support it has the default score, without a score it is not executed."""
    if not name.strip():
        raise ValueError("a check item needs a name")
    if total <= 0 or weight < 0 or default > total:
        raise ValueError("total must be positive, weight not negative, and the default at most the total")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    support = F.coalesce(support, F.lit(False)) if isinstance(support, Column) else F.lit(support)
    score = score.cast("double") if isinstance(score, Column) else F.lit(score).cast("double")
    ran = support & score.isNotNull()
    said = F.coalesce(reason.cast("string"), F.lit("")) if reason is not None else F.lit("")
    return F.struct(
        F.lit(name).alias("name"),
        F.when(ran, score).when(support, 0.0).otherwise(float(default)).alias("score"),
        F.lit(float(total)).alias("total_score"),
        F.lit(float(weight)).alias("weight"),
        F.lit(star).alias("star"),
        support.alias("support"),
        ran.alias("executed"),
        F.lit(method).alias("check_method"),
        F.when(ran, said).when(support, NOT_EXECUTED).otherwise(NOT_SUPPORTED).alias("reason"),
    )


def _fold(values: Column, how: str) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    if how == "sum":
        out = total
    elif how == "avg":
        out = F.try_divide(total, F.size(values))
    elif how == "min":
        out = F.array_min(values)
    else:
        raise ValueError(f"merge must be sum, avg or min: {how}")
    return F.coalesce(out, F.lit(0.0))


def item_score(items: Column, how: str) -> Column:
    """Score of an array of check items: 0 if a star item has 0; else of score * weight of those not negative."""
    veto = F.exists(items, lambda i: i["star"] & (i["score"] == 0))
    good = F.filter(items, lambda i: i["score"] >= 0)
    return F.when(veto, 0.0).otherwise(_fold(F.transform(good, lambda i: i["score"] * i["weight"]), how))


def checker(name: str, items: list[Column], how: str = "sum", *, star: bool = False, support: Column | None = None) -> Column:
    """Struct of a checker: its score, total, reason and items. Without support it has no items and score 0."""
    array = F.array(*items)
    if support is not None:
        array = F.when(F.coalesce(support, F.lit(False)), array).otherwise(F.filter(array, lambda _: F.lit(False)))
    return bound(array, lambda a: F.struct(
        F.lit(name).alias("name"),
        F.lit(star).alias("star"),
        (support if support is not None else F.lit(True)).alias("support"),
        item_score(a, how).alias("score"),
        F.aggregate(a, F.lit(0.0), lambda t, i: t + i["total_score"]).alias("total_score"),
        F.array_join(F.transform(F.filter(a, lambda i: (i["score"] == 0) & (i["reason"] != "")), lambda i: i["reason"]), " | ").alias("reason"),
        a.alias("items"),
    ))


def merged(checkers: list[Column] | Column, how: str = "sum", skip_unsupported: bool = False) -> Column:
    """Struct (score, total, reason, extra) of a scorer made of checkers, a list or an array: 0 if a star checker has 0.

    An unsupported star checker has score 0 and so vetoes, unless unsupported ones are skipped.
    """
    array = checkers if isinstance(checkers, Column) else F.array(*checkers)
    if skip_unsupported:
        array = F.filter(array, lambda c: c["support"])
    return bound(array, lambda a: F.struct(
        F.when(F.exists(a, lambda c: c["star"] & (c["score"] == 0)), 0.0).otherwise(_fold(F.transform(a, lambda c: c["score"]), how)).alias("score"),
        F.aggregate(a, F.lit(0.0), lambda t, c: t + c["total_score"]).alias("total"),
        F.array_join(F.transform(F.filter(a, lambda c: c["reason"] != ""), lambda c: F.concat_ws(":", c["name"], c["reason"])), " | ").alias("reason"),
        F.map_from_entries(F.transform(a, lambda c: F.struct(c["name"], F.to_json(c["items"], {"ignoreNullFields": "false"})))).alias("extra"),
    ))


def merged_by(checkers: list[Column], *hows: str) -> Column:
    """Struct of one merge per way, all over the same checkers, which are evaluated once."""
    return bound(F.array(*checkers), lambda a: F.struct(*(merged(a, how).alias(how) for how in hows)))


def checked(before, check, after=None, failed=None):
    """A checker with hooks: before(row) may change the row that check(row) sees, after(row, items) its items; failed(row, error) gives items in place of an error.

    For checkers in plain Python, as judged.python_scorer runs them; without failed an error goes on.
    """

    def run(row: dict):
        row = (before(row) if before else None) or row
        try:
            items = check(row)
        except Exception as e:
            if failed is None:
                raise
            return failed(row, e)
        return (after(row, items) if after else None) or items

    return run


def long_item_scores(check_items: DataFrame, how: str) -> DataFrame:
    """The same fold over a long table of check items, by case and checker: rows (data_index, checker, checker_star, score, total_score)."""
    good, weighted = F.col("score") >= 0, F.col("score") * F.col("weight")
    fold = {"sum": F.sum, "avg": F.avg, "min": F.min}[how](F.when(good, weighted))
    veto = F.bool_or(F.col("star") & (F.col("score") == 0))
    return check_items.groupBy("data_index", "checker").agg(
        F.first("checker_star").alias("checker_star"), F.when(veto, 0.0).otherwise(F.coalesce(fold, F.lit(0.0))).alias("score"), F.sum("total_score").alias("total_score")
    )


def llm_rounds(scores: Column) -> Column:
    """Running mean of the scores of an LLM's rounds: each round counts as much as all before it."""
    first = F.lit(None).cast("double")
    return F.aggregate(scores, first, lambda a, x: F.when(a.isNull(), x).otherwise((a + x) / 2))
