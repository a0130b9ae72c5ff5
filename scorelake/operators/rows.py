"""Row operators between a source and the scorers: filter, shuffle, slice, index, wrap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.values import get_or, put
from scorelake.model import scratch
from scorelake.operators import ranks


def filter_all(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Rows for which all predicates are true; null counts as false."""
    return df.where(reduce(lambda a, b: a & b, (F.coalesce(p, F.lit(False)) for p in predicates), F.lit(True)))


#: Rows, skipped ones included, up to which a page is sorted out by its tasks and merged in one.
SMALL_PAGE = 10_000


def sliced(df: DataFrame, order: list, offset: int = 0, limit: int = -1) -> DataFrame:
    """A page of the rows in this order. Without a limit (below 0) the offset doesn't count; limit 0 gives none.

    Pages that end within SMALL_PAGE rows are sorted, up to that many rows for each task. Others are a filter: the keys at
    both ends are found by histograms of the order's columns, and the page's rows stay in
    their partitions. Among rows of equal keys at an end, their place in the input decides. Orders
    of other columns than whole numbers, dates, times and booleans by name index all rows and filter the index.
    """
    if limit < 0:
        return df
    if limit == 0:
        return df.limit(0)
    if offset + limit <= SMALL_PAGE:
        return df.orderBy(*order).offset(offset).limit(limit)
    keys = ranks.whole_keys(df, order)
    if keys is None:
        name = _free(df, "place")
        return reindexed(df, order, name).where(F.col(name).between(offset, offset + limit - 1)).drop(name)
    first, end = ranks.place(df, keys, offset), ranks.place(df, keys, offset + limit)
    if first is None:
        return df.limit(0)
    less, equal = ranks.compared(keys, first.keys)
    after, from_ = ~(less | equal), ~less
    before = ranks.compared(keys, end.keys)[0] if end else F.lit(True)
    if end is not None and end.keys == first.keys:
        return _numbered_between(df.where(equal), first.before, end.before)
    page = df.where((after if first.before else from_) & before)
    if first.before:
        page = page.unionByName(_numbered_between(df.where(equal), first.before, first.ties))
    if end is not None and end.before:
        page = page.unionByName(_numbered_between(df.where(ranks.compared(keys, end.keys)[1]), 0, end.before))
    return page


def _free(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _numbered_between(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows from start up to end, not included, in the order of the input; only counts by partition meet."""
    name = _free(df, "place")
    return _numbered(df, name).where(F.col(name).between(start, end - 1)).drop(name)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """A random permutation that the seed and the rows decide: an order column, no sort in one task."""
    return df.withColumn("order_key", F.xxhash64(F.lit(seed), *(F.to_json(F.struct(c)) for c in df.columns)))


def pinned(df: DataFrame) -> DataFrame:
    """The same rows for all that read them, written and read back: range bounds are sampled, so they may differ between two runs of a plan."""
    path = scratch(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reindexed(df: DataFrame, order: list, name: str = "data_index") -> DataFrame:
    """Dense index from 0 in this order, in place of any there is.

    Rows are range-partitioned by the order, numbered in each partition, and moved by the number of
    rows in the partitions before; only a row per partition goes through a single task.
    """
    rest = df.drop(name) if name in df.columns and not any(str(o) == name for o in order) else df
    return _numbered(rest.repartitionByRange(*order).sortWithinPartitions(*order), name)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 by partition and place in it, written and read back; in place of a column of that name."""
    parted = pinned(df.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}))
    # ids count from the partition's number times 2^33
    inside = F.col("__id") - F.col("__part").cast("bigint") * (1 << 33)
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = parted.join(before, "__part").withColumn("__index", inside + F.col("__before"))
    return out.drop("__part", "__id", "__before", name).withColumnRenamed("__index", name)


def with_input(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.withColumn("input_item", put(F.col("input_item"), key, value))


def input_value(key: str, default: str | None = None) -> Column:
    return get_or(F.col("input_item"), key, default)


def wrapped(df: DataFrame, fields: list[str], change: Callable[[Column], Column]) -> DataFrame:
    """Fields of input_item changed by a column expression; null results leave the field as it was."""
    for f in fields:
        old = F.try_element_at("input_item", F.lit(f))
        df = df.withColumn("input_item", F.when(old.isNotNull(), put(F.col("input_item"), f, F.coalesce(change(old), old))).otherwise(F.col("input_item")))
    return df


def union_sources(sources: list[DataFrame | None]) -> DataFrame:
    """All rows of the sources in their order: source_pos tells the source, missing columns are null; empty entries are skipped."""
    some = [s.withColumn("source_pos", F.lit(k)) for k, s in enumerate(s for s in sources if s is not None)]
    if not some:
        raise ValueError("no source has rows")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)


def progress(cases: DataFrame) -> DataFrame:
    """remaining: cases with input and no result; processed: with input and an API or eval result. Input columns: has_input, has_api, has_eval."""
    return cases.agg(
        F.count_if(F.expr("has_input and not has_api and not has_eval")).alias("remaining"),
        F.count_if(F.expr("has_input and (has_api or has_eval)")).alias("processed"),
        F.count("*").alias("total"),
    )


def injected(df: DataFrame, fields: tuple[str, ...] = ("dataIndex", "apiCompletionResult", "evalResult", "extra", "inputData")) -> DataFrame:
    """Results of an earlier run, moved out of input_item (JSON text under their names) into columns.

    Gives data_index, api_result, eval_result and extra where named, and input_item replaced by the saved input.
    """
    raw = lambda k: F.try_element_at("input_item", F.lit(k))
    api = "dataIndex bigint, resultItem map<string,string>, startTime bigint, endTime bigint, timeCost bigint, success boolean"
    scorer = "dataIndex bigint, metric string, score double, scoreRate double, totalScore double, reason string, success boolean, pass boolean, threshold double, star boolean"
    ev = f"dataIndex bigint, score double, reason string, startTime bigint, endTime bigint, timeCost bigint, success boolean, pass boolean, threshold double, scorerResults array<struct<{', '.join(c.replace(' ', ':', 1) for c in scorer.split(', '))}>>"
    names = {"dataIndex": "data_index", "apiCompletionResult": "api_result", "evalResult": "eval_result", "extra": "extra"}
    out = {}
    for f in fields:
        if f == "dataIndex":
            index = F.trim(raw(f))
            out["data_index"] = F.when(index.isNull() | index.rlike("^-?[0-9]+$"), index.try_cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("data index is no whole number: "), index)))
        elif f in names:
            out[names[f]] = F.from_json(raw(f), {"apiCompletionResult": api, "evalResult": ev}.get(f, "map<string,string>"))
    keep = [F.col(c) for c in df.columns if c not in out and c != "input_item"]
    saved = F.from_json(raw("inputData"), "dataIndex bigint, inputItem map<string,string>")["inputItem"]
    item = F.coalesce(saved, F.col("input_item")) if "inputData" in fields else F.col("input_item")
    return df.select(*keep, item.alias("input_item"), *(c.alias(k) for k, c in out.items()))
