"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Tokens are summed by source and hash bucket; a source's budget ends inside one bucket, and only that
bucket is refined, with the next bits of the hash, until a single hash is left. Documents whose
hash is below the threshold are taken: no sort, and a larger budget takes all that a smaller one does. Where
several documents share the hash at a threshold, as rows without id do, they are told apart in the same way by a
hash of their text, and equal texts by their place in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import WORD, fresh, id_hash, written

WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
REPEATS = 3
#: Hash bits, and those that one histogram resolves.
BITS, STEP = 60, 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: all sizes shared by weight, no target above ``repeats`` times its source's size.

    Sources reach their limit in the order of limit / weight; with the first k at their limits, the rest
    share what these leave. The rows are one per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * repeats)
    full = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("left_size", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("over", F.col("left_size") * F.col("weight") > F.col("cap") * F.col("left_weight"))
    )
    # the first source that isn't over its limit sets the level for all after it
    level = F.struct(F.col("left_size"), F.col("left_weight"))
    rows = rows.withColumn("level", F.first(F.when(~F.col("over"), level), True).over(full.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.col("level.left_size") * F.col("weight") / F.col("level.left_weight")
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(share, F.col("cap").cast("double"))).alias("target"))


def _boundary(docs: DataFrame, budgets: DataFrame, hash_: str) -> DataFrame:
    """source, at, fits, n, budget: the hash value at which each source's budget ends, whether its documents still fit, how many they are, and what is left for them."""
    open_ = budgets.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"))
    for shift in range(BITS - STEP, -1, -STEP):
        # of the open bucket only: its sums by the next bits
        o = open_.select(F.col("source").alias("s"), "budget", "prefix")
        inside = docs.join(o, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright(hash_, shift + STEP) == F.col("prefix")))
        sums = inside.groupBy("source", "budget", F.shiftright(hash_, shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(run)).withColumn("last", F.lead("bucket").over(run).isNull())
        # the first bucket that goes beyond the budget; if none does, the end of the last one
        first = sums.where((F.col("upto") > F.col("budget")) | F.col("last")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "budget", "n")).alias("x"))
        fits = 2 * F.col("x.upto") - F.col("x.size") <= 2 * F.col("x.budget")
        open_ = written(first.select("source", (F.col("x.budget") - F.col("x.upto") + F.col("x.size")).alias("budget"), F.col("x.bucket").alias("prefix"), fits.alias("fits"), F.col("x.n").alias("n")), "mix_bounds")
    return open_.withColumnRenamed("prefix", "at")


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, bound: documents (source, size, hash) with hash < bound fill the budget.

    The documents of the hash at the boundary are taken if their source's sum comes nearer to the budget with them.
    """
    return _boundary(docs, budgets, "hash").select("source", (F.col("at") + F.col("fits").cast("int")).alias("bound"))


#: Columns by which documents are taken, one after the other among equal ones.
KEYS = ("hash", "text_hash", "row")


def bounds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, bound: an array; documents (source, size, hash, text_hash, row) whose three hashes are below it, compared from the first on, fill the budget."""
    done, open_, above = None, budgets, F.array().cast("array<bigint>")
    for k, hash_ in enumerate(KEYS):
        found = _boundary(docs, open_, hash_)
        if k:
            found = found.join(open_.select(F.col("source").alias("t"), "above"), F.col("source").eqNullSafe(F.col("t"))).drop("t")
        found = found.withColumn("above", F.col("above") if k else above)
        whole = found if k == len(KEYS) - 1 else found.where("n <= 1")
        end = F.concat("above", F.array(F.col("at") + F.col("fits").cast("int")), F.array_repeat(F.lit(0).cast("bigint"), len(KEYS) - 1 - k))
        ended = whole.select("source", end.alias("bound"))
        done = ended if done is None else done.unionByName(ended)
        more = found.where("n > 1")
        if k == len(KEYS) - 1 or more.isEmpty():
            return done
        open_ = written(more.select("source", "budget", F.concat("above", F.array("at")).alias("above")), "mix_ties")
        o = open_.select(F.col("source").alias("s"), F.element_at("above", -1).alias("tied"))
        docs = docs.join(o, F.col("source").eqNullSafe(F.col("s")) & (F.col(hash_) == F.col("tied"))).drop("s", "tied")


def below(bound: Column, keys: tuple[Column, ...]) -> Column:
    """Whether keys are below a bound, compared from the first on; false without a bound."""
    out = F.lit(False)
    for k in reversed(range(len(keys))):
        out = (keys[k] < bound[k]) | ((keys[k] == bound[k]) & out)
    return F.coalesce(out, F.lit(False))


def _keys(doc_id: Column, text: Column) -> tuple[Column, ...]:
    return id_hash(doc_id), id_hash(F.coalesce(text, F.lit(""))), F.monotonically_increasing_id()


def plan(docs: DataFrame, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all rows; and for each source how often all are taken, and the bound below which once more."""
    keys = (c.alias(k) for c, k in zip(_keys(F.col("doc_id"), F.col("text")), KEYS, strict=True))
    rows = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), *keys), "mix_sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goals = written(targets(sizes, weights, repeats).withColumn("whole", whole), "mix_targets")
    budgets = goals.select("source", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    ends = bounds(rows, budgets.where("budget > 0")).select(F.col("source").alias("t"), "bound")
    known = goals.join(ends, F.col("source").eqNullSafe(F.col("t")), "left")
    bound = F.col("bound").alias("__bound")
    return rows, known.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), bound)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies), one per row of docs (doc_id, text, source).

    Each document is taken floor(target / source_size) times, and once more if its hash is below the
    source's threshold. Null text has size 0; null source is a source of its own, the last one; rows without
    doc_id have hash 0. Rows with one hash are told apart at a threshold by their texts, and equal rows
    by their places: which of these are taken is a matter of chance, but not how many. A source
    without words has target 0 and isn't taken. An empty table gives no rows.
    """
    rows, known = plan(docs, weights, repeats)
    copies = F.col("__whole") + below(F.col("__bound"), tuple(map(F.col, KEYS))).cast("bigint")
    out = rows.join(known, F.col("source").eqNullSafe(F.col("__source")))
    return out.select("doc_id", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix as rows of docs with all their columns, each as often as it is taken; see mix.

    Taken rows are told by source and hashes, so texts aren't shuffled: a row per source is joined. docs are
    read twice and should be files or a written table, whose rows keep their places.
    An empty table gives no rows; columns of docs may have any names.
    """
    names = [fresh(f"mix_{c}", docs) for c in ("source", "whole", "bound", "copy", *KEYS)]
    source, whole, bound, copy, *keys = names
    known = plan(docs, weights, repeats)[1].select(F.col("__source").alias(source), F.col("__whole").alias(whole), F.col("__bound").alias(bound))
    numbered = docs.withColumns(dict(zip(keys, _keys(F.col("doc_id"), F.col("text")), strict=True)))
    out = numbered.join(known, F.col("source").eqNullSafe(F.col(source)))
    copies = (F.col(whole) + below(F.col(bound), tuple(map(F.col, keys))).cast("bigint")).cast("int")
    return out.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).drop(*names)
