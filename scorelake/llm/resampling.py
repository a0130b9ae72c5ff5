"""Target-distribution importance resampling over hashed word n-grams, with DataFrame functions only.

A bucket's gain is the log ratio of its smoothed shares among the features of a target and of all
documents. A document's weight is the sum of the gains of its features; with a Gumbel draw by its id added,
the highest scores are a sample without replacement by weight. Both counts are grouped
by bucket, of which there is a fixed number, so the gain table can be broadcast whatever the data's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import written

#: Lengths of n-grams, buckets, words that a document needs to be drawn, percent of these that are drawn, and seed.
LEAST, MOST, BUCKETS, WORDS, PERCENT, SEED = 1, 1, 10_000, 20, 10, "2024"
#: Letters, digits, and all beyond ASCII; case is lowered afterwards, which leaves words' borders as they are.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(s: Column) -> Column:
    """A-Z in lower case, all else as it is; the cheap way is right for ASCII alone."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, _UPPER, _LOWER))


def grams(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """All runs of ``least`` to ``most`` words, joined by one space, as an array; null text has none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)
    if (least, most) == (1, 1):
        return words

    def runs(n: int) -> Column:
        first = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(first, lambda w, i: F.array_join(F.slice(words, i + 1, n), " "))

    return F.concat(*map(runs, range(least, most + 1)))


def bucket(gram: Column, buckets: int) -> Column:
    return (F.crc32(lowered(gram).cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, name: str, least: int, most: int, buckets: int) -> DataFrame:
    """Rows (bucket, name): how many features of the texts are in each bucket; tasks sum first."""
    found = texts.select(F.explode(grams(F.col("text"), least, most)).alias("g"))
    return found.groupBy(bucket(F.col("g"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, gain), one for each of the buckets: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) in doubles."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, "s", least, most, buckets), bucket_counts(target, "t", least, most, buckets)
    rows = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    rows = rows.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    rows = written(rows, "bucket_counts")
    all_s, all_t = rows.agg(F.sum("s"), F.sum("t")).first()
    x, y = (F.col("t") + 1) * F.lit(all_s + buckets), (F.col("s") + 1) * F.lit(all_t + buckets)
    return rows.select("bucket", F.floor(1000 * F.log(x / y)).alias("gain"))


def noise(doc_id: Column, seed: str) -> Column:
    """A Gumbel draw in thousandths, from 32 bits of the SHA-256 of seed and id; a null id counts as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, target: DataFrame, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score), one per row of docs.

    Rows keep apart by their place in the input, so docs should be files or a written table. A
    document's features are summed by the task that reads it before they are shuffled.
    """
    table = written(gains(docs, target, least, most, buckets), "gains")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = numbered.select("row", "doc_id", F.explode_outer(grams(F.col("text"), least, most)).alias("g"))
    found = found.select("row", "doc_id", "g", bucket(F.col("g"), buckets).alias("bucket"))
    single = F.col("g").isNotNull() & (F.instr("g", " ") == 0)
    words = F.count("g") if (least, most) == (1, 1) else F.count_if(single)
    sums = found.join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id")
    rows = sums.agg(words.alias("n_words"), F.count("g").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("bigint").alias("weight"))
    return rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("bigint").alias("score"))


def ranked(rows: DataFrame, least_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """rows with rank 1, 2, 3, ... by score of the drawn ones, null for the others.

    Of the N rows with ``least_words`` words, floor(percent N / 100) are drawn, the highest scores first, ties to the
    smaller doc_id (null last). Rows are range-partitioned by score and sorted; a rank is the place in
    the partition and the sizes of those before, of which there is a row for each partition.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    able = rows.where(F.col("n_words") >= least_words)
    parts = able.repartitionByRange(*order).sortWithinPartitions(*order)
    # range bounds are sampled anew whenever a plan runs, so the sorted rows are written
    parts = written(parts.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "by_score")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy())
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.floor(total * percent / 100).alias("drawn"))
    place = F.col("at") - F.shiftleft(F.col("part").cast("bigint"), 33) + F.col("before") + 1
    out = parts.join(F.broadcast(sizes), "part").select(*rows.columns, F.when(place <= F.col("drawn"), place).alias("rank"))
    return out.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, least_words: int = WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one per row of docs (doc_id, text); target: rows (text).

    Null, empty and wordless texts have no features and weight 0. Rows with one doc_id are documents of
    their own that share their draw; rows without doc_id are drawn as if it were empty, last among
    equal scores. Without target texts all its counts are 0. An empty table gives no rows; other
    columns aren't looked at.
    """
    rows = written(weighted(docs, target, least, most, buckets, seed), "weighted")
    return ranked(rows, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The ids that are drawn with their ranks: rows (doc_id, rank)."""
    return resample(docs, target, **how).where("rank is not null").select("doc_id", "rank")
