"""Quality rules and cross-document line frequency, with DataFrame functions only.

Lines are normalised (lower case, digits as 0, single spaces) and hashed. A line that is in more
distinct documents of its host than the limit allows is boilerplate; a document whose words are mostly in
such lines is depleted and rejected. Copies of a whole text count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import SPACE, WORD, _tested, fresh, id_filter, let, probably_in, written

MIN_WORDS = 10
#: Rejected beyond this percentage of words in repeated windows.
MAX_REPEATED = 20
WINDOW = 5
#: A line is frequent beyond LINE_DOCS documents and LINE_SHARE of its host's documents.
LINE_DOCS, LINE_SHARE = 10, 0.02
#: A document is depleted when frequent lines hold more than this share of its words.
MAX_REMOVED = 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """How many words are in windows of five words that occur twice or more, the first occurrence included."""
    windows = F.when(
        F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(WINDOW))))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        hits = let(pairs, lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(s, j, j + 1) | ((j > 0) & same(s, j, F.greatest(j - 1, F.lit(0))))), lambda j: F.get(s, j)["i"]))
        # each window adds the words that the one before it doesn't hold
        return let(F.array_sort(hits), lambda p: F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).cast("bigint").alias("n"), x.cast("int").alias("at")), lambda a: a["n"]))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def measured(docs: DataFrame) -> DataFrame:
    """Statistics of each row of docs (doc_id, text, source), and its different normalised lines with their words."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").alias("host"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = rows.select("*", F.xxhash64("t").alias("text_hash"), let(words(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("w"), lines.alias("l"))
    return rows.select(
        "row", "doc_id", "host", "text_hash",
        F.col("w.n").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        F.transform("l", lambda x: let(_normalised(x), lambda y: F.struct(F.xxhash64(y).alias("line"), F.regexp_count(y, F.lit(WORD)).alias("n")))).alias("lines"),
    )


def frequent_lines(lines: DataFrame, hosts: DataFrame, docs_limit: int, share: float) -> DataFrame:
    """key: hash of host and line, of the lines in too many distinct documents of the host."""
    seen = lines.select("host", "text_hash", "line").distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    seen = seen.where(F.col("n") > docs_limit).join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > share * F.col("n_docs"))
    return seen.select(F.xxhash64("host", "line").alias("key")).distinct()


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}+", "0"), f"[{SPACE}]+", " "))


def frequent_keys(rows: DataFrame, docs_limit: int, share: float) -> DataFrame:
    """frequent_lines of rows as measured gives them, written."""
    one = rows.groupBy("host", "text_hash").agg(F.min("row").alias("row"))
    hosts = one.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("n_docs"))
    lines = rows.select("host", "text_hash", F.explode("lines").alias("x")).select("host", "text_hash", "x.line")
    return written(frequent_lines(lines, hosts, docs_limit, share), "frequent_lines")


def cleaned(docs: DataFrame, docs_limit: int = LINE_DOCS, share: float = LINE_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Documents that judge keeps, without their frequent lines; all columns, and all other lines as they are.

    Only texts that may hold a frequent line are shuffled. Documents without such a line stay as they are if
    they pass the rules. Null text has no words and fails; rows are judged one by one, also those that repeat
    a doc_id or have none; an empty table stays empty. Columns of docs may have any names.
    """
    rows = written(measured(docs), "lines")
    frequent = frequent_keys(rows, docs_limit, share)
    # by text: whether it is kept, and the hashes of its frequent lines, which its own lines bound
    keyed = rows.select("host", "text_hash", F.explode("lines").alias("x")).select("host", "text_hash", "x.line", "x.n", F.xxhash64("host", "x.line").alias("key"))
    hits = probably_in(keyed, "key", id_filter(frequent, "key")).join(frequent, "key")
    texts = rows.groupBy("host", "text_hash").agg(F.count("*").alias("copies"), F.min("n_words").alias("n_words"), F.min("n_repeat_words").alias("n_repeat_words"))
    held = hits.groupBy(F.col("host").alias("h"), F.col("text_hash").alias("t")).agg(F.sum("n").alias("n"), F.collect_set("line").alias("hot"))
    judged = texts.join(held, F.col("host").eqNullSafe(F.col("h")) & (F.col("text_hash") == F.col("t")), "left").drop("h", "t")
    judged = judged.select("host", "text_hash", F.coalesce("hot", F.array().cast("array<bigint>")).alias("hot"), _failed().alias("failed"), (F.coalesce("n", F.lit(0)) / F.col("copies") > max_removed * F.col("n_words")).alias("depleted"))
    changed = written(judged.where("failed or depleted or size(hot) > 0"), "changed_texts")
    found, own, host, key, hot, go = (fresh(c, docs) for c in ("found", "text_key", "changed_host", "changed_key", "hot", "go"))
    marked = _tested(docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))), own, id_filter(changed, "text_hash"), found)
    known = changed.select(F.col("host").alias(host), F.col("text_hash").alias(key), F.col("hot").alias(hot), (F.col("failed") | F.col("depleted")).alias(go))
    out = marked.where(F.col(found)).join(known, (F.col(own) == F.col(key)) & F.col("source").eqNullSafe(F.col(host)), "left").where(~F.coalesce(F.col(go), F.lit(False)))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.rlike(x, F.lit(WORD)) | ~F.array_contains(F.col(hot), F.xxhash64(_normalised(x))))
    out = out.withColumn("text", F.when(F.size(hot) > 0, F.array_join(kept, "\n")).otherwise(F.col("text")))
    return marked.where(~F.col(found)).select(*docs.columns).unionByName(out.select(*docs.columns))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, docs_limit: int = LINE_DOCS, share: float = LINE_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed, kept), one per row of docs.

    Null and empty texts have no words and fail; null source is a host of its own. Rows are judged one by
    one, also those that repeat a doc_id or have none, and texts of any length as a whole. An empty table
    gives no rows, and other columns aren't looked at. cleaned gives the texts without the lines.
    """
    rows = written(measured(docs), "lines")
    frequent = frequent_keys(rows, docs_limit, share)
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.n")
    # only lines that may be frequent are shuffled
    keyed = lines.select("row", "n", F.xxhash64("host", "line").alias("key"))
    removed = probably_in(keyed, "key", id_filter(frequent, "key")).join(frequent, "key").groupBy("row").agg(F.sum("n").alias("n_removed"))
    out = rows.drop("lines", "host", "text_hash").join(removed, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("bigint"))
    out = out.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & (F.col("n_removed") <= max_removed * F.col("n_words")))
    return out.drop("row")
