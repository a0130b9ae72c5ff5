"""All queries by name, each with the SQL of its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import text as tx
from scorelake.functions import values as vl
from scorelake.operators import checkers, counting, external, mock, ranks, rows, scoring
from scorelake.plans import views
from scorelake.plans.views import CONV_ITEMS, DOC_ITEMS, EVENT_CASES, line_scores_sql, table
from scorelake.sources import files
from scorelake.streaming import delta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- final scores -------------------------------------------------------------------------

_DEC = "cast(sum(cast({} as decimal(18,6))) as double)"
_STRATEGY_SQL = {
    "sum": f"coalesce({_DEC.format('CASE WHEN success THEN score END')}, 0.0::DOUBLE)",
    "avg": f"coalesce({_DEC.format('CASE WHEN score >= 0 THEN score END')} / nullif(count(*) FILTER (WHERE score >= 0), 0), 0.0::DOUBLE)",
    "min": "least(arg_min(score, scorer_pos), min(score) FILTER (WHERE score >= 0))",
    "max": "max(score)",
    "sum_rate": _DEC.format("score_rate"),
    "avg_rate": f"{_DEC.format('score_rate')} / count(*)",
    "max_rate": "greatest(0.0::DOUBLE, max(score_rate))",
    "min_rate": "least(0.0::DOUBLE, min(score_rate))",
    "min_rate_true": "min(score_rate)",
}


def _final(k: int, name: str) -> None:
    kind = scoring.KINDS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scoring.final_score(views.line_scores(spark, sf_dir, kind, 5.0), name)

    run.__name__ = f"q{k:02d}_final_{name}"
    query(f"WITH {line_scores_sql(kind, 5.0)} SELECT data_index, {_STRATEGY_SQL[name]} AS score FROM line_scores GROUP BY data_index")(run)


for _k, _name in enumerate(("sum", "avg", "min", "max", "sum_rate", "avg_rate", "max_rate", "min_rate", "min_rate_true"), 1):
    _final(_k, _name)


def _pass_counts(kind: str, sql_only: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("data_index"), "l_quantity", "l_discount")
        s = [scoring.Scorer(F.col("l_quantity"), "quantity", total_score=50, threshold=10 if kind == "value" else 0.2), scoring.Scorer(F.col("l_discount"), "discount", total_score=0, threshold=0.05)]
        out = scoring.score_items(items, s, kind)
        return out.groupBy("metric", "pass").agg(F.count("*").alias("n"), F.max("score_rate").alias("max_rate"))

    return run


def _pass_sql(kind: str) -> str:
    value = kind == "value"
    return f"""WITH r AS (SELECT 'quantity' AS metric, l_quantity / 50.0::DOUBLE AS rate, {'l_quantity >= 10' if value else 'l_quantity / 50.0::DOUBLE >= 0.2::DOUBLE'} AS pass FROM lineitem
  UNION ALL SELECT 'discount', 0.0::DOUBLE, {'l_discount >= 0.05::DOUBLE' if value else 'false'} FROM lineitem) SELECT metric, pass, count(*) AS n, max(rate) AS max_rate FROM r GROUP BY metric, pass"""


@query(_pass_sql("value"))
def q10_scorer_pass_value(spark, sf_dir):
    return _pass_counts("value")(spark, sf_dir)


@query(_pass_sql("rate"))
def q11_scorer_pass_rate(spark, sf_dir):
    return _pass_counts("rate")(spark, sf_dir)


@query(f"""WITH {line_scores_sql()} SELECT data_index, {_STRATEGY_SQL['sum']} AS score, CASE WHEN bool_and(success) THEN min(start_time) ELSE 0 END AS start_time,
  CASE WHEN bool_and(success) THEN max(end_time) ELSE 0 END AS end_time, CASE WHEN bool_and(success) THEN max(time_cost) ELSE 0 END AS time_cost, bool_and(success) AS success,
  NOT bool_or(star AND NOT pass) AND {_STRATEGY_SQL['sum']} >= 60 AS pass, 60.0::DOUBLE AS threshold, 'sum' AS strategy FROM line_scores GROUP BY data_index""")
def q12_verdict_strict(spark, sf_dir):
    return scoring.verdicts(views.line_scores(spark, sf_dir), "sum", 60, reasons=False)


@query(f"""WITH {line_scores_sql()}, p AS (SELECT *, bool_and(success) OVER (PARTITION BY data_index ORDER BY scorer_pos) AS ok FROM line_scores)
  SELECT data_index, {_STRATEGY_SQL['sum']} AS score, coalesce(min(start_time) FILTER (WHERE ok), 0) AS start_time, coalesce(max(end_time) FILTER (WHERE ok), 0) AS end_time,
  coalesce(max(time_cost) FILTER (WHERE ok), 0) AS time_cost, bool_or(ok) AS success, NOT bool_or(star AND NOT pass) AND {_STRATEGY_SQL['sum']} >= 60 AS pass,
  60.0::DOUBLE AS threshold, 'sum' AS strategy FROM p GROUP BY data_index""")
def q13_verdict_prefix(spark, sf_dir):
    return scoring.verdicts(views.line_scores(spark, sf_dir), "sum", 60, mode="prefix", reasons=False)


@query(f"""WITH {line_scores_sql()} SELECT data_index, '[' || string_agg('{{"评估指标":"' || metric || '","评估理由":"' || reason || '"}}', ',' ORDER BY scorer_pos) || ']' AS reason FROM line_scores GROUP BY data_index""")
def q14_reason_json(spark, sf_dir):
    return views.line_scores(spark, sf_dir).groupBy("data_index").agg(scoring.reason_json().alias("reason"))


# --- counts -------------------------------------------------------------------------------

_RATES = {
    "pass": "eval_success IS NOT NULL AND pass", "unpass": "eval_success IS NOT NULL AND NOT pass", "eval_success": "eval_success", "eval_error": "NOT eval_success",
    "completion_success": "eval_success IS NOT NULL AND api_success", "completion_error": "eval_success IS NOT NULL AND NOT api_success",
}
RATES_SQL = "count(*) AS total_count, " + ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}_count, (count(*) FILTER (WHERE {v}))::DOUBLE / count(*) AS {k}_rate" for k, v in _RATES.items())


def _mean_sql(x: str, where: str) -> str:
    return f"coalesce(cast(sum(cast({x} as decimal(18,6))) FILTER (WHERE {where}) as double) / nullif(count(*) FILTER (WHERE {where}), 0), 0.0::DOUBLE)"


def _times_sql(x: str, where: str, name: str, percentiles=()) -> str:
    parts = [f"{_mean_sql(x, where)} AS avg_{name}"] + [f"({f}({x}) FILTER (WHERE {where}))::DOUBLE AS {f}_{name}" for f in ("min", "max")]
    return ", ".join(parts + [f"(quantile_disc({x}, {p / 100}) FILTER (WHERE {where}))::DOUBLE AS tp{p}_{name}" for p in percentiles])


SCORES_SQL = _times_sql("score", "eval_success", "score", counting.PERCENTILES) + ", stddev_pop(score) FILTER (WHERE eval_success) AS stddev_score"


def _agg(spark, sf_dir, metrics):
    return views.event_cases(spark, sf_dir).agg(*(c.alias(k) for k, c in metrics.items()))


@query(f"WITH {EVENT_CASES} SELECT {RATES_SQL} FROM event_cases")
def q15_rates(spark, sf_dir):
    return _agg(spark, sf_dir, counting.rate_metrics())


@query(f"WITH {EVENT_CASES} SELECT {_times_sql('api_time_cost', 'api_success', 'api_time', counting.PERCENTILES)} FROM event_cases")
def q16_api_time(spark, sf_dir):
    return counting.summarized(views.event_cases(spark, sf_dir), [], counting.time_metrics("api_time_cost", "api_success", "api_time"), counting.API_TIME)


@query(f"WITH {EVENT_CASES} SELECT {_times_sql('eval_time_cost', 'eval_success', 'eval_time')} FROM event_cases")
def q17_eval_time(spark, sf_dir):
    return _agg(spark, sf_dir, counting.time_metrics("eval_time_cost", "eval_success", "eval_time"))


_NO_DEV = "a.* REPLACE (floor(stddev_score * 1e6 + 0.5) / 1e6 AS stddev_score)"


def _rounded_dev(df: DataFrame) -> DataFrame:
    return df.withColumn("stddev_score", F.floor(F.col("stddev_score") * 1e6 + 0.5) / 1e6)


@query(f"WITH {EVENT_CASES} SELECT {_NO_DEV} FROM (SELECT {SCORES_SQL} FROM event_cases) a")
def q18_score_stats(spark, sf_dir):
    metrics = {k: c for k, c in counting.score_metrics().items() if not k.startswith("tp")}
    return _rounded_dev(counting.summarized(views.event_cases(spark, sf_dir), [], metrics, counting.SCORE))


@query(f"WITH {EVENT_CASES} SELECT event_type, quantile_disc(score, 0.5) AS tp50, quantile_disc(score, 0.9) AS tp90, quantile_disc(score, 0.99) AS tp99 FROM event_cases GROUP BY event_type")
def q19_tp_all(spark, sf_dir):
    rows = ranks.percentiles(views.event_cases(spark, sf_dir), ["event_type"], {"score": ("score", "true")}, (50, 90, 99))
    return rows.withColumnsRenamed({f"tp{p}_score": f"tp{p}" for p in (50, 90, 99)})


@query(f"WITH {EVENT_CASES} SELECT event_type, floor(stddev_pop(score) * 1e6 + 0.5) / 1e6 AS stddev_score FROM event_cases GROUP BY event_type")
def q20_stddev(spark, sf_dir):
    return _rounded_dev(views.event_cases(spark, sf_dir).groupBy("event_type").agg(F.stddev_pop("score").alias("stddev_score")))


@query(f"""WITH {EVENT_CASES} SELECT {_NO_DEV} FROM (SELECT event_type, {RATES_SQL}, {_times_sql('api_time_cost', 'api_success', 'api_time', counting.PERCENTILES)},
  {_times_sql('eval_time_cost', 'eval_success', 'eval_time')}, {SCORES_SQL} FROM event_cases GROUP BY event_type) a""")
def q21_count_by(spark, sf_dir):
    return _rounded_dev(counting.count_by(views.event_cases(spark, sf_dir), "event_type"))


@query(f"""WITH {EVENT_CASES} SELECT event_type, {RATES_SQL}, {_times_sql('api_time_cost', 'api_success', 'api_time')}, {_times_sql('eval_time_cost', 'eval_success', 'eval_time')}, {_times_sql('score', 'eval_success', 'score')},
  true AS near FROM event_cases GROUP BY event_type""")
def q77_merged_counts(spark, sf_dir):
    """Counts of 16 parts of the cases, merged: all metrics but percentiles as of all cases, and percentiles at a place that is wrong by 1 % at most."""
    cases = views.event_cases(spark, sf_dir)
    parts = counting.partial_counts(cases.withColumn("part", F.pmod(F.xxhash64("event_type", "score"), F.lit(16))), "part", "event_type")
    merged = counting.merged_counts(parts, "event_type")
    names = [f"tp{p}_{x}" for x in ("api_time", "score") for p in counting.PERCENTILES]
    ends = [counting.ranks.percentiles(cases, ["event_type"], counting.API_TIME | counting.SCORE, tuple(min(100, max(1, p + d)) for p in counting.PERCENTILES)) for d in (-1, 1)]
    low, high = (e.withColumnsRenamed({f"tp{min(100, max(1, p + d))}_{x}": f"{side}{p}_{x}" for x in ("api_time", "score") for p in counting.PERCENTILES}) for e, d, side in zip(ends, (-1, 1), ("low", "high"), strict=True))
    both = merged.join(low, "event_type").join(high, "event_type")
    near = F.lit(True)
    for c in names:
        near = near & F.col(c).between(F.col("low" + c[2:]), F.col("high" + c[2:]))
    kept = [c for c in merged.columns if c not in names and c != "stddev_score"]
    return both.select(*kept, near.alias("near"))


_SEGMENTS = "JOIN orders ON data_index = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(f"""WITH {line_scores_sql()} SELECT c_mktsegment, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE pass) AS passed, {_DEC.format('score')} AS total_score
  FROM line_scores {_SEGMENTS} GROUP BY ROLLUP (c_mktsegment, o_orderpriority)""")
def q22_count_rollup(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    owned = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("data_index"), "c_mktsegment", "o_orderpriority")
    scored = views.line_scores(spark, sf_dir).select("data_index", "score", "pass").join(owned, "data_index")
    metrics = {"n": F.count("*"), "passed": F.count_if("pass"), "total_score": F.sum(F.col("score").cast("decimal(18,6)")).cast("double")}
    return counting.count_by(scored, "c_mktsegment", "o_orderpriority", rollup=True, metrics=metrics)


# --- rows ---------------------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def q23_filter_all(spark, sf_dir):
    return rows.filter_all(table(spark, sf_dir, "documents"), [F.col("lang") == "en", F.col("n_chars") > 500]).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 40 OFFSET 10")
def q24_slice(spark, sf_dir):
    return rows.sliced(table(spark, sf_dir, "documents"), ["doc_id"], 10, 40).select("doc_id", "n_chars")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 25000 OFFSET 15000")
def q75_large_page(spark, sf_dir):
    """A page that is too large for one task: its ends are found by histograms, its rows are filtered."""
    return rows.sliced(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 15_000, 25_000).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, n_chars FROM documents")
def q25_slice_nolimit(spark, sf_dir):
    return rows.sliced(table(spark, sf_dir, "documents"), ["doc_id"], 10, -1).select("doc_id", "n_chars")


@query("SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS data_index, doc_id FROM documents")
def q26_reindex(spark, sf_dir):
    return rows.reindexed(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), "doc_id"]).select("data_index", "doc_id")


@query("""SELECT row_number() OVER (ORDER BY source_pos, id) - 1 AS data_index, source_pos, id FROM (SELECT 0::INTEGER AS source_pos, item_id AS id FROM benchmark
  UNION ALL SELECT 1::INTEGER, doc_id FROM documents)""")
def q27_multi_union(spark, sf_dir):
    one = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    two = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return rows.reindexed(rows.union_sources([one, None, two]), ["source_pos", "id"]).select("data_index", "source_pos", "id")


@query("SELECT doc_id AS data_index, quality::DOUBLE AS score, toxic = 0 AS pass, 'saved ' || doc_id AS query FROM labels")
def q28_inject(spark, sf_dir):
    saved = table(spark, sf_dir, "labels").select(F.create_map(
        F.lit("dataIndex"), F.col("doc_id").cast("string"),
        F.lit("evalResult"), F.to_json(F.struct(F.col("quality").cast("double").alias("score"), (F.col("toxic") == 0).alias("pass"))),
        F.lit("inputData"), F.to_json(F.struct(F.create_map(F.lit("query"), F.concat(F.lit("saved "), F.col("doc_id").cast("string"))).alias("inputItem"))),
    ).alias("input_item"))
    out = rows.injected(saved)
    return out.select("data_index", "eval_result.score", F.col("eval_result.pass"), vl.get_or(F.col("input_item"), "query").alias("query"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q29_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", vl.json_at(F.col("props"), "$.k").alias("k"))


@query(f"WITH {DOC_ITEMS} SELECT count(*) FILTER (WHERE quality IS NULL) AS remaining, count(*) FILTER (WHERE quality IS NOT NULL) AS processed, count(*) AS total FROM doc_items")
def q30_remaining_processed(spark, sf_dir):
    cases = views.doc_items(spark, sf_dir).select(F.col("text").isNotNull().alias("has_input"), F.lit(False).alias("has_api"), F.col("quality").isNotNull().alias("has_eval"))
    return rows.progress(cases)


# --- scalar functions ---------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(regexp_replace(lower({}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+')"


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::BIGINT AS n_tokens, array_to_string(list_sort({_TOKENS.format('text')})[1:5], ' ') AS first_tokens, md5(array_to_string(list_sort({_TOKENS.format('text')}), ' ')) AS all_tokens FROM documents")
def q31_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.bound(F.array_sort(tx.tokens(F.col("text"))), lambda t: F.struct(F.size(t).cast("bigint").alias("n_tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("first_tokens"), F.md5(F.array_join(t, " ")).alias("all_tokens"))).alias("t"))
    return t.select("doc_id", "t.*")


_COSINE = f"""{CONV_ITEMS}, a AS (SELECT data_index, unnest({_TOKENS.format('query')}) AS t FROM conv_items), b AS (SELECT data_index, unnest({_TOKENS.format('response')}) AS t FROM conv_items),
ta AS (SELECT data_index, t, count(*) AS n FROM a GROUP BY ALL), tb AS (SELECT data_index, t, count(*) AS n FROM b GROUP BY ALL),
na AS (SELECT data_index, sum(n * n)::DOUBLE AS s FROM ta GROUP BY ALL), nb AS (SELECT data_index, sum(n * n)::DOUBLE AS s FROM tb GROUP BY ALL),
dot AS (SELECT ta.data_index, sum(ta.n * tb.n)::DOUBLE AS s FROM ta JOIN tb ON ta.data_index = tb.data_index AND ta.t = tb.t GROUP BY ALL),
cosine AS (SELECT c.data_index, coalesce(dot.s, 0) / (sqrt(na.s) * sqrt(nb.s)) AS similarity FROM conv_items c LEFT JOIN dot USING (data_index) LEFT JOIN na USING (data_index) LEFT JOIN nb USING (data_index))"""


@query(f"WITH {_COSINE} SELECT data_index, similarity, coalesce(similarity > 0.3, false) AS similar FROM cosine")
def q32_tf_cosine(spark, sf_dir):
    s = views.conv_items(spark, sf_dir).select("data_index", tx.tf_cosine(F.col("query"), F.col("response")).alias("similarity"))
    return s.select("*", (tx.similar_enough(F.col("similarity"), 0.3) == 1).alias("similar"))


_COUNT = r"greatest(floor(len(regexp_extract_all(text, '\p{Han}')) * 1.2::DOUBLE + 0.5::DOUBLE) + floor(len(regexp_extract_all(text, '[\x00-\x7F]')) * 0.25::DOUBLE + 0.5::DOUBLE), floor(length(text) / 4.0::DOUBLE + 0.5::DOUBLE))::BIGINT"


@query(f"SELECT doc_id, {_COUNT} AS tokens FROM documents")
def q33_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query(f"SELECT lang, sum({_COUNT})::BIGINT AS tokens, (sum({_COUNT}) * 0.0000025::DECIMAL(20,10))::DOUBLE AS price FROM documents GROUP BY lang")
def q34_price(spark, sf_dir):
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(tx.token_count(F.col("text"))).alias("tokens"))
    return t.select("lang", "tokens", tx.token_price(F.col("tokens"), F.lit(2.5)).alias("price"))


@query("SELECT event_id, props AS block FROM events")
def q35_md_json_block(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("here it is ```json\n"), F.col("props"), F.lit("\n``` done"))).otherwise(F.col("props"))
    return e.select("event_id", tx.markdown_json(reply).alias("block"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN event_type ELSE 'none' END AS kind, coalesce(json_extract_string(props, '$.missing'), 'default') AS other FROM events")
def q36_map_get_default(spark, sf_dir):
    m = F.when(F.col("event_type") == "click", F.create_map(F.lit("kind"), F.col("event_type"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    m = vl.put(m, "x", F.lit("z"))
    return table(spark, sf_dir, "events").select("event_id", vl.get_or(m, "kind", "none").alias("kind"), vl.get_or(m, "other", "default").alias("other"))


@query("""WITH h AS (SELECT doc_id, md5('doc-' || doc_id) AS h FROM documents) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def q37_uuid3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.uuid3(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("uuid"))


@query("SELECT page_id, lower(hex(url)) AS hex, url AS back FROM pages")
def q38_hex(spark, sf_dir):
    h = tx.to_hex(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("hex"), tx.from_hex(h).cast("string").alias("back"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS text, epoch_us(ts) // 1000000 * 1000 AS parsed, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS later FROM events")
def q39_date_format(spark, sf_dir):
    ms, e = vl.millis(F.col("ts")), table(spark, sf_dir, "events")
    return e.select("event_id", ms.alias("ms"), vl.format_millis(ms).alias("text"), vl.parse_millis(vl.format_millis(ms)).alias("parsed"), F.date_format(vl.add_days(F.col("ts"), 3), "yyyy-MM-dd").alias("later"))


# --- checkers -----------------------------------------------------------------------------


def _doc_checks(how: str, merge: str = "sum"):
    size = F.least(F.col("n_chars") / 1000.0, F.lit(1.0))
    items = [
        checkers.check_item("has_text", (F.length("text") > 20).cast("double"), star=True, reason=F.lit("too short")),
        checkers.check_item("length", size, weight=2, reason=F.lit("length")),
        checkers.check_item("lang", (F.col("lang") == "en").cast("double"), weight=0.5, reason=F.lit("not English")),
        checkers.check_item("quality", F.col("quality"), support=F.col("quality").isNotNull(), default=-1, reason=F.lit("low quality")),
    ]
    safe = [checkers.check_item("toxic", 1 - F.col("toxic"), support=F.col("toxic").isNotNull(), default=1, star=True, reason=F.lit("toxic"))]
    return [checkers.checker("form", items, how), checkers.checker("safety", safe, "sum", star=True)]


_FORM = """form AS (SELECT *, least(n_chars / 1000.0::DOUBLE, 1.0::DOUBLE) AS len_score, CASE WHEN length(text) > 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_text, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_en FROM doc_items)"""
_WEIGHTED = "[has_text, len_score * 2, is_en * 0.5::DOUBLE] || CASE WHEN quality IS NULL THEN [] ELSE [quality::DOUBLE] END"
_HOW = {"sum": "list_sum({0})", "avg": "list_sum({0}) / len({0})", "min": "list_min({0})"}


def _form_sql(how: str) -> str:
    return f"CASE WHEN has_text = 0 THEN 0.0::DOUBLE ELSE {_HOW[how].format('(' + _WEIGHTED + ')')} END"


def _check(k: int, how: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = views.doc_items(spark, sf_dir).select("data_index", _doc_checks(how)[0].alias("c"))
        return c.select("data_index", _round(F.col("c.score")).alias("score"), "c.reason")

    run.__name__ = f"q{k}_check_{how}"
    reason = "array_to_string(list_filter([CASE WHEN has_text = 0 THEN 'too short' END, CASE WHEN len_score = 0 THEN 'length' END, CASE WHEN is_en = 0 THEN 'not English' END, CASE WHEN quality = 0 THEN 'low quality' END], lambda x: x IS NOT NULL), ' | ')"
    query(f"WITH {DOC_ITEMS}, {_FORM} SELECT data_index, floor(({_form_sql(how)}) * 1e6 + 0.5) / 1e6 AS score, {reason} AS reason FROM form")(run)


def _round(c):
    return F.floor(c * 1e6 + 0.5) / 1e6


for _k, _name in ((40, "sum"), (41, "avg"), (42, "min")):
    _check(_k, _name)

_SAFE = "CASE WHEN toxic IS NULL THEN 1 ELSE 1 - toxic END::DOUBLE"


@query(f"""WITH {DOC_ITEMS}, {_FORM}, c AS (SELECT data_index, {_form_sql('sum')} AS f, {_SAFE} AS s FROM form)
  SELECT data_index, floor(CASE WHEN s = 0 THEN 0 ELSE f + s END * 1e6 + 0.5) / 1e6 AS sum_score, floor(CASE WHEN s = 0 THEN 0 ELSE (f + s) / 2 END * 1e6 + 0.5) / 1e6 AS avg_score,
  floor(CASE WHEN s = 0 THEN 0 ELSE least(f, s) END * 1e6 + 0.5) / 1e6 AS min_score, 5.0::DOUBLE AS total FROM c""")
def q43_checker_merge(spark, sf_dir):
    c = views.doc_items(spark, sf_dir)
    out = c.select("data_index", checkers.merged_by(_doc_checks("sum"), "sum", "avg", "min").alias("m"))
    return out.select("data_index", *(_round(F.col(f"m.{k}.score")).alias(f"{k}_score") for k in ("sum", "avg", "min")), F.col("m.sum.total").alias("total"))


@query(f"""WITH {DOC_ITEMS}, {_FORM}, c AS (SELECT data_index, CASE WHEN {_SAFE} = 0 THEN 0 ELSE ({_form_sql('sum')}) + {_SAFE} END AS score FROM form)
  SELECT score / 5.0 >= 0.5 AS pass, count(*) AS n, max(floor(score * 1e6 + 0.5) / 1e6) AS max_score FROM c GROUP BY 1""")
def q44_multi_checker(spark, sf_dir):
    items = views.doc_items(spark, sf_dir).withColumn("m", checkers.merged(_doc_checks("sum"), "sum"))
    s = scoring.Scorer(F.col("m.score"), "checks", reason=F.col("m.reason"), dynamic_total=True, own_total=F.col("m.total"), threshold=0.5, extra=F.col("m.extra"))
    return scoring.score_items(items, [s], "rate").groupBy("pass").agg(F.count("*").alias("n"), F.max(_round(F.col("score"))).alias("max_score"))


# --- attribution --------------------------------------------------------------------------

_REPLY_SQL = "CASE data_index % 4 WHEN 0 THEN '慢#错' WHEN 1 THEN ' 慢 ##慢' WHEN 2 THEN '' ELSE '格式#乱码' END"
_ISSUES = f"""replies AS (SELECT doc_id AS data_index, CASE doc_id % 4 WHEN 0 THEN '慢#错' WHEN 1 THEN ' 慢 ##慢' WHEN 2 THEN '' ELSE '格式#乱码' END AS reply FROM documents),
issues AS (SELECT DISTINCT data_index, trim(i) AS issue FROM (SELECT data_index, unnest(string_split(reply, '#')) AS i FROM replies WHERE reply <> '') WHERE trim(i) <> ''
  UNION ALL SELECT data_index, '未知问题' FROM replies WHERE reply = '')"""


def _replies(spark, sf_dir):
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, "慢#错").when(k == 1, " 慢 ##慢").when(k == 2, "").otherwise("格式#乱码")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_index"), reply.alias("reply"))


@query(f"WITH {_ISSUES} SELECT issue AS issue_name, data_index, count(*) OVER (PARTITION BY issue) AS case_count FROM issues")
def q45_attribute_index(spark, sf_dir):
    return counting.attribute_cases(counting.issues(_replies(spark, sf_dir)))


@query(f"""WITH {_ISSUES}, syn AS (SELECT * FROM (VALUES ('延迟', '慢'), ('错误', '错'), ('错误', '乱码')) t(standard, synonym)),
  n AS (SELECT DISTINCT data_index, standard FROM issues JOIN syn ON issue = synonym)
  SELECT standard AS issue_name, data_index, count(*) OVER (PARTITION BY standard) AS case_count FROM n""")
def q46_attribute_normalized(spark, sf_dir):
    synonyms = counting.synonym_table(spark, '```json\n{"延迟": ["慢"], "错误": ["错", "乱码"]}\n```')
    return counting.attribute_cases(counting.normalized_issues(counting.issues(_replies(spark, sf_dir)), synonyms))


# --- calls --------------------------------------------------------------------------------


class _Echo:
    """A system under test that echoes queries, has no answer for every fifth case and fails for every seventh."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    def __call__(self, data_index, item):
        if data_index % 7 == 0:
            raise RuntimeError("no service")
        if data_index % 5 == 0:
            return None
        key = item.get("key", "")
        self.calls[key] = self.calls.get(key, 0) + 1
        return {"response": f"echo {item.get('query', '')}", "nth": str(self.calls[key])}


def _clock():
    return 0


@query("""SELECT doc_id AS data_index, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS success, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 'echo ' || doc_id ELSE 'none' END AS response FROM documents""")
def q47_api_fake(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_index"), F.create_map(F.lit("query"), F.col("doc_id").cast("string")).alias("input_item"))
    out = external.api_completion(items, _Echo, clock=_clock)
    return out.select("data_index", "success", vl.get_or(F.col("result_item"), "response", "none").alias("response"))


@query("""SELECT event_id AS data_index, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN
  (count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 5 <> 0) OVER (PARTITION BY user_id ORDER BY ts, event_id))::VARCHAR ELSE 'none' END AS nth FROM events""")
def q48_ordered_seq(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("data_index"), "user_id", "ts", F.create_map(F.lit("key"), F.col("user_id").cast("string")).alias("input_item"))
    out = external.ordered_completion(e, F.col("user_id"), [F.col("ts"), F.col("data_index")], _Echo, _clock)
    return out.select("data_index", vl.get_or(F.col("result_item"), "nth", "none").alias("nth"))


def _echo_model():
    return lambda prompt: prompt[:40]


@query(f"""WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, {_COUNT} AS i, {_COUNT.replace('text', 'left(text, 40)')} AS o FROM documents)
  SELECT model, sum(i)::BIGINT AS in_tokens, sum(o)::BIGINT AS out_tokens, (sum(i) + sum(o))::BIGINT AS total_tokens, (sum(i) * (CASE model WHEN 'small' THEN 0.0000005 ELSE 0.0000030 END)::DECIMAL(20,10))::DOUBLE AS in_cost,
  (sum(o) * (CASE model WHEN 'small' THEN 0.0000015 ELSE 0.0000120 END)::DECIMAL(20,10))::DOUBLE AS out_cost FROM c GROUP BY model""")
def q49_llm_usage(spark, sf_dir):
    prices = spark.createDataFrame([("small", 0.5, 1.5), ("large", 3.0, 12.0)], "model string, in_price double, out_price double")
    calls = []
    for k, model in enumerate(("small", "large")):
        prompts = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == k).select(F.col("doc_id").alias("data_index"), F.col("text").alias("prompt"))
        calls.append(external.llm_calls(external.llm(prompts, _echo_model, model, retries=1), model))
    return counting.llm_usage(calls[0].union(calls[1]), prices)


# --- generated and mocked cases -----------------------------------------------------------


@query("""SELECT conv_id, turn, coalesce(string_agg(turn || ': ' || text || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS "contextDependency" FROM conversations""")
def q50_context_dependency(spark, sf_dir):
    return files.with_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "contextDependency")


class _Numbers:
    def support(self, rule, args):
        return rule == "twice"

    def mock(self, rule, args, draw):
        return str(2 * int(args[0]))


def _number_engine():
    return mock.Engine([_Numbers()])


@query("SELECT doc_id, 'n = ' || (2 * doc_id) || ' and ' || ', ' || lang AS text FROM documents")
def q51_mock_fixed(spark, sf_dir):
    template = F.concat(F.lit("n = {{twice "), F.col("doc_id").cast("string"), F.lit(" }} and {{nothing}}, "), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", mock.mock_text(template, F.col("doc_id"), 1, _number_engine).alias("text"))


@query("SELECT (i % 4 + 1)::INTEGER AS round, (SELECT count(*) FROM customer) AS n, CASE WHEN i % 4 = 0 THEN 0 ELSE (SELECT sum(length(k || ': query ' || k) + 1) FROM range(1, i % 4 + 1) t(k)) END::BIGINT AS context_length FROM range(4) r(i)")
def q52_gen_sessions(spark, sf_dir):
    """A session of four rounds for each customer."""
    s = files.sessions(spark, table(spark, sf_dir, "customer").count(), 4, seed=3)
    return s.groupBy("round").agg(F.count_distinct("sessionId").alias("n"), F.max(F.length("contextDependency")).cast("bigint").alias("context_length"))


# --- streams ------------------------------------------------------------------------------


def _length_scores(batch: DataFrame) -> DataFrame:
    s = [scoring.Scorer(F.length("text").cast("double"), "length", total_score=1000, threshold=100), scoring.Scorer((F.col("lang") == "en").cast("double"), "english")]
    return scoring.verdicts(scoring.score_items(batch, s), "sum", 500, reasons=False)


def _ordered_scores(batch: DataFrame) -> DataFrame:
    """The number of calls of its source that succeeded up to a case: it depends on the order of calls."""
    items = batch.select("data_index", "source", F.create_map(F.lit("key"), F.col("source")).alias("input_item"))
    out = external.ordered_completion(items, F.col("source"), [F.col("data_index")], _Echo, _clock)
    return out.select("data_index", vl.get_or(F.col("result_item"), "nth", "0").cast("double").alias("score"), F.col("success").alias("pass"))


def _delta(spark, sf_dir, name, evaluate, **how):
    from scorelake.model import RunConfig, scratch

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_index"), "text", "lang", "source")
    run = delta.DeltaRun(spark, scratch(spark, name), evaluate, RunConfig(task_name=name, batch_size=2000, message_process_max_time=3600), files_per_batch=4, **how)
    run.load(docs)
    return run.run().select("data_index", "score", "pass")


_DELTA_SQL = "SELECT doc_id AS data_index, length(text)::DOUBLE + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS score, length(text) + CASE WHEN lang = 'en' THEN 1 ELSE 0 END >= 500 AS pass FROM documents"


@query(_DELTA_SQL)
def q53_delta_batch_equiv(spark, sf_dir):
    return _delta(spark, sf_dir, "delta", _length_scores)


@query("""SELECT doc_id AS data_index, CASE WHEN ok THEN count(*) FILTER (WHERE ok) OVER (PARTITION BY source ORDER BY doc_id) ELSE 0 END::DOUBLE AS score, ok AS pass
  FROM (SELECT doc_id, source, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS ok FROM documents)""")
def q54_ordered_delta_equiv(spark, sf_dir):
    return _delta(spark, sf_dir, "ordered", _ordered_scores, key=F.col("source"), order=[F.col("data_index")])


@query(f"""WITH {EVENT_CASES} SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, {RATES_SQL} FROM event_cases GROUP BY ALL""")
def q55_events_window(spark, sf_dir):
    return delta.windowed_counts(views.event_cases(spark, sf_dir), "ts", "1 hour", metrics=counting.rate_metrics())


# --- flagship -----------------------------------------------------------------------------


def _flagship_verdicts(spark, sf_dir):
    items = views.conv_items(spark, sf_dir)
    scorers = [
        scoring.Scorer(F.least(F.length("response") / 100.0, F.lit(1.0)), "length", threshold=0.2),
        scoring.vector_similarity(F.col("query"), F.col("response"), 0.1, metric="similarity"),
    ]
    return scoring.item_verdicts(items, scorers, "sum", 1.0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation pairs -> two scorers -> verdicts -> one row of counts."""
    v = _flagship_verdicts(spark, sf_dir)
    return v.agg(F.count("*").alias("total_count"), F.count_if("pass").alias("pass_count"), F.count_if("success").alias("success_count"), vl.nearest_rank("score", 90).alias("tp90_score"), F.max("score").alias("max_score"))


query(f"""WITH {_COSINE}, v AS (SELECT c.data_index, (cast(cast(least(length(response) / 100.0::DOUBLE, 1.0::DOUBLE) as decimal(18,6)) + CASE WHEN similarity > 0.1 THEN 1 ELSE 0 END as double)) AS score FROM conv_items c JOIN cosine USING (data_index))
  SELECT count(*) AS total_count, count(*) FILTER (WHERE score >= 1) AS pass_count, count(*) AS success_count, quantile_disc(score, 0.9) AS tp90_score, max(score) AS max_score FROM v""")(flagship)
QUERIES["q00_flagship"] = QUERIES.pop("flagship")
ORACLE_SQL["q00_flagship"] = ORACLE_SQL.pop("flagship")
