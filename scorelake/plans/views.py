"""Driver tables in the shape of evaluation data, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn that an assistant turn follows directly."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("response"))
    rows = rows.where("role = 'user' and next_role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("data_index"), "conv_id", F.col("turn").alias("round"), F.col("text").alias("query"), "response")


CONV_ITEMS = """conv_items AS (SELECT conv_id * 1000 + turn AS data_index, conv_id, turn AS round, text AS query, response FROM (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").withColumnRenamed("doc_id", "data_index")


DOC_ITEMS = "doc_items AS (SELECT d.doc_id AS data_index, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def line_scores(spark: SparkSession, sf_dir: str, kind: str = "value", shift: float = 0.0) -> DataFrame:
    """Line items as scorer results of their order; results of an order are in one partition, so folds need no further shuffle."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    ok, score = F.col("l_returnflag") != "R", F.col("l_quantity") - shift
    start = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    rows = rows.select(
        F.col("l_orderkey").alias("data_index"), pos.alias("scorer_pos"), F.col("l_linenumber").cast("string").alias("metric"), score.alias("score"), F.lit(50.0).alias("total_score"),
        (score / 50.0).alias("score_rate"), F.lit(10.0).alias("threshold"), ok.alias("success"), start.alias("start_time"), (start + F.floor("l_quantity")).alias("end_time"), F.floor("l_quantity").alias("time_cost"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("reason"),
    )
    rows = rows.withColumn("star", F.col("scorer_pos") == 1)
    return rows.withColumn("pass", F.col("success") & ((F.col("score") if kind == "value" else F.col("score_rate")) >= (F.col("threshold") if kind == "value" else F.lit(0.2))))


def line_scores_sql(kind: str = "value", shift: float = 0.0) -> str:
    passes = "score >= threshold" if kind == "value" else "score_rate >= 0.2::DOUBLE"
    return f"""line_scores AS (SELECT *, scorer_pos = 1 AS star, success AND {passes} AS pass FROM (SELECT l_orderkey AS data_index,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INTEGER AS scorer_pos, l_linenumber::VARCHAR AS metric,
  l_quantity - {shift}::DOUBLE AS score, 50.0::DOUBLE AS total_score, (l_quantity - {shift}::DOUBLE) / 50.0::DOUBLE AS score_rate, 10.0::DOUBLE AS threshold, l_returnflag <> 'R' AS success,
  epoch_us(l_shipdate) // 1000 AS start_time, epoch_us(l_shipdate) // 1000 + floor(l_quantity)::BIGINT AS end_time, floor(l_quantity)::BIGINT AS time_cost, 'part ' || l_partkey AS reason FROM lineitem))"""


def event_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cases: one in ten API calls fails, evaluation succeeds unless the value is small."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("data_index"), "user_id", "ts", "event_type", (F.col("event_id") % 10 != 0).alias("api_success"), F.floor(F.col("value") * 100).alias("api_time_cost"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") >= 1.0).alias("eval_success"), F.floor(F.col("value") * 10).alias("eval_time_cost"), F.col("value").alias("score"), (F.col("value") >= 20).alias("pass"),
    )


EVENT_CASES = """event_cases AS (SELECT event_id AS data_index, user_id, ts, event_type, event_id % 10 <> 0 AS api_success, floor(value * 100)::BIGINT AS api_time_cost,
  CASE WHEN event_id % 7 <> 0 THEN value >= 1.0 END AS eval_success, floor(value * 10)::BIGINT AS eval_time_cost, value AS score, value >= 20 AS pass FROM events)"""
