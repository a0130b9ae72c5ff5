import ast
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from scorelake.sinks import reports
from scorelake.sources import files

ROOT = Path(__file__).resolve().parent.parent
#: Executors in processes of their own, which share the folder given first with the driver.
RUN = """
import sys, __spark_entry__
from pyspark.sql import SparkSession
shared, sf_dir, name = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS", [tuple(r) for r in __spark_entry__.queries()[name](spark, sf_dir).collect()])
spark.stop()
"""


def test_q63_on_executors_of_their_own(spark, tmp_path):
    home = tmp_path / "home"  # executors' logs go to work in it
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    spark.createDataFrame([(k, f"R{k}", None) for k in range(2500)], "r_regionkey int, r_name string, r_comment string").repartition(3).write.parquet(f"{tmp_path}/region.parquet")
    env = os.environ | {"SPARK_HOME": str(home), "PYTHONPATH": str(ROOT), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_SCALA_VERSION": "2.13"}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS"):
        env.pop(k, None)
    out = subprocess.run([sys.executable, "-c", RUN, f"{tmp_path}/shared", str(tmp_path), "q63_jdbc_round_trip"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    rows = [x.split("ROWS ", 1)[1] for x in out.stdout.splitlines() if "ROWS " in x]
    assert rows, out.stderr[-2000:]
    assert sorted(ast.literal_eval(rows[0])) == [(k, f"R{k}") for k in range(2500)]


@pytest.mark.parametrize("batch", [1, 2, 1000])
def test_rows_by_the_driver(spark, tmp_path, batch):
    url = f"jdbc:derby:memory:d{tmp_path.name};create=true"
    rows = spark.createDataFrame([(1, 'a "b"\n漢', 0.5), (2, None, None), (1 << 40, "", 2.0)], "id long, query string, n double")
    for _ in range(2):  # the second time the table is there
        reports.jdbc_by_driver(rows, url, "cases", batch=batch)
    got = files.jdbc_by_driver(spark, url, 'select * from cases order by "id"', batch).orderBy("order_key").collect()
    want = [{"id": "1", "query": 'a "b"\n漢', "n": "0.5"}] * 2 + [{"id": "2", "query": None, "n": None}] * 2 + [{"id": str(1 << 40), "query": "", "n": "2.0"}] * 2
    assert [r.input_item for r in got] == want and [r.order_key for r in got] == list(range(6))
    assert files.jdbc_by_driver(spark, url, 'select * from cases where "id" = 3').collect() == []


def test_a_failure_leaves_no_rows(spark, tmp_path):
    url = f"jdbc:derby:memory:f{tmp_path.name};create=true"
    reports.jdbc_by_driver(spark.createDataFrame([(1, "a")], "id int, query string"), url, "cases")
    more = spark.range(5).selectExpr("int(id + 2) id", "case when id = 4 then raise_error('lost') else 'x' end query").coalesce(1)
    with pytest.raises(Exception, match="lost"):
        reports.jdbc_by_driver(more, url, "cases", batch=1)
    odd = spark.createDataFrame([(5, "b"), (None, "c")], "id int, query string").selectExpr("id", "query", "1 more")
    with pytest.raises(Exception):
        reports.jdbc_by_driver(odd, url, "cases", batch=1)
    assert [r.input_item for r in files.jdbc_by_driver(spark, url, "select * from cases").collect()] == [{"id": "1", "query": "a"}]
