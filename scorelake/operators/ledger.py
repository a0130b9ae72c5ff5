"""A written table of what systems outside have answered, so that nobody is asked twice.

Answers are kept by scope (a scorer or an API), case and a hash of what was asked. Only what isn't
there yet is asked, and what comes back is written before anybody reads it: sinks, further runs and lost executors read
answers. Each task's answers are kept when the task ends, also those of a job that fails later.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ["data_index", "ask"]


def asked(*values: Column) -> Column:
    """A hash of what is asked; maps count whatever the order of their keys."""
    return F.sha2(F.to_json(F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values)))), 256)


@dataclass
class Ledger:
    """path: a folder that the driver and all executors share. per_task: cases that a task asks at most, which a lost task asks again."""

    spark: SparkSession
    path: str
    per_task: int = 500

    def _folder(self, scope: str) -> str:
        return f"{self.path}/{quote(scope, safe='')}"

    def _batches(self, scope: str) -> list[str]:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self._folder(scope))
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().toString() for f in fs.listStatus(target)) if fs.exists(target) else []

    def known(self, scope: str, schema: str | StructType) -> DataFrame | None:
        """All answers so far, with their batch; None if nobody has asked yet."""
        batches = self._batches(scope)
        if not batches:
            return None
        plain = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
        # a table made of files of finished tasks, in folders of finished and failed jobs
        rows = self.spark.read.schema(plain).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").parquet(*batches)
        batch = F.regexp_extract(F.input_file_name(), r"/(\d{20}-[0-9a-f]+)/", 1)
        return rows.where(~F.input_file_name().contains("/_temporary/")).withColumn("batch", batch)

    def fill(self, scope: str, cases: DataFrame, call: Callable[[DataFrame], DataFrame], schema: str, good: str = "true") -> DataFrame:
        """Answers to cases (data_index, ask, ...), a row for each; ``call`` takes cases and gives rows of the schema, which has data_index and ask.

        Cases with an answer for which ``good`` is true aren't asked; others are, once in this call, however
        often they are among the cases. Of several answers to a case a good one counts, and the latest of these.
        """
        known = self.known(scope, schema)
        missing = cases.dropDuplicates(KEY)
        if known is not None:
            missing = missing.join(known.where(good).select(*KEY).distinct(), KEY, "left_anti")
        missing = missing.persist()  # counted, then asked; a lost part is found anew from the tables
        try:
            n = missing.count()
            if n:
                made = call(missing.repartition(-(-n // self.per_task), *KEY))
                # with the second algorithm a task's files are there when the task ends, not only when the job does
                target = f"{self._folder(scope)}/{time.time_ns():020d}-{uuid.uuid4().hex}"
                made.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(target)
        finally:
            missing.unpersist()
        all_ = self.known(scope, schema)
        if all_ is None:
            return cases.select(*KEY).join(self.spark.createDataFrame([], schema), KEY)
        rest = [c for c in all_.columns if c not in (*KEY, "batch")]
        best = all_.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.expr(good), F.lit(False)), "batch")).alias("x"))
        return cases.select(*KEY).join(best, KEY).select(*KEY, "x.*")

    def calls(self, scope: str, schema: str) -> DataFrame:
        """Rows (run, n): how many cases each batch of calls has asked, from the first on."""
        known = self.known(scope, schema)
        if known is None:
            return self.spark.createDataFrame([], "run int, n bigint")
        order = {path.rstrip("/").rpartition("/")[2]: k + 1 for k, path in enumerate(self._batches(scope))}
        names = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
        return known.groupBy(F.element_at(names, F.col("batch")).alias("run")).agg(F.count("*").alias("n"))
