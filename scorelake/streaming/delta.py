"""Delta runs: cases evaluated in micro-batches with a checkpoint, resumable, each case once; ordered by key on demand.

The checkpoint tells which files have been evaluated. A batch overwrites its own partition of the results,
so a batch that runs twice leaves one copy; readers keep one row per case, which covers duplicates in the source.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.model import RunConfig
from scorelake.plans.flow import paged

INIT, RUNNING, FINISHED, FAILED = 0, 1, 2, 3
#: Tasks that fill a queue, and the column that deals keys to its files.
TASKS, FILE = 1000, "__file"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@dataclass
class TaskRegistry:
    """A small table of runs: task_name, all_count, status and times; a new version of a row is a new file."""

    spark: SparkSession
    path: str
    schema: str = "task_name string, all_count bigint, status int, create_time bigint, update_time bigint, finish_time bigint, version bigint"

    def all(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.groupBy("task_name").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "task_name")), "version").alias("r")).select("task_name", "r.*")

    def get(self, name: str):
        return self.all().where(F.col("task_name") == name).first()

    def put(self, name: str, **values: int) -> None:
        now, old = int(time.time() * 1000), self.get(name)
        row = old.asDict() if old else {"task_name": name, "all_count": 0, "status": INIT, "create_time": now, "finish_time": None, "version": 0}
        row |= values | {"update_time": now, "version": row["version"] + 1}
        if row["status"] == FINISHED and row["finish_time"] is None:
            row["finish_time"] = now
        self.spark.createDataFrame([row], self.schema).coalesce(1).write.mode("append").parquet(self.path)


@dataclass
class DeltaRun:
    """evaluate maps a batch of cases to results with data_index; it may run again for a batch after a failure.

    Of the config, offset and limit page the cases that load takes, batch_size is the number of cases to a file,
    message_process_max_time bounds the seconds of a batch, a batch beyond it fails the run, which
    can be resumed; receive_timeout is how many seconds run waits for a queue that another process loads.

    partial and merge make reports cheap: partial maps a batch's results to rows of bounded size, as counting.partial_counts
    does, which are written with the batch; a report gets what merge makes of all of them, instead of all results, so it costs a
    row or a few for each batch. For this, cases must be in the queue once; load sees to it.

    queue: a folder of Parquet files of cases, each up to batch_size of them, of which thread_num are a batch. With key and order, the cases
    of a key are evaluated in one task and in this order inside a batch; all of a queue loaded by load go
    by key into files, so that they meet in a batch.
    """

    spark: SparkSession
    folder: str
    evaluate: Callable[[DataFrame], DataFrame]
    config: RunConfig = field(default_factory=RunConfig)
    key: Column | None = None
    order: list[Column] = field(default_factory=list)
    report: Callable[[DataFrame], None] | None = None
    files_per_batch: int | None = None
    partial: Callable[[DataFrame], DataFrame] | None = None
    merge: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        if (self.partial is None) != (self.merge is None):
            raise ValueError("partial and merge go together")
        base = f"{self.folder}/{self.config.task_name}"
        self.queue, self.results, self.checkpoint, self.state = f"{base}/queue", f"{base}/results", f"{base}/checkpoint", f"{base}/state"
        self.tasks = TaskRegistry(self.spark, f"{self.folder}/tasks")
        if not self.config.enable_resume:
            _delete(self.spark, base)

    def load(self, items: DataFrame) -> bool:
        """Fill the queue once; False if the run has been loaded before. Cases go in about batch_size to a file, however many files there are.

        Files are written by TASKS tasks at most. Cases with the data_index of another one are left out, if a report is merged.
        """
        if _exists(self.spark, f"{self.queue}/_SUCCESS"):
            return False
        items = paged(items, self.config)
        if self.partial:
            items = items.dropDuplicates(["data_index"])
        n = items.count()
        files = max(1, -(-n // self.config.batch_size))
        tasks = min(files, TASKS)
        if self.key is None:
            items.repartition(tasks).write.mode("overwrite").option("maxRecordsPerFile", self.config.batch_size).parquet(self.queue)
        else:  # a file has all cases of its keys
            rows = items.withColumn(FILE, F.pmod(F.xxhash64(self.key), F.lit(files)))
            rows = rows.repartition(tasks, FILE).sortWithinPartitions(FILE, self.key, *self.order)
            rows.write.mode("overwrite").partitionBy(FILE).parquet(self.queue)
        self.tasks.put(self.config.task_name, all_count=n, status=RUNNING)
        return True

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.drop(FILE)
        if self.key is not None:
            batch = batch.repartition(self.key).sortWithinPartitions(self.key, *self.order)
        # a batch that runs again overwrites what it wrote
        with self._limited(batch_id):
            self.evaluate(batch).write.mode("overwrite").parquet(target := f"{self.results}/batch_id={batch_id}")
            if self.partial:
                self.partial(self.spark.read.parquet(target)).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/batch_id={batch_id}")

    @contextmanager
    def _limited(self, batch_id: int):
        """Cancel the batch's jobs when its time is over."""
        context, tag, over = self.spark.sparkContext, f"delta-{self.config.task_name}-{batch_id}-{uuid.uuid4().hex}", threading.Event()

        def cancel() -> None:
            over.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.config.message_process_max_time, cancel)
        context.addJobTag(tag)
        timer.start()
        try:
            yield
        except Exception as e:
            if over.is_set():
                raise TimeoutError(f"batch {batch_id} took more than {self.config.message_process_max_time} s") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def wait_for_queue(self) -> bool:
        """Whether the queue is loaded, at the latest after receive_timeout seconds."""
        end = time.monotonic() + self.config.receive_timeout
        while not (there := _exists(self.spark, f"{self.queue}/_SUCCESS")) and time.monotonic() < end:
            time.sleep(0.2)
        return there

    def start(self):
        """The streaming query over all files of the queue that the checkpoint doesn't have; it ends after them."""
        schema = self.spark.read.parquet(self.queue).schema
        cases = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch or self.config.thread_num).parquet(self.queue)
        return cases.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def run(self) -> DataFrame:
        """Evaluate what is left, reporting every report_interval seconds and at the end; results of all batches so far."""
        name = self.config.task_name
        if not self.wait_for_queue():
            raise TimeoutError(f"no cases came to {self.queue} in {self.config.receive_timeout} s")
        query = self.start()
        try:
            while not query.awaitTermination(self.config.report_interval):
                self._report()
            self.tasks.put(name, status=FINISHED)
        except Exception:
            self.tasks.put(name, status=FAILED)
            raise
        finally:
            self._report()
        return self.all_results()

    def _report(self) -> None:
        if self.report and self.merge and _exists(self.spark, self.state):
            self.report(self.merged())
        elif self.report and not self.merge and _exists(self.spark, self.results):
            self.report(self.all_results())

    def merged(self) -> DataFrame:
        """What merge makes of the partial rows of all batches so far."""
        return self.merge(self.spark.read.parquet(self.state).drop("batch_id"))

    def all_results(self) -> DataFrame:
        """One row per case."""
        rows = self.spark.read.parquet(self.results)
        return rows.drop("batch_id").dropDuplicates(["data_index"])

    def progress(self) -> dict[str, int]:
        task = self.tasks.get(self.config.task_name)
        total = task.all_count if task else 0
        done = self.all_results().count() if _exists(self.spark, self.results) else 0
        return {"total": total, "processed": done, "remaining": total - done}


def windowed_counts(events: DataFrame, time_column: str, width: str, late: str | None = None, metrics: dict[str, Column] | None = None, slide: str | None = None) -> DataFrame:
    """Metrics by event-time window, for batches and streams alike; late rows count until the watermark passes."""
    rows = events.withWatermark(time_column, late) if late else events
    window = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    metrics = metrics or {"n": F.count("*")}
    out = rows.groupBy(window.alias("w")).agg(*(c.alias(k) for k, c in metrics.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *metrics)
