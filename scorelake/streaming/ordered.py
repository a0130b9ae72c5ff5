"""Cases of a key in their order, whatever the order in which a queue brings them: what comes too early waits for what is missing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State that is kept by key needs this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key_ string, place bigint, row string, late boolean"


class _Release(StatefulProcessor):
    """By key: the place that is next, and the rows that wait for it."""

    def __init__(self, first: int, wait: int):
        self.first, self.wait = first, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "place bigint")
        self.waiting = handle.getMapState("waiting", "place bigint", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else self.first
        out = []
        for some in rows:
            for place, row in zip(some["place"].tolist(), some["row"].tolist(), strict=True):
                if place < at:  # others after it have gone already, or it comes again
                    out.append((place, row, True))
                else:
                    held = json.loads(self.waiting.getValue((place,))[0]) if self.waiting.containsKey((place,)) else []
                    self.waiting.updateValue((place,), (json.dumps([*held, row]),))
        while self.waiting.containsKey((at,)):
            out += [(at, row, False) for row in json.loads(self.waiting.getValue((at,))[0])]
            self.waiting.removeKey((at,))
            at += 1
        self.next.update((at,))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What is missing isn't waited for any longer: all that waits goes on in its order."""
        places = sorted(k[0] for k in self.waiting.keys())
        out = [(p, row, False) for p in places for row in json.loads(self.waiting.getValue((p,))[0])]
        for p in places:
            self.waiting.removeKey((p,))
        if places:
            self.next.update((places[-1] + 1,))
        yield self._rows(key, out)

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(str(key[0]), p, r, late) for p, r, late in out], columns=["key_", "place", "row", "late"]).astype({"place": "int64", "late": "bool"})

    def close(self) -> None: ...


def in_order(cases: DataFrame, key: str, place: str, first: int = 0, wait: float = 60.0) -> DataFrame:
    """The stream's rows with __late, released by key in the order of place, which counts from ``first`` without gaps.

    A row that comes before its predecessors waits for them in the stream's state, ``wait`` seconds from the last row of its key; then all that
    wait go on. Rows whose place has gone by come at once, marked as late, and so do repeated ones. A batch holds any number of
    rows of a key, in no order: sort it by key and place. Needs the state store PROVIDER. Timers keep a stream with the
    trigger availableNow alive for ever, unless spark.sql.streaming.noDataMicroBatches.enabled is off; then they
    fire with the next data only.
    """
    columns = cases.columns
    packed = cases.select(F.col(key).cast("string").alias("key_"), F.col(place).cast("bigint").alias("place"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))
    released = packed.groupBy("key_").transformWithStateInPandas(_Release(first, int(wait * 1000)), OUT, "Append", "ProcessingTime")
    return released.select(F.from_json("row", cases.schema).alias("x"), F.col("late").alias("__late")).select("x.*", "__late")


def use_state_store(spark: SparkSession) -> None:
    """Let the session's streams keep state by key in RocksDB, which in_order needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def release_all(cases: DataFrame, key: str, place: str, first: int, results: str, checkpoint: str) -> None:
    """Release what a stream of files has at present, in order, to Parquet in ``results``, a folder for each batch (batch_id); it can be continued.

    Rows whose predecessors haven't come yet stay in the checkpoint's state for the next call.
    """
    spark = cases.sparkSession
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = [spark.conf.get(n) for n in names]
    use_state_store(spark)
    spark.conf.set(names[1], "false")
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{results}/batch_id={number}")
        query = in_order(cases, key, place, first, 3600).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
