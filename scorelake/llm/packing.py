"""Best-fit packing of documents into fixed-length sequences by minimum bin slack.

The plan depends on how many pieces there are of each length, never on the pieces themselves: a
histogram of at most ``capacity`` rows. For one bin after another, a subset-sum dynamic program on
bitsets finds the fullest combination of available lengths that holds the longest one; the
combination is then taken as often as the histogram allows. Each such step leaves one length with
less than half of its remainder or fewer than one use, so a plan has a few thousand lines whatever
the corpus's size. Pieces find their place by their rank among those of the same length: they are sorted
by length over the tasks, and only counts by task and length, a row for each task and length more than there
are lengths, go through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import written
from scorelake.llm.tokens import encoder, vocabulary_path

CAPACITY = 2048
END = 0
#: Words that a worker remembers: fewer than elsewhere, as other operators' workers may be alive beside it.
REMEMBERED = 200_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How often to use each length so that a bin with the longest available one is as full as can be."""
    order = sorted((n for n, c in counts.items() if c), reverse=True)
    room = capacity - order[0]
    reach, states = 1, []
    keep = (1 << room + 1) - 1
    for n in order:
        if n > room:
            continue
        left = min(counts[n] - (n == order[0]), room // n)
        step = 1
        while left > 0:  # binary splitting: 1, 2, 4, ... of the same length
            k = min(step, left)
            states.append((n, k, reach))
            reach |= (reach << n * k) & keep
            left, step = left - k, step * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {order[0]: 1}
    for n, k, before in reversed(states):
        if not before >> at & 1:
            at -= n * k
            used[n] = used.get(n, 0) + k
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Lines (length, first rank, last rank + 1, uses per bin, first sequence, offset in it)."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    taken = dict.fromkeys(counts, 0)
    lines, sequence = [], 0
    while counts:
        used = fullest(counts, capacity)
        times = min(counts[n] // u for n, u in used.items())
        offset = 0
        for n, u in used.items():
            lines.append((n, taken[n], taken[n] + u * times, u, sequence, offset))
            taken[n] += u * times
            counts[n] -= u * times
            offset += n * u
            if not counts[n]:
                del counts[n]
        sequence += times
    return sorted(lines)


def _cut(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """(start, ids) of each piece; only the first of a cut document may be shorter than capacity."""
    size = len(ids) // 4
    start, end = 0, (size - 1) % capacity + 1
    while start < size:
        yield start, ids[start * 4 : end * 4]
        start, end = end, end + capacity


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces with the number of their task and their own in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, nth = encoder(tokenizer, REMEMBERED).encode, TaskContext.get().partitionId(), 0
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (start, ids) in enumerate(_cut(code(text.as_py() or "") + end, capacity)):
                    rows.append((doc, k, start, len(ids) // 4, zlib.crc32(ids), task, nth))
                    nth += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


_KEPT = ["doc_id", "piece", "start", "length", "ids_crc32"]


def ranked(cut: DataFrame) -> DataFrame:
    """Pieces sorted by length over the tasks, with their part of the order and their rank among those of their length there."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            n = batch.column("length").to_numpy()
            if not len(n):
                continue
            starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            rank = np.arange(len(n)) - np.repeat(starts, np.diff(np.r_[starts, len(n)]))
            if n[0] == at:  # the length goes on from the batch before
                rank[n == at] += seen
            at, seen = n[-1], rank[-1] + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(np.full(len(n), part, np.int32)), pa.array(rank)], [*_KEPT, "part", "rank"])

    ordered = cut.repartitionByRange("length", "task", "nth").sortWithinPartitions("length", "task", "nth").select(*_KEPT)
    return ordered.mapInArrow(number, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece. A null or
    empty text is its end id alone; a text of any length is cut as a whole. Rows with a null or repeated doc_id are packed like any other,
    each on its own. An empty table gives no rows. Other columns of docs aren't looked at.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer or vocabulary_path(), capacity), "pieces")
    rows = written(ranked(cut), "ranked_pieces")
    # a row per part and length: lengths are sorted over the parts, so at most parts + lengths
    counts = sorted((r["length"], r["part"], r["n"]) for r in rows.groupBy("part", "length").agg(F.count("*").alias("n")).collect())
    histogram: dict[int, int] = {}
    bases = []
    for n, part, many in counts:
        bases.append((n, part, histogram.get(n, 0)))
        histogram[n] = histogram.get(n, 0) + many
    lines = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    if len(lines) and lines[:, 2].max() >= 1 << 50:
        raise ValueError("too many pieces of one length")
    shared = spark.sparkContext.broadcast((lines, np.array(bases, np.int64).reshape(-1, 3)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, bases = shared.value
        length, first, _, uses, sequence, offset = lines.T
        span, parts = int(lines[:, 2].max(initial=0)) + 1, int(bases[:, 1].max(initial=0)) + 1
        key, base_key = length * span + first, bases[:, 0] * parts + bases[:, 1]
        for batch in batches:
            n, part = batch.column("length").to_numpy(), batch.column("part").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy() + bases[np.searchsorted(base_key, n * parts + part), 2]
            at = np.searchsorted(key, n * span + rank, "right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(sequence[at] + nth // uses[at]), pa.array(offset[at] + nth % uses[at] * n)], out)

    out = [*_KEPT, "sequence_id", "offset"]
    return rows.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
