"""Exact dedup by a log-structured merge index of digests.

Each task collects documents in a memtable: digest of the normalised text -> smallest id, count and
the text itself, so that hits inside a memtable are verified byte by byte at once. A full memtable
is flushed as a run: entries sorted by digest and cut into segments by digest range. Compaction
merges the segments of a range in tiers of a fixed fan-in: each tier writes merged runs, one entry per
digest with the smallest id and the number of flushed entries. The last tier's run of a range holds the digests that several
entries share, behind a Bloom filter; flushed entries are looked up in it. The texts of such hits are
fetched and compared byte by byte. A group of copies, however large, gives one entry per flushed run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import SPACE, id_filter, probably_in, without, written

#: Entries of a range that one compaction task holds, about 60 bytes each.
RANGE_ROWS = 250_000
#: Runs that one step of compaction merges, and entries of a digest that one task compares.
FAN_IN, COMPARED = 64, 1024
#: A memtable is flushed at this many documents or bytes of text.
MEMTABLE_ROWS, MEMTABLE_BYTES = 50_000, 64 << 20
NO_ID = np.iinfo(np.int64).max
_FILTER_HASHES, _FILTER_BITS_PER_KEY = 4, 10
_RUNS = re.compile(rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with each run of white space as one space; null is empty."""
    return _RUNS.sub(b" ", (text or "").encode())


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """Places of 64-bit keys in a Bloom filter of ``size`` bits, a row per hash."""
    a, b = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    return (a[None, :] + np.arange(_FILTER_HASHES, dtype=np.uint64)[:, None] * b[None, :]) % np.uint64(size)


def _heads(digests: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each digest as a number."""
    out = np.zeros((len(digests), 8), np.uint8)
    out[:, : digests.shape[1]] = digests[:, :8]
    return out.view("<u8").ravel()


def bloom(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(-(-max(64, len(keys) * _FILTER_BITS_PER_KEY) // 8) * 8, bool)
    bits[_bits(keys, len(bits)).ravel()] = True
    return np.packbits(bits)


def may_hold(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(keys, len(filter_) * 8).astype(np.int64)
    return (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0)


_COLUMNS = {
    "run": pa.int64(), "digest": pa.binary(), "variant": pa.int32(), "doc_id": pa.int64(), "run_min": pa.int64(), "run_n": pa.int64(),
    "front": pa.bool_(), "bucket": pa.int32(), "ids": pa.binary(), "counts": pa.binary(), "variants": pa.binary(),
}
_DDL = "run bigint, digest binary, variant int, doc_id bigint, run_min bigint, run_n bigint, front boolean, bucket int, ids binary, counts binary, variants binary"


def _flushed(run: int, table: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    """The run's rows by document, sorted by digest, and its segments."""
    rows, entries = [], []
    for digest in sorted(table):
        for variant, (_, ids) in enumerate(table[digest]):
            least = min((i for i in ids if i is not None), default=None)
            front = ids.index(least)
            entries.append((digest, NO_ID if least is None else least, len(ids), variant))
            rows += [(run, digest, variant, i, least, len(ids), k == front) for k, i in enumerate(ids)]
    yield _batch([*zip(*rows)] + [[None] * len(rows)] * 4)
    segments = []
    keys = np.array([int.from_bytes(e[0][:4].ljust(4, b"\0")) for e in entries], np.int64) * buckets >> 32
    for a, b in zip(cuts := np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), [*cuts[1:], len(keys)], strict=True):
        digests, ids, counts, variants = zip(*entries[a:b])
        segments.append((run, b"".join(digests), None, None, None, len(digests), None, int(keys[a]), *(np.array(x, t).tobytes() for x, t in ((ids, "<i8"), (counts, "<i8"), (variants, "<i4")))))
    yield _batch([*zip(*segments)])


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COLUMNS.values(), strict=True)], [*_COLUMNS])


def runs(docs: DataFrame, buckets: int, digest, rows: int = MEMTABLE_ROWS, size: int = MEMTABLE_BYTES) -> DataFrame:
    """Flush all documents: rows by document, and by segment (those with a bucket)."""

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32
        table: dict[bytes, list] = {}
        n = held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = normalised(text.as_py())
                entries = table.setdefault(digest(text), [])
                for known, ids in entries:
                    if known == text:  # a hit, verified byte by byte
                        ids.append(doc)
                        break
                else:
                    entries.append((text, [doc]))
                    held += len(text)
                n += 1
                if n >= rows or held >= size:
                    yield from _flushed(run, table, buckets)
                    run, table, n, held = run + 1, {}, 0, 0
        if n:
            yield from _flushed(run, table, buckets)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(flush, _DDL)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind)


def _digests(data: bytes, n: int) -> np.ndarray:
    """n digests of one width as rows of bytes."""
    return np.frombuffer(data, np.uint8).reshape(n, -1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per digest of sorted parts (digests, smallest ids, flushed entries), sorted by digest."""
    raw, ids, entries = (np.concatenate(x) for x in zip(*parts, strict=True))
    wide = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    order = np.lexsort(wide.view(">u8").T[::-1])
    raw, ids, entries = raw[order], ids[order], entries[order]
    first = np.flatnonzero(np.r_[True, (raw[1:] != raw[:-1]).any(1)])
    return raw[first], np.minimum.reduceat(ids, first), np.add.reduceat(entries, first)


_MERGED = "bucket int, slot bigint, digests binary, n int, ids binary, entries binary"


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that share the first ``width`` columns, which are next to each other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def compacted(segments: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One merged run per range, by tiers in which a task merges about ``fan_in`` runs of a range at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, 2):
            raw, ids, entries = _merged([(_digests(d, n), _numbers(i, "<i8"), _numbers(e, "<i8") if e is not None else np.ones(n, np.int64)) for _, _, d, n, i, e in rows])
            types = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            row = (*rows[0][:2], raw.tobytes(), len(ids), ids.astype("<i8").tobytes(), entries.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["bucket", "slot", "digests", "n", "ids", "entries"])

    runs_ = segments.select("bucket", F.col("run").alias("slot"), F.col("digest").alias("digests"), F.col("run_n").cast("int").alias("n"), "ids", F.lit(None).cast("binary").alias("entries"))
    left = segments.select("run").distinct().count()
    while True:
        left = -(-left // fan_in)
        slot = F.pmod(F.xxhash64("slot", F.lit(left)), F.lit(max(1, left)))
        ready = runs_.withColumn("slot", slot).repartition("bucket", "slot").sortWithinPartitions("bucket", "slot")
        runs_ = written(ready.mapInArrow(merge, _MERGED), "merged_runs")
        if left <= 1:
            return runs_


def _shared(digests: bytes, n: int, ids: bytes, entries: bytes) -> tuple[dict[bytes, tuple[int, int]], np.ndarray]:
    """Of a merged run: digests of several entries, their first 8 bytes, smallest ids, entries, and a filter over them."""
    counts = _numbers(entries, "<i8")
    some = np.flatnonzero(counts > 1)
    raw = _digests(digests, n)[some]
    heads = _heads(raw)
    return {d.tobytes(): (int(i), int(c)) for d, i, c in zip(raw, _numbers(ids, "<i8")[some], counts[some], strict=True)}, bloom(heads)


def looked_up(segments: DataFrame, merged: DataFrame) -> DataFrame:
    """Hits: flushed entries whose digest other entries have too, with the digest's number of entries."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, guard = None, {}, None
        for batch in batches:
            for bucket, run, digests, n, ids, counts, variants in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run is None:  # the merged run comes first in its range
                    at, (known, guard) = bucket, _shared(digests, n, ids, counts)
                    continue
                raw = _digests(digests, n)
                maybe = np.flatnonzero(may_hold(guard, _heads(raw))) if bucket == at and known else []
                rows = [(d, k, known[d]) for k in maybe if (d := raw[k].tobytes()) in known]
                if rows:
                    ids, counts, variants = _numbers(ids, "<i8"), _numbers(counts, "<i8"), _numbers(variants, "<i4")
                    out = [(run, d, int(variants[k]), None if ids[k] == NO_ID else int(ids[k]), int(counts[k]), total) for d, k, (_, total) in rows]
                    types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], ["run", "digest", "variant", "run_min", "run_n", "entries"])

    one = merged.select("bucket", F.lit(None).cast("bigint").alias("run"), F.col("digests").alias("digest"), "n", "ids", F.col("entries").alias("counts"), F.lit(None).cast("binary").alias("variants"))
    both = one.unionByName(segments.select("bucket", "run", "digest", F.col("run_n").cast("int").alias("n"), "ids", "counts", "variants"))
    ready = both.repartition("bucket").sortWithinPartitions("bucket", F.col("run").asc_nulls_first())
    return ready.mapInArrow(look, "run bigint, digest binary, variant int, run_min bigint, run_n bigint, entries bigint")


def verified(hits: DataFrame, docs: DataFrame, digest) -> DataFrame:
    """Compare the texts of hits byte by byte: (run, digest, variant, keep_id, group_size, wins) for each.

    A group is a digest and a text; texts are compared as keys of a grouping, which map tasks
    combine before the shuffle. Entries of a digest are spread over tasks, COMPARED to each.
    """

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(t) for t in texts], pa.binary()), pa.array(texts, pa.binary())], ["run_min", "digest", "text"])

    named = hits.where("run_min is not null")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("run_min"), "text").where("run_min is not null")
    texts = probably_in(texts, "run_min", id_filter(named, "run_min")).mapInArrow(normal, "run_min bigint, digest binary, text binary")
    # an id may have several texts, and a row may be there several times
    texts = texts.repartition("run_min", "digest").dropDuplicates(["run_min", "digest", "text"])
    full = written(named.join(texts, ["run_min", "digest"]), "verified_texts")
    groups = full.groupBy("digest", "text").agg(F.min("run_min").alias("keep_id"), F.sum("run_n").alias("group_size"), F.min(F.struct("run_min", "run", "variant")).alias("lead"), F.max("entries").alias("most"))
    loose = hits.where("run_min is null")
    alone = None
    if not loose.isEmpty():
        # a text that can't be fetched by id is taken for equal, as its digest is, to the digest's first group
        lost = loose.groupBy("digest").agg(F.sum("run_n").alias("lost_n"), F.min(F.struct("run", "variant")).alias("lost_lead"))
        heads = groups.groupBy("digest").agg(F.min(F.struct("keep_id", "lead", "group_size")).alias("g"))
        heads = lost.join(heads, "digest", "left").select("digest", "lost_n", "lost_lead", "g.lead", "g.keep_id", F.coalesce("g.group_size", F.lit(0)).alias("had"))
        heads = written(heads, "lost_ids")
        extra = heads.where("lead is not null").select(F.col("digest").alias("d"), F.col("lead").alias("l"), "lost_n")
        groups = groups.join(extra, (F.col("digest") == F.col("d")) & (F.col("lead") == F.col("l")), "left")
        groups = groups.withColumn("group_size", F.col("group_size") + F.coalesce("lost_n", F.lit(0))).drop("d", "l", "lost_n")
        wins = F.col("lead").isNull() & (F.struct("run", "variant") == F.col("lost_lead"))
        alone = loose.join(heads, "digest").select("run", "digest", "variant", "keep_id", (F.col("had") + F.col("lost_n")).alias("group_size"), wins.alias("wins"))
    spread = lambda n: F.ceil(F.col(n) / F.lit(COMPARED)).cast("int")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), spread("most") - 1)))
    salted = full.withColumn("salt", F.pmod(F.xxhash64("run"), spread("entries")).cast("int"))
    settled = salted.join(groups, ["digest", "text", "salt"]).select(
        "run", "digest", "variant", "keep_id", "group_size", (F.struct("run_min", "run", "variant") == F.col("lead")).alias("wins")
    )
    return settled if alone is None else settled.union(alone)


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def exact_groups(docs: DataFrame, digest=sha256, buckets: int | None = None, fan_in: int = FAN_IN, **memtable) -> DataFrame:
    """Groups of documents (doc_id, text) with equal normalised texts.

    One row per document: doc_id, keep_id (the group's smallest id), group_size, kept, digest. Null
    text counts as empty, and empty texts are equal. Rows that repeat id and text count like other
    copies: one of them stays. An id may be repeated with other texts; its rows are judged by text.
    Rows without doc_id yield to any id; if none has one, one row stays and keep_id is null. An
    empty table gives no rows, and other columns aren't looked at. ``digest`` may have collisions: texts decide (but it must then
    tell the texts of one id apart).
    """
    buckets = buckets or max(16, 1 << (docs.count() // RANGE_ROWS).bit_length())
    flushed = written(runs(docs, buckets, digest, **memtable), "runs")
    segments = flushed.where("bucket is not null")
    hits = written(looked_up(segments, compacted(segments, fan_in)), "hits")
    settled = verified(hits, docs, digest)
    rows = flushed.where("bucket is null").select("run", "digest", "variant", "doc_id", "run_min", "run_n", "front")
    return rows.join(settled, ["run", "digest", "variant"], "left").select(
        "doc_id",
        F.when(F.col("wins").isNull(), F.col("run_min")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "run_n").alias("group_size"),
        (F.col("front") & F.coalesce("wins", F.lit(True))).alias("kept"),
        "digest",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Documents without exact copies, all columns; see exact_groups. Columns of docs may have any names."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"[{SPACE}]+", " ")
    return without(docs, exact_groups(docs).select("doc_id", F.col("digest").alias("mark"), "kept"), F.unhex(F.sha2(text.cast("binary"), 256)), "copies")
