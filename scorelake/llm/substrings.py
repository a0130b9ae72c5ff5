"""Removal of long passages that repeat across documents, by prefix-partitioned suffix trees.

A window is ``window`` consecutive words; it goes if its words also start in a document with a
smaller doc_id. Each window's start is a suffix. Dealing suffixes by their own first words would copy the text of
each, so they are dealt by an anchor: the run of ``gram`` words with the least hash inside the window, which is
the prefix of the anchor's own suffix. Equal windows have equal anchors, and neighbours mostly share one, so
a run of windows travels as one piece of text. Prefixes that only one document has are pruned before texts
move. A prefix's suffixes must fit in memory: where they don't, the prefix grows to the whole window, at which
depth all suffixes of a prefix are one node, and Spark aggregates.

Inside a task, the tree is built level by level: a node at depth 2n is a pair of nodes at depth n. The
nodes at the window's depth that have suffixes of several documents are the repeats; consecutive
suffixes in such nodes make up the maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import SPACE, WORD, _tested, bitmap, fresh, id_filter, with_totals, written
from scorelake.llm.ngram_join import _Hashes, text_mark

WINDOW, GRAM = 50, 20
#: Words of the suffixes of a prefix up to which they are one group; and of the groups that a task makes into trees at a time.
GROUP_WORDS = 500_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of n words, from hashes of words; those of 1, 2, 4, ... words are put together."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (a * np.uint64(_MIX[0]) ^ b) * np.uint64(_MIX[1 + seed])
        return out ^ out >> np.uint64(29)

    out, covered, level, size = None, 0, words, 1
    while size <= n:
        if n & size:
            out = level if out is None else pair(out[: len(words) - covered - size + 1], level[covered : len(words) - size + 1])
            covered += size
        if 2 * size <= n:
            level = pair(level[:-size], level[size:])
        size *= 2
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return values if size == width else np.minimum(values[: len(values) - width + size], values[width - size :])


class _Words(_Hashes):
    """Hashes of words, of which a worker of this operator remembers more."""

    kept = 400_000


class Anchors:
    """Runs of windows of a text that share an anchor."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.hash = window, gram, _Words().__getitem__

    def __call__(self, text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray] | None:
        """Words, their hashes, the first window of each run (and the end), and each run's anchor; None without a window."""
        words = (text or "").encode().split()
        if len(words) < self.window:
            return None
        hashes = np.array([*map(self.hash, words)], np.uint64)
        least = _least(gram_hashes(hashes, self.gram), self.window - self.gram + 1)
        starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1], True])
        return words, hashes, starts, least[starts[:-1]].view(np.int64)


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (anchor, doc_id, words): of each document its different anchors, and the words of their runs. Rows without doc_id have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Anchors(window, gram)
        for batch in batches:
            ids, keys, sizes = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (found := runs(text.as_py())) is None:
                    continue
                _, _, starts, own = found
                key, place = np.unique(own, return_inverse=True)
                keys.append(key)
                sizes.append(np.bincount(place, np.diff(starts) + window - 1).astype(np.int64))
                ids.append(np.full(len(key), doc))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, ids, sizes)], ["anchor", "doc_id", "words"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(find, "anchor bigint, doc_id bigint, words bigint")


def pieces(docs: DataFrame, live: tuple[bytes, int], large: tuple[bytes, int], window: int, gram: int) -> DataFrame:
    """Rows (anchor, doc_id, mark, first, n, words, key): runs of windows with a live anchor, n words from the first one on.

    Those with a large anchor come as single windows instead, with their hash as key and without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((live, large))  # two bitmaps of bounded size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Anchors(window, gram)
        (live, n_live), (large, n_large) = ((np.frombuffer(bits, np.uint8), n) for bits, n in shared.value)
        for batch in batches:
            out = []
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (found := runs(text.as_py())) is None:
                    continue
                words, hashes, starts, own = found
                keep = np.flatnonzero(_bits(live, n_live, own))
                if not len(keep):
                    continue
                big = _bits(large, n_large, own[keep])
                for k in keep[~big].tolist():
                    a, b = int(starts[k]), int(starts[k + 1]) + window - 1
                    out.append((int(own[k]), doc, mark, a, b - a, b" ".join(words[a:b]), None))
                if big.any():
                    keys = np.stack([gram_hashes(hashes, window), gram_hashes(hashes, window, 1)], 1)
                    for k in keep[big].tolist():
                        out += [(int(own[k]), doc, mark, a, window, None, keys[a].tobytes()) for a in range(starts[k], starts[k + 1])]
                if len(out) >= 5000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), text_mark().alias("mark"), "text")
    return rows.mapInArrow(cut, "anchor bigint, doc_id bigint, mark bigint, first bigint, n bigint, words binary, key binary")


_TYPES = [pa.int64()] * 5 + [pa.binary()] * 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES, strict=True)], ["anchor", "doc_id", "mark", "first", "n", "words", "key"])


def _bits(bitmap: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    at = keys & (size - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """For each place at which ``depth`` words begin, the number of its node at that depth of the tree of all suffixes."""
    out, covered, level, size = None, 0, words, 1

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]

    while size <= depth:
        if depth & size:
            out = level if out is None else pair(out[: len(words) - covered - size + 1], level[covered : len(words) - size + 1])
            covered += size
        if 2 * size <= depth:
            level = pair(level[:-size], level[size:])
        size *= 2
    return out


def repeats(texts: list[bytes], sizes: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces of text, the runs of windows that are also in one of a smaller document: place of the piece, first and last window."""
    place: dict[bytes, int] = {}
    words = np.array([place.setdefault(w, len(place)) for w in b" ".join(texts).split(b" ")], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes - window + 1)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - window + 1) - (sizes - window + 1), sizes - window + 1)
    node = nodes(words, window)[starts[owner] + inside]
    least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, docs[owner])
    hit = np.flatnonzero(docs[owner] > least[node])
    if not len(hit):
        return hit, hit, hit
    new = np.r_[True, (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)]
    return owner[hit[new]], inside[hit[new]], inside[hit[np.r_[new[1:], True]]]


def from_trees(rows: DataFrame, window: int) -> DataFrame:
    """Spans (doc_id, mark, start, end) of words to remove, from groups of pieces with one anchor; a task holds a bounded number of words."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            docs, marks, first, n = (table.column(c).to_numpy() for c in ("doc_id", "mark", "first", "n"))
            owner, a, b = repeats(table.column("words").to_pylist(), n, docs, window)
            if len(owner):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs[owner], marks[owner], first[owner] + a, first[owner] + b + window)], ["doc_id", "mark", "start", "end"])

        for batch in batches:
            anchor, n = batch.column("anchor").to_numpy(), batch.column("n").to_numpy()
            cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]).tolist() + [len(anchor)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and total >= GROUP_WORDS and held[-1].column("anchor")[-1].as_py() != int(anchor[a]):
                    yield from out()
                    held, total = [], 0
                held.append(batch.slice(a, b - a))
                total += int(n[a:b].sum())
        if held:
            yield from out()

    dealt = rows.select("anchor", "doc_id", "mark", "first", "n", "words").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(grow, "doc_id bigint, mark bigint, start bigint, end bigint")


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_words: int = GROUP_WORDS) -> DataFrame:
    """Rows (doc_id, mark, spans): of documents that lose words, which ones, as ranges [start, end) that may overlap. mark tells texts of one doc_id apart."""
    sizes = anchors(docs, window, gram).groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("words").alias("words"))
    live = written(sizes.where("low < high").select("anchor", "words"), "live_anchors")
    large = live.where(F.col("words") > group_words)
    found = written(pieces(docs, bitmap(live, "anchor"), bitmap(large, "anchor"), window, gram), "suffixes")
    gone = from_trees(found.where("words is not null"), window)
    whole = found.where("words is null").select("key", "doc_id", "mark", "first")
    whole = with_totals(whole, "key", "doc_id", [F.min("doc_id").alias("p")], [F.min("p").alias("m")]).where("doc_id > m")
    gone = gone.unionByName(whole.select("doc_id", "mark", F.col("first").alias("start"), (F.col("first") + window).alias("end")))
    return written(gone.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def _kept(text: Column, gone: Column) -> Column:
    """The words of a text outside the spans, joined by one space."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, ranges in zip(texts, gone, strict=True):
            words = (text or "").encode().split()
            if ranges is not None and len(ranges):
                edge = np.zeros(len(words) + 1, np.int64)
                for r in ranges:
                    edge[r["start"]] += 1
                    edge[r["end"]] -= 1
                words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
            out.append(b" ".join(words).decode())
        return pd.Series(out, dtype=object)

    return kept(text, gone)


def _judged(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, str, str]:
    """docs with the kept text and the number of words before in new columns, and their names. Only texts that lose words are shuffled, and a few more."""
    gone = spans(docs, window, gram)
    hit, kept, own, id_, m, ranges, count = (fresh(c, docs) for c in ("found", "kept", "mark", "kept_id", "kept_mark", "spans", "count"))
    tested = _tested(docs, "doc_id", id_filter(gone, "doc_id"), hit)
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE}]+", " "))
    rest = tested.where(~F.col(hit)).withColumn(kept, plain).withColumn(count, _spaced(F.col(kept)))
    known = gone.select(F.col("doc_id").alias(id_), F.col("mark").alias(m), F.col("spans").alias(ranges))
    some = tested.where(F.col(hit)).withColumn(own, text_mark())
    some = some.join(known, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(m)), "left")
    some = some.withColumn(kept, _kept(F.col("text"), F.col(ranges))).drop(own, id_, m, ranges)
    some = some.withColumn(count, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
    return rest.unionByName(some).drop(hit), kept, count


def _spaced(words: Column) -> Column:
    """How many words there are, joined by one space."""
    return F.when(words == "", F.lit(0)).otherwise(F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def judge(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one per row of docs (doc_id, text).

    A word goes if a window that covers it also starts in a document with a smaller doc_id; what
    repeats inside one document or one doc_id only stays. Rows without doc_id neither lose words nor make others lose any;
    of a repeated doc_id each row is judged by its own text. Null, empty and blank texts have no words, texts below
    a window's length lose none, and texts of any length are read whole. An empty table gives no rows; other
    columns aren't looked at.
    """
    rows, kept, count = _judged(docs.select("doc_id", "text"), window, gram)
    return rows.select("doc_id", F.col(count).alias("n_words"), (F.col(count) - _spaced(F.col(kept))).alias("n_removed"), F.sha2(F.col(kept).cast("binary"), 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, all columns, without the words that judge removes: texts are what is left, joined by one space, null texts empty."""
    rows, kept, _ = _judged(docs, window, gram)
    return rows.withColumn("text", F.col(kept)).drop(kept).select(docs.columns)
