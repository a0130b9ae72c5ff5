"""Token-id shards compressed by Re-Pair grammars, with random access to documents.

A shard holds consecutive documents in ascending order of doc_id. Re-Pair replaces frequent pairs
of ids by new symbols, again and again: each round counts all pairs, takes the most frequent ones
and replaces their occurrences from left to right. No pair spans two documents, so each document
is a range of symbols. Symbols fit 16 bits: ids of the vocabulary, then the shard's rules.

Layout of a shard, little-endian: 8 unsigned 32-bit numbers (magic, version, documents, symbols,
rules, rounds, first rule's symbol, 0); then 64-bit ids of documents; 64-bit starts of their
tokens in the shard, and the total; 32-bit starts of their symbols, and the total; 32-bit first
rule of each round, and the total; pairs of 16-bit symbols of the rules; 32-bit expansion lengths of
the rules; 16-bit symbols. Shards are the binary column of Parquet files, which Spark commits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import scratch_path
from scorelake.llm.tokens import encoder, ragged, vocabulary_path

MAGIC, VERSION = 0x52505452, 1
END = 0
#: A null doc_id in a shard; documents without an id come first.
NO_ID = -(1 << 63)
#: Rounds that share the room for rules when their number is free; later ones have what these left.
BATCHES = 12
#: Bits of the hashes by which a round finds its pairs.
HASH_BITS = 20
#: In place of a pair that spans two documents.
NO_PAIR = np.uint32(0xFFFFFFFF)


def repair(ids: np.ndarray, last: np.ndarray, first_rule: int, rounds: int | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Compress 16-bit ids. last: marks the last id of each document.

    Returns symbols, their ``last`` marks, rules as pairs, and the first rule of each round. A pair
    becomes a rule if it occurs ``least`` times or more; rounds end when there is none, when 16 bits
    are full, or after ``rounds`` if that isn't None.
    """
    seq, ends = ids.astype(np.uint16), np.flatnonzero(last)
    rules: list[np.ndarray] = []
    firsts = [0]
    room = (1 << 16) - first_rule
    slot = np.zeros(1 << HASH_BITS, np.uint16)  # by hash: the place of a pair among those of the round, plus 1
    for done in count() if rounds is None else range(rounds):
        if len(seq) <= max(1, least) or firsts[-1] >= room:
            break
        codes = seq[:-1].astype(np.uint32)
        codes <<= np.uint32(16)
        codes |= seq[1:]
        codes[ends[:-1]] = NO_PAIR
        ordered = np.sort(codes)
        # runs of equal pairs by their ends; most pairs are rare and aren't listed
        new = np.r_[True, ordered[1:] != ordered[:-1], True]
        enough = ordered[least - 1 :] == ordered[: len(ordered) - least + 1]
        often = np.flatnonzero(enough & new[: len(enough)])
        counts = np.flatnonzero(enough & new[least:]) + least - often
        pairs = ordered[often]
        pairs, counts = pairs[pairs != NO_PAIR], counts[pairs != NO_PAIR]
        # the most frequent pairs of this round; later rounds pair up the new symbols
        quota = -(-(room - firsts[-1]) // max(1, (BATCHES if rounds is None else rounds) - done))
        if len(pairs) > quota:
            bound = np.partition(counts, -quota)[-quota]
            tied = np.flatnonzero(counts == bound)
            counts[tied[quota - np.count_nonzero(counts > bound) :]] = 0  # of equal counts the smallest pairs
            pairs = pairs[counts >= bound]
        if not len(pairs):
            break
        slot[:] = 0
        slot[_hashed(pairs)] = np.arange(1, len(pairs) + 1, dtype=np.uint16)
        pairs = pairs[slot[_hashed(pairs)] == np.arange(1, len(pairs) + 1)]  # of pairs with one hash the last stays
        slot[:] = 0
        slot[_hashed(pairs)] = np.arange(1, len(pairs) + 1, dtype=np.uint16)
        at = slot.take(_hashed(codes))
        where = np.flatnonzero(at != 0)
        at = at[where].astype(np.int64) - 1
        hit = pairs[at] == codes[where]
        where, at = where[hit], at[hit]
        # of overlapping pairs every other one is replaced, from the left
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(where) > 1], np.arange(len(where)), 0))
        some = (np.arange(len(where)) - run) % 2 == 0
        where, at = where[some], at[some]
        seq[where] = first_rule + firsts[-1] + at
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq.compress(keep)
        ends = ends - np.searchsorted(where + 1, ends, "right")  # an end that goes gives way to its pair
        rules.append(np.stack([pairs >> 16, pairs & 0xFFFF], 1).astype(np.uint16))
        firsts.append(firsts[-1] + len(pairs))
    last = np.zeros(len(seq), bool)
    last[ends] = True
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16), firsts


def _hashed(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435769)) >> np.uint32(32 - HASH_BITS)


class Expansions:
    """What each symbol stands for: sizes of all symbols, and where their ids are in one array."""

    def __init__(self, rules: np.ndarray, firsts: np.ndarray, first_rule: int):
        self.ids = np.arange(first_rule, dtype=np.uint16)
        self.starts, self.sizes = np.arange(first_rule), np.ones(first_rule, np.int64)
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):  # rules of a round refer to earlier ones
            sides = rules[a:b].astype(np.int64)
            sizes = self.sizes[sides].sum(1)
            more = self.ids[ragged(self.starts[sides.ravel()], self.sizes[sides.ravel()])]
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
            self.sizes, self.ids = np.r_[self.sizes, sizes], np.r_[self.ids, more]

    def __call__(self, seq: np.ndarray) -> np.ndarray:
        return self.ids[ragged(self.starts[seq], self.sizes[seq])]


def expand(seq: np.ndarray, rules: np.ndarray, firsts: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids of a range of symbols."""
    return Expansions(rules, firsts, first_rule)(seq)


def encode_shard(docs: list[int], parts: list[bytes], first_rule: int, rounds: int | None, least: int) -> bytes:
    """docs: their ids; parts: their token ids as unsigned 32-bit bytes."""
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    ids = np.frombuffer(b"".join(parts), "<u4")
    if len(ids) and ids.max() >= first_rule:
        raise ValueError("an id isn't below the first rule's symbol")
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    seq, last, rules, firsts = repair(ids, last, first_rule, rounds, least)
    lengths = np.ones(len(rules), np.uint32)
    for a, b in zip(firsts, firsts[1:], strict=False):
        sides = rules[a:b].astype(np.int64) - first_rule
        lengths[a:b] = np.where(sides >= 0, lengths[np.maximum(sides, 0)], 1).sum(1) if a else 2
    head = np.array([MAGIC, VERSION, len(docs), len(seq), len(rules), len(firsts) - 1, first_rule, 0], "<u4")
    starts, symbols = np.r_[0, np.cumsum(sizes)], np.r_[0, np.flatnonzero(last) + 1]
    fields = ((head, "<u4"), (np.array(docs), "<i8"), (starts, "<i8"), (symbols, "<u4"), (np.array(firsts), "<u4"), (rules, "<u2"), (lengths, "<u4"), (seq, "<u2"))
    return b"".join(a.astype(t).tobytes() for a, t in fields)


class Shard:
    """Reads a shard; documents are decoded one by one or all at once."""

    def __init__(self, data: bytes):
        magic, version, n, symbols, rules, rounds, self.first_rule, _ = np.frombuffer(data, "<u4", 8).tolist()
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a shard of token ids")
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.docs, self.starts, self.symbols = take("<i8", n), take("<i8", n + 1), take("<u4", n + 1)
        self.firsts, self.rules, self.lengths = take("<u4", rounds + 1), take("<u2", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.seq = take("<u2", symbols)
        self.expanded = Expansions(self.rules, self.firsts, self.first_rule)

    def document(self, k: int) -> np.ndarray:
        """Token ids of the k-th document, from its own symbols alone."""
        return self.expanded(self.seq[self.symbols[k] : self.symbols[k + 1]])

    def tokens(self, k: int, start: int, end: int) -> np.ndarray:
        """Token ids start..end of the k-th document; expansion lengths tell which symbols hold them."""
        seq = self.seq[self.symbols[k] : self.symbols[k + 1]]
        sides = seq.astype(np.int64) - self.first_rule
        sizes = np.where(sides >= 0, self.lengths[np.maximum(sides, 0)], 1) if len(self.lengths) else np.ones(len(seq), np.int64)
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expanded(seq[a:b])[start - skipped : end - skipped]

    def all(self) -> np.ndarray:
        return self.expanded(self.seq)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = 1 << 20, rounds: int | None = None, least: int = 4, vocabulary: int = 50257) -> None:
    """Write the token ids of documents (doc_id, text), each with an end id, in order of doc_id.

    Null text counts as empty; documents without doc_id come first; of repeated ids each row is a
    document, by its text's hash and then its text among rows of one id. A shard ends with the document that brings it to ``shard_tokens``, and a longer
    text makes a longer shard. An empty table gives no shards; other columns aren't looked at.
    """
    tokenizer = tokenizer or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, shard = encoder(tokenizer).encode_all, TaskContext.get().partitionId(), 0
        end = np.array([END], "<u4").tobytes()
        ids, parts, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            row = [[task], [shard], [size], [encode_shard(ids, parts, vocabulary, rounds, least)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "tokens", "data"])

        for batch in batches:
            for doc, tokens in zip(batch.column(0).to_pylist(), code(batch.column(1)), strict=True):
                ids.append(NO_ID if doc is None else doc)
                parts.append(tokens + end)
                size += len(parts[-1]) // 4
                if size >= shard_tokens:
                    yield flushed()
                    ids, parts, size, shard = [], [], 0, shard + 1
        if ids:
            yield flushed()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]  # rows of one id have a defined order, and are split over tasks if they are many
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(encode, "part int, shard int, tokens bigint, data binary").write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Decode all documents: rows (doc_id, start, n_tokens, ids_crc32); none without shards."""
    shards = spark.read.schema("part int, shard int, tokens bigint, data binary").parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that wrote
    bases = sizes.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "shard", F.coalesce(F.sum("tokens").over(inner), F.lit(0)).alias("inside")).join(bases, "part")
    places = places.select("part", "shard", (F.col("base") + F.col("inside")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                shard = Shard(data)
                ids = memoryview(shard.all().astype("<u4").tobytes())
                cuts = (shard.starts * 4).tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                n = len(shard.docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([k] * n, pa.int32()),
                        pa.array(shard.docs, mask=shard.docs == NO_ID),
                        pa.array(shard.starts[:-1]),
                        pa.array(np.diff(shard.starts)),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "shard", "data").mapInArrow(decode, "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(places, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, **how) -> DataFrame:
    """Write documents and decode them from the files; an empty table gives no rows. See write_shards and read_shards."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_shards(docs, path, tokenizer, **how)
    return read_shards(docs.sparkSession, path)
