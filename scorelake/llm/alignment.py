"""Alignment of two tokenizers on the same texts: groups between common borders, and how many documents link each pair of ids.

A pair's count is the number of documents that hold it linked. Workers read documents in chunks of a
bounded number of pairs and sum these up first, so a chunk asks for each of its pairs once, however often
its documents link it. Pairs are partitioned by their id on side A, striped: ids that are equal modulo the number of stripes
share one. A stripe's counts are a dense matrix of a few ids of A by all ids of B, into which np.add.at puts
those of the chunks; the maxima of its rows tell the best partners. The chunks' links lie in
the same partitions as the matrices and are scored there, and the answers go back to their chunks,
where documents add them up. Chunks of one stripe are dealt to several tasks, whose blocks are added.

A text's units are cut where both tokenizers have a border: before a space or line end that has
other characters than white space on both sides. A unit is tokenized and aligned once for a chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import written
from scorelake.llm.tokens import Encoder, vocabulary_path

#: Ids of side A in a stripe, and tasks that a stripe's chunks are dealt to.
ROWS, SALTS = 64, 4
#: Words, and different units, with which a chunk ends.
CHUNK_WORDS, CHUNK_UNITS = 1_200_000, 240_000
#: Units that are tokenized at a time, and documents whose pairs are looked up at a time.
BATCH, DOCS = 2000, 128
#: Bits of a pair's number; above it, units or documents are counted.
CODE_BITS = 40
_SPACE_SIGN = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Units of a text with runs of white space: they end before a space or line end between other characters.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def _alphabet() -> dict[str, int]:
    """Bytes of the characters that byte-level vocabularies are written in: visible ones stand for themselves, the others for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Ids of a byte-level BPE file (A) and of a sentencepiece model (B), their bytes, and the groups of a unit."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(path_a), SentencePieceProcessor(model_file=path_b)
        chars, whole = _alphabet(), self.a.whole
        tokens = [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size())]
        added = {t.content for t in whole.get_added_tokens_decoder().values()}
        self.bytes_a = [t.encode() if t in added else bytes(chars[c] for c in t) for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE_SIGN, " ").encode() for p in pieces]
        self.size_a, self.size_b = len(tokens), len(pieces)
        self.stripes = -(-self.size_a // ROWS)
        most = self.stripes * ROWS * self.size_b
        if most > 1 << CODE_BITS:
            raise ValueError("the vocabularies have too many pairs")
        self.kind = np.uint32 if most <= 1 << 32 else np.uint64
        self.width = max(self.size_a, self.size_b)
        #: Decimal ids and what follows them: a comma, a bar, or a semicolon.
        self.written = [str(i).encode() + sign for sign in (b",", b"|", b";") for i in range(self.width)]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides of a text that begins with a space or line end; the model of B puts a space before what it gets."""
        a = np.frombuffer(self.a.pieces(text), "<u4").tolist()
        return a, self.b.encode(text[1:], num_threads=1) if text[0] == " " else self.b.encode(text, num_threads=1)[1:]

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for a pair, in the order of stripe, row in it, and id of B."""
        return ((a % self.stripes * ROWS + a // self.stripes) * self.size_b + b).astype(self.kind)

    def units(self, units: list[str]) -> "Units":
        """All units aligned: ordinary ones many at a time, for they meet at borders of both sides; others one by one."""
        out = Units(self, len(units))
        plain = [k for k, u in enumerate(units) if u[0] in " \n" and u[1:] and not u[1].isspace() and not u[-1].isspace()]
        for at in range(0, len(plain), BATCH):
            some = plain[at : at + BATCH]
            if not out.add(some, [units[k] for k in some]):  # some unit's bytes differ
                for k in some:
                    out.add([k], [units[k]])
        for k in sorted({*range(len(units))}.difference(plain)):
            out.add([k], [units[k]])
        out.finish()
        return out


class Units:
    """What each unit has: text of its groups, numbers of tokens, groups and links, different pairs and how many links each has; ``good`` tells those whose bytes are the text's."""

    def __init__(self, align: Aligner, n: int):
        self.align, self.texts, self.good = align, [b""] * n, np.zeros(n, bool)
        self.counts = np.zeros((n, 4), np.int64)
        self.pairs: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, places: list[int], units: list[str]) -> bool:
        """Align units one after the other as one text; False if the bytes of one side aren't the text's."""
        align, text = self.align, "".join(units)
        plain = text.encode()
        ids_a, ids_b = align.tokens(text)
        part_a, part_b = [align.bytes_a[i] for i in ids_a], [align.bytes_b[i] for i in ids_b]
        if b"".join(part_a) != plain or b"".join(part_b) != plain:
            return False
        a, b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = np.cumsum([*map(len, part_a)]), np.cumsum([*map(len, part_b)])
        borders = np.intersect1d(ends_a, ends_b)
        group_a, group_b = np.searchsorted(borders, ends_a), np.searchsorted(borders, ends_b)
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        own = np.searchsorted(np.cumsum([len(u.encode()) for u in units]), borders)  # of each group, its unit
        n, at = len(units), np.array(places)
        for k, per_group in enumerate((n_a, n_b, np.ones(len(borders)), n_a * n_b)):
            self.counts[at, k] = np.bincount(own, per_group, n)
        # links: each id of A with all ids of B in its group
        times = n_b[group_a]
        first_b = np.cumsum(n_b) - n_b
        self.pairs.append(align.code(np.repeat(a, times), b[_ragged(first_b[group_a], times)]))
        self.owners.append(at[np.repeat(own[group_a], times)])
        # an id of A is followed by a comma or, at its group's end, by a bar; one of B by a comma or a semicolon
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
        signs = np.r_[a + align.width * last_a, b + align.width * 2 * last_b]
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        words = [*map(align.written.__getitem__, signs[order].tolist())]
        ends = np.cumsum(np.bincount(own, n_a + n_b, n).astype(np.int64)).tolist()
        for place, start, end in zip(places, [0, *ends], ends, strict=False):
            self.texts[place] = b"".join(words[start:end])
        self.good[at] = True
        return True

    def finish(self) -> None:
        """Different pairs of each unit, sorted, with how many links they have; unit k's are at starts[k] : starts[k + 1]."""
        key = _joined(self.owners, np.uint64) << np.uint64(CODE_BITS) | _joined(self.pairs, np.uint64)
        key, times = np.unique(key, return_counts=True)
        self.codes, self.times = (key & np.uint64((1 << CODE_BITS) - 1)).astype(self.align.kind), times.astype(np.uint32)
        self.starts = np.searchsorted(key >> np.uint64(CODE_BITS), np.arange(len(self.good) + 1).astype(np.uint64))
        self.pairs, self.owners = [], []


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class _Odd(Exception):
    """The text has runs of white space."""


class Chunk:
    """Documents that are asked about together; its units have places in the order in which they came."""

    def __init__(self, align: Aligner):
        self.align, self.places, self.units = align, _Places(self), []
        self.docs: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, text: str | None) -> None:
        places: list[int] = []
        if text:
            try:
                # a unit's key is its text, without the space that it begins with if it isn't a line end
                places = [*map(self.places.__getitem__, text.replace("\n", " \n").split(" "))]
            except _Odd:
                places = [self.places.of(u) for u in _CUT.split(" " + text)]
        self.docs.append(doc)
        self.words.append(np.array(places, np.int32))
        self.size += len(places) + 1

    def full(self) -> bool:
        return self.size >= CHUNK_WORDS or len(self.units) >= CHUNK_UNITS

    def batch(self, number: int) -> pa.RecordBatch:
        """A row of all documents (stripe -1), and one for each stripe with its different pairs and how many documents hold each."""
        align, span, units = self.align, ROWS * self.align.size_b, self.align.units(self.units)
        found, times, digests = [], [], []
        for places in self.words:
            some, n = np.unique(places, return_counts=True)
            if not len(some) or not units.good[some].all():
                some, n = some[:0], n[:0]
                digests.append(b"")
            else:
                digests.append(hashlib.sha256(b"".join(map(units.texts.__getitem__, places.tolist()))[:-1]).digest())
            found.append(some)
            times.append(n)
        sizes, found, times = np.array([len(f) for f in found], np.int64), _joined(found, np.int64), _joined(times, np.int64)
        asked, lengths, ends = [], np.diff(units.starts), np.cumsum(sizes)
        for k in range(0, len(sizes), DOCS):  # each document's pairs once
            a, b = int(ends[k] - sizes[k]), int(ends[min(k + DOCS, len(sizes)) - 1])
            some = found[a:b]
            owner = np.repeat(np.repeat(np.arange(len(sizes[k : k + DOCS])), sizes[k : k + DOCS]), lengths[some])
            key = owner.astype(np.uint64) << np.uint64(CODE_BITS) | units.codes[_ragged(units.starts[some], lengths[some])]
            asked.append((np.unique(key) & np.uint64((1 << CODE_BITS) - 1)).astype(align.kind))
        codes, held = np.unique(_joined(asked, align.kind), return_counts=True)
        del asked
        stripes = codes // span
        cuts = np.flatnonzero(np.r_[True, stripes[1:] != stripes[:-1]]) if len(codes) else np.zeros(0, int)
        last = np.r_[cuts[1:], len(codes)]
        inside, held = (codes % span).astype("<u4"), held.astype("<u4")
        body = {
            "docs": np.array([0 if d is None else d for d in self.docs], "<i8"),
            "nulls": np.array([d is None for d in self.docs], "u1"),
            "counts": np.stack([_runs(units.counts[found, k] * times, sizes) for k in range(4)], 1).astype("<i8"),
            "digests": np.frombuffer(b"".join(d or bytes(32) for d in digests), "u1"),
            "plain": np.array([bool(d) for d in digests], "u1"),
            "sizes": sizes.astype("<u4"),
            "found": found.astype("<u4"),
            "times": times.astype("<u4"),
            "unit_sizes": lengths.astype("<u4"),
            # units of documents without tokens ask for nothing and are in no other document's sums
            "unit_pairs": np.minimum(np.searchsorted(codes, units.codes), max(0, len(codes) - 1)).astype("<u4"),
            "unit_times": units.times.astype("<u4"),
        }
        part = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, last, strict=True)]
        n = len(cuts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * (n + 1), pa.int64()),
                pa.array([-1, *stripes[cuts].tolist()], pa.int32()),
                pa.array([None, *part(inside)], pa.binary()),
                pa.array([None, *part(held)], pa.binary()),
                pa.array([_packed(body), *[None] * n], pa.binary()),
            ],
            names=["chunk", "stripe", "pairs", "held", "body"],
        )


class _Places(dict):
    """Places of units in a chunk by key; units with white space at an end or twice in a row raise."""

    def __init__(self, chunk: Chunk):
        super().__init__()
        self.chunk = chunk

    def __missing__(self, key: str) -> int:
        core = key[1:] if key[:1] == "\n" else key
        if not core or core[0].isspace() or core[-1].isspace():
            raise _Odd
        return self.put(key, key if key[0] == "\n" else " " + key)

    def put(self, key: str, unit: str) -> int:
        self[key] = len(self.chunk.units)
        self.chunk.units.append(unit)
        return self[key]

    def of(self, unit: str) -> int:
        """Place of any unit; those that a key can't tell are under their text with a mark that keys can't begin with."""
        core = unit[1:]
        if core and not core[0].isspace() and not core[-1].isspace():
            return self[unit if unit[0] == "\n" else core]
        key = " " + unit
        return dict.__getitem__(self, key) if key in self else self.put(key, unit)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays).astype(kind, copy=False) if arrays else np.zeros(0, kind)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] times, then the same for the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _packed(fields: dict[str, np.ndarray]) -> bytes:
    """Sizes and values of the fields, compressed after their size."""
    data = np.array([a.nbytes for a in fields.values()], "<i8").tobytes() + b"".join(a.tobytes() for a in fields.values())
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


_FIELDS = {"docs": "<i8", "nulls": "u1", "counts": "<i8", "digests": "u1", "plain": "u1", "sizes": "<u4", "found": "<u4", "times": "<u4", "unit_sizes": "<u4", "unit_pairs": "<u4", "unit_times": "<u4"}


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    data = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    sizes, at, out = np.frombuffer(data, "<i8", len(_FIELDS)).tolist(), 8 * len(_FIELDS), {}
    for (name, kind), n in zip(_FIELDS.items(), sizes, strict=True):
        out[name] = np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at)
        at += n
    return out


CHUNKS = "chunk bigint, stripe int, pairs binary, held binary, body binary"


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Chunks of documents and their questions by stripe, see Chunk.batch; whoever reads them twice must write them first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        chunk = Chunk(align)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(doc, text.as_py())
                if chunk.full():
                    yield chunk.batch(number)
                    number, chunk = number + 1, Chunk(align)
        if chunk.docs:
            yield chunk.batch(number)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, CHUNKS)


def _salt(chunk: Column) -> Column:
    return F.pmod(F.xxhash64(chunk), F.lit(SALTS)).cast("int")


def _summed(rows: DataFrame, keys: list[str], size_b: int, best: bool) -> DataFrame:
    """Rows (stripe, pairs, held) summed by key in dense blocks; with ``best``, which pairs are the most frequent of their id of A."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = np.zeros((ROWS, size_b), np.int64), None

        def out() -> pa.RecordBatch:
            flat = block.ravel()
            pairs = np.flatnonzero(flat)
            counts = flat[pairs]
            top = block.max(1)[pairs // size_b] == counts if best else np.zeros(0)
            row = [[at[-1]], [pairs.astype("<u4").tobytes()], [counts.astype("<i8").tobytes()], [top.astype("u1").tobytes()]]
            flat[pairs] = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["stripe", "pairs", "held", "top"])

        for batch in batches:
            for *key, pairs, held in zip(*(batch.column(k).to_pylist() for k in range(len(keys))), batch.column("pairs"), batch.column("held"), strict=True):
                if at is not None and key != at:
                    yield out()
                at = key
                p = np.frombuffer(pairs.as_py(), "<u4")
                h = held.as_py()
                np.add.at(block.ravel(), p, np.frombuffer(h, "<i8" if len(h) == 8 * len(p) else "<u4").astype(np.int64))
        if at is not None:
            yield out()

    dealt = rows.select(*keys, "pairs", "held").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(add, "stripe int, pairs binary, held binary, top binary")


def pair_counts(asked: DataFrame, size_b: int) -> DataFrame:
    """A row per stripe: its pairs, in how many documents each is, and whether it is the best of its id of A. asked: rows (chunk, stripe, pairs, held)."""
    parts = _summed(asked.withColumn("salt", _salt(F.col("chunk"))), ["salt", "stripe"], size_b, False)
    return _summed(parts, ["stripe"], size_b, True)


def answers(asked: DataFrame, counts: DataFrame, size_b: int) -> DataFrame:
    """Rows (chunk, stripe, held, top): counts and best marks of the pairs that a chunk asked for, in its order.

    Questions and their stripe's counts are sorted into the same partitions, the counts first.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, at = np.zeros(ROWS * size_b, np.int64), np.zeros(ROWS * size_b, bool), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for stripe, chunk, pairs, held, top in zip(batch.column("stripe").to_pylist(), batch.column("chunk").to_pylist(), batch.column("pairs"), batch.column("held"), batch.column("top"), strict=True):
                p = np.frombuffer(pairs.as_py(), "<u4")
                if chunk is None:
                    block[at], at = 0, p
                    block[p], best[p] = np.frombuffer(held.as_py(), "<i8"), np.frombuffer(top.as_py(), "u1")
                else:
                    out.append((chunk, stripe, block[p].tobytes(), best[p].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "stripe", "held", "top"])

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = counts.select("stripe", salts.alias("salt"), F.lit(None).cast("bigint").alias("chunk"), "pairs", "held", "top")
    links = asked.select("stripe", _salt(F.col("chunk")).alias("salt"), "chunk", "pairs", F.lit(None).cast("binary").alias("held"), F.lit(None).cast("binary").alias("top"))
    both = known.unionByName(links).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("chunk").asc_nulls_first())
    return both.mapInArrow(look, "chunk bigint, stripe int, held binary, top binary")


def _scored(bodies: DataFrame, told: DataFrame) -> DataFrame:
    """Documents of all chunks with the sums of their links' answers; a chunk's answers come before its body, by stripe."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, top = [], []
        for batch in batches:
            for body, h, t in zip(batch.column("body"), batch.column("held"), batch.column("top"), strict=True):
                if not body.is_valid:
                    held.append(np.frombuffer(h.as_py(), np.int64))
                    top.append(np.frombuffer(t.as_py(), bool))
                    continue
                x = _unpacked(body.as_py())
                counts, best = _joined(held, np.int64), _joined(top, np.int64)
                held, top = [], []
                by_unit = [_runs(v[x["unit_pairs"]] * x["unit_times"], x["unit_sizes"]) for v in (best, counts)]
                n_best, count_sum = (_runs(v[x["found"]] * x["times"], x["sizes"]) for v in by_unit)
                n = x["counts"].reshape(-1, 4)
                digest = x["digests"].tobytes()
                digests = [digest[32 * k : 32 * k + 32].hex() if plain else "" for k, plain in enumerate(x["plain"].tolist())]
                columns = [pa.array(x["docs"], mask=x["nulls"].astype(bool)), *(pa.array(n[:, k]) for k in range(4)), pa.array(n_best), pa.array(count_sum), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, _OUT)

    rows = told.select("chunk", "stripe", "held", "top", F.lit(None).cast("binary").alias("body"))
    last = bodies.select("chunk", F.lit(1 << 30).cast("int").alias("stripe"), F.lit(None).cast("binary").alias("held"), F.lit(None).cast("binary").alias("top"), "body")
    both = rows.unionByName(last).repartition("chunk").sortWithinPartitions("chunk", "stripe")
    return both.mapInArrow(add, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; an empty run's is 0."""
    upto = np.r_[0, np.cumsum(values, dtype=np.int64)]
    ends = np.cumsum(sizes, dtype=np.int64)
    return upto[ends] - upto[ends - sizes]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per row of docs (doc_id, text).

    Both sides tokenize a space and the text, without special tokens. Null and empty texts, and those
    whose tokens' bytes aren't the text's on one side, have no tokens: zeros, and an empty digest. Texts of any length are
    read whole. Rows that repeat doc_id or have none are documents of their own, in counts too. An
    empty table gives no rows; other columns aren't looked at.
    """
    path_a, path_b = path_a or vocabulary_path(), path_b or vocabulary_path("piece_bpe_32k.model")
    size_b = aligner(path_a, path_b).size_b
    all_ = written(chunks(docs, path_a, path_b), "aligned_chunks")
    asked = all_.where("stripe >= 0").select("chunk", "stripe", "pairs", "held")
    told = answers(asked, written(pair_counts(asked, size_b), "pair_counts"), size_b)
    return _scored(all_.where("stripe < 0").select("chunk", "body"), told)


def pair_table(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Rows (a, b, count, best): all linked pairs of ids, in how many documents they are, and whether no other partner of a has more."""
    path_a, path_b = path_a or vocabulary_path(), path_b or vocabulary_path("piece_bpe_32k.model")
    size_b, stripes = aligner(path_a, path_b).size_b, aligner(path_a, path_b).stripes
    asked = chunks(docs, path_a, path_b).where("stripe >= 0").select("chunk", "stripe", "pairs", "held")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, pairs, held, top in zip(batch.column("stripe").to_pylist(), batch.column("pairs"), batch.column("held"), batch.column("top"), strict=True):
                p = np.frombuffer(pairs.as_py(), "<u4").astype(np.int64)
                columns = [p // size_b * stripes + stripe, p % size_b, np.frombuffer(held.as_py(), "<i8"), np.frombuffer(top.as_py(), "u1").astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "count", "best"])

    return pair_counts(asked, size_b).mapInArrow(spread, "a bigint, b bigint, count bigint, best boolean")
