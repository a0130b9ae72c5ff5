"""Similarity join of documents on word n-grams: a MinHash LSH forest, then exact verification.

Every text has a label of ``depth`` MinHash values in each of ``trees`` trees. The labels of a tree,
sorted, are a prefix trie: labels with equal prefixes are next to each other. Two texts
with similarity J share a prefix of k values with probability J^k.

Matched prefixes are shortened from ``depth`` on, for each text and tree on their own: in a tree as
long as no more than a limit of texts share the prefix. A text's limit is the least, from CROWD on, at which its
trees together reach the target recall: prod(1 - threshold^k) is at most 1 - recall. So texts in sparse neighbourhoods are looked up by short prefixes, texts in crowds by the
longest that the recall allows. What a text needs holds for all below the same node of the trie.

Texts that meet in a node compare whole signatures, and only a spanning forest of those that look alike
leaves the task. In crowded nodes, all texts meet the node's first text, and only those that don't
come to be linked to it meet all others. The components of the forest hold all pairs to verify: inside
each, word n-grams are compared exactly. Large components are cut into chunks, and each pair of
chunks is a task of its own; n-grams are hashed once for each text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import IdFilter, _tested, components, id_filter, probably_in, spread_join, with_totals, without, written

N, THRESHOLD, RECALL = 5, (4, 5), 0.9999
TREES, DEPTH, SHORTEST = 24, 8, 4
#: Rows of a task's part of the tries.
TRIE_ROWS = 250_000
#: How many texts may share a prefix: the least limit.
CROWD = 64
#: Texts of a chunk when texts meet; texts and n-grams of one when they are verified.
MEET_ROWS, VERIFY_ROWS, VERIFY_GRAMS = 512, 256, 200_000
#: Share of equal MinHash values from which two texts look alike: 5 standard errors below 0.8.
ALIKE = 0.65
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
WORDS_KEPT = 150_000


class _Hashes(dict):
    kept = WORDS_KEPT

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.kept:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


class Shingler:
    """Sorted 64-bit hashes of a text's different word n-grams; words are runs of no white space.

    A text with fewer than n words has one n-gram: all its words. One without words has none.
    """

    def __init__(self, n: int = N):
        self.n, self.hash = n, _Hashes().__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.array([*map(self.hash, words)], np.uint64)
        size = max(1, len(h) - self.n + 1)
        out = np.full(size, min(len(h), self.n), np.uint64)
        for k in range(min(self.n, len(h))):
            out = (out ^ h[k : k + size]) * np.uint64(_MIX[0])
            out ^= out >> np.uint64(29)
        out *= np.uint64(_MIX[1])
        return np.unique(out ^ out >> np.uint64(32))


def _signer(size: int) -> Callable[[np.ndarray], np.ndarray]:
    draw = np.random.default_rng(7)
    odd = draw.integers(1, 1 << 31, size, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
    plus = draw.integers(0, 1 << 32, size, dtype=np.uint32)

    def sign(shingles: np.ndarray) -> np.ndarray:
        out = np.full(size, 0xFFFFFFFF, np.uint32)
        low = (shingles ^ shingles >> np.uint64(31)).astype(np.uint32)
        for a in range(0, len(low), 1024):
            np.minimum(out, ((low[None, a : a + 1024] ^ plus[:, None]) * odd[:, None]).min(1), out=out)
        out *= np.uint32(2654435769)  # small values become even ones
        return (out >> np.uint32(16)).astype("<u2")

    return sign


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """doc_id, hash of the text, hash of the set of n-grams (null without words), its size, signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(n), _signer(trees * depth)
        for batch in batches:
            sets, sizes, signs = [], [], []
            for text in batch.column(2):
                found = shingle(text.as_py())
                sets.append(_digest(found) if len(found) else None)
                sizes.append(len(found))
                signs.append(sign(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())], ["doc_id", "mark", "same", "size", "signature"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_mark().alias("mark"), "text")
    return rows.mapInArrow(sketch, "doc_id bigint, mark bigint, same binary, size int, signature binary")


def text_mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _roots(size: int, pairs: np.ndarray) -> np.ndarray:
    """Union of pairs of places: the smallest place that each is linked to."""
    root = np.arange(size)
    if len(pairs):
        a, b = pairs.T
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root


# --- the forest ---------------------------------------------------------------------------


def _shared_prefixes(trees: np.ndarray, labels: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted labels: how many share each prefix, from ``shortest`` values to all, and whether their run touches an end."""
    n, depth = labels.shape
    equal = np.logical_and.accumulate(labels[1:] == labels[:-1], 1) & (trees[1:] == trees[:-1])[:, None]
    sizes, open_ = np.empty((n, depth - shortest + 1), np.int64), np.zeros((n, depth - shortest + 1), bool)
    for at, k in enumerate(range(shortest, depth + 1)):
        starts = np.flatnonzero(np.r_[True, ~equal[:, k - 1]])
        run = np.diff(np.r_[starts, n])
        sizes[:, at] = np.repeat(run, run)
        open_[: run[0], at] = open_[n - run[-1] :, at] = True
    return sizes, open_


def tries(reps: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """Labels that share a prefix of ``shortest`` values, from sorted tries: rows (part, tree, label, rep, sizes, open).

    sizes: how many of the task's labels share the prefixes of shortest, ..., depth values. open:
    where these may go on in another task's part, as bits. Tasks hold ranges of the sorted labels,
    ties dealt by rep, so that a crowded node is cut like any other.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, depth), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if len(b)]
        if not parts:
            return
        tree, label, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes, open_ = _shared_prefixes(tree, label, shortest)
        some = np.flatnonzero((sizes[:, 0] > 1) | open_[:, 0])
        bits = (open_ << np.arange(open_.shape[1])).sum(1)
        for at in range(0, len(some), 10_000):
            k = some[at : at + 10_000]
            columns = [
                pa.array(np.full(len(k), TaskContext.get().partitionId(), np.int32)), pa.array(tree[k].astype(np.int32)), pa.array([x.tobytes() for x in label[k]], pa.binary()), pa.array(rep[k]),
                pa.array([*sizes[k]], pa.list_(pa.int64())), pa.array(bits[k].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "tree", "label", "rep", "sizes", "open"])

    one = lambda t: F.struct(t.alias("tree"), F.substring("signature", t * (2 * depth) + 1, F.lit(2 * depth)).alias("label"))
    labels = reps.select("rep", F.inline(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), one))).select("tree", "label", "rep")
    parts = -(-trees * reps.count() // TRIE_ROWS) or 1
    ranged = labels.repartitionByRange(parts, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    return ranged.mapInArrow(sort, "part int, tree int, label binary, rep bigint, sizes array<bigint>, open int")


def _across(rows: DataFrame, depth: int, shortest: int) -> dict[tuple[int, bytes], int]:
    """How many labels share a prefix that goes over the parts of several tasks: at most two prefixes of each length for a part."""
    at = F.explode(F.sequence(F.lit(0), F.lit(depth - shortest)))
    ends = rows.where("open > 0").withColumn("at", at).where(F.expr("getbit(open, at) = 1"))
    ends = ends.select("part", "tree", F.substring("label", F.lit(1), 2 * (F.col("at") + shortest)).alias("prefix"), F.get("sizes", F.col("at")).alias("n")).distinct()
    sums = ends.groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    return {(r.tree, bytes(r.prefix)): r.n for r in sums.toLocalIterator()}


def shortened(sizes: np.ndarray, starts: np.ndarray, trees: int, depth: int, shortest: int, threshold: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """The prefix length of each row (a text in a tree), and the limit that its text needs.

    sizes: how many texts share the prefixes of shortest, ..., depth values. starts: the first row of each
    text; trees that a text has no row for are empty but for itself, there its prefix is the shortest.
    """
    missed = np.log1p(-(threshold ** np.arange(1, depth + 1, dtype=float)))  # log chance that a pair at the threshold differs in k values
    if trees * missed[shortest - 1] > math.log(1 - recall):
        raise ValueError("too few trees for this recall")
    counts = np.diff(np.r_[starts, len(sizes)])

    def lengths(limit: np.ndarray) -> np.ndarray:
        return np.minimum(shortest + (sizes > np.repeat(limit, counts)[:, None]).sum(1), depth)

    def enough(k: np.ndarray) -> np.ndarray:
        return np.add.reduceat(missed[k - 1], starts) + (trees - counts) * missed[shortest - 1] <= math.log(1 - recall)

    # the least limit of each text that is enough, by bisection between one that isn't and one that is
    low, high = np.full(len(starts), CROWD - 1), np.maximum(np.maximum.reduceat(sizes[:, 0], starts), CROWD)
    high = np.where(enough(lengths(low + 1)), CROWD, high)
    while (high - low > 1).any():
        middle = np.where(high - low > 1, (low + high) // 2, high)
        good = enough(lengths(middle))
        low, high = np.where(good, low, middle), np.where(good, middle, high)
    return lengths(high), high


def prefixes(rows: DataFrame, trees: int, depth: int, shortest: int, threshold: float, recall: float) -> DataFrame:
    """Rows (rep, tree, label, sizes, k, crowd) of tries with each text's prefix length k; crowd: the text needs a higher limit."""
    across = _across(rows, depth, shortest)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_last(batches):
            both = [b for b in (held, batch) if b is not None]
            if not both:
                return
            table = pa.Table.from_batches(both).combine_chunks().to_batches()
            now = table[0] if table else both[0]
            rep = now.column("rep").to_numpy()
            # the last text may go on in the next batch
            end = len(rep) if batch is None else int(np.searchsorted(rep, rep[-1])) if len(rep) else 0
            held, now, rep = now.slice(end), now.slice(0, end), rep[:end]
            if not end:
                continue
            sizes = np.array(now.column("sizes").to_pylist(), np.int64)
            open_ = now.column("open").to_numpy()
            if across:
                for i in np.flatnonzero(open_):
                    tree, label = now.column("tree")[int(i)].as_py(), now.column("label")[int(i)].as_py()
                    sizes[i] = [across.get((tree, label[: 2 * (shortest + at)]), n) for at, n in enumerate(sizes[i])]
            starts = np.flatnonzero(np.r_[True, rep[1:] != rep[:-1]])
            k, limit = shortened(sizes, starts, trees, depth, shortest, threshold, recall)
            crowd = np.repeat(limit > CROWD, np.diff(np.r_[starts, len(rep)]))
            some = np.flatnonzero(sizes[:, 0] > 1)
            columns = [now.column("rep"), now.column("tree"), now.column("label"), pa.array([*sizes], pa.list_(pa.int64())), pa.array(k.astype(np.int32)), pa.array(crowd)]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "tree", "label", "sizes", "k", "crowd"]).take(pa.array(some))

    ready = rows.select("rep", "tree", "label", "sizes", "open").repartition("rep").sortWithinPartitions("rep")
    return ready.mapInArrow(choose, "rep bigint, tree int, label binary, sizes array<bigint>, k int, crowd boolean")


def _and_last(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def nodes(rows: DataFrame, depth: int, shortest: int) -> DataFrame:
    """Rows (rep, node, n): each text in the nodes where it meets others, n texts in all.

    A text that needs a higher limit takes along all texts below its node: nodes that such texts ask for are in an
    id filter, and each text goes to the shortest of its prefixes that is in there, or else to its own.
    """
    key = lambda k: F.xxhash64("tree", F.substring("label", F.lit(1), 2 * k))
    size = lambda k: F.get("sizes", k - shortest)
    asked = written(rows.where(F.col("crowd") & (size(F.col("k")) > CROWD)).select(key(F.col("k")).alias("node")).distinct(), "asked")
    if not asked.isEmpty():
        asked = id_filter(asked, "node")
        for k in range(depth - 1, shortest - 1, -1):
            rows = _shorter(rows.withColumn("node", key(F.lit(k))), asked, k)
    return rows.select("rep", key(F.col("k")).alias("node"), size(F.col("k")).alias("n")).where("n > 1")


def _shorter(rows: DataFrame, asked: IdFilter, k: int) -> DataFrame:
    """Rows with a longer prefix than k go to the node of k values if that is asked for; its size is above the limit."""
    found = _tested(rows, "node", asked, "found")
    own = F.when((F.col("k") > k) & F.col("found"), F.lit(k)).otherwise(F.col("k"))
    return found.withColumn("k", own).drop("node", "found")


# --- texts meet -----------------------------------------------------------------------------


def _by_block(batches: Iterator[pa.RecordBatch], width: int = 1) -> Iterator[list[tuple]]:
    """Rows of each value of the first ``width`` columns, which are next to each other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _alike(signs: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Pairs of places in signs, or in signs and others, whose signatures look alike."""
    least, pairs = ALIKE * signs.shape[1], [np.zeros((0, 2), np.int64)]
    for i in range(len(signs)):
        like = np.flatnonzero(((signs[i + 1 :] if others is None else others) == signs[i]).sum(1) >= least)
        pairs.append(np.stack([np.full(len(like), i), like + (i + 1 if others is None else 0)], 1))
    return np.concatenate(pairs)


def _signs(rows: list[tuple]) -> np.ndarray:
    return np.stack([np.frombuffer(r[2], "<u2") for r in rows])


_EDGES = "a bigint, b bigint, node bigint, n bigint"


def _edges(a, b, node: int | None = None, n: int | None = None) -> pa.RecordBatch:
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([node] * len(a), pa.int64()), pa.array([n] * len(a), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "node", "n"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All texts of a block (block, rep, signature, node, n, hub): a spanning forest of those that look alike.

    In a chunk of a crowded node (node and n aren't null) the node's first text, the hub, is there
    as well; texts that aren't linked to it come out without b.
    """
    for rows in _by_block(batches):
        node, n = rows[0][3:5]
        hub = max((r[5] for r in rows if r[5] is not None), default=None)
        rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])
        ids = np.array([r[1] for r in rows])
        root = _roots(len(ids), _alike(_signs(rows)))
        off = np.flatnonzero(root != np.arange(len(ids)))
        if len(off):
            yield _edges(ids[off], ids[root[off]])
        if hub is not None:
            out = np.flatnonzero(root != root[int(np.flatnonzero(ids == hub)[0])])
            if len(out):
                yield _edges(ids[out], [None] * len(out), node, n)


def _meet_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, rep, signature, left): all on the left meet all on the right."""
    for rows in _by_block(batches):
        left, right = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        if left and right:
            pairs = _alike(_signs(left), _signs(right))
            a, b = np.array([r[1] for r in left])[pairs[:, 0]], np.array([r[1] for r in right])[pairs[:, 1]]
            # a spanning forest is enough
            ids, at = np.unique(np.r_[a, b], return_inverse=True)
            root = _roots(len(ids), at.reshape(2, -1).T)
            off = np.flatnonzero(root != np.arange(len(ids)))
            if len(off):
                yield _edges(ids[off], ids[root[off]])


def candidates(reps: DataFrame, trees: int, depth: int, shortest: int, threshold: float, recall: float) -> DataFrame:
    """Components of texts that look alike: id, root. reps: rep, signature."""
    forest = written(tries(reps, trees, depth, shortest), "tries")
    forest = written(prefixes(forest, trees, depth, shortest, threshold, recall), "prefixes")
    met = written(nodes(forest, depth, shortest), "nodes")
    signed = met.join(reps.select("rep", "signature"), "rep")
    null = F.lit(None).cast("bigint")
    few = signed.where(F.col("n") <= MEET_ROWS).select(F.col("node").alias("block"), "rep", "signature", null.alias("node"), null.alias("n"), null.alias("hub"))
    crowded = met.where(F.col("n") > MEET_ROWS)
    hubs = written(crowded.groupBy("node").agg(F.max("n").alias("n"), F.min("rep").alias("hub")), "hubs")
    chunks = F.ceil(F.col("n") / F.lit(MEET_ROWS)).cast("int")
    chunk = lambda of: F.pmod(F.xxhash64(of, F.lit(3)), chunks).cast("int")
    many = not hubs.isEmpty()
    blocks = few
    if many:
        # each chunk of a node holds the node's first text too, in a row that names it as the hub
        own = signed.where(F.col("n") > MEET_ROWS).select(F.xxhash64("node", chunk("rep")).alias("block"), "rep", "signature", "node", "n", null.alias("hub"))
        first = hubs.join(reps.select(F.col("rep").alias("hub"), "signature"), "hub").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        first = first.select(F.xxhash64("node", "chunk").alias("block"), F.col("hub").alias("rep"), "signature", "node", "n", "hub")
        blocks = few.unionByName(own).unionByName(first)
    blocks = blocks.repartition("block").sortWithinPartitions("block")
    edges = written(blocks.mapInArrow(_meet, _EDGES), "edges")
    if many:
        left = edges.where("b is null").select(F.col("a").alias("rep"), "node", "n").distinct()
        sizes = written(left.groupBy("node").agg(F.count("*").alias("left_n")), "left_sizes")
        if not sizes.isEmpty():
            groups = F.ceil(F.col("left_n") / F.lit(MEET_ROWS)).cast("int")
            group = F.pmod(F.xxhash64("rep", F.lit(5)), groups).cast("int")
            key = F.xxhash64("node", "group", "chunk").alias("block")
            lone = spread_join(left, sizes, "node", "rep", "left_n").join(reps.select("rep", "signature"), "rep")
            lone = lone.withColumn("group", group).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(key, "rep", "signature", F.lit(True).alias("left"))
            rest = spread_join(signed.where(F.col("n") > MEET_ROWS), sizes, "node", "rep", "left_n").where("left_n is not null")
            rest = rest.withColumn("chunk", chunk("rep")).withColumn("group", F.explode(F.sequence(F.lit(0), groups - 1))).select(key, "rep", "signature", F.lit(False).alias("left"))
            others = lone.unionByName(rest).repartition("block").sortWithinPartitions("block")
            edges = edges.unionByName(others.mapInArrow(_meet_others, _EDGES))
    return components(edges.where("b is not null").select("a", "b"), "alike")


# --- verification -----------------------------------------------------------------------------


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    sizes = [len(s) for s in (*left, *right)]
    values, at, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    use = counts[at] > 1
    row, at = row[use], column[at[use]]
    out, wide = np.zeros((len(left), len(right)), np.float32), 4096
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, wide):
        some = slice(*np.searchsorted(at, (a, a + wide)))
        dense = np.zeros((len(sizes), wide), np.float32)
        dense[row[some], at[some] - a] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(out).astype(np.int64)


#: A chunk of a group: ids, copies and sizes of its texts, and their n-grams one after the other.
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _links(threshold: tuple[int, int], left: Chunk, right: Chunk | None = None) -> pa.RecordBatch | None:
    """Exact links inside a chunk or between two: id, documents linked to it there, smallest id it is linked to."""
    over, under = threshold
    cut = lambda c: np.split(c[3], np.cumsum(c[2])[:-1])
    other = left if right is None else right
    common = _overlaps(cut(left), cut(other))
    linked = under * common >= over * (left[2][:, None] + other[2][None, :] - common)
    if right is None:
        np.fill_diagonal(linked, False)
    pairs = np.argwhere(linked)
    ids, found = left[0], linked @ left[1] if right is None else linked @ right[1]
    if right is not None:
        pairs[:, 1] += len(ids)
        ids, found = np.r_[ids, right[0]], np.r_[found, linked.T @ left[1]]
    some = np.flatnonzero(found)
    if not len(some):
        return None
    root = _roots(len(ids), pairs)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(found[some].astype(np.int64)), pa.array(least[root[some]])], ["a", "links", "b"])


_CHUNK = "a bigint, links bigint, b bigint, root bigint, chunk int, chunks int, data array<binary>"


def _verify_chunks(n: int, threshold: tuple[int, int]) -> Callable:
    """Groups of one chunk are verified at once; chunks of larger ones come out with their n-grams."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, schema = Shingler(n), pa.schema([("a", pa.int64()), ("links", pa.int64()), ("b", pa.int64()), ("root", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("data", pa.list_(pa.binary()))])
        for rows in _by_block(batches, 2):
            held = {}
            for _, _, _, rep, copies, same, text in rows:
                # a text that only shares its doc_id with the one that is meant has another digest
                if rep not in held and _digest(grams := shingle(text)) == same:
                    held[rep] = copies, grams
            root, number, chunks = rows[0][:3]
            ids = sorted(held)
            chunk = np.array(ids, np.int64), np.array([held[i][0] for i in ids], np.int64), np.array([len(held[i][1]) for i in ids], np.int64), np.concatenate([held[i][1] for i in ids]) if ids else np.zeros(0, np.uint64)
            if chunks == 1:
                found = _links(threshold, chunk) if len(ids) > 1 else None
                if found is not None:
                    blank = [pa.nulls(len(found), f.type) for f in schema][3:]
                    yield pa.RecordBatch.from_arrays([*found.columns, *blank], schema=schema)
            else:
                row = [None, None, None, root, number, chunks, [x.tobytes() for x in chunk]]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return verify


def _verify_pairs(threshold: tuple[int, int]) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches, 3):
            parts = [tuple(np.frombuffer(x, t) for x, t in zip(r[3], ("<i8", "<i8", "<i8", "<u8"), strict=True)) for r in rows]
            # a block of a chunk with itself has one row, one of two chunks has two
            if len(parts) == 2 or rows[0][1] == rows[0][2]:
                found = _links(threshold, *parts) if len(parts[0][0]) and len(parts[-1][0]) else None
                if found is not None:
                    yield found

    return verify


def linked(docs: DataFrame, reps: DataFrame, groups: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Exact links in each group: rows (a, links, b), several for a text. groups: id, root."""
    sized = groups.join(reps.select(F.col("rep").alias("id"), "doc", "same", "copies", "size"), "id")
    both = [F.count("*").alias("pn"), F.sum("size").alias("ps")], [F.sum("pn").alias("texts"), F.sum("ps").alias("grams")]
    members = with_totals(sized, "root", "id", *both)
    chunks = F.greatest(F.ceil(F.col("texts") / F.lit(VERIFY_ROWS)), F.ceil(F.col("grams") / F.lit(VERIFY_GRAMS))).cast("int")
    members = members.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int"))
    members = written(members.select("root", "chunk", "chunks", "id", "doc", "copies", "same"), "members")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").where("doc is not null")
    texts = probably_in(texts, "doc", id_filter(members, "doc"))
    rows = members.join(texts, "doc").select("root", "chunk", "chunks", "id", "copies", "same", "text")
    rows = rows.repartition("root", "chunk").sortWithinPartitions("root", "chunk", "id")
    found = written(rows.mapInArrow(_verify_chunks(n, threshold), _CHUNK), "chunks")
    links = found.where("a is not null").select("a", "links", "b")
    large = found.where("a is null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = large.select("root", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "data")
    blocks = blocks.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return links.unionByName(blocks.mapInArrow(_verify_pairs(threshold), "a bigint, links bigint, b bigint"))


def _classes(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, shortest: int = SHORTEST) -> DataFrame:
    """Rows of similar, with mark (the text's hash) and kept (whether the row's text stands for its class)."""
    marked = written(sketches(docs, n, trees, depth), "sketches")
    named = marked.where("doc_id is not null and same is not null")
    reps = named.groupBy("same").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    groups = written(candidates(reps, trees, depth, shortest, threshold[0] / threshold[1], recall), "groups")
    links = written(linked(docs, reps, groups, n, threshold), "links")
    found = components(links.select("a", "b"), "classes").join(reps.select(F.col("rep").alias("id"), "doc"), "id")
    lead = F.struct("doc", "id")
    found = with_totals(found, "root", "id", [F.min(lead).alias("p")], [F.min("p").alias("lead")]).select("id", "lead")
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    known = reps.join(found, F.col("rep") == F.col("id"), "left").join(counts, F.col("rep") == F.col("a"), "left")
    known = known.select("same", "rep", "copies", F.col("doc").alias("copy"), F.coalesce("lead", F.struct(F.col("doc"), F.col("rep").alias("id"))).alias("lead"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = spread_join(marked.select("doc_id", "mark", "same"), written(known, "known"), "same", "doc_id", "copies")
    lone = F.col("doc_id").isNull() | F.col("rep").isNull()
    return rows.select(
        "doc_id",
        "mark",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("lead.doc", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copy", "doc_id")).alias("copy_id"),
        F.when(lone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("bigint").alias("n_links"),
        (lone | ((F.col("rep") == F.col("lead.id")) & (F.col("doc_id") == F.col("lead.doc")))).alias("kept"),
    )


def similar(docs: DataFrame, **how) -> DataFrame:
    """Near-duplicate classes of documents (doc_id, text) by Jaccard similarity of word n-grams.

    One row per document: doc_id, class_id (the smallest doc_id that links lead to), copy_id (the
    smallest doc_id with the same n-grams) and n_links, the number of other documents at
    ``threshold`` (a fraction) or more, copies included. Links are verified exactly; ``recall`` is
    the chance that a pair just at the threshold is found, more for closer pairs. Documents
    without words have no links and are classes of their own; those without doc_id have null
    class_id and copy_id and 0 links. Rows that repeat doc_id and text count as further copies, and
    rows that repeat doc_id with another text are documents like any other. An empty table gives no rows;
    other columns aren't looked at. Parameters: n, threshold, recall, trees, depth, shortest.
    """
    return _classes(docs, **how).drop("mark", "kept")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest doc_id; all columns.

    Of rows that repeat doc_id and text one stays. Documents without doc_id or without words all stay. An
    empty table stays empty, and columns may have any names.
    """
    rows = written(_classes(docs, **how).select("doc_id", "mark", "kept", (F.col("n_links") > 0).alias("linked")), "near")
    again = rows.where("kept and linked").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.select("doc_id", "mark", "kept").unionByName(again.select("doc_id", "mark", F.lit(False).alias("kept")))
    return without(docs, rows, text_mark(), "near")
