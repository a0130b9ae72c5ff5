"""Shared pieces: written intermediate tables, bounded samples, id filters, spread aggregates, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java, RE2 and Python character class body.
SPACE = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"

#: Tasks that a bounded sample is dealt to.
SAMPLE_TASKS = 24
#: Bits of an id filter: 16 for each id, but not fewer than the first nor more than the second (16 MB).
FILTER_BITS = 1 << 23, 1 << 27
_SLICE = 8 * 4096  # bits of one bitmap that bitmap_construct_agg builds


@cache
def _local_scratch() -> str:
    path = tempfile.mkdtemp(prefix="scorelake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_scratch()


def _app_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/scorelake/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of this application's own in the shared folder; it goes with discard."""
    _discard_at_exit()
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that read them can't be used any more.

    Done at the end of the driver's program if its session is still active by then.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(_app_dir(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@cache
def _discard_at_exit() -> None:
    def end() -> None:
        try:
            spark = SparkSession.getActiveSession()
            if spark is not None:
                discard(spark)
        except Exception:  # the session has ended before
            pass

    atexit.register(end)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, with as many underscores after it as make it no column of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(id_crc(doc_id) % modulus == remainder, F.lit(False))


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text; 0 for a null id."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def labelled_sample(labels: DataFrame, label: str, modulus: int, remainder: int, limit: int) -> DataFrame:
    """At most ``limit`` training labels (doc_id, y), those with the smallest hash of their id.

    Rows with a null id or label and rows of the held-out fold never count.
    Only ids and labels are sorted, each task keeps ``limit`` rows at most.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)
    )
    return rows.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "y").limit(limit)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, limit: int) -> DataFrame:
    """Rows (doc_id, y, text) of at most ``limit`` labelled documents; of an id's rows one text and the larger label. Null text is empty."""
    chosen = labelled_sample(labels, label, modulus, remainder, limit).withColumnRenamed("doc_id", "id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # sample rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return written(rows.repartition(SAMPLE_TASKS, "doc_id"), f"sample_{label}")


@dataclass
class IdFilter:
    """A bitmap over hashes, in slices of 4 KB: rows (s, bits)."""

    rows: DataFrame
    size: int

    def bit(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.size))


def id_filter(ids: DataFrame, key: str) -> IdFilter:
    """A filter over ids[key], which is counted first: best a written table.

    It grows with the ids up to 16 MB and so can be broadcast whatever the data's size; when it is
    full it lets all rows through, and an exact join must follow anyway.
    """
    least, most = FILTER_BITS
    out = IdFilter(ids, min(most, max(least, 1 << (16 * ids.count()).bit_length())))
    rows = ids.select(out.bit(F.col(f"`{key}`")).alias("bit"))
    out.rows = rows.groupBy(F.floor(F.col("bit") / _SLICE).alias("s")).agg(F.bitmap_construct_agg(F.col("bit") % _SLICE).alias("bits"))
    return out


def bitmap(keys: DataFrame, key: str) -> tuple[bytes, int]:
    """A bitmap over the low bits of keys[key], which are hashes themselves, and its size in bits, a power of two.

    keys is counted first: best a written table. Like an id filter it grows up to 16 MB and then fills up,
    so the driver may collect it and hand it to workers.
    """
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (16 * keys.count()).bit_length()))
    bit = F.col(f"`{key}`").bitwiseAND(size - 1)
    slices = keys.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _SLICE).alias("s")).agg(F.bitmap_construct_agg(F.col("bit") % _SLICE).alias("bits"))
    out = bytearray(size // 8)
    for row in slices.collect():
        out[row.s * (_SLICE // 8) : (row.s + 1) * (_SLICE // 8)] = row.bits
    return bytes(out), size


def _tested(df: DataFrame, key: str, ids: IdFilter, found: str) -> DataFrame:
    """df with a column ``found``: whether its key may be among the filter's ids."""
    slices, bits = fresh("slice", df), fresh("bits", df)
    bit = ids.bit(F.col(f"`{key}`"))
    byte = F.conv(F.hex(F.substring(F.col(bits), (bit % _SLICE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bitmap = ids.rows.select(F.col("s").alias(slices), F.col("bits").alias(bits))
    joined = df.join(F.broadcast(bitmap), F.floor(bit / _SLICE) == F.col(slices), "left")
    return joined.withColumn(found, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop(slices, bits)


def probably_in(df: DataFrame, key: str, ids: IdFilter) -> DataFrame:
    """Rows whose key may be among the filter's ids."""
    found = fresh("found", df)
    return _tested(df, key, ids, found).where(F.col(found)).drop(found)


def without(docs: DataFrame, rows: DataFrame, mark: Column, name: str) -> DataFrame:
    """Documents without those that ``rows`` (doc_id, mark, kept) drops; all columns of docs.

    mark is an expression over docs that tells texts of one doc_id apart. Whole texts aren't
    shuffled, but for those of dropped ids and of a few that share their place in an id filter.
    Documents without doc_id stay. Of an id with rows that go, those whose mark is kept stay, one of each.
    """
    gone = rows.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("all"))
    gone = written(gone.where("not `all`").select("doc_id"), f"{name}_gone")
    found, own, id_, m = fresh("found", docs), fresh("mark", docs), fresh("kept_id", docs), fresh("kept_mark", docs)
    tested = _tested(docs, "doc_id", id_filter(gone, "doc_id"), found)
    marked = tested.where(F.col(found)).withColumn(own, mark)
    gone = gone.select(F.col("doc_id").alias(id_))
    other = marked.join(gone, F.col("doc_id") == F.col(id_), "left_anti")
    left = tested.where(~F.col(found)).unionByName(other.drop(own))
    # ids of which some rows stay: few, only repeated ids can be
    some = rows.where("kept").join(gone, F.col("doc_id") == F.col(id_), "left_semi").select("doc_id", "mark").distinct()
    some = written(some, f"{name}_some")
    if not some.isEmpty():
        some = some.select(F.col("doc_id").alias(id_), F.col("mark").alias(m))
        one = marked.join(some, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(m)), "left_semi")
        left = left.unionByName(one.dropDuplicates(["doc_id", own]).drop(own))
    return left.drop(found)


#: Tasks over which the rows of one key are spread at most.
SALTS = 256


def with_totals(rows: DataFrame, key: str, by: str, partial: list[Column], total: list[Column]) -> DataFrame:
    """rows with aggregates of their key: ``partial`` ones by key and salt of ``by``, and ``total`` over these by key.

    No task holds more than a key's share of one of SALTS salts, or its SALTS partial rows.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by, F.lit(9)), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(*partial)
    known = parts.select(key, "salt").join(parts.groupBy(key).agg(*total).hint("merge"), key)
    return salted.join(known.hint("merge"), [key, "salt"]).drop("salt")


#: Rows of a key from which it is spread when it is joined.
HOT = 65_536


def spread_join(rows: DataFrame, unique: DataFrame, key: str, by: str, count: str) -> DataFrame:
    """Left join with a table of one row per key, which knows how many rows the key has; best a written table.

    Rows of keys with more than HOT rows are dealt to SALTS tasks by the hash of ``by``; both
    sides learn from an id filter which keys these are, so that only their rows are repeated.
    """
    hot = unique.where(F.col(count) > HOT).select(key)
    if hot.isEmpty():
        return rows.join(unique, key, "left")
    hot = id_filter(hot, key)
    salt = F.pmod(F.xxhash64(by, F.lit(9)), F.lit(SALTS)).cast("int")
    left = _tested(rows, key, hot, "hot").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = _tested(unique, key, hot, "hot").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, [key, "salt"], "left").drop("salt")


def components(edges: DataFrame, name: str, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (id, root), root the smallest id; only linked ids.

    Alternates large-star and small-star steps, each a few shuffles over the edges; the rounds are
    written tables, so lost executors cost one round at most. Nodes of more than HOT edges are
    spread over tasks. Raises if the rounds don't suffice.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(max_rounds):
        now = written(now, name)
        done, widest = _shape(now)
        if done:
            return now.selectExpr("a as id", "b as root").union(now.selectExpr("b as id", "b as root").distinct())
        both = now.union(now.selectExpr("b as a", "a as b"))
        large = _with_least(both, widest > HOT).where("b > a").selectExpr("b as a", "least(m, a) as b").distinct()
        # here a node has at most an edge for each one that it had
        small = _with_least(large, widest > HOT).selectExpr("inline(array(struct(a, m as b), struct(b as a, m as b)))")
        now = small.where("a <> b").distinct()
    raise RuntimeError(f"components of {name}: no fixed point in {max_rounds} rounds")


def _with_least(edges: DataFrame, spread: bool) -> DataFrame:
    """Edges (a, b) with m, the least b of their a."""
    if spread:
        return with_totals(edges, "a", "b", [F.min("b").alias("p")], [F.min("p").alias("m")])
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether each a has one b only and no b is an a; and the most edges of a node."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    sides = ends.groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = sides.agg(F.count_if(F.expr("up > 1 or (up = 1 and down > 0)")).alias("other"), F.max(F.col("up") + F.col("down")).alias("widest")).first()
    return row.other == 0, row.widest or 0
