"""Order statistics of whole tables: the keys at given ranks and exact percentiles, from histograms and counts alone.

Rows are neither sorted nor moved. Each pass reads the key columns and counts, and what leaves a task is
bounded by the number of buckets, whatever the number of rows or of different values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a pass over a range of keys.
BUCKETS = 4096
_WHOLE = {"tinyint", "smallint", "int", "bigint", "date", "timestamp", "boolean"}


def whole_keys(df: DataFrame, order: list) -> list[Column] | None:
    """Columns of longs whose order is that of the named columns, nulls first; None if one isn't a whole number, date, time or boolean."""
    kinds, out = dict(df.dtypes), []
    for name in order:
        kind = kinds.get(name) if isinstance(name, str) else None
        if kind not in _WHOLE:
            return None
        c = F.col(f"`{name}`")
        value = F.unix_micros(c) if kind == "timestamp" else F.unix_date(c) if kind == "date" else c
        value = value.cast("bigint") if kind != "boolean" else c.cast("int").cast("bigint")
        out += [c.isNotNull().cast("bigint"), F.coalesce(value, F.lit(0))]
    return out


@dataclass(frozen=True)
class Place:
    """Where a rank is: the keys of its row, how many rows with these keys come before it, and how many have them."""

    keys: tuple[int, ...]
    before: int
    ties: int


def place(df: DataFrame, keys: list[Column], rank: int) -> Place | None:
    """Place of the row with this rank (from 0) in the order of the keys; None beyond the last row.

    One key after the other is narrowed down: the range that holds the rank is cut into at most BUCKETS
    and counted, and the bucket in which the rank falls is the next range, up to a single value.
    """
    found: list[int] = []
    n = 0
    for key in keys:
        low, high, n = df.agg(F.min(key), F.max(key), F.count("*")).first()
        if rank >= n:
            return None
        while low < high:
            bits = max(0, (high - low).bit_length() + 1 - BUCKETS.bit_length())  # low bits that a bucket leaves open
            counts = df.where(key.between(low, high)).groupBy(F.shiftright(key, bits).alias("bucket")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
            for row in sorted(counts, key=lambda r: r.bucket):
                if rank < row.n:
                    break
                rank -= row.n
            low, high, n = row.low, row.high, row.n
        found.append(low)
        df = df.where(key == low)
    return Place(tuple(found), rank, n)


def compared(keys: list[Column], values: tuple[int, ...]) -> tuple[Column, Column]:
    """Whether keys are less than the values, compared from the first on, and whether they are equal."""
    less, equal = F.lit(False), F.lit(True)
    for key, value in reversed(list(zip(keys, values, strict=True))):
        less, equal = (key < value) | ((key == value) & less), (key == value) & equal
    return less, equal


#: Accuracy of the sketches that bracket a percentile, the values that one task may hold of it at the end, and rounds at most.
ACCURACY, HELD, ROUNDS = 10_000, 10_000, 40
#: Ranges that a bracket is cut into when it holds too many values.
CUTS = 64


def percentiles(rows: DataFrame, by: list[str], values: dict[str, tuple[str, str]], percents: tuple[int, ...]) -> DataFrame:
    """Exact percentiles by nearest rank: rows (by..., tp<percent>_<name>), one per group, null where a group has no values.

    values: for each name an SQL expression and the condition under which it counts; nulls don't. A percentile is the
    value at place ceil(n * percent / 100) of the sorted values. A sketch of bounded size brackets each,
    exact counts tell which place inside the bracket is asked for, and brackets are narrowed until their
    inner values, those at the ends aside, are few enough to be sorted. All percentiles, values and groups share each pass,
    and no task holds more than HELD values of a bracket, however many there are in all.
    """
    keys = [f"__k{k}" for k in range(len(by))] or ["__k0"]
    key_columns = [F.col(f"`{c}`") for c in by] or [F.lit(0)]
    names = list(values)
    data = rows.select(*(c.alias(k) for c, k in zip(key_columns, keys, strict=True)), *(F.expr(f"CASE WHEN {where} THEN {x} END").alias(f"v{i}") for i, (x, where) in enumerate(values.values())))
    asked = [(i, p) for i in range(len(names)) for p in percents]

    # brackets from sketches: a sketch's value is at most 1 / ACCURACY of all away from its place
    ends = []
    for p in percents:
        ends += [max(0.0, p / 100 - 2 / ACCURACY), min(1.0, p / 100 + 2 / ACCURACY)]
    sketches = [F.expr(f"approx_percentile(v{i}, array({', '.join(map(repr, ends))}), {ACCURACY})").alias(f"q{i}") for i in range(len(names))]
    state = data.groupBy(*keys).agg(*sketches, *(F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))))
    columns = []
    for i, p in asked:
        k = percents.index(p)
        columns += [F.get(f"q{i}", F.lit(2 * k)).alias(_at("lo", i, p)), F.get(f"q{i}", F.lit(2 * k + 1)).alias(_at("hi", i, p)), F.expr(f"(n{i} * {p} + 99) div 100").alias(_at("rank", i, p))]
    state = _pinned(state.select(*keys, *columns))
    for _ in range(ROUNDS):
        state = _pinned(_counted(data, state, keys, asked))
        wide = [F.max(F.when(_open(i, p), F.col(_at("inner", i, p)))).alias(_at("w", i, p)) for i, p in asked]
        widest = state.agg(*wide).first()
        if all(w is None or w <= HELD for w in widest):
            break
        state = _pinned(_narrowed(data, state, keys, [a for a, w in zip(asked, widest, strict=True) if w is not None and w > HELD], asked))
    else:
        raise RuntimeError(f"percentiles weren't found in {ROUNDS} rounds")
    inner = _joined(data, state, keys).groupBy(*keys).agg(
        *(F.array_sort(F.collect_list(F.when(_open(i, p) & _inside(i, p), F.col(f"v{i}")))).alias(_at("s", i, p)) for i, p in asked)
    )
    out = _joined(inner, state, keys)
    found = []
    for i, p in asked:
        lo, hi, place_ = F.col(_at("lo", i, p)), F.col(_at("hi", i, p)), F.col(_at("rank", i, p)) - F.col(_at("below", i, p))
        low, inner_ = F.col(_at("low", i, p)), F.col(_at("inner", i, p))
        value = F.when(place_ <= low, lo).when(place_ > low + inner_, hi).otherwise(F.get(_at("s", i, p), (place_ - low - 1).cast("int")))
        found.append(value.alias(f"tp{p}_{names[i]}"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=False)), *found)


def _at(what: str, i: int, p: int) -> str:
    return f"{what}_{i}_{p}"


def _inside(i: int, p: int) -> Column:
    return (F.col(f"v{i}") > F.col(_at("lo", i, p))) & (F.col(f"v{i}") < F.col(_at("hi", i, p)))


def _open(i: int, p: int) -> Column:
    """Whether the place asked for is between the ends of the bracket."""
    place_ = F.col(_at("rank", i, p)) - F.col(_at("below", i, p)) - F.col(_at("low", i, p))
    return (place_ > 0) & (place_ <= F.col(_at("inner", i, p)))


def _pinned(df: DataFrame) -> DataFrame:
    from scorelake.operators.rows import pinned

    return pinned(df)


def _joined(data: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the state of their group, a small table if groups are few; a null key is a group."""
    state = state.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return data.join(state, same).drop(*(f"{k}_" for k in keys))


def _counted(data: DataFrame, state: DataFrame, keys: list[str], asked: list[tuple[int, int]]) -> DataFrame:
    """The state with how many values are below each bracket, at its low end, and between its ends."""
    counts = []
    for i, p in asked:
        v, lo = F.col(f"v{i}"), F.col(_at("lo", i, p))
        counts += [F.count_if(v < lo).alias(_at("below", i, p)), F.count_if(v == lo).alias(_at("low", i, p)), F.count_if(_inside(i, p)).alias(_at("inner", i, p))]
    kept = [c for c in state.columns if c.split("_")[0] in ("lo", "hi", "rank")]
    return _joined(data, state, keys).groupBy(*keys).agg(*counts, *(F.first(c).alias(c) for c in kept))


def _narrowed(data: DataFrame, state: DataFrame, keys: list[str], wide: list[tuple[int, int]], asked: list[tuple[int, int]]) -> DataFrame:
    """The state with narrower brackets for those that are wide: between sketched cuts of their inner values around the place asked for."""
    cuts = ", ".join(repr(k / CUTS) for k in range(CUTS + 1))
    inner = _joined(data, state, keys).groupBy(*keys).agg(
        *(F.expr(f"approx_percentile(CASE WHEN v{i} > {_at('lo', i, p)} AND v{i} < {_at('hi', i, p)} THEN v{i} END, array({cuts}), {ACCURACY})").alias(_at("c", i, p)) for i, p in wide)
    )
    out = _joined(inner, state, keys)
    changed = {}
    for i, p in wide:
        place_ = F.col(_at("rank", i, p)) - F.col(_at("below", i, p)) - F.col(_at("low", i, p))
        at = F.floor(place_ * CUTS / F.col(_at("inner", i, p))).cast("int")
        low, high = (F.get(_at("c", i, p), F.least(F.greatest(at + d, F.lit(0)), F.lit(CUTS))) for d in (-1, 2))
        changed[_at("lo", i, p)] = F.when(_open(i, p), low).otherwise(F.col(_at("lo", i, p)))
        changed[_at("hi", i, p)] = F.when(_open(i, p), high).otherwise(F.col(_at("hi", i, p)))
    kept = [c for i, p in asked for c in (_at("lo", i, p), _at("hi", i, p), _at("rank", i, p))]
    return out.withColumns(changed).select(*keys, *kept)
