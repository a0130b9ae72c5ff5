"""Text functions: tokens, similarity, token counts and prices, patterns, JSON blocks, ids, hex."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\p{IsHan}"
WORDS = r"[\p{L}\p{N}_]+"


def bound(value: Column, body) -> Column:
    """Evaluate value once and hand it to body as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased words; each Han character is a token. Null gives no tokens."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"({HAN})", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(WORDS), 0)


def _squares(found: Column) -> Column:
    """Sum of squares of the counts of each different token: runs of the sorted array are its counts."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("sum"))

    def step(a: Column, x: Column) -> Column:
        same = (a["last"] == x) & (a["run"] > 0)
        return F.struct(x.alias("last"), F.when(same, a["run"] + 1).otherwise(F.lit(1).cast("bigint")).alias("run"), F.when(same, a["sum"] + 2 * a["run"] + 1).otherwise(a["sum"] + 1).alias("sum"))

    return F.aggregate(F.array_sort(found), start, step, lambda a: a["sum"])


def tf_cosine(a: Column, b: Column) -> Column:
    """Cosine of raw term frequencies of two texts; null if one has no tokens.

    With the sums of squares of a, b and both together, the dot product is half of what the last
    exceeds the others by; so one pass over each sorted token array does, without a shuffle.
    """

    def cosine(x: Column, y: Column) -> Column:
        both = _squares(F.concat(x, y))
        return bound(F.struct(_squares(x).alias("x"), _squares(y).alias("y"), both.alias("z")), lambda s: F.try_divide((s["z"] - s["x"] - s["y"]).cast("double") / 2, F.sqrt(s["x"].cast("double")) * F.sqrt(s["y"].cast("double"))))

    return bound(tokens(a), lambda x: bound(tokens(b), lambda y: cosine(x, y)))


def similar_enough(similarity: Column, threshold: float) -> Column:
    """1 when similarity exceeds the threshold, else 0, also for null."""
    return F.coalesce(similarity > threshold, F.lit(False)).cast("double")


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def token_count(text: Column) -> Column:
    """Estimate: 1.2 per Han and 0.25 per ASCII character, or a quarter of the length if that is more."""
    text = F.coalesce(text, F.lit(""))
    parts = _rounded(F.regexp_count(text, F.lit(HAN)) * 1.2) + _rounded(F.regexp_count(text, F.lit(r"[\x00-\x7F]")) * 0.25)
    return F.greatest(parts, _rounded(F.length(text) / 4)).cast("bigint")


def token_price(count: Column, price_per_million: Column) -> Column:
    """Tokens times the price of one, which is rounded half up to ten places."""
    one = F.round(price_per_million.cast("decimal(18,6)") / F.lit(Decimal(1_000_000)).cast("decimal(7,0)"), 10)
    return (count.cast("decimal(18,0)") * one.cast("decimal(20,10)")).cast("double")


def markdown_json(text: Column) -> Column:
    """Content of the first fenced json block, or the text itself."""
    found = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.coalesce(F.nullif(found, F.lit("")), text)


def extract_first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def uuid3(name: Column) -> Column:
    """Name-based UUID (version 3) of the name's UTF-8 bytes."""
    h = F.md5(name.cast("binary"))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    third = F.concat(F.lit("3"), F.substring(h, 14, 3))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes of a hex string; an error for an odd length or other characters."""
    return F.when(F.length(text) % 2 == 0, F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("odd number of hex digits: "), text)))


def nano_id(size: int = 21, seed: int | None = None) -> Column:
    """Random characters of a 64-character alphabet."""
    alphabet = F.lit("_-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    draw = lambda k: F.floor(F.rand(None if seed is None else seed + k) * 64).cast("int") + 1
    return F.concat(*(F.substring(alphabet, draw(k), F.lit(1)) for k in range(size)))


def sse_events(text: Column) -> Column:
    """Server-sent events of a text: array of (event, data); blocks end at blank lines, data lines are joined."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+"), lambda b: F.trim(b) != "")
    lines = lambda b, key: F.transform(F.filter(F.split(b, "\n"), lambda x: F.startswith(x, F.lit(key + ":"))), lambda x: F.regexp_replace(x, f"^{key}: ?", ""))
    return F.transform(blocks, lambda b: F.struct(F.get(lines(b, "event"), F.lit(0)).alias("event"), F.array_join(lines(b, "data"), "\n").alias("data")))
