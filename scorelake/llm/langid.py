"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams of one to three characters by rank. A document's
own list is compared with each profile by out-of-place distance: the sum over its n-grams of the
difference of ranks, or the profile's length for an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import held_out, id_hash

LENGTH = 300
#: Documents of each language whose n-grams make its profile: a bound on what training reads.
SAMPLE = 2000
UNDETERMINED = "und"
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Each code point, or a space where it is no letter."""
    return np.array([c if chr(c).isalpha() else _SPACE for c in range(0x110000)], np.uint64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text's words; empty if it has no letter.

    Letters are lower-cased, all else parts words; n-grams may begin or end with the space beside a
    word. A code holds 21 bits for each character.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    a = _letters()[np.r_[np.uint32(_SPACE), points, np.uint32(_SPACE)]]
    space = a == _SPACE
    a = a[~(space & np.r_[False, space[:-1]])]
    if len(a) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space, shift = a == _SPACE, np.uint64(21)
    two = a[:-1] << shift | a[1:]
    three = two[:-1] << shift | a[2:]
    return np.unique(np.concatenate([a[~space], two, three[~space[1:-1]]]), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, of equally frequent ones those with smaller codes first."""
    if len(codes) > 4 * length:  # those that can't be among the first needn't be sorted
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:length]]


def _sampled(docs: DataFrame, modulus: int, remainder: int, sample: int) -> DataFrame:
    """About ``sample`` training documents a language: those whose hash of the id, modulo the language's number of documents, is below it."""
    train = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)
    sizes = docs.where(train).groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}  # a row per language
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == lang) & (id_hash(F.col("doc_id")) % n < sample))
    return docs.where(train & chosen)


def train(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE, modulus: int = 5, remainder: int = 0) -> dict[str, np.ndarray]:
    """Profiles by language, from documents outside the fold crc32(doc_id) mod modulus = remainder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, parts in found.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                found[lang] = [(codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)))]
        for lang, [(codes, counts)] in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])

    grams = _sampled(docs, modulus, remainder, sample).select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint")
    total = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= length).collect()
    profiles: dict[str, np.ndarray] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, np.uint64) for lang, codes in profiles.items()}


class Classifier:
    def __init__(self, profiles: dict[str, np.ndarray], length: int = LENGTH):
        self.names, self.length, self.sorted = sorted(profiles), length, []
        for name in self.names:
            order = np.argsort(profiles[name])
            self.sorted.append((profiles[name][order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 - distance / largest possible distance; und and 0 without letters or profiles."""
        own = profile(*ngrams(text), self.length)
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0
        places, distances = np.arange(len(own)), []
        for codes, ranks in self.sorted:
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            distances.append(int(np.where(codes[at] == own, np.minimum(np.abs(ranks[at] - places), self.length), self.length).sum()))
        best = int(np.argmin(distances))
        return self.names[best], 1 - distances[best] / (self.length * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per row of docs (doc_id, text), from whole texts.

    Null, empty and letterless texts give und and score 0; of languages at equal distance the first
    by name counts. Nulls and repeats of doc_id pass through; an empty table gives no rows.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(profiles, length)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def held_out_predictions(docs: DataFrame) -> DataFrame:
    rows = identify(docs, train(docs))
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
