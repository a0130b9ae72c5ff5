"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words, a
document's score the noisy-or of its sentences' scores: the chance that one at least is toxic. Weights
are learned from labels of documents alone; sentence scores then tell where the offence is. Only features that
are more frequent in documents with label 1 are known, their weights aren't negative, and what a sentence has without any
is held below the least score that counts; lower ones are 0. So plain and harmless sentences add
nothing, however many there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import held_out, labelled_texts, written

#: Labelled documents that training reads at most, and features that have a weight.
SAMPLE, WORDS = 8000, 600
#: Stems are beginnings of words of these lengths.
STEMS = (4, 5, 6)
#: Documents that a feature needs, and least log-likelihood ratio over documents (one in ten thousand has it by chance).
LEAST, GAIN = 4, 15
#: The same for features by the different words they are in, which pools rare words of few documents.
LEAST_POOLED, GAIN_POOLED = 3, 20
STEPS, RATE, RIDGE = 500, 0.1, 1e-4
#: Entries of a table of counts before a task passes it on.
COUNTS = 100_000
FROM = 0.3
#: Least score of a sentence, lower ones are 0; and the most that the common part of all scores may be, a score of 0.05.
SENTENCE_FROM, BASE = 0.1, -3.0

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> list[str]:
    """Parts of a text between full stops, exclamation and question marks and line ends; none if it is null or blank."""
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


def parts(sentence: str) -> set[str]:
    """Features of a lower-cased sentence: its words, and the beginnings of longer ones with a hyphen."""
    words = set(_WORD.findall(sentence))
    out = set(words)
    for k in STEMS:
        out.update({w[:k] + "-" for w in words if len(w) > k})
    return out


@dataclass
class Model:
    weights: dict[str, float]
    base: float = 0.0

    def __post_init__(self):
        self._words = {w for w in self.weights if w[-1] != "-"}
        self._stems = [(k, s) for k in STEMS if (s := {w[:-1] for w in self.weights if w[-1] == "-" and len(w) == k + 1})]

    def _score(self, sentence: str) -> float:
        words = set(_WORD.findall(sentence))
        found = sorted(self._words & words)
        for k, stems in self._stems:
            found += sorted(s + "-" for s in stems & {w[:k] for w in words if len(w) > k})
        p = float(_sigmoid(self.base + sum(self.weights[f] for f in found))) if found else 0.0
        return p if p >= SENTENCE_FROM else 0.0

    def sentence(self, text: str) -> float:
        """Score of a sentence from the different words and stems in it; 0 if none is known or it is below SENTENCE_FROM."""
        return self._score(text.lower())

    def located(self, text: str | None) -> tuple[float, int | None, str | None, float]:
        """Noisy-or over all sentences, and number, text and score of the first sentence with the highest score above 0."""
        clean, best, at, place, nth = 0.0, 0.0, None, None, 0
        for k, s in enumerate(_SENTENCE.split((text or "").lower())):
            if not s or s.isspace():
                continue
            p = self._score(s)
            if p:
                clean += float(np.log1p(-min(p, 1 - 1e-12)))
                if p > best:
                    best, at, place = p, nth, k
            nth += 1
        return float(-np.expm1(clean)), at, None if at is None else _SENTENCE.split(text)[place].strip(), best

    def document(self, text: str | None) -> float:
        """Noisy-or over all sentences."""
        return self.located(text)[0]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _gain(n: np.ndarray, pos: np.ndarray, total: float, share: float) -> np.ndarray:
    """Log-likelihood ratio of features in n of total units, pos of them among the share with label 1."""
    n, pos = n.astype(float), pos.astype(float)
    table = np.stack([pos, n - pos, share - pos, total - n - share + pos])
    expected = np.stack([n * share, n * (total - share), (total - n) * share, (total - n) * (total - share)]) / total
    return 2 * (table * np.log(np.maximum(table, 1e-12) / np.maximum(expected, 1e-12))).sum(0)


def counted(texts: DataFrame) -> DataFrame:
    """Rows (feature, n, pos, words, pos_words): documents and different words of documents with a feature, all and those with label 1.

    The feature "" is in all documents and words. Counted by executors, with tables of bounded size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*found.values(), strict=True))]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, ["feature", "n", "pos", "words", "pos_words"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set(_WORD.findall(text.as_py().lower()))
                bag = Counter(words)
                for k in STEMS:
                    bag.update(w[:k] + "-" for w in words if len(w) > k)
                bag[""] = len(words)
                for f, c in bag.items():
                    row = found.setdefault(f, [0, 0, 0, 0])
                    row[0] += 1
                    row[1] += y
                    row[2] += c
                    row[3] += c * y
                if len(found) >= COUNTS:
                    yield out()
        if found:
            yield out()

    rows = texts.select("y", "text").mapInArrow(count, "feature string, n bigint, pos bigint, words bigint, pos_words bigint")
    return rows.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "pos", "words", "pos_words")))


def vocabulary(counts: DataFrame, size: int = WORDS) -> list[str]:
    """Features that speak for label 1, by documents or by different words; the strongest first, ties by name.

    The driver sees the features of several documents of the bounded sample.
    """
    total = counts.where("feature = ''").first()
    if total is None or not 0 < total.pos < total.n:
        return []
    some = counts.where(F.col("feature") != "").where((F.col("n") >= LEAST) | (F.col("pos") >= LEAST_POOLED))
    rows = some.toPandas().sort_values("feature", kind="stable")
    if rows.empty:
        return []
    by_doc = _gain(rows["n"].to_numpy(), rows["pos"].to_numpy(), total.n, total.pos)
    by_word = _gain(rows["words"].to_numpy(), rows["pos_words"].to_numpy(), total.words, total.pos_words)
    more = rows["pos_words"].to_numpy() * total.words > rows["words"].to_numpy() * total.pos_words
    pooled = (by_word > GAIN_POOLED) & (rows["pos"].to_numpy() >= LEAST_POOLED) & more
    plain = (by_doc > GAIN) & (rows["n"].to_numpy() >= LEAST)
    speaks = rows["pos"].to_numpy() * total.n > rows["n"].to_numpy() * total.pos
    plain, pooled = plain & speaks, pooled & speaks
    strength = np.maximum(np.where(plain, by_doc, 0), np.where(pooled, by_word, 0))
    names = rows["feature"].tolist()
    return [names[k] for k in np.argsort(-strength, kind="stable")[:size] if strength[k] > 0]


def _known(texts: DataFrame, words: list[str]) -> pd.DataFrame:
    """doc_id, y, and for each sentence with known features how many there are, and their places; found by executors."""
    place = {w: k for k, w in enumerate(words)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = [], []
            for text in batch.column(2):
                found = [sorted(place[w] for w in place.keys() & parts(s)) for s in sentences(text.as_py().lower())]
                sizes.append([len(f) for f in found if f])
                places.append([k for f in found for k in f])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "y", "sizes", "places"])

    rows = texts.select(F.col("doc_id").cast("bigint"), "y", "text").mapInArrow(find, "doc_id bigint, y int, sizes array<int>, places array<int>")
    return rows.toPandas().sort_values("doc_id", kind="stable")


def fit(words: list[str], sizes: list, places: list, y: np.ndarray) -> Model:
    """Maximise the likelihood of document labels under noisy-or by Adam steps, with weights of 0 or more and a base of at most BASE.

    sizes: for each document, how many features each of its sentences with any has; places: these
    features, one sentence after the other.
    """
    owner = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    rows = np.repeat(np.arange(len(owner)), np.concatenate([np.asarray(s, np.int64) for s in sizes]))
    cols = np.concatenate([np.asarray(p, np.int64) for p in places])
    w = np.zeros(len(words) + 1)  # the last is common to all sentences with a known feature
    w[-1] = -4
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = _sigmoid(np.clip(w[-1] + np.bincount(rows, w[cols], len(owner)), -30, 30))
        clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        toxic = np.maximum(-np.expm1(clean), 1e-6)
        # of the loss by log(1 - sentence score), for each document
        pull = np.where(y == 1, (1 - toxic) / toxic, -1.0)
        by_sentence = -pull[owner] * p
        grad = np.r_[np.bincount(cols, by_sentence[rows], len(words)), by_sentence.sum()] / len(y) + RIDGE * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
        w[-1] = min(w[-1], BASE)
    return Model(dict(zip(words, w[:-1].tolist(), strict=True)), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` labelled documents outside the fold; labels (doc_id, toxic).

    Executors count features and find them in sentences; the driver sees at most WORDS features and
    their places. Without labels of both kinds no feature has a weight.
    """
    texts = labelled_texts(docs, labels, "toxic", modulus, remainder, sample)
    words = vocabulary(written(counted(texts), "toxic_features"))
    if not words:
        return Model({})
    rows = _known(texts, words)
    return fit(words, rows["sizes"].tolist(), rows["places"].tolist(), rows["y"].to_numpy())


def located(text: Column, model: Model) -> Column:
    """Struct (score, nth, sentence, sentence_score) of whole texts: the document's score and its worst sentence; see Model.located."""

    @F.pandas_udf("score double, nth int, sentence string, sentence_score double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            out = pd.DataFrame([model.located(t) for t in some], columns=["score", "nth", "sentence", "sentence_score"])
            yield out.astype({"score": float, "nth": "Int32", "sentence": object, "sentence_score": float})

    return toxic(text)


def scores(text: Column, model: Model) -> Column:
    """Document scores of whole texts; null and blank texts score 0."""

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([model.document(t) for t in some], dtype=float)

    return toxic(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, predicted, nth, sentence, sentence_score), one per row of docs (doc_id, text).

    nth counts the sentences that aren't blank from 0; the last three tell the sentence with the highest score and
    are null, null and 0 without one above 0. Null, empty and blank texts score 0, and so do texts of any
    length without a known feature. Rows that repeat doc_id or have none are scored like any other; an
    empty table gives no rows, and other columns aren't looked at.
    """
    rows = docs.select("doc_id", located(docs["text"], model).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "score", (F.col("score") >= FROM).cast("int").alias("predicted"), "nth", "sentence", "sentence_score")


def offending(docs: DataFrame, model: Model, at_least: float = FROM) -> DataFrame:
    """Sentences that score ``at_least``: rows (doc_id, nth, sentence, sentence_score), nth from 0.

    Null, empty and blank texts have none, an empty table gives no rows, and other columns aren't looked at.
    """

    @F.pandas_udf("array<struct<nth: int, sentence: string, sentence_score: double>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([[{"nth": k, "sentence": s.strip(), "sentence_score": p} for k, s in enumerate(sentences(t)) if (p := float(model.sentence(s))) >= at_least] for t in some])

    return docs.select("doc_id", F.explode(found(docs["text"])).alias("x")).select("doc_id", "x.*")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", "nth", "sentence", "sentence_score")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that aren't predicted toxic, all columns; null and empty texts stay, an empty table stays empty."""
    return docs.where(scores(docs["text"], train(docs, labels)) < FROM)
