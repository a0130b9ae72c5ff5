"""Quality classifier as a sparse rule ensemble.

Small trees are grown on bootstrap samples of labelled documents; each path from a root to a node
is a conjunctive rule over statistics of the text. A lasso logistic fit keeps few of the rules, and
these are compiled to a Spark column expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import held_out, labelled_texts

#: Labelled documents that training reads at most.
SAMPLE = 8000
TREES, DEPTH, BINS, LEAST = 40, 3, 24, 15
LASSO, STEPS = 0.002, 600
FROM = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "exclamation", "bars", "commas", "stops", "other",
    "spaces", "newlines", "different", "line_words", "dup_lines", "common_word", "capitals", "marked",
)


def statistics(text: str | None) -> list[float]:
    """Values of STATISTICS for a whole text; null counts as empty, and all shares of an empty text are 0."""
    text = text or ""
    raw = text.encode()
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words = max(1, len(raw)), text.split()
    lines = [s for x in text.split("\n") if (s := x.strip())]
    kinds = Counter(words)
    w = max(1, len(words))
    letters = max(1, int(n[65:91].sum() + n[97:123].sum()))
    marks = int(n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum())
    symbols = int(sum(n[ord(c)] for c in "#*$%&|<>"))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), len(text) / w, n[65:91].sum() / letters, n[48:58].sum() / size, symbols / size, marks / size,
        n[33] / w, n[124] / w, n[44] / w, n[46] / w, n[128:].sum() / size, n[32] / size, n[10] / size, len(kinds) / w, len(words) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), max(kinds.values(), default=0) / w,
        sum(k for x, k in kinds.items() if x[:1].isupper()) / w, sum(k for x, k in kinds.items() if not x[-1:].isalnum()) / w,
    ]


def measured(docs: DataFrame) -> Column:
    """Statistics of docs.text as a struct, by an Arrow function over whole texts."""
    schema = ", ".join(f"{s} double" for s in STATISTICS)

    @F.pandas_udf(schema)
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            yield pd.DataFrame(np.array([statistics(t) for t in some], float).reshape(len(some), -1), columns=list(STATISTICS))

    return stats(docs["text"])


#: One condition: (statistic, bound, whether the statistic is at most the bound). A rule is all of several.
Condition = tuple[int, float, bool]
Rule = tuple[Condition, ...]


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    base: float

    def column(self, stats: Column) -> Column:
        """Probability of label 1 as a column expression over the struct of statistics."""
        total = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for k, bound, low in rule:
                value = stats[STATISTICS[k]]
                one = value <= bound if low else value > bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], some: np.ndarray, depth: int, path: Rule = ()) -> Iterator[Rule]:
    """Paths of a tree by Gini gain over the features ``some``."""
    if path:
        yield path
    if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
        return
    best, at = 1e-9, None
    for f in some:
        if not len(edges[f]):
            continue
        bins = np.searchsorted(edges[f], x[:, f], "left")
        n = np.bincount(bins, minlength=len(edges[f]) + 1).cumsum()[:-1]
        p = np.bincount(bins, y, len(edges[f]) + 1).cumsum()[:-1]
        ok = (n >= LEAST) & (len(y) - n >= LEAST)
        gain = np.where(ok, p**2 / np.maximum(n, 1) + (y.sum() - p) ** 2 / np.maximum(len(y) - n, 1) - y.sum() ** 2 / len(y), 0)
        if gain.max() > best:
            best, at = gain.max(), (int(f), float(edges[f][gain.argmax()]))
    if at is None:
        return
    low = x[:, at[0]] <= at[1]
    yield from _paths(x[low], y[low], edges, some, depth - 1, (*path, (*at, True)))
    yield from _paths(x[~low], y[~low], edges, some, depth - 1, (*path, (*at, False)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, bound, low in rule:
        out &= (x[:, k] <= bound) == low
    return out


def lasso(z: np.ndarray, y: np.ndarray, strength: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the base isn't penalised."""
    n, k = z.shape
    w, base = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), base, 1.0
    norm = np.linalg.norm(np.c_[z, np.ones(n)], 2) ** 2 / (4 * n)
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - z.T @ e / n / norm
        new = np.sign(new) * np.maximum(np.abs(new) - strength / norm, 0)
        new_base = vb - e.mean() / norm
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / faster * (new - w), new_base + (t - 1) / faster * (new_base - base)
        w, base, t = new, new_base, faster
    return w, float(base)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Ensemble:
    """With no labels all scores are one half; with one kind of labels, near that kind."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Ensemble([], [], float(np.log(share / (1 - share))))
    draw = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    rules: dict[bytes, Rule] = {}
    for _ in range(TREES):
        rows = draw.integers(0, len(y), len(y))
        some = draw.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
        for rule in _paths(x[rows], y[rows].astype(float), edges, some, DEPTH):
            where = holds(rule, x)
            if LEAST <= where.sum() <= len(y) - LEAST:
                key = min(where.tobytes(), (~where).tobytes())  # a rule and its opposite say the same
                if key not in rules or len(rule) < len(rules[key]):
                    rules[key] = rule
    found = list(rules.values())
    if not found:
        return Ensemble([], [], float(np.log(share / (1 - share))))
    z = np.stack([holds(r, x) for r in found], 1).astype(float)
    w, base = lasso(z, y.astype(float), LASSO, STEPS)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([found[k] for k in kept], [float(w[k]) for k in kept], base)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample: int = SAMPLE) -> Ensemble:
    """Fit to at most ``sample`` labelled documents outside the fold; labels (doc_id, quality)."""
    texts = labelled_texts(docs, labels, "quality", modulus, remainder, sample)
    rows = texts.select("doc_id", "y", measured(texts).alias("s")).select("doc_id", "y", "s.*").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy())


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """Rows (doc_id, score, predicted), one per row of docs (doc_id, text).

    Null and empty texts have the statistics of an empty text. Rows that repeat doc_id or have none
    are scored like any other; an empty table gives no rows.
    """
    rows = docs.select("doc_id", measured(docs).alias("s")).select("doc_id", model.column(F.col("s")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= FROM).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
