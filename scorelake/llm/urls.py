"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Only DataFrame functions run over the URLs. The trees are fitted on the driver to a bounded sample of
labelled URLs and compiled to a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import let

#: Rules (verdict, host, path); a rule fits its host and all subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled URLs that training reads at most, trees, their depth, and the step of boosting.
SAMPLE, TREES, DEPTH, RATE, BINS = 10_000, 30, 3, 0.3, 32
BLOCK_FROM = 0.5


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct (rule, verdict); null if none fits."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def suffix(h: Column, labels: int) -> Column:
    """The last labels of a host."""
    return F.substring_index(h, ".", -labels)


def entropy(s: Column) -> Column:
    """Bits per character; 0 for an empty string."""
    return let(F.filter(F.split(s, ""), lambda c: c != ""), lambda a: F.coalesce(F.aggregate(
        F.transform(F.array_distinct(a), lambda c: F.size(F.filter(a, lambda x: x == c)) / F.size(a)), F.lit(0.0), lambda t, q: t - q * F.log2(q)
    ), F.lit(0.0)))


#: Suffixes with statistics: of one label, and of two; those with so many labelled URLs, at most so many.
SUFFIXES, SUFFIX_LEAST, SUFFIX_MOST = {"suffix": 1, "domain": 2}, 20, 500
#: Folds of the labelled URLs for these statistics.
FOLDS = 5


def features(url: Column, h: Column, p: Column, rates: dict[str, float], base: float) -> dict[str, Column]:
    """Lexical features. rates: share of blocked URLs by host suffix, smoothed; base for those without."""
    u = F.coalesce(url, F.lit(""))
    stats = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]) if rates else None
    count = lambda s, pattern: F.regexp_count(s, F.lit(pattern)).cast("double")
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(h).cast("double"),
        "depth": count(p, "/[^/]"),
        "labels": count(h, r"\.") + 1,
        "digits": count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)),
        "host_digits": count(h, "[0-9]"),
        "hyphens": count(h, "-"),
        "entropy": entropy(u),
        "host_entropy": entropy(h),
        "parameters": F.when(u.contains("?"), count(F.regexp_extract(u, r"\?([^#]*)", 1), "[^&]+")).otherwise(0.0),
        "escapes": count(u, "%[0-9A-Fa-f]{2}"),
        "secure": F.lower(u).startswith("https://").cast("double"),
    } | {k: F.coalesce(stats[suffix(h, n)], F.lit(base)) if stats is not None else F.lit(base) for k, n in SUFFIXES.items()}


@dataclass
class Tree:
    """A split (feature, bound, two trees), or a leaf."""

    value: float = 0.0
    feature: int = -1
    bound: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], depth: int, least: int = 10, ridge: float = 1.0) -> Tree:
    """Newton tree on gradients g and curvatures h over histograms of the features."""
    leaf = Tree(float(-g.sum() / (h.sum() + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, at = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        bins = np.searchsorted(cuts, x[:, f], "left")
        gs, hs, ns = (np.bincount(bins, w, len(cuts) + 1).cumsum()[:-1] for w in (g, h, None))
        gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole
        gain[(ns < least) | (len(x) - ns < least)] = 0
        if gain.max() > best:
            best, at = gain.max(), (f, float(cuts[gain.argmax()]))
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    return Tree(leaf.value, *at, grow(x[low], g[low], h[low], edges, depth - 1, least, ridge), grow(x[~low], g[~low], h[~low], edges, depth - 1, least, ridge))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list[Tree]]:
    """Logistic boosting: first log-odds, and trees to add up."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    start, out = float(np.log(share / (1 - share))), []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    score = np.full(len(y), start)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, p - y, np.maximum(p * (1 - p), 1e-6), edges, depth)
        score += rate * values(tree, x)
        out.append(tree)
    return start, out


def values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if tree.low is None:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.bound, values(tree.low, x), values(tree.high, x))


def compiled(tree: Tree, x: list[Column], rate: float = RATE) -> Column:
    if tree.low is None:
        return F.lit(rate * tree.value)
    return F.when(x[tree.feature] <= tree.bound, compiled(tree.low, x, rate)).otherwise(compiled(tree.high, x, rate))


def classifier(labelled: DataFrame, sample: int = SAMPLE):
    """Fit to rows (key, url, y), of which at most ``sample`` are read; gives a function of url, host and path to the block probability."""
    some = labelled.where("url is not null and y is not null").orderBy(F.xxhash64("key", F.lit(5)), "url", "y").limit(sample)
    some = some.select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p"), "url", "y")
    plain = features(F.col("url"), F.col("h"), F.col("p"), {}, 0.5) | {k: suffix(F.col("h"), n) for k, n in SUFFIXES.items()}
    rows = some.select(F.col("y").alias("label"), F.struct(*(c.alias(k) for k, c in plain.items())).alias("x")).collect()
    y = np.array([r.label for r in rows], float)
    base = float(y.mean()) if len(y) else 0.5
    # labelled URLs and blocked ones by suffix and fold
    ends: dict[str, np.ndarray] = {}
    for at, r in enumerate(rows):
        for end in {r.x[k] for k in SUFFIXES}:
            ends.setdefault(end, np.zeros((2, FOLDS)))[:, at % FOLDS] += 1, r.label
    often = sorted((e for e in ends if ends[e][0].sum() >= SUFFIX_LEAST), key=lambda e: (-ends[e][0].sum(), e))[:SUFFIX_MOST]
    rate = lambda n, blocked: float((blocked + 5 * base) / (n + 5))
    rates = {e: rate(*ends[e].sum(1)) for e in sorted(often)}
    # in training, a row's rates come from the other folds, so that its own label isn't among them
    others = {e: [rate(*(ends[e].sum(1) - ends[e][:, f])) for f in range(FOLDS)] for e in rates}
    x = np.array([[(others[r.x[k]][at % FOLDS] if r.x[k] in others else base) if k in SUFFIXES else r.x[k] for k in plain] for at, r in enumerate(rows)], float).reshape(len(rows), len(plain))
    start, trees = boost(x, y)

    def probability(columns: list[Column]) -> Column:
        return 1 / (1 + F.exp(-sum((compiled(t, columns) for t in trees), F.lit(start))))

    return rates, base, probability


def matched(pages: DataFrame, rules=RULES) -> DataFrame:
    """Rows (page_id, url, host, path, found), found the struct (rule, verdict) of the longest fitting rule or null."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return rows.withColumn("found", rule(F.col("host"), F.col("path"), rules))


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, block_score), one per row of pages (page_id, url).

    URLs that a rule decides are the labels of the trees, which decide the others: block from a score of
    one half. A null URL, or one without ://, has empty host and path and goes to the trees; without
    labels, or with one kind only, all trees' verdicts are that of the majority, block for none.
    Rows with null or repeated page_id are judged like any other; an empty table gives no rows. URLs of
    any length count as a whole, and other columns aren't looked at.
    """
    rows = matched(pages, rules)
    labelled = rows.where("found is not null").select(F.col("page_id").alias("key"), "url", (F.col("found.verdict") == "block").cast("int").alias("y"))
    rates, base, probability = classifier(labelled, sample)
    x = features(F.col("url"), F.col("host"), F.col("path"), rates, base)
    rows = rows.select("*", F.struct(*(c.alias(k) for k, c in x.items())).alias("x"))
    rows = rows.withColumn("block_score", probability([F.col(f"x.{k}") for k in x]))
    verdict = F.coalesce("found.verdict", F.when(F.col("block_score") >= BLOCK_FROM, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "block_score")
