import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from scorelake.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, target, least, most, buckets, words, percent, seed):
    def features(text):
        w = WORD.findall((text or "").translate(UPPER))
        return len(w), [" ".join(w[k : k + n]) for n in range(least, most + 1) for k in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    found = [(doc, *features(text)) for doc, text in rows]
    s = Counter(bucket(g) for *_, f in found for g in f)
    t = Counter(bucket(g) for text in target for g in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    scored = []
    for doc, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in f)
        scored.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in scored if r[5] >= words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in scored), key=str)


def result(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("least, most, buckets, words, percent", [(1, 1, 10_000, 20, 10), (1, 3, 97, 5, 50), (2, 2, 1000, 0, 100)])
def test_against_python(spark, make, least, most, buckets, words, percent):
    draw = random.Random(least + most)
    vocabulary = "The the É é naïve STRASSE straße x1 7 漢字 don't İ ﬁ _ a-b".split()
    text = lambda: draw.choice([" ", "\n", "; "]).join(draw.choices(vocabulary, k=draw.randint(0, 40)))
    rows = [(k, text()) for k in range(150)] + [(7, text()), (7, "the " * 25), (7, "the " * 25), (None, text() + " x" * 25), (None, None), (200, None), (201, "")]
    target = [text() for _ in range(9)] + [None, ""]
    want = brute(rows, target, least, most, buckets, words, percent, "2024")
    benchmark = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "'x' as s", "1 as bucket")
    got = result(resampling.resample(make(rows, extra=True), benchmark, least, most, buckets, words, percent))
    assert got == want and sum(r[4] is not None for r in got) == sum(1 for r in want if r[4])
    again = result(resampling.resample(make(rows, parts=7), benchmark, least, most, buckets, words, percent))
    assert again == got


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("one two three",)], "text string")
    assert result(resampling.resample(odd, target)) == brute([(r.doc_id, r.text) for r in odd.collect()], ["one two three"], 1, 1, 10_000, 20, 10, "2024")
    assert resampling.resample(none, target).count() == 0
    assert result(resampling.resample(odd, target.limit(0))) == brute([(r.doc_id, r.text) for r in odd.collect()], [], 1, 1, 10_000, 20, 10, "2024")


def test_the_draw_leans_to_the_target(spark, make):
    draw = random.Random(9)
    words = lambda kind: " ".join(f"{kind}{draw.randint(0, 300)}" for _ in range(60))
    rows = [(k, words("law" if k % 10 == 0 else "web")) for k in range(600)]
    target = spark.createDataFrame([(words("law"),) for _ in range(30)], "text string")
    chosen = [r.doc_id for r in resampling.drawn(make(rows), target).collect()]
    assert len(chosen) == 60 and sum(k % 10 == 0 for k in chosen) >= 55
