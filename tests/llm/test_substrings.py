import hashlib
import random

import numpy as np
import pytest

from scorelake.llm import common, substrings


def brute(rows, window):
    low = {}
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if doc is not None:
                low[w] = min(low.get(w, doc), doc)
    out = []
    for doc, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if doc is not None and low[tuple(words[k : k + window])] < doc:
                gone.update(range(k, k + window))
        left = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def corpus(seed):
    """Passages that documents share, with own words around them, copies, near copies, and texts that repeat themselves."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghijklmnop") + str(draw.randint(0, 40))
    passages = [[word() for _ in range(draw.randint(8, 40))] for _ in range(6)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(draw.randint(0, 4)):
            words += [word() for _ in range(draw.randint(0, 25))] + draw.choice([[], draw.choice(passages), draw.choice(passages)[: draw.randint(1, 12)]])
        rows.append((draw.randint(0, 10_000), draw.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(20_000 + k, rows[k][1]) for k in range(15)] + [(20_500 + k, rows[k][1].replace("a", "z", 1)) for k in range(15)]
    rows += [(30_000, "x y " * 60), (30_001, "x y " * 40), (29_000, "x y x " * 7), (30_002, "z " * 30), (5, rows[3][1]), (5, rows[4][1]), (5, rows[4][1]), (None, rows[7][1]), (None, None), (None, rows[8][1])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, group_words", [(1, 500_000), (2, 300), (3, 0)])
def test_against_all_windows(make, seed, group_words, monkeypatch):
    """Large groups, groups by whole windows where a prefix has many words, and whole windows alone."""
    rows = corpus(seed)
    found = substrings.spans(make(rows), 12, 5, group_words)
    monkeypatch.setattr(substrings, "spans", lambda *_: found)
    got = result(substrings.judge(make(rows, extra=True), 12, 5))
    assert got == brute(rows, 12) and sum(r[2] > 0 for r in got) > 30


def test_production_window(make):
    draw = random.Random(5)
    passage = " ".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=70))
    rows = [(k, f"own{k} words{k} {passage if k % 3 == 0 else 'none'} tail{k} " + " ".join(f"{k}w{j}" for j in range(60))) for k in range(40)]
    rows += [(100, passage), (101, passage[: 2 * 50 - 1]), (102, passage[: 2 * 49 - 1])]
    got = result(substrings.judge(make(rows)))
    assert got == brute(rows, 50)
    assert {r[0]: r[2] for r in got} == {k: 70 if k % 3 == 0 and k else 0 for k in range(40)} | {100: 70, 101: 50, 102: 0}


def test_odd_rows(odd, none, make):
    assert result(substrings.judge(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()], 50)
    assert substrings.judge(none).count() == 0 and substrings.cleaned(none).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = make([(1, text), (2, f"head {text} end"), (3, None)], extra=True)
    out = substrings.cleaned(rows)
    assert out.columns == rows.columns
    assert sorted((r.doc_id, r.text, r.lang, r.size) for r in out.collect()) == [(1, text, "en", "x"), (2, "head end", "en", "x"), (3, "", "en", "x")]


def test_nodes_are_equal_where_words_are():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 3, 400)
    for depth in (1, 2, 3, 6, 7, 50):
        got = substrings.nodes(words, depth)
        want = [tuple(words[k : k + depth]) for k in range(len(words) - depth + 1)]
        assert len(got) == len(want) and len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))
    hashes = draw.integers(0, 1 << 63, 3).astype(np.uint64)[words]
    for n in (1, 5, 20, 31):
        got, want = substrings.gram_hashes(hashes, n), [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))
    values = draw.integers(0, 1000, 90)
    assert all(substrings._least(values, w).tolist() == [values[k : k + w].min() for k in range(91 - w)] for w in (1, 2, 5, 8, 31))


def test_bitmap_holds_its_keys(spark):
    rows = spark.range(3000).selectExpr("xxhash64(id) as k")
    bits, size = common.bitmap(rows, "k")
    keys = np.array([r.k for r in rows.collect()])
    assert substrings._bits(np.frombuffer(bits, np.uint8), size, keys).all() and len(bits) == size // 8
    others = np.array([r.k for r in spark.range(5000, 9000).selectExpr("xxhash64(id) as k").collect()])
    assert substrings._bits(np.frombuffer(bits, np.uint8), size, others).mean() < 0.01
    assert sum(common.bitmap(rows.limit(0), "k")[0]) == 0
