import hashlib
import itertools
import os
import random
import re
from collections import defaultdict

import pytest

from scorelake.llm import dedup, ngram_join
from scorelake.llm.common import components, id_filter, probably_in


SF = "/root/testdata/sf0.01"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def groups_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[norm(r.text)].append(r.doc_id)
    return out


def weak(text):
    """A digest with many collisions."""
    return hashlib.sha256(text).digest()[:1]


@pytest.mark.parametrize(("digest", "memtable"), [(dedup.sha256, {}), (dedup.sha256, {"rows": 7}), (weak, {"rows": 50}), (weak, {"size": 200})])
def test_exact_groups_against_a_dictionary(make, digest, memtable):
    draw = random.Random(2)
    texts = [f"text  {draw.randint(0, 60)}\n{draw.choice(['', ' '])}end" for _ in range(300)]
    docs = make([*enumerate(texts)], parts=5)
    found = {r.doc_id: r for r in dedup.exact_groups(docs, digest, buckets=4, **memtable).collect()}
    assert len(found) == 300
    for text, ids in groups_of(docs.collect()).items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids)) and bytes(r.digest) == digest(text.encode())


def test_exact_groups_of_odd_rows(odd, none):
    rows = dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {(r.keep_id, r.group_size) for i in (1, 6, 9) for r in by[i]} == {(1, 4)} and by[1][0].kept and not any(r.kept for r in by[6])
    # null and empty texts are equal; a row without doc_id yields
    assert (by[2][0].keep_id, by[2][0].group_size, by[2][0].kept, by[3][0].kept) == (2, 3, True, False)
    assert sum(r.kept for r in rows) == len(groups_of(odd.collect()))
    assert dedup.exact_groups(none).count() == 0


def test_repeated_ids_with_other_texts(make):
    for rows in ([(5, "X"), (5, "Y"), (9, "X"), (7, "Y")], [(5, "Y"), (5, "X"), (7, "Y"), (9, "X")]):
        for memtable in ({}, {"rows": 1}):
            got = sorted(tuple(r)[:4] for r in dedup.exact_groups(make(rows, parts=4), **memtable).collect())
            assert got == [(5, 5, 2, True), (5, 5, 2, True), (7, 5, 2, False), (9, 5, 2, False)]
    # the copy goes, the other text with its id stays
    out = dedup.exact_dedup(make([(1, "A"), (6, "A"), (6, "B"), (6, "B")], parts=4))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "A"), (6, "B")]


def test_compaction_in_tiers_and_a_hot_digest(make, monkeypatch):
    monkeypatch.setattr(dedup, "COMPARED", 4)
    rows = [(k, "hot text" if k % 3 else f"text {k % 40}") for k in range(200)] + [(None, "hot text"), (None, "lost"), (None, "lost")]
    docs = make(rows, parts=6)
    segments = dedup.runs(docs, 2, dedup.sha256, rows=3).where("bucket is not null").cache()
    merged = dedup.compacted(segments, fan_in=4).collect()
    assert segments.select("run").distinct().count() > 60 and sorted(r.bucket for r in merged) == [0, 1]
    want = groups_of(docs.collect())
    assert sum(r.n for r in merged) == len(want)
    found = dedup.exact_groups(docs, buckets=2, fan_in=4, rows=3).collect()
    size = {norm(t): len(ids) for t, ids in want.items()}
    texts = {hashlib.sha256(t.encode()).digest(): t for t in size}
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(want)
    for r in found:
        ids = want[texts[bytes(r.digest)]]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(odd, make, none):
    out = dedup.exact_dedup(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 5, 7, 8, 10, 11]
    twice = make([(1, "same"), (1, "same"), (2, "other")])
    assert sorted(r.doc_id for r in dedup.exact_dedup(twice).collect()) == [1, 2]
    assert dedup.exact_dedup(none).count() == 0


def test_filters_have_no_false_negatives():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = dedup.bloom(keys[:2500])
    assert dedup.may_hold(f, keys[:2500]).all() and dedup.may_hold(f, keys[2500:]).mean() < 0.05


def test_id_filter(spark):
    ids, all_ = spark.range(0, 5000, 7), spark.range(5000)
    got = {r.id for r in probably_in(all_, "id", id_filter(ids, "id")).collect()}
    assert {*range(0, 5000, 7)} <= got and len(got) < 900
    assert probably_in(all_, "id", id_filter(ids.limit(0), "id")).count() == 0


@pytest.mark.parametrize("hot", [5, 10**6])
def test_components_against_union_find(spark, monkeypatch, hot):
    from scorelake.llm import common

    monkeypatch.setattr(common, "HOT", hot)
    draw = random.Random(5)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect()}
    assert got == {x: find(x) for x in linked}


# --- near duplicates ----------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    links, root = dict.fromkeys(docs, 0), {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in docs}


def near_copies(seed, bases, copies, words):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3000)]
    docs, shared = {}, " ".join(draw.choices(vocabulary, k=20))
    for _ in range(bases):
        base = draw.choices(vocabulary, k=words)
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.randint(0, words // 30)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            docs[len(docs)] = " ".join(text) + (" " + shared if draw.random() < 0.3 else "")
    return docs


def test_join_against_all_pairs(make):
    docs = near_copies(3, 25, 8, 120)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(make([*docs.items()])).collect()}
    assert got == brute(docs)


def test_chunks_of_a_large_group_lose_no_link(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEET_ROWS", 9)
    monkeypatch.setattr(ngram_join, "VERIFY_ROWS", 7)
    docs = near_copies(4, 2, 45, 100)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(make([*docs.items()])).collect()}
    assert got == brute(docs)


def test_join_of_odd_rows(odd, none):
    rows = ngram_join.similar(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.class_id, r.copy_id, r.n_links))
    assert by[1] == by[6] == by[9] == {(1, 1, 3)}
    for i in (2, 3, 4, 5, 7, 8, 10, 11):
        assert by[i] == {(i, i, 0)}
    assert by[None] == {(None, None, 0)}
    assert ngram_join.similar(none).count() == 0
    kept = ngram_join.near_dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 8, 10, 11]


def test_prefixes_are_shortened_to_the_recall():
    import numpy as np

    # texts in 24 trees: one alone, one in a crowd of 40 in some trees, one in crowds of thousands in all
    sizes = np.array([[1, 1, 1, 1, 1]] * 24 + [[40, 30, 20, 9, 5]] * 14 + [[300, 200, 90, 60, 50]] * 10 + [[9000, 8000, 7000, 5000, 3000]] * 12 + [[3000, 2000, 900, 600, 30]] * 12)
    starts = np.array([0, 24, 48])
    k, limit = ngram_join.shortened(sizes, starts, 24, 8, 4, 0.8, 0.9999)
    assert set(k[:24]) == {4} and limit[0] == ngram_join.CROWD
    assert set(k[24:38]) == {4} and set(k[38:48]) == {7} and limit[1] == ngram_join.CROWD
    assert limit[2] == 7000 and set(k[48:60]) == {6} and set(k[60:]) == {4}
    for a in starts:
        assert 1 - np.prod(1 - 0.8 ** k[a : a + 24]) >= 0.9999
    # with a lower recall the same text keeps longer prefixes
    assert ngram_join.shortened(sizes, starts, 24, 8, 4, 0.8, 0.9)[0][48:].sum() > k[48:].sum()
    with pytest.raises(ValueError):
        ngram_join.shortened(sizes[:2], np.array([0]), 2, 8, 4, 0.1, 0.9999)


def test_sorted_tries_count_what_shares_a_prefix(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_join, "TRIE_ROWS", 100)
    draw = random.Random(8)
    rows = [(k, b"".join(draw.choices([b"ab", b"cd"], weights=[4, 1], k=8 * 3))) for k in range(150)]
    reps = spark.createDataFrame(rows, "rep bigint, signature binary")
    tries = ngram_join.tries(reps, 3, 8, 4).cache()
    assert tries.select("part").distinct().count() > 2
    across = ngram_join._across(tries, 8, 4)
    want = defaultdict(int)
    for _, s in rows:
        for t in range(3):
            for k in range(4, 9):
                want[t, s[16 * t : 16 * t + 2 * k]] += 1
    seen = {(r.rep, r.tree) for r in tries.collect()}
    assert len(seen) == tries.count() and {(i, t) for i, s in rows for t in range(3) if want[t, s[16 * t : 16 * t + 8]] > 1} <= seen
    for r in tries.collect():
        for at, n in enumerate(r.sizes):
            prefix = bytes(r.label)[: 2 * (4 + at)]
            assert across.get((r.tree, prefix), n) == want[r.tree, prefix]
    # texts in the same node share its prefix, and all of a node have the same one
    chosen = ngram_join.prefixes(tries, 3, 8, 4, 0.8, 0.5)
    nodes = ngram_join.nodes(chosen, 8, 4).collect()
    by = defaultdict(set)
    for r in nodes:
        by[r.node].add(r.rep)
    assert all(len(by[r.node]) == r.n for r in nodes) and nodes
    assert np.mean([r.n for r in nodes]) > 2


def test_texts_below_a_node_that_a_crowded_text_needs_come_along(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    docs = near_copies(11, 6, 40, 90)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(make([*docs.items()])).collect()}
    assert got == brute(docs)


def test_repeated_ids_with_other_texts_keep_their_links(make):
    docs = near_copies(12, 3, 1, 80)
    a, b, c = docs[0], docs[1], docs[2]
    rows = make([(1, a), (1, b), (1, b), (2, b + " tail"), (3, a + " end"), (4, c)], parts=4)
    got = sorted((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in ngram_join.similar(rows).collect())
    assert got == [(1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 2, 2), (3, 1, 3, 1), (4, 4, 4, 0)]
    kept = sorted((r.doc_id, r.text) for r in ngram_join.near_dedup(rows).collect())
    assert kept == sorted([(1, a), (1, b), (4, c)])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_recall_on_driver_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").where(F.col("text").isNotNull()).collect()}
    want = brute({i: t for i, t in texts.items() if shingles(t)})
    links, found = sum(n for _, n in want.values()), sum(min(n, got[i][1]) for i, (_, n) in want.items())
    assert links > 50 and found >= 0.99 * links
    assert all(got[i][1] <= n for i, (_, n) in want.items())
    assert sum(got[i] == w for i, w in want.items()) >= 0.99 * len(want)
