import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorelake.llm import packing, token_files
from scorelake.llm.tokens import Encoder, encoder, vocabulary_path

#: As the library gives it, without any setting.
LIBRARY = Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\r\x0b\x85　\xa0ab.,!'s1é漢_<|>", "<|endoftext|>"]), max_size=14).map("".join) | st.text(max_size=30))
def test_words_give_the_same_ids_as_whole_texts(text):
    assert np.frombuffer(encoder(vocabulary_path()).encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|>a b", "ab<|endoftext|>cd <|endoftext|>", "one\n<|endoftext|>\ntwo", "<|endoftext <|endoftext|", "x <|endoftext|><|endoftext|> y"])
def test_added_tokens_have_the_librarys_ids(text):
    ids = np.frombuffer(encoder(vocabulary_path()).encode(text), "<u4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids and ids.count(50256) == text.count("<|endoftext|>")


def test_words_are_forgotten_beyond_the_bound():
    coder = Encoder(vocabulary_path(), remembered=20)
    for k in range(100):
        text = f"word{k} other{k % 7} same"
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(coder.rest) + len(coder.rest.before) <= 20


def check_packing(rows, docs, plain, capacity):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in docs.items():
        ids, at = plain(text), 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            assert r.length == capacity or k == 0
        assert at == len(ids)
    return len(bins)


def test_pack_against_the_library(make, plain):
    draw = random.Random(4)
    docs = {k: " ".join("".join(draw.choices("abcde", k=draw.randint(1, 9))) for _ in range(draw.choice([1, 5, 40, 300, 900]))) for k in range(120)}
    rows = packing.pack(make([*docs.items()])).collect()
    used = check_packing(rows, docs, plain, 2048)
    assert used <= -(-sum(len(plain(t)) for t in docs.values()) // 2048) + 1


def test_ranks_go_on_over_batches_and_parts(spark, make):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = packing.pack(make([(k, "x " * (k % 3)) for k in range(300)], parts=9), capacity=8).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 300
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 8
    assert len(bins) == -(-sum(r.length for r in rows) // 8)


def test_pack_of_odd_rows(odd, none, plain):
    rows = packing.pack(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 6)}
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()} and sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    for doc, text in texts.items():
        assert sum(r.length for r in rows if r.doc_id == doc) == len(plain(text))
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), min_size=1))
def test_fullest_is_the_best_bin_with_the_longest_length(counts):
    used = packing.fullest(counts, 20)
    assert used[max(counts)] >= 1 and all(used[n] <= counts[n] for n in used) and sum(n * k for n, k in used.items()) <= 20
    reach = {0}
    rest = dict(counts)
    rest[max(counts)] -= 1
    for n, c in rest.items():
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= 20 - max(counts)}
    assert sum(n * k for n, k in used.items()) == max(counts) + max(reach)


def test_plan_is_small_however_large_the_counts():
    few, many = ({n: c * (3000 - n) for n in range(1, 2049)} for c in (1, 10**6))
    a, b = packing.plan(few, 2048), packing.plan(many, 2048)
    assert len(b) < 2 * len(a) < 40_000
    for lines, histogram in ((a, few), (b, many)):
        done = defaultdict(int)
        for n, first, last, uses, _, _ in lines:
            assert first == done[n] and (last - first) % uses == 0
            done[n] = last
        assert done == {n: c for n, c in histogram.items() if c}


# --- token files --------------------------------------------------------------------------


def test_files_against_the_library(odd, make, none, plain):
    for docs in (odd, make([(k, " ".join(["ab cd"] * (k % 7) + ["xyz"])) for k in range(60)])):
        rows = token_files.round_trip(docs, shard_tokens=500).collect()
        want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        rows.sort(key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [d for d, _ in want]
        at = 0
        crcs = defaultdict(list)
        for doc, text in want:
            crcs[doc].append(zlib.crc32(np.array(plain(text), "<u4").tobytes()))
        for r in rows:
            assert r.start == at and r.ids_crc32 in crcs[r.doc_id]
            at += r.n_tokens
        assert sorted(r.ids_crc32 for r in rows) == sorted(c for v in crcs.values() for c in v)
    assert token_files.round_trip(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=40), min_size=1, max_size=8), st.integers(0, 6))
def test_repair_round_trip_and_random_access(docs, rounds):
    parts = [np.array(d, "<u4").tobytes() for d in docs]
    shard = token_files.Shard(token_files.encode_shard([*range(len(docs))], parts, 50257, rounds, 2))
    assert shard.all().tolist() == sum(docs, [])
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d
        for a, b in ((0, len(d)), (len(d) // 3, len(d) // 2 + 1), (len(d) - 1, len(d))):
            assert shard.tokens(k, a, b).tolist() == d[a:b]
    for rule, length in enumerate(shard.lengths):
        assert len(token_files.expand(np.array([50257 + rule], np.uint16), shard.rules, shard.firsts, 50257)) == length


def test_repair_compresses():
    data = token_files.encode_shard([0], [np.array([1, 2, 3, 4] * 5000, "<u4").tobytes()], 50257, 12, 2)
    assert len(data) < 2000
    with pytest.raises(ValueError):
        token_files.Shard(b"\0" * 40)
    with pytest.raises(ValueError):
        token_files.encode_shard([0], [np.array([60000], "<u4").tobytes()], 50257, 2, 2)


def test_written_shards_leave_no_frequent_pair(make, tmp_path):
    draw = random.Random(5)
    passage = " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(300))
    docs = make([(k, f"{k} {passage}") for k in range(40)], parts=1)
    token_files.write_shards(docs, str(tmp_path / "shards"))
    for row in docs.sparkSession.read.parquet(str(tmp_path / "shards")).collect():
        shard = token_files.Shard(row.data)
        left = Counter(p for a, b in zip(shard.symbols, shard.symbols[1:], strict=False) for p in zip(shard.seq[a:b].tolist(), shard.seq[a + 1 : b].tolist(), strict=False))
        assert max(left.values()) < 4 and len(shard.rules) < (1 << 16) - 50257


def test_rows_of_one_id_have_one_order(make):
    rows = [(None if k % 3 else 5, " ".join(["ab", "naïve", "x"][: k % 4]) + f" {k % 17}", "en", "a") for k in range(200)]
    first, again = (sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(make(rows, parts=p), shard_tokens=300).collect()) for p in (2, 7))
    assert first == again and len({r[0] for r in first}) == 200


def test_encode_all_looks_a_word_up_once_for_many_texts():
    coder, asked = Encoder(vocabulary_path()), []

    class Counted(type(coder.rest)):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    coder.rest = Counted(coder, " ")
    assert len(set(coder.encode_all(pa.array(["so talt, talt. talt"] * 500)))) == 1 and asked == ["talt"]


@pytest.mark.parametrize("size", [1, 300, 8 << 20])
def test_encode_all_of_odd_texts(monkeypatch, size):
    """Copies, more texts than a chunk holds, slices, and texts that go through the library whole."""
    texts = ["Ærlig talt, das naïve wort's 12 %!\nwort talt, ünd..", None, "", " wort", "wort ", "a\n\nb", "wort  wort", "a <|endoftext|> b", "漢字 wort,\nпривет!", "\n", "x\ttalt talt"] * 30
    want = [np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr("scorelake.llm.tokens.CHUNK", size)
    for some in (pa.array(texts), pa.array(["cut", *texts])[1:], pa.array(texts, pa.large_string())):
        assert list(Encoder(vocabulary_path()).encode_all(some)) == want
    assert list(encoder(vocabulary_path()).encode_all(pa.array([], pa.string()))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t\r\x0b\x85　\xa0ab.,!'s1é漢_<|>", " mot", "Ærə", "<|endoftext|>"]), max_size=14).map("".join) | st.text(max_size=30), max_size=5))
def test_encode_all_equals_the_library(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(vocabulary_path()).encode_all(pa.array(texts, pa.string()))] == want


@pytest.mark.parametrize("least", [1, 2, 4])
def test_repair_takes_the_most_frequent_pairs(least):
    """Of equal counts the smallest pairs, as many as a round has room for."""
    ids = np.array([1, 2] * 9 + [3, 4] * 5 + [5, 6] * 5 + [7, 8] * 2 + [9], np.uint32)
    last = np.zeros(len(ids), bool)
    last[[17, 27, 37, 41, 42]] = True
    rules, firsts = token_files.repair(ids, last, (1 << 16) - 2, 1, least)[2:]
    assert rules.tolist() == [[1, 2], [2, 1]] and firsts == [0, 2]
    seq, last, rules, firsts = token_files.repair(ids, last, 100, 3, least)
    assert token_files.expand(seq, rules, np.array(firsts), 100).tolist() == ids.tolist()
