import hashlib
import random
from collections import Counter

import pytest

from scorelake.llm import alignment
from scorelake.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def byte_chars():
    """The byte-level alphabet, as published with it."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + n)
            n += 1
    return {c: b for b, c in chars.items()}


def brute(sides, rows):
    """Whole texts through both libraries; counts over all rows."""
    a, b = sides
    chars, found = byte_chars(), []
    for doc, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in x]
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = _ends(bytes_a), _ends(bytes_b)
                both, at = sorted(set(ends_a) & set(ends_b)), {}
                for k, end in enumerate(both):
                    at[end] = k
                groups = [([], []) for _ in both]
                for side, ids, ends in ((0, x, ends_a), (1, y, ends_b)):
                    k = 0
                    for i, end in zip(ids, ends, strict=True):
                        groups[k][side].append(i)
                        k += end in at
        found.append((doc, groups))
    counts = Counter()
    for _, groups in found:
        counts.update({(i, j) for p, q in groups for i in p for j in q})
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for doc, groups in found:
        links = [(i, j) for p, q in groups for i in p for j in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), counts, best


def _ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def result(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


TEXTS = [
    "The naïve café isn't here", "a  b", " lead", "tail ", "tail\n", "\n\nx\n\n\ny", "x \n y\n z", "tab\there\r\nthere", "▁ sign", "<|endoftext|> and <s> </s> <0x41> <unk>", "漢字 かな 한국어", "emoji 😀👍🏽 ok", "\x00\x01\x7f", "a b   c　", "ﬁ ½ Å é",
    "1234567 3.14 10,000", "x" * 300, "!!!??? ...", " line\u0085sep ", " ", "\n", "\t", "don't I'll we've", "word\nword\nword", "word \nword", "‌zero​width", "CamelCase snake_case http://a.b/c?d=e&f#g",
]


def test_against_both_libraries(sides, make):
    draw = random.Random(3)
    pieces = [" ", "  ", "\n", "\n\n", "\t", " ", "a", "the", "▁", "'s", "é", "漢", "😀", "12", ".", "\r\n", "<s>", "Ing", "́", "\x00"]
    texts = TEXTS + ["".join(draw.choices(pieces, k=draw.randint(1, 25))) for _ in range(400)] + ["the then there other " * draw.randint(1, 5) for _ in range(20)]
    rows = [*enumerate(texts), (3, TEXTS[0]), (3, TEXTS[0]), (None, TEXTS[1]), (None, None), (900, None), (901, "")]
    want, counts, best = brute(sides, rows)
    assert result(alignment.align(make(rows, extra=True))) == want
    assert sum(bool(r[1]) for r in want) > 200 and any(r[4] != r[5] for r in want)
    pairs = {(r.a, r.b): (r["count"], r.best) for r in alignment.pair_table(make(rows)).collect()}
    assert pairs == {x: (n, n == best[x[0]]) for x, n in counts.items()}


def test_odd_rows_and_chunks(sides, odd, none, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(alignment.align(odd)) == brute(sides, rows)[0]
    assert alignment.align(none).count() == 0


def test_chunks_ask_once_and_add_up(sides):
    """Small chunks, without Spark: what chunks ask for adds up to the counts, and bodies come back whole."""
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choices("one two three fourteen naïve x1 Don't café".split(), k=draw.randint(0, 30)))) for k in range(60)]
    align = alignment.aligner(vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
    _, counts, _ = brute(sides, rows)
    seen = Counter()
    for part in (rows[:7], rows[7:8], rows[8:]):
        chunk = alignment.Chunk(align)
        for r in part:
            chunk.add(*r)
        batch = chunk.batch(5)
        body = alignment._unpacked(batch.column("body")[0].as_py())
        assert body["docs"].tolist() == [r[0] for r in part] and len(body["sizes"]) == len(part)
        asked = set()
        for stripe, pairs, held in list(zip(*(batch.column(c).to_pylist() for c in ("stripe", "pairs", "held")), strict=True))[1:]:
            p = alignment.np.frombuffer(pairs, "<u4").tolist()
            for code, n in zip(p, alignment.np.frombuffer(held, "<u4").tolist(), strict=True):
                pair = (code // align.size_b * align.stripes + stripe, code % align.size_b)
                assert pair not in asked
                asked.add(pair)
                seen[pair] += n
    assert seen == counts
