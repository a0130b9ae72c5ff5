"""Token ids of whole texts with the tokenizers library, remembered by word."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that an encoder remembers at most, about 170 bytes each, in two generations.
REMEMBERED = 900_000
#: Bytes of text whose words are told apart together; a longer text goes alone.
CHUNK = 8 << 20
#: Characters that are one piece with their like and part of no contraction.
MARKS = "!#$%&*+,./:;<=>?|"
#: Below it lie Latin letters, which all versions of Unicode agree on.
LATIN = "ɐ"
#: A word's Latin letters and the marks behind them, which are pieces of their own.
PLAIN = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<marks>[" + MARKS + "]*)$"
_PACK = [Struct(f"<{n}I").pack for n in range(64)]


class _Runs(Exception):
    """The text has white space that mustn't be cut, or an added token."""


def _packed(tokens: list) -> bytes:
    ids = [t.id for t in tokens]
    return _PACK[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()


class _Words(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of lead + word."""

    def __init__(self, coder: "Encoder", lead: str):
        super().__init__()
        self.coder, self.lead, self.before, self.most = coder, lead, {}, coder.remembered // 2
        self.sign = coder.space if lead else ""

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if word.isalpha() and (word.isascii() or max(word) < LATIN):
                piece = word if word.isascii() else word.translate(self.coder.bytes)
                ids = _packed(self.coder.model.tokenize(self.sign + piece))
            elif (core := word.rstrip(MARKS)) != word and core.isalpha():
                ids = self[core] + self.coder.piece(word[len(core) :])
            elif not word or word[0].isspace() or word[-1].isspace():
                raise _Runs
            else:
                ids = self.coder.pieces(self.lead + word)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] times, then the same for the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Bytes(dict):
    """A character's bytes in the library's own alphabet."""

    def __init__(self, split):
        super().__init__()
        self.split = split

    def __missing__(self, code: int) -> str:
        self[code] = self.split(chr(code))[0][0]
        return self[code]


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    The library splits a text into pieces and its model merges each piece on its own. No piece
    reaches over a newline or a single space that has characters on both sides, except that the
    space begins the next piece. So texts are cut there, and the library works on each different
    word once. Texts with other white space at a cut, or with one of the file's added tokens anywhere,
    go through the library whole. Equality with the library is tested on texts of random characters.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole, self.remembered = Tokenizer.from_file(path), remembered
        #: Tokens that the file adds to the model's: the library finds them in a text before it makes pieces.
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split, self.model = self.whole.pre_tokenizer.pre_tokenize_str, self.whole.model
        self.piece = lru_cache(100_000)(lambda piece: _packed(self.model.tokenize(piece)))
        self.bytes, self.space = _Bytes(self.split), self.split(" ")[0][0]
        self.first, self.rest = _Words(self, ""), _Words(self, " ")
        self.newline = self.pieces("\n")

    def pieces(self, text: str) -> bytes:
        return b"".join(self.piece(p) for p, _ in self.split(text))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        first, rest = self.first, self.rest.__getitem__
        try:
            if any(t in text for t in self.added):
                raise _Runs
            lines = []
            for line in text.split("\n"):
                head, *words = line.split(" ")
                lines.append(first[head] + b"".join(map(rest, words)))
            return self.newline.join(lines)
        except _Runs:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The same of each text of an Arrow array: a word is looked up once for many texts. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            yield from self._encoded(texts[at:to]) if to > at + 1 else (self.encode(texts[at].as_py()),)
            at = to

    def _word(self, word: str) -> bytes | None:
        """Ids of a word after a space or with a newline in front; None: a text with that word mustn't be cut."""
        try:
            return self.newline + self.first[word[1:]] if word[:1] == "\n" else self.rest[word]
        except _Runs:
            return None

    def _encoded(self, texts: pa.Array) -> Iterator[bytes]:
        lines = pc.replace_substring(pc.binary_join_element_wise("", texts.cast(pa.string()), "\n"), "\n", " \n")
        words = pc.split_pattern(pc.utf8_slice_codeunits(lines, 1), " ")  # the first of each line has the newline in front
        bounds = words.offsets.to_numpy()
        words = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        of, words, bounds = words.indices.to_numpy(), words.dictionary, bounds - bounds[0]
        # each different word is letters and marks, or something else
        plain = pc.extract_regex(words, PLAIN)
        matched = plain.is_valid()
        letters, marks = (pc.struct_field(plain.filter(matched), k).dictionary_encode() for k in ("letters", "marks"))
        other = words.filter(pc.invert(matched))
        known = [self.rest[w] for w in _strings(letters.dictionary)] + [self.piece(m) for m in _strings(marks.dictionary)] + [self._word(w) for w in _strings(other)]
        matched = matched.to_numpy(zero_copy_only=False)
        parts = np.full((len(words), 2), len(known))
        parts[matched] = np.stack([letters.indices.to_numpy(), len(letters.dictionary) + marks.indices.to_numpy()], 1)
        parts[~matched, 0] = np.arange(len(known) - len(other), len(known))
        uncut = np.array([k is None for k in known])[parts[:, 0]]
        known = [k or b"" for k in known] + [b""]
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        for places in (parts, of[:, None]):  # ids of the different words, then of all
            ids = ids[ragged((np.cumsum(sizes) - sizes)[places.ravel()], sizes[places.ravel()])]
            sizes = sizes[places].sum(1)
        cuts = (np.r_[0, np.cumsum(sizes)][bounds] * 4).tolist()
        whole = np.logical_or.reduceat(uncut[of], bounds[:-1])
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        ids = ids.tobytes()
        for k, alone in enumerate(whole.tolist()):
            yield self.encode(texts[k].as_py()) if alone else ids[cuts[k] + len(self.newline) : cuts[k + 1]]


@lru_cache(2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, remembered)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
