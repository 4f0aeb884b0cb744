"""Byte-level BPE: a backtracking encoder and a decoder by offset table.

A text is cut at the vocabulary's special tokens and by its word pattern; every word is encoded by
itself. An Aho-Corasick automaton over the reversed tokens, run once over the reversed word, finds
the longest token that starts at every byte. The encoder takes it if it may follow the token before,
else the next shorter token that is a prefix of it, else it goes back one token. Whether two tokens
may stand side by side is read off a table of pairs: no merge across their border may come before
the merges that consume its two sides. Tokens that all stand well side by side are exactly what
merging by rank gives, and a position that was given up is never tried again, so time is linear in
the length of a word.

The decoder holds the bytes of all tokens in one buffer with an offset per id, and gathers whole
batches from it.

Null text is an empty text, a null list of ids is empty, an empty table gives an empty table.
Ids that are null or not in the vocabulary are skipped by the decoder; bytes that are not UTF-8
become replacement characters. Texts and words of any length are encoded whole; a worker
remembers words met before, up to ``CACHE`` letters of them. Rows are independent: repeated ones
give repeated results, and there are no ties. Columns that bear the name of a new one give way."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Letters of the words whose ids a worker remembers, besides those of the text at hand.
CACHE = 4_000_000
#: Pairs of tokens that a worker remembers.
PAIRS = 1_000_000
# Fixed value: the published word pattern of this kind of vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Beyond these, characters may be unknown to one of two versions of Unicode.
_BEYOND = re.compile("[^\x00-՗]")
_NEVER = 1 << 60


def byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 characters
    stand for themselves, the rest for the letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as byte strings (one Latin-1 character per byte), and what they are merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], byte_of_letter()
        if model["type"] != "BPE" or file.get("normalizer"):
            raise ValueError("not a byte-level BPE vocabulary")
        for added in file["added_tokens"]:
            if added["single_word"] or added["lstrip"] or added["rstrip"]:
                raise ValueError("special tokens that take in what is around them")

        def plain(token: str) -> str:
            return "".join(chr(letters[c]) for c in token)

        self.special = {a["content"]: a["id"] for a in file["added_tokens"]}
        self.ids = {plain(t): i for t, i in model["vocab"].items() if t not in self.special}
        #: Merged token of a pair, and its parts and rank.
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (plain(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, both = self.ids[a], self.ids[b], self.ids[a + b]
            if both in self.parts or max(self.rank.get(left, -1), self.rank.get(right, -1)) >= rank:
                raise ValueError("merges that no training gives")
            self.merged[left, right] = both
            self.parts[both] = (left, right)
            self.rank[both] = rank
        if any(chr(b) not in self.ids for b in range(256)):
            raise ValueError("a byte without a token")


class Encoder:
    """Ids of words by backtracking over longest matches."""

    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary = v = Vocabulary(path)
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for token in v.ids.values():
            self.right[token] = self._edge(token, 1)
            self.left[token] = self._edge(token, 0)
        known = {s: i for s, i in v.ids.items() if self._reachable(i)}
        self.length = {i: len(s) for s, i in known.items()}
        #: The longest other token that a token starts with.
        self.shorter: dict[int, int | None] = {}
        self.longest_of = ahocorasick.Automaton()
        for s, i in known.items():
            self.longest_of.add_word(s[::-1], i)
            self.shorter[i] = next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), None)
        self.longest_of.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of ``token`` while it is built, last first, with the rank of the merge
        that ends each."""
        v, out, until = self.vocabulary, [], _NEVER
        while True:
            out.append((token, until))
            if token not in v.parts:
                return out
            until = v.rank[token]
            token = v.parts[token][side]

    def _crossed(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether a merge across the border of ``a`` and ``b`` comes first. Of equal merges the
        leftmost comes first, so one within ``b`` has to wait for one across."""
        v = self.vocabulary
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                both = v.merged.get((x, y))
                if both is not None:
                    rank = v.rank[both]
                    if rank < min(x_until, before) and rank <= min(y_until, before):
                        return True
        return False

    def _reachable(self, token: int) -> bool:
        """Whether merging the bytes of a token gives that token."""
        v = self.vocabulary
        if token not in v.parts:
            return True
        a, b = v.parts[token]
        return self._reachable(a) and self._reachable(b) and not self._crossed(a, b, v.rank[token])

    def may_follow(self, a: int, b: int) -> bool:
        fine = self.pairs.get((a, b))
        if fine is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            fine = self.pairs[a, b] = not self._crossed(a, b)
        return fine

    def __call__(self, word: bytes) -> list[int]:
        n, length, shorter, may_follow = len(word), self.length, self.shorter, self.may_follow
        longest = [-1] * n
        for last, token in self.longest_of.iter(word.decode("latin-1")[::-1]):
            at = n - 1 - last
            if longest[at] < 0 or length[token] > length[longest[at]]:
                longest[at] = token
        tokens: list[int] = []
        given_up: set[int] = set()
        at = 0
        token = longest[0] if n else None
        while at < n:
            end = at + length[token]
            if end not in given_up and (not tokens or may_follow(tokens[-1], token)):
                tokens.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                given_up.add(at)
                token = tokens.pop()
                at -= length[token]
        return tokens


def gathered(flat: np.ndarray, offsets: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``numbers`` of a ragged table, one after the other, and where each ends."""
    sizes = offsets[numbers + 1] - offsets[numbers]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(offsets[numbers] - (ends - sizes), sizes)
    return flat[index], ends


class TextIds:
    """Ids of whole texts; words met before are remembered."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.encode = Encoder(path)
        special = self.encode.vocabulary.special
        self.special = special
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        self.split = regex.compile(WORDS).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.flat = array("i")
        self.offsets = array("q", [0])

    def _words(self, text: str) -> list[str]:
        if _BEYOND.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            at = [span for _, span in self.library(text)]
            return [text[a:b] for a, b in at]
        return self.split(text)

    def _learn(self, words: set[str]) -> None:
        for word in words:
            self.letters += len(word)
            self.known[word] = len(self.offsets) - 1
            self.flat.extend(self.encode(word.encode()))
            self.offsets.append(len(self.flat))

    def _ids(self, words: list[str]) -> np.ndarray:
        numbers = list(map(self.known.get, words))
        if None in numbers:
            new = {w for w, k in zip(words, numbers, strict=True) if k is None}
            if self.letters > CACHE:
                self._forget()
                new = set(words)
            self._learn(new)
            numbers = list(map(self.known.get, words))
        flat, offsets = np.frombuffer(self.flat, dtype=np.int32), np.frombuffer(self.offsets, dtype=np.int64)
        return gathered(flat, offsets, np.array(numbers, dtype=np.int64))[0]

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        if not self.special or not self.cut.search(text):
            return self._ids(self._words(text))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype=np.int32))
            elif part:
                out.append(self._ids(self._words(part)))
        return np.concatenate(out)


class Decoder:
    """Bytes of ids, gathered from one buffer."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        tokens = {i: s.encode("latin-1") for s, i in vocabulary.ids.items()}
        tokens |= {i: s.encode() for s, i in vocabulary.special.items()}
        self.size = max(tokens) + 1
        own = [tokens.get(i, b"") for i in range(self.size)]
        self.flat = np.frombuffer(b"".join(own), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in own], dtype=np.int64)])

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of several lists of ids, given as one with the end of each."""
        ids = ids.astype(np.int64)
        inside = (ids >= 0) & (ids < self.size)
        left = np.concatenate([[0], np.cumsum(inside)])  # ids left of each place that count
        flat, token_ends = gathered(self.flat, self.offsets, ids[inside])
        places = np.concatenate([[0], token_ends])[left[ends]].tolist()
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip([0, *places], places, strict=False)]


_loaded: dict[tuple[type, str], object] = {}


def _once(make: Callable, path: str):
    return _loaded.get((make, path)) or _loaded.setdefault((make, path), make(path))


def _with(docs: DataFrame, given: str, new: T.StructField, carry: list[str] | None, compute) -> DataFrame:
    kept = [c for c in (docs.columns if carry is None else carry) if c != new.name]
    source = docs.select(*dict.fromkeys([*kept, given]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column(given))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, new.name])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in kept), new]))


def encode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", carry: list[str] | None = None
) -> DataFrame:
    """Rows with the ``ids`` of their ``text``. ``path``: the vocabulary file, on every executor;
    ``carry``: the columns that go on (None: all)."""

    def compute(texts: pa.Array) -> pa.Array:
        encoder = _once(TextIds, path)
        own = [encoder(t) for t in texts.to_pylist()]
        offsets = np.cumsum([0, *map(len, own)], dtype=np.int32)
        flat = np.concatenate([np.empty(0, dtype=np.int32), *own])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return _with(docs, text, T.StructField(ids, T.ArrayType(T.IntegerType())), carry, compute)


def decode(
    docs: DataFrame, path: str, ids: str = "ids", text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Rows with the ``text`` of their ``ids``."""

    def compute(lists: pa.Array) -> pa.Array:
        decoder = _once(Decoder, path)
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array([b.decode("utf-8", "replace") for b in decoder(flat, ends)], pa.string())

    return _with(docs, ids, T.StructField(text, T.StringType()), carry, compute)
