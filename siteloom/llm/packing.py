"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

A document is its token ids and one end token. Documents longer than a sequence are cut into whole
sequences and a rest; nothing else is cut. Pieces are dealt into blocks of bounded size, and every
block is packed in its own task: best fit in order of decreasing length, then a local search that
moves one piece, or exchanges one for one or two for one, between underfull sequences whenever that
raises the sum of squared fills, until sequences run empty. A block that already needs no more
sequences than its tokens do is left alone. Blocks cost at most one sequence each.

Null text is an empty document (the end token alone). Rows with equal ids are packed each, equal
lengths in order of their rows. A very long text is cut into as many pieces as it needs. An empty table gives
no rows; columns other than ``doc_id`` and ``text`` are not read and may bear any name."""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.session import cut_lineage

SEQUENCE = 4096
END = 1
#: Pieces packed together in one task.
BLOCK = 20_000
#: Words whose ids a worker remembers.
CACHE = 250_000

# Characters for which Python and the tokenizer fold case and split words alike.
_RARE = re.compile("[^\x00-\x1b\x20-\u024fΑ-Ρα-ωА-я‐-‧€]")


class WordIds:
    """Ids of a text, word by word. The tokenizer never looks across white space, so ids of words
    met before are remembered; texts with rare characters go through it whole."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # The same vocabulary for words already folded and split, joined by blanks.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        # The pattern in the tokenizer's file.
        self.split = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        ).findall
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        for token, number in self.whole.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.parts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        # A word of letters only is one piece.
        split, parts, known = self.split, self.parts, self.known
        if len(parts) + len(words) > CACHE:
            parts.clear()
        whole, mixed, needed = [], [], set()
        for word in words:
            folded = word.lower()
            if folded.isalpha():
                whole.append((word, folded))
                needed.add(folded)
            else:
                own = split(folded)
                mixed.append((word, own))
                needed.update(own)
        new = list(needed.difference(parts))
        if new:
            ids = self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids
            flat = np.array(ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[flat]) + 1
            raw, start = flat.tobytes(), 0
            if len(cuts) != len(new):
                raise ValueError("a word without an end in the vocabulary")
            for piece, cut in zip(new, (cuts * 4).tolist(), strict=True):
                parts[piece] = raw[start:cut]
                start = cut
        for word, folded in whole:
            known[word] = parts[folded]
        for word, own in mixed:
            known[word] = b"".join([parts[p] for p in own])

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        ids_of = self.known.__getitem__
        for text in texts:
            text = text or ""
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            if _RARE.search(text) or any(s in text for s in self.special):
                ids = self.whole.encode(text, add_special_tokens=False).ids
                yield np.array(ids, dtype="<u4").tobytes()
                continue
            words = text.split()
            distinct = set(words)
            missing = distinct.difference(self.known)
            if missing and len(self.known) + len(missing) > CACHE:
                self.known.clear()
                missing = distinct
            if missing:
                self._learn(missing)
            yield b"".join(map(ids_of, words))


_loaded: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row. ``tokenizer``: the
    path of the vocabulary file, on every executor."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordIds(tokenizer))
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, encode(batch.column(1).to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    own = raw[at : at + 4 * size]
                    out.append((doc_id, k, k * size, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    open_at: dict[int, list[int]] = {}  # room -> bins
    rooms: list[int] = []  # ascending
    for i in order:
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        if left:
            if left not in open_at:
                bisect.insort(rooms, left)
                open_at[left] = []
            open_at[left].append(b)
    return bins


class _Partners:
    """What underfull bins would give back, by the most they could take for it: an entry for every
    sum ``t`` of given items of a bin, filed under ``t`` and the room of the bin together. Of every
    such limit the least ``t`` counts, so the best partner of an item is a minimum over all limits
    from its length on."""

    def __init__(self, size: int):
        self.none = size + 1
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
        self.least = np.full(size + 1, self.none, dtype=np.int64)

    def add(self, sums: set[int], room: int, bin_: int, version: int) -> None:
        for t in sums:
            heap = self.heaps[t + room]
            heapq.heappush(heap, (t, bin_, version))
            if t < self.least[t + room]:
                self.least[t + room] = t

    def drop(self, sums: set[int], room: int, versions: list[int]) -> None:
        """Forget entries of versions gone by; those below the top of a heap go when they get there."""
        for t in sums:
            heap = self.heaps[t + room]
            while heap and heap[0][2] != versions[heap[0][1]]:
                heapq.heappop(heap)
            self.least[t + room] = heap[0][0] if heap else self.none

    def best(self, sums: np.ndarray) -> tuple[int, int, int, int]:
        """Most tokens moved by one of ``sums``, that sum, what comes back and from which bin."""
        ahead = np.minimum.accumulate(self.least[::-1])[::-1][sums]
        k = int(np.argmax(sums - ahead))
        s, t = int(sums[k]), int(ahead[k])
        if t >= s:
            return 0, s, t, -1
        return s - t, s, t, self.heaps[s + int(np.argmin(self.least[s:]))][0][1]


def _sums(lengths: list[int]) -> tuple[set[int], set[int]]:
    """Distinct lengths, and distinct sums of two items."""
    counts = Counter(lengths)
    twice = {2 * n for n, c in counts.items() if c > 1}
    return set(counts), twice | {a + b for a, b in itertools.combinations(counts, 2)}


def _with_sum(items: list[int], lengths: list[int], total: int, most: int) -> list[int]:
    """At most ``most`` (0, 1 or 2) of the items that make up ``total``, as few as possible."""
    if total == 0:
        return []
    at: dict[int, int] = {}
    for i in items:
        if lengths[i] == total:
            return [i]
    for i in items if most == 2 else []:
        if (other := at.get(total - lengths[i])) is not None:
            return [other, i]
        at[lengths[i]] = i
    raise ValueError("no such items")


def local_search(bins: list[list[int]], lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Empty bins by moves and exchanges between underfull bins that raise the squared fill.

    In every pass each underfull bin, emptiest first, gives to the bins that are fuller: one item, one
    item for one or two smaller ones, or two items for a smaller one, whichever moves most tokens, until no
    such step is left for it. All bins are partners: they are filed by what they can take, so none has to be
    tried. It ends when the bins are as few as the tokens allow, or after a pass without a step, when
    no pair of bins has one."""
    bins = [list(b) for b in bins]
    fills = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fills) // size)
    used = sum(f > 0 for f in fills)
    versions = [0] * len(bins)
    changed = True
    while changed and used > least:
        changed = False
        for_one, for_two = _Partners(size), _Partners(size)
        filed: dict[int, tuple[set[int], set[int], int]] = {}
        queue: list[tuple[int, int, int]] = []

        def enter(b: int) -> None:
            if not 0 < fills[b] < size:
                return
            ones, twos = _sums([lengths[i] for i in bins[b]])
            room = size - fills[b]
            filed[b] = ones, twos, room
            for_one.add({0} | ones | twos, room, b, versions[b])
            for_two.add(ones, room, b, versions[b])
            heapq.heappush(queue, (fills[b], b, versions[b]))

        def leave(b: int) -> None:
            versions[b] += 1
            ones, twos, room = filed.pop(b)
            for_one.drop({0} | ones | twos, room, versions)
            for_two.drop(ones, room, versions)

        for b in range(len(bins)):
            enter(b)
        while queue and used > least:
            _, a, version = heapq.heappop(queue)
            if version != versions[a]:
                continue
            # Bins still filed are at least as full, so that tokens going there raise the squared fill.
            leave(a)
            while bins[a]:
                ones, twos = _sums([lengths[i] for i in bins[a]])
                step = for_one.best(np.array(sorted(ones)))
                back = 2
                if twos and (other := for_two.best(np.array(sorted(twos))))[0] > step[0]:
                    step, back = other, 1
                moved, s, t, b = step
                if not moved:
                    break
                given = _with_sum(bins[a], lengths, s, 3 - back)
                taken = _with_sum(bins[b], lengths, t, back)
                leave(b)
                bins[a] = [i for i in bins[a] if i not in given] + taken
                bins[b] = [i for i in bins[b] if i not in taken] + given
                fills[a] -= moved
                fills[b] += moved
                enter(b)
                changed = True
            used -= not bins[a]
    return [b for b in bins if b]


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``. The pieces are written out first, so
    that blocks are dealt from fixed rows."""
    salted = pieces(docs, tokenizer, size).withColumn("_order", F.monotonically_increasing_id())
    stored = cut_lineage(salted)
    blocks = max(1, -(-stored.count() // block))
    dealt = stored.withColumn("_block", F.pmod(F.xxhash64("doc_id", "_order"), F.lit(blocks)))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("_order", "ascending")])
        lengths = rows["length"].to_pylist()
        bins = local_search(best_fit(lengths, size), lengths, size)
        sequence = np.empty(len(lengths), dtype=np.int64)
        offset = np.empty(len(lengths), dtype=np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = b, at
                at += lengths[i]
        sequence += key[0].as_py() << 32
        return rows.select(names).append_column("sequence_id", pa.array(sequence)).append_column(
            "offset", pa.array(offset)
        )

    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long"
    )
    return dealt.groupBy("_block").applyInArrow(run, schema)
