"""Byte-level BPE encoding in numpy, many texts at a time.

Method: the text of a batch is one array of code points; token borders before the merges (the split pattern of the public
vocabulary) follow from character classes by array operations; equal words are encoded once; the symbols of many words stand
in one flat array, and in every merge round the rank of all neighbouring pairs is found by binary search over the sorted
pair keys, the lowest-ranked pair of each word is merged wherever it occurs, and words without a pair leave. Very long words
(blobs without a blank) take the same merges from a heap, in time that grows with their length only.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The white space of the split pattern (Unicode White_Space) and its contractions.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")
#: Code points worked on at once.
SLICE = 1_000_000
#: Bytes of a word from which on it is merged by itself.
LONG = 2_000
#: Words kept encoded from one slice to the next.
CACHE_WORDS = 100_000


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of a byte-level BPE: ids of the bytes, sorted pair keys with the pair's rank and merged id, character classes."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    classes: np.ndarray

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """Rank and merged id by pair key, for single words."""
        return {k: (r, i) for k, r, i in zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), self.pair_ids.tolist())}

    @staticmethod
    def read(path: str) -> Vocabulary:
        """From a ``tokenizers`` file (``.json``: vocabulary and ordered merges) or a rank file (``.tiktoken``).

        In a rank file a pair merges if its joined bytes are a token, with that token's rank.
        """
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            byte_ids = np.array([vocab[c] for c in _byte_characters()], np.int64)
            triples = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)]
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
            byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
            triples = [(ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(triples, np.int64)
        keys = (table[:, 0] << 32) | table[:, 1]
        order = np.argsort(keys)
        return Vocabulary(byte_ids, keys[order], table[order, 2], table[order, 3], character_classes())


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in a ``tokenizers`` byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def character_classes() -> np.ndarray:
    """The class of every code point: letter (L*), number (N*), white space, or other."""
    first = {"L": LETTER, "N": NUMBER}
    classes = np.array([first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    classes[list(WHITE_SPACE)] = SPACE
    return classes


def token_starts(codes: np.ndarray, doc_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions where the words of the split pattern start; ``doc_starts`` are the first positions of the (non-empty) texts."""
    n = len(codes)
    kind = classes[codes]
    border = np.empty(n, bool)
    border[0] = True
    np.not_equal(kind[1:], kind[:-1], out=border[1:])
    new_doc = np.zeros(n + 1, bool)
    new_doc[doc_starts] = True
    new_doc[n] = True
    border |= new_doc[:n]
    start = np.flatnonzero(border)
    end = np.append(start[1:], n)
    run = kind[start]
    goes_on = ~new_doc[end]  # the text goes on after the run
    # White space before more text: all but its last character are a word; the last one is a prefix if it is a blank.
    inner = (run == SPACE) & goes_on
    border[end[inner] - 1] = True
    led = inner & (codes[end - 1] == 32)
    border[end[led]] = False
    # Contractions: an apostrophe that starts a word, before letters.
    at = np.flatnonzero((end - start == 1) & (run == OTHER) & goes_on & (codes[start] == 39))
    at = at[border[start[at]]]
    at = at[run[np.minimum(at + 1, len(run) - 1)] == LETTER]
    if len(at):
        p, size = start[at], end[at + 1] - start[at + 1]
        one, two = codes[p + 1], codes[np.minimum(p + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in CONTRACTIONS_1])
        long = ~short & (size >= 2) & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in CONTRACTIONS_2])
        border[p[short | long] + 1] = False
        border[p[short & (size > 1)] + 2] = True
        border[p[long & (size > 2)] + 3] = True
    return np.flatnonzero(border)


def merge_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """The ids of one word (not empty) of any length, in n log n steps: the lowest-rank pair, the leftmost first, from a heap."""
    merges, n = v.merges, len(word)
    symbol: list[int] = v.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [-1] * n  # of the pair that starts here and waits in the heap
    heap = []
    for i in range(n - 1):
        merge = merges.get(symbol[i] << 32 | symbol[i + 1])
        if merge:
            rank[i] = merge[0]
            heap.append((merge[0], i))
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue  # its pair is gone
        j = after[i]
        symbol[i] = merges[symbol[i] << 32 | symbol[j]][1]
        symbol[j], rank[j] = -1, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n:
                merge = merges.get(symbol[a] << 32 | symbol[b])
                rank[a] = merge[0] if merge else -1
                if merge:
                    heapq.heappush(heap, (merge[0], a))
            elif a == i:
                rank[i] = -1
    return np.array([x for x in symbol if x >= 0], np.int64)


def merge_words(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The ids of each word (not empty), merged all together; words of more than ``LONG`` bytes one by one.

    A round passes over all words, and a word takes as many rounds as it merges different pairs: in long words that grows with
    the square of their length, so these go through :func:`merge_long`, with the same result.
    """
    long = [k for k, w in enumerate(words) if len(w) > LONG]
    if long:
        apart = dict(zip(long, (merge_long(words[k], v) for k in long)))
        rest = iter(merge_words([w for w in words if len(w) <= LONG], v))
        return [apart[k] if k in apart else next(rest) for k in range(len(words))]
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
    none = np.iinfo(np.int64).max
    while len(symbol):
        # Rank of each symbol with its right neighbour.
        keys = (symbol[:-1] << 32) | symbol[1:]
        at = np.minimum(np.searchsorted(v.pair_keys, keys), len(v.pair_keys) - 1)
        rank = np.full(len(symbol), none)
        hit = (v.pair_keys[at] == keys) & (word[1:] == word[:-1])
        rank[:-1][hit] = v.pair_ranks[at[hit]]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(symbol)))
        lowest = np.minimum.reduceat(rank, first)
        over = lowest == none
        if over.any():
            for f, s in zip(first[over], size[over]):
                out[word[f]] = symbol[f : f + s]
            stay = np.repeat(~over, size)
            symbol, word, rank, lowest, size = symbol[stay], word[stay], rank[stay], lowest[~over], size[~over]
            if not len(symbol):
                break
            keys = (symbol[:-1] << 32) | symbol[1:]
        chosen = rank == np.repeat(lowest, size)
        left = np.flatnonzero(chosen)
        # In a chain of overlapping equal pairs (aaa) every second one counts, from the left.
        chain = np.concatenate([[True], np.diff(left) != 1])
        place = np.arange(len(left)) - np.maximum.accumulate(np.where(chain, np.arange(len(left)), 0))
        left = left[place % 2 == 0]
        symbol = symbol.copy()
        symbol[left] = v.pair_ids[np.searchsorted(v.pair_keys, keys[left])]
        keep = np.ones(len(symbol), bool)
        keep[left + 1] = False
        symbol, word = symbol[keep], word[keep]
    return out


class Encoder:
    """Encodes Arrow batches of texts; one for each worker, since it keeps common words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}
        b = 0x9E3779B97F4A7C15 | 1
        inverse = pow(b, -1, 1 << 64)
        self._b, self._inverse = np.uint64(b), np.uint64(inverse)
        self._powers = self._back = np.ones(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self._powers) < n + 1:
            with np.errstate(over="ignore"):
                self._powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self._b))])
                self._back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self._inverse))])

    def _same_words(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its text, and for each number a word that has it."""
        n = len(codes)
        self._tables(n)
        with np.errstate(over="ignore"):
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            upto = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self._powers[:n])])
            hashed = (upto[start + size] - upto[start]) * self._back[start]
        number, _ = pd.factorize(hashed)
        example = np.empty(number.max() + 1, np.int64)
        example[number[::-1]] = np.arange(len(number))[::-1]
        # Equal hashes are no proof: compare every character with the example's.
        shift = start[example[number]] - start
        same = (size == size[example[number]]).all() and (codes[np.repeat(shift, size) + np.arange(n)] == codes).all()
        if not same:
            texts = [codes[s : s + k].tobytes() for s, k in zip(start, size)]
            _, example, number = np.unique(np.array(texts, object), return_index=True, return_inverse=True)
        return number, example

    def _ids(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each word has."""
        number, example = self._same_words(codes, start, size)
        texts = [codes[s : s + k].tobytes().decode("utf-32-le") for s, k in zip(start[example], size[example])]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [t for t in texts if t not in self.known]
        if new:
            self.known.update(zip(new, merge_words([t.encode() for t in new], self.v)))
        parts = [self.known[t] for t in texts]
        counts = np.array([len(p) for p in parts])
        flat, first = np.concatenate(parts).astype(np.int32), np.cumsum(counts) - counts
        n_ids = counts[number]
        ends = np.cumsum(n_ids)
        return flat[np.repeat(first[number] - (ends - n_ids), n_ids) + np.arange(ends[-1])], n_ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; empty and null texts have none."""
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out, per_text = [], np.zeros(len(texts), np.int64)
        upto, a = np.cumsum(sizes), 0
        while a < len(texts):
            base = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, base + SLICE, "right")))
            for ids, n_ids in self._slice(texts.slice(a, b - a), sizes[a:b]):
                out.append(ids)
                per_text[a:b] += n_ids
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.int32), per_text

    def _slice(self, texts: pa.Array, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = int(sizes.sum())
        if not n:
            return
        joined = "".join(t for t in texts.to_pylist() if t)
        if len(sizes) > 1 or n <= SLICE:
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            doc = (np.cumsum(sizes) - sizes)[sizes > 0]
            start = token_starts(codes, doc, self.v.classes)
            ids, n_ids = self._ids(codes, start, np.diff(np.append(start, n)))
            of = np.flatnonzero(sizes)[np.searchsorted(doc, start, "right") - 1]
            yield ids, np.bincount(of, n_ids, len(sizes)).astype(np.int64)
            return
        # One very long text, in parts: a change from other characters to white space is a border whatever stands before.
        a = 0
        while a < n:
            codes = np.frombuffer(joined[a : a + SLICE].encode("utf-32-le"), np.uint32)
            while a + len(codes) < n:
                blank = self.v.classes[codes] == SPACE
                cuts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
                if len(cuts):
                    codes = codes[: cuts[-1]]
                    break
                codes = np.frombuffer(joined[a : a + 2 * len(codes)].encode("utf-32-le"), np.uint32)
            start = token_starts(codes, np.zeros(1, np.int64), self.v.classes)
            ids, n_ids = self._ids(codes, start, np.diff(np.append(start, len(codes))))
            yield ids, np.array([n_ids.sum()])
            a += len(codes)
