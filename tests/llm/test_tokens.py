"""Token ids against two public libraries, and windows against their invariants."""

from __future__ import annotations

import base64
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import bpe, packing, tokens
from loomtrace.llm.bpe import Encoder, Vocabulary

DIR = tokens.VOCABULARIES
tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def odd_texts(n: int) -> list[str]:
    rng = random.Random(4)
    alphabet = "  \n\t\r ​　'''strevldmA1é中0½Ⅷ٣_-!¿́😀\x1c\x85a bcll"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*texts, "", " ", "a" * 3000, "ab" * 900, " " * 700, "don't'sll 's 're'rex", "<|endoftext|>hi<|endoftext|>", "\n\n\n x", "中文字" * 300]


def ids(encoder: Encoder, texts: list[str | None]) -> list[list[int]]:
    flat, counts = encoder.encode(pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


@pytest.mark.parametrize("part", [1_000_000, 300])
def test_same_as_tokenizers(monkeypatch, part):
    monkeypatch.setattr(bpe, "SLICE", part)
    reference = tokenizers.Tokenizer.from_file(f"{DIR}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = odd_texts(1500)
    assert ids(Encoder(Vocabulary.read(f"{DIR}/byte_bpe_50k.json")), texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_same_as_rank_files(name):
    path = f"{DIR}/{name}.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(400)
    assert ids(Encoder(Vocabulary.read(path)), texts) == [reference.encode_ordinary(t) for t in texts]


def test_words_with_equal_hashes(monkeypatch):
    encoder = Encoder(Vocabulary.read(f"{DIR}/byte_bpe_50k.json"))
    want = ids(encoder, ["one two three one"])
    blunt = Encoder(encoder.v)
    blunt._b = blunt._inverse = np.uint64(0)  # every hash is the same
    assert ids(blunt, ["one two three one"]) == want


def test_encode_rows(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, "a" * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(docs).collect())
    assert got[0] == (1, [31373, 995]) and got[1:4] == [(2, []), (3, []), (3, [])] and len(got) == 5
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()} == {i: len(x) for i, x in got}
    assert tokens.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed,top", [(1, 100), (2, 60), (3, 30)])
def test_pack(seed, top):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, top + 1, 600)
    bins = packing.pack(sizes, 100)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 100 and len(bins) == 600
    start = packing.in_order(sizes, 100)
    assert (fill**2).sum() > (np.bincount(start, sizes) ** 2).sum() and bins.max() < start.max() and np.bincount(start, sizes).max() <= 100


def test_search_empties_bins():
    sizes = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    search = packing.Search(sizes, np.array([0, 1, 1, 0, 2, 2, 2, 3]), 10)
    search.run()
    assert len(np.unique(search.bin_of)) == 3 and np.bincount(search.bin_of, sizes).max() <= 10


@pytest.mark.parametrize("low,high", [(1, 40), (20, 60), (34, 51), (26, 101)])
def test_search_ends_where_no_step_is_left(low, high):
    """At the end no move, swap, two for one or one for two between any two bins would raise the squares."""
    sizes = np.random.default_rng(low).integers(low, high, 60)
    search = packing.Search(sizes, packing.in_order(sizes, 100), 100)
    search.run()
    bins = [[int(i) for i in np.flatnonzero(search.bin_of == b)] for b in np.unique(search.bin_of)]
    if len(bins) == -(-int(sizes.sum()) // 100):
        return
    some = lambda items, most: [c for k in range(most + 1) for c in itertools.combinations(items, k)]
    for a, c in itertools.permutations(bins, 2):
        for out in some(a, 2):
            for back in some(c, 2):
                if (len(out), len(back)) in {(1, 0), (1, 1), (2, 1), (1, 2)}:
                    gain, fa, fc = int(sizes[list(out)].sum() - sizes[list(back)].sum()), int(sizes[a].sum()), int(sizes[c].sum())
                    assert not (gain > 0 and fc + gain <= 100 and (fa - gain) ** 2 + (fc + gain) ** 2 > fa**2 + fc**2)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_long_words_merge_as_short_ones(file, monkeypatch):
    v, rng = Vocabulary.read(f"{DIR}/{file}"), random.Random(6)
    words = [bytes(rng.choice(b"aabcdeothing ") for _ in range(rng.randint(1, 400))) for _ in range(60)] + [b"a" * 301, base64.b64encode(bytes(rng.randrange(256) for _ in range(600)))]
    rounds = bpe.merge_words(words, v)
    monkeypatch.setattr(bpe, "LONG", 50)
    assert [x.tolist() for x in bpe.merge_words(words, v)] == [x.tolist() for x in rounds] == [bpe.merge_long(w, v).tolist() for w in words]


def test_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 2048, 4096, 5000, rng.randrange(1, 2048), rng.randrange(1, 300)])) for i in range(300)] + [(7, 10), (7, 10), (8, 5000), (8, 5000)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("window_id", F.lit("clash"))
    got = packing.fill_windows(sizes).collect()
    by_doc: dict[int, int] = {}
    fill: dict[str, int] = {}
    for r in got:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.n_tokens
        assert (r.window_id is None) == (r.n_tokens == 0) and r.start == r.piece * 2048
        if r.window_id:
            fill[r.window_id] = fill.get(r.window_id, 0) + r.n_tokens
    want: dict[int, int] = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + (n or 0)
    assert by_doc == want and max(fill.values()) <= 2048
    assert len(got) == sum(-(-(n or 0) // 2048) or 1 for _, n in rows)
    report = packing.fill_report(packing.fill_windows(sizes)).first()
    assert report.n_windows == len(fill) <= report.n_windows_before and report.n_tokens == sum(want.values()) and report.largest_fill <= 2048
    assert packing.fill_windows(sizes.limit(0)).count() == 0
