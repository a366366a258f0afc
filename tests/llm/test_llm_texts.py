"""The numpy helpers, without Spark."""

import brute
import numpy as np
import pyarrow as pa
import pytest
import regex
from conftest import TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st

from cleargrain.llm import bpe, covertree, minhash, toxicity
from cleargrain.llm.digest import Digests, likeness
from cleargrain.llm.texts import Rolling, blocks, shingles, text_bytes

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Vocabulary(ranks), plain


def _encoded(vocabulary, texts):
    split = regex.compile(public_tokenizers.PATTERN)
    numbers: dict[str, int] = {}
    rows = [[numbers.setdefault(w, len(numbers)) for w in split.findall(t)] for t in texts]
    ids, bounds = vocabulary.encode_words([w.encode() for w in numbers])
    return [[i for w in row for i in ids[bounds[w] : bounds[w + 1]].tolist()] for row in rows]


def test_replay_equals_the_reference_encoder(vocabulary):
    own, plain = vocabulary
    texts = [t or "" for _, t, *_ in TEXTS] + ["aaaa" * 900, "abab" * 700, "\n\n\n  x", "<|endoftext|>", "eatnris" * 500]
    for text, ids in zip(texts, _encoded(own, texts), strict=True):
        assert ids == plain.encode_ordinary(text)
        assert own.decode(np.array(ids, np.int64)).tobytes() == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_replay_on_any_text(vocabulary, texts):
    own, plain = vocabulary
    assert _encoded(own, texts) == [plain.encode_ordinary(t) for t in texts]


def test_replay_hands_over_words_where_order_matters():
    """Ranks in which a later merge makes a pair of lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 258, b"abca": 259, b"ca": 260}
    own = bpe.Vocabulary(ranks)
    plain = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    words = ["abc", "abca", "ababc", "cabab", "abcabc", "bcabca", "aabbcc"]
    ids, bounds = own.encode_words([w.encode() for w in words])
    for k, word in enumerate(words):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode_ordinary(word) == own.one_word(word.encode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\x0bé", max_size=30), max_size=6))
def test_shingles(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    assert [len(s) for s in shingles(data, offsets, 3)] == [len(brute.shingle_set(t, 3)) for t in texts]


def test_equal_strings_have_equal_prints_anywhere():
    data = np.frombuffer(b"xabcabcyabc", np.uint8)
    prints = Rolling(data).windows(3)
    assert prints[1] == prints[4] == prints[8] and len(set(prints.tolist())) == 7


def test_blocks_cover_all_rows():
    offsets = np.array([0, 5, 5, 400, 401, 900])
    for limit in (1, 6, 500, 10_000):
        ranges = list(blocks(offsets, limit, rows=2))
        assert [r for a, b in ranges for r in range(a, b)] == list(range(5))


def test_pruning_bounds():
    for similarity in (0.8, 0.85):
        bands = minhash.bands_needed(similarity)
        assert (1 - similarity**minhash.ROWS) ** bands <= minhash.MISS
        floors = [minhash.least_matches(similarity, n) for n in (20, 60, 120)]
        assert floors == sorted(floors) and floors[-1] < 120 * similarity
    rng = np.random.default_rng(1)
    left = rng.integers(0, 9, (50, 40), dtype=np.uint32)
    kept = minhash.likely(left, np.where(rng.random((50, 40)) < 0.5, left, 99), [(20, 14), (40, 30)])
    assert len(kept) < 50 and list(minhash.likely(left, left, [(20, 14), (40, 30)])) == list(range(50))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 32, 400, dtype=np.uint32) | np.uint32(1)
    base = rng.integers(0, 1 << 63, 5_000, dtype=np.uint64)
    a, b = base[:3_000], base[1_000:4_000]  # 2000 of 4000 in common
    assert abs((minhash.signature(a, seeds) == minhash.signature(b, seeds)).mean() - 0.5) < 0.08


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 12), st.integers(0, 3), st.integers(0, 10**6))
def test_dual_search_is_exact(n, width, spread, seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(-(10**spread), 10**spread + 1, (n, width))
    queries, ids = data[::5], np.arange(n)
    found = covertree.dual_search(queries, ids[::5], data, ids, 4)
    for q, name, rows in zip(queries, ids[::5], found, strict=True):
        every = sorted(((int(q @ d), int(i)) for d, i in zip(data, ids, strict=True) if i != name), key=lambda s: (-s[0], s[1]))
        assert rows == every[:4]


def test_dual_search_prunes_grouped_points_and_takes_huge_numbers():
    rng = np.random.default_rng(3)
    centers = rng.integers(-3_000, 3_000, (12, 8))
    data = np.repeat(centers, 200, axis=0) + rng.integers(-9, 10, (2_400, 8))
    tree = covertree.cover_tree(data.astype(np.float64))
    assert tree.children and sum(len(c.rows) for c in tree.children) == len(data)
    huge = np.array([[1 << 40, 5], [1 << 40, 6], [-(1 << 40), 7]])
    (first, *_) = covertree.dual_search(huge[:1], np.array([0]), huge, np.arange(3), 2)
    assert first == [((1 << 80) + 30, 1), (-(1 << 80) + 35, 2)]


def test_sentences_cover_each_text():
    texts = ["", "One. Two!!! three\nfour", "...", "no end", "", "é. x"]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    hashes, sentence, row, begin, stop = toxicity.sentence_words(data, offsets)
    assert set(row.tolist()) == set(range(len(texts)))
    for k, text in enumerate(texts):
        own = row == k
        joined = b"".join(data[a:b].tobytes() for a, b in zip(begin[own], stop[own], strict=True))
        assert joined == text.encode()
    assert [int((row[sentence] == k).sum()) for k in range(len(texts))] == [0, 4, 0, 2, 0, 2]
    assert int((row == 1).sum()) == 4


def test_digests():
    texts = ["", "a", "b", "some words in a row " * 20, "some words in a row " * 20]
    shown = Digests(*text_bytes(pa.array(texts, pa.string()))).texts()
    assert shown[3] == shown[4] and len({*shown}) == 4 and {len(s) for s in shown} == {262}
    assert likeness(shown[3], shown[4]) == 1.0 == likeness(shown[0], shown[0])
    assert 0 <= likeness(shown[0], shown[3]) < 0.5
