"""Weighted similarity of two normalised names, scored in Arrow batches.

The score is the published weighted fuzzy ratio: 100 * (1 - indel distance / total length) of the
plain strings, of their sorted words and of their word sets, with the alignments against part of
the longer string taking over when the lengths differ by half or more.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these functions inside the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The weights of the score and the length ratios at which they change.
WORD_WEIGHT = 0.95
PART_WEIGHT = 0.9
FAR_PART_WEIGHT = 0.6
PART_FROM = 1.5
FAR_PART_ABOVE = 8.0


def _indel(a: str, b: str) -> int:
    """Insertions plus deletions between two strings, by bit-parallel longest common subsequence."""
    if a == b:
        return 0
    # What both begin and end with is common to them; names of one block mostly share a beginning.
    start, shorter = 0, min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    end, shorter = 0, shorter - start
    while end < shorter and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    marks: dict[str, int] = {}
    for place, ch in enumerate(a):
        marks[ch] = marks.get(ch, 0) | (1 << place)
    open_bits = full = (1 << len(a)) - 1
    for ch in b:
        hit = open_bits & marks.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(b) - len(a) + 2 * open_bits.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return (1.0 - _indel(a, b) / total) * 100 if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against any stretch of the longer one."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_stretch(short, long)
    return best if len(a) != len(b) or best == 100.0 else max(best, _best_stretch(long, short))


def _best_stretch(short: str, long: str) -> float:
    size, best = len(short), 0.0
    for start in range(1 - size, len(long)):
        stretch = long[max(start, 0) : start + size]
        # A stretch of n characters can share at most n, which bounds its ratio.
        if 200.0 * len(stretch) / (size + len(stretch)) > best:
            best = max(best, ratio(short, stretch))
    return best


@lru_cache(maxsize=1 << 14)
def _words(name: str) -> tuple[list[str], frozenset[str]]:
    """Sorted words of a name, which is compared with many others."""
    words = sorted(name.split())
    return words, frozenset(words)


def weighted_ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100."""
    if not a or not b:
        return 0.0
    (words_a, set_a), (words_b, set_b) = _words(a), _words(b)
    if not words_a or not words_b:
        return 0.0
    shared = set_a & set_b
    only_a, only_b = sorted(set_a - shared), sorted(set_b - shared)
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)

    if lengths < PART_FROM:
        if shared and not (only_a and only_b):
            words = 100.0
        else:
            sorted_a, sorted_b = " ".join(words_a), " ".join(words_b)
            same = sorted_a == a and sorted_b == b
            words = max(best if same else ratio(sorted_a, sorted_b), _set_ratio(shared, only_a, only_b))
        return max(best, words * WORD_WEIGHT)

    weight = PART_WEIGHT if lengths <= FAR_PART_ABOVE else FAR_PART_WEIGHT
    best = max(best, partial_ratio(a, b) * weight)
    if shared:
        words = 100.0
    else:
        words = max(
            partial_ratio(" ".join(words_a), " ".join(words_b)),
            partial_ratio(" ".join(only_a), " ".join(only_b)),
        )
    return max(best, words * WORD_WEIGHT * weight)


def _set_ratio(shared: set[str], only_a: list[str], only_b: list[str]) -> float:
    rest_a, rest_b = " ".join(only_a), " ".join(only_b)
    common = len(" ".join(shared))
    gap = 1 if common else 0
    whole_a, whole_b = common + gap + len(rest_a), common + gap + len(rest_b)
    best = 100 - 100 * _indel(rest_a, rest_b) / (whole_a + whole_b)
    if common:
        for whole in (whole_a, whole_b):
            best = max(best, 100 - 100 * (whole - common) / (common + whole))
    return best


def _score_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    """Weighted ratio of each pair of names.

    Declared non-deterministic only so that a filter on the score is not pushed below it, which
    would score every pair twice.
    """
    return F.pandas_udf(_score_batch, T.DoubleType()).asNondeterministic()(left, right)


def edit_similarity(left: Column, right: Column) -> Column:
    """Native 0-100 similarity: one minus edit distance over the longer length."""
    longest = F.greatest(F.char_length(left), F.char_length(right))
    return (1 - F.levenshtein(left, right) / longest) * 100


def word_key(normalized: Column) -> Column:
    """Sorted words of a name, NULL when a word repeats."""
    words = F.split(normalized, " ")
    key = F.array_join(F.array_sort(words), " ")
    return F.when(F.size(F.array_distinct(words)) == F.size(words), key)


def unshared(left: Column, right: Column) -> dict[str, Column]:
    """What :func:`may_reach` needs of two names: the words only one has, sorted, and the length of those both have."""
    a, b = F.split(left, " "), F.split(right, " ")
    return {
        "only_left_": F.array_join(F.array_sort(F.array_except(a, b)), " "),
        "only_right_": F.array_join(F.array_sort(F.array_except(b, a)), " "),
        "common_": F.char_length(F.array_join(F.array_intersect(a, b), " ")),
    }


def may_reach(left: Column, right: Column, left_key: Column, right_key: Column, floor: float, parts: dict[str, Column] | None = None) -> Column:
    """False only for pairs whose weighted ratio is certainly below ``floor``.

    Edit distance never exceeds indel distance, so an edit distance above the indel budget of
    ``floor`` rules a ratio out: of the names, of their sorted words, and of the words they do not
    share, which together with the lengths of the shared ones bound the ratio of word sets. Pairs
    that differ much in length or repeat words have other ways to score and always pass. ``parts`` are
    the columns of :func:`unshared`, if there are such columns already.
    """
    long = F.greatest(F.char_length(left), F.char_length(right))
    short = F.least(F.char_length(left), F.char_length(right))

    def within(a: Column, b: Column, wanted: float) -> Column:
        # An indel distance is odd or even as the sum of the lengths is.
        total = F.char_length(a) + F.char_length(b)
        budget = F.floor((1 - wanted / 100) * total + 1e-6)
        return F.levenshtein(a, b) <= budget - F.pmod(budget + total, F.lit(2))

    rest_a, rest_b, common = (parts or unshared(left, right)).values()
    whole_a, whole_b = (common + F.least(F.char_length(rest), F.lit(1)) + F.char_length(rest) for rest in (rest_a, rest_b))
    wanted = floor / WORD_WEIGHT
    sets = (common > 0) & (
        (rest_a == "")
        | (rest_b == "")
        | (F.levenshtein(rest_a, rest_b) <= (1 - wanted / 100) * (whole_a + whole_b) + 1e-6)
        | (200 * common >= (wanted - 1e-6) * (common + F.least(whole_a, whole_b)))
    )
    # The cheapest tests come first.
    return (
        (long >= short * PART_FROM)
        | within(left, right, floor)
        | sets
        | F.coalesce(within(left_key, right_key, floor / WORD_WEIGHT), F.lit(True))
    )
