"""Byte-level BPE: encoding by replaying the merges over a vocabulary of words, and decoding.

A task turns its texts into numbers of distinct words (matches of the split pattern). The distinct
words are laid out as one array of byte tokens. An inverted index maps each merge to the positions
where its pair stands; merges are applied in rank order, all positions of one merge at once, and a
merge changes only the index entries of the pairs next to it. Work follows distinct words and merges
that occur, not the length of the text; then the ids of each text are gathered from its words.

A pair that appears with a rank below the merge being applied would have gone first in its word
alone. Such words (few or none, depending on the ranks) are encoded again one at a time.

Results for odd input: a null or empty text has no ids; any text, of any length, decodes to its own
UTF-8 bytes; special tokens are ordinary text; rows with equal texts have equal ids; an empty table
gives an empty result; other columns can be carried along.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .texts import documents, small_batches

# A task encodes this much text, or so many distinct words, at a time: about 130 MB of arrays.
TEXT_BYTES = 4 << 20
DISTINCT_WORDS = 100_000
# Tokens turned into ids and bytes at a time.
GATHERED = 1 << 18

_NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks as arrays: the merge of any two tokens, and the bytes of any token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left * self.size + right] = rank
        self.pairs = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[p] for p in self.pairs.tolist()], np.int64)
        by_rank = [b""] * self.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.token_sizes = np.array([len(t) for t in by_rank], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)

    @classmethod
    def shared(cls, parts: dict) -> Vocabulary:
        """One whose arrays came with a broadcast."""
        it = object.__new__(cls)
        it.__dict__.update(parts)
        return it

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.merged[at], _NONE)

    def one_word(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals: what the replay must equal."""
        token = self.bytes_to_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        merges = dict(zip(self.pairs.tolist(), self.merged.tolist(), strict=True)) if len(token) > 1 else {}
        size, end = self.size, len(token)
        heap = [(m, i) for i in range(end - 1) if (m := merges.get(token[i] * size + token[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * end
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else end
            if j >= end or merges.get(token[i] * size + token[j]) != rank:
                continue
            token[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < end:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else end
                if right < end and (m := merges.get(token[left] * size + token[right])) is not None:
                    heapq.heappush(heap, (m, left))
        return [t for t, a in zip(token, alive, strict=True) if a]

    def encode_words(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids start (and the last end)."""
        sizes = np.array([len(w) for w in distinct], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        n = int(starts[-1])
        if not n:
            return np.empty(0, np.int64), np.zeros(len(distinct) + 1, np.int64)
        token = self.bytes_to_id[np.frombuffer(b"".join(distinct), np.uint8)]
        # A spare position at the end stands for "no neighbour".
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts[1:][sizes > 0] - 1] = n
        before[starts[:-1][sizes > 0]] = n
        after[n], before[n] = n, n
        token = np.append(token, 0)
        pair = np.full(n + 1, _NONE)
        inner = np.flatnonzero(after[:n] < n)
        byte_pairs = self.merge_of(np.repeat(self.bytes_to_id, 256), np.tile(self.bytes_to_id, 256))
        by_byte = np.zeros(self.size, np.int64)
        by_byte[self.bytes_to_id] = np.arange(256)
        pair[inner] = byte_pairs[by_byte[token[inner]] * 256 + by_byte[token[inner + 1]]]

        index: dict[int, list[np.ndarray]] = {}

        def enter(ranks: np.ndarray, positions: np.ndarray) -> list[int]:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
            fresh = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ranks)], strict=True):
                rank = int(ranks[a])
                if rank not in index:
                    index[rank] = []
                    fresh.append(rank)
                index[rank].append(positions[a:b])
            return fresh

        found = np.flatnonzero(pair < _NONE)
        heap = enter(pair[found], found) if len(found) else []
        heapq.heapify(heap)
        early: list[np.ndarray] = []
        alive = np.ones(n, bool)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                # Of pairs that share a token, every second one from the left.
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if chained.any():
                    where = np.arange(len(at))
                    at = at[(where - np.maximum.accumulate(np.where(chained, 0, where))) % 2 == 0]
            gone = after[at]
            token[at], pair[gone], alive[gone] = rank, _NONE, False
            beyond = after[gone]
            after[at], before[beyond] = beyond, at
            prior = before[at]
            changed = np.concatenate((at, prior[prior < n]))
            if len(changed) > len(at):
                changed = np.unique(changed)
            following = after[changed]
            new = np.where(following < n, self.merge_of(token[changed], token[following]), _NONE)
            pair[changed] = new
            if (new < rank).any():
                early.append(changed[new < rank])
            some = new < _NONE
            if some.any():
                for fresh in enter(new[some], changed[some]):
                    heapq.heappush(heap, fresh)

        kept = np.flatnonzero(alive)
        ids, bounds = token[kept], np.searchsorted(kept, starts)
        if early:
            again = np.unique(np.searchsorted(starts, np.concatenate(early), "right") - 1)
            own = np.split(ids, bounds[1:-1])
            for k in again.tolist():
                own[k] = np.array(self.one_word(distinct[k]), np.int64)
            ids = np.concatenate(own)
            bounds = np.concatenate(([0], np.cumsum([len(o) for o in own])))
        return ids, bounds

    def decode(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.token_sizes[ids]
        if not len(ids):
            return np.empty(0, np.uint8)
        jump = self.token_starts[ids] - (np.cumsum(sizes) - sizes)
        return self.token_bytes[np.repeat(jump, sizes) + np.arange(int(sizes.sum()))]


def _gathered(flat: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    sizes = bounds[chosen + 1] - bounds[chosen]
    if not len(chosen):
        return flat[:0]
    jump = bounds[chosen] - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(jump, sizes) + np.arange(int(sizes.sum()))]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, keep_ids: bool = False) -> DataFrame:
    """Number and print of each text's ids and of the bytes they decode to; all but ``text`` is carried.

    Adds ``n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids``. The ranks are
    read once, on the driver, and travel as a broadcast of a few megabytes, whatever the data.
    """
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vars(Vocabulary(read_ranks(ranks_path))))
    carried = [c for c in docs.columns if c != "text"]
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text") + added

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = Vocabulary.shared(shared.value), regex.compile(pattern)
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        number = numbers.__getitem__
        texts: list[np.ndarray] = []
        rows: list[pa.RecordBatch] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            flat, bounds = vocabulary.encode_words([w.encode() for w in numbers])
            at = 0
            for batch in rows:
                mine = texts[at : at + batch.num_rows]
                at += batch.num_rows
                counts, id_prints, text_prints, ids = [], [], [], []
                first = 0
                while first < len(mine):
                    last, total = first, 0
                    while last < len(mine) and (last == first or total + len(mine[last]) <= GATHERED):
                        total += len(mine[last])
                        last += 1
                    words = np.concatenate(mine[first:last])
                    own = _gathered(flat, bounds, words)
                    ends = np.cumsum(bounds[words + 1] - bounds[words])
                    cuts = np.cumsum([len(m) for m in mine[first:last]])
                    ends = np.concatenate(([0], ends))[cuts].tolist()
                    decoded = vocabulary.decode(own)
                    byte_ends = np.concatenate(([0], np.cumsum(vocabulary.token_sizes[own])))
                    narrow, a = own.astype("<u4"), 0
                    for b in ends:
                        counts.append(b - a)
                        id_prints.append(hashlib.sha256(narrow[a:b]).hexdigest())
                        text_prints.append(hashlib.sha256(decoded[byte_ends[a] : byte_ends[b]]).hexdigest())
                        if keep_ids:
                            ids.append(narrow[a:b].astype(np.int32))
                        a = b
                    first = last
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in carried]
                    + [pa.array(counts, pa.int64()), pa.array(id_prints, pa.string()), pa.array(text_prints, pa.string())]
                    + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []),
                    names=[*carried, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])],
                )
            numbers.clear()
            texts.clear()
            rows.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                piece = batch.slice(a, 512)
                for text in piece.column("text").to_pylist():
                    text = text or ""
                    held += len(text)
                    if len(text) < 1 << 20:
                        own = np.array(list(map(number, split.findall(text))), np.int32)
                    else:  # no list of all its words
                        own = np.fromiter((number(m.group()) for m in split.finditer(text)), np.int32)
                    texts.append(own)
                rows.append(piece.select(carried))
                if held >= TEXT_BYTES or len(numbers) >= DISTINCT_WORDS:
                    yield from flush()
                    held = 0
        if rows:
            yield from flush()

    return docs.mapInArrow(read, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The bytes that each row's ``ids`` stand for, as ``decoded`` binary; null ids give none."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(Vocabulary(read_ranks(ranks_path))))
    names = encoded.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema) + "decoded binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.shared(shared.value)
        for batch in batches:
            own = [vocabulary.decode(np.array(ids or [], np.int64)).tobytes() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(read, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.PATTERN)
