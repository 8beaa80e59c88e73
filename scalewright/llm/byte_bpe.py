"""Byte-level BPE by merge replay over a corpus, and its inverse."""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bare, bound_batches, column_at, trimmed

#: Words kept with their ids in a worker; beyond, the memory starts anew.
CACHED_WORDS = 150_000
#: Characters of text whose new words are merged together.
BLOCK_CHARS = 4_000_000
#: White space other than space and newline.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class MergeReplay:
    """Applies every merge of a vocabulary, in rank order, to many words at once.

    The words' tokens lie in one array. An inverted index leads from a rank to the
    positions of the token pairs whose joint bytes have that rank. Ranks are taken from
    a heap, lowest first. Of a rank's positions, the first in every word is merged, all
    words at once, and only the pairs with its left and right neighbours are looked up
    anew; the word's other positions go back to the index. So each word's merges come
    in the order in which that word alone would take them, even where a merge gives a
    pair of lower rank.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if self.single.min() < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.width = max(ranks.values()) + 1
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank_of = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], -1)
        self.ranks = ranks

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of token pairs, and their ranks or -1; a negative token is no token."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -1)
        at = np.searchsorted(self.keys, key)
        return key, np.where(self.keys[at] == key, self.rank_of[at], -1)

    def __call__(self, words: Iterable[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        words = list(words)
        known = self.ranks.get
        done = [None if (r := known(w)) is None else r.to_bytes(4, "little") for w in words]
        todo = [i for i, d in enumerate(done) if d is None]
        if not todo:
            return done  # type: ignore[return-value]
        sizes = np.array([len(words[i]) for i in todo])
        # Before, between and behind the words stands a -2.
        owner = np.repeat(np.arange(len(todo), dtype=np.int32), sizes)
        spot = np.arange(1, len(owner) + 1, dtype=np.int32) + owner
        n = len(owner) + len(todo) + 1
        token = np.full(n, -2, dtype=np.int32)
        token[spot] = self.single[np.frombuffer(b"".join(words[i] for i in todo), dtype=np.uint8)]
        word = np.full(n, -1, dtype=np.int32)
        word[spot] = owner
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: defaultdict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        heap: list[int] = []

        def add(key: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
            if not len(rank):
                return
            if len(rank) > 1:
                order = np.argsort(rank, kind="stable")
                key, rank, at = key[order], rank[order], at[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                bounds = [0, *cuts.tolist(), len(rank)]
            else:
                bounds = [0, 1]
            for a, b, r in zip(bounds, bounds[1:], rank[np.array(bounds[:-1])].tolist(), strict=False):
                if r not in index:
                    heappush(heap, r)
                index[r].append((at[a:b], key[a:b]))

        key, rank = self.look(token[:-1], token[1:])
        at = np.flatnonzero(rank >= 0).astype(np.int32)
        add(key[at], rank[at], at)
        while heap:
            rank_now = heappop(heap)
            found = index.pop(rank_now)
            at, key = found[0] if len(found) == 1 else (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            if len(at) > 1:
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
            follow = after[at]
            good = (token[at].astype(np.int64) * self.width + token[follow] == key) & (token[at] >= 0) & (token[follow] >= 0)
            if len(at) > 1:
                good[1:] &= at[1:] != at[:-1]
            if not good.all():
                at, key, follow = at[good], key[good], follow[good]
                if not len(at):
                    continue
            if len(at) > 1:
                own = word[at]
                first = np.append(True, own[1:] != own[:-1])
                if not first.all():
                    rest = ~first
                    heappush(heap, rank_now)
                    index[rank_now].append((at[rest], key[rest]))
                    at, follow = at[first], follow[first]
            token[at], token[follow] = rank_now, -1
            far = after[follow]
            after[at], before[far] = far, at
            near = before[at]
            both = np.concatenate([at, near])
            key, rank = self.look(np.concatenate([token[at], token[near]]), np.concatenate([token[far], token[at]]))
            fresh = rank >= 0
            add(key[fresh], rank[fresh], both[fresh])
        left = np.flatnonzero(token >= 0)
        counts = np.bincount(word[left], minlength=len(todo))
        ids = token[left].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        begin = 0
        for i, end in zip(todo, ends, strict=True):
            done[i] = ids[begin:end]
            begin = end
        return done  # type: ignore[return-value]


class Encoder:
    """Ids of texts: each match of the pattern is a word, each new word goes through MergeReplay once.

    A stretch between single spaces, with the space before it, is matched by itself
    (no match then reaches over its ends) and remembered with its ids. Texts where white
    space stands beside a space, or is of a rarer kind, are matched as a whole.
    """

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex

        self.replay = MergeReplay(read_ranks(ranks))
        self.find = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def learn(self, matches: list[list[str]]) -> None:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        new = list({w for found in matches for w in found if w not in self.words})
        self.words.update(zip(new, self.replay([w.encode() for w in new]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = ["  " in t or "\n " in t or " \n" in t or bool(_OTHER_SPACE(t)) for t in texts]
        if len(self.chunks) > CACHED_WORDS:
            self.chunks.clear()
        chunks = self.chunks
        heads, coded, missing, new = [], [], [], {}
        for n, (t, w) in enumerate(zip(texts, whole, strict=True)):
            head, *parts = [t] if w else t.split(" ")
            heads.append(self.find(head))
            ids = list(map(chunks.get, parts))
            coded.append(ids)
            if None in ids:
                gaps = [(i, c) for i, c in enumerate(parts) if ids[i] is None]
                missing.append((n, gaps))
                new.update(dict.fromkeys(c for _, c in gaps))
        keys = list(new)
        matches = [self.find(f" {c}") for c in keys]
        self.learn(matches + heads)
        get = self.words.__getitem__
        for c, found in zip(keys, matches, strict=True):
            chunks[c] = b"".join(map(get, found))
        for n, gaps in missing:
            for i, c in gaps:
                coded[n][i] = chunks[c]
        return [b"".join([*map(get, found), *ids]) for found, ids in zip(heads, coded, strict=True)]


@cache
def _encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


@cache
def _pieces(ranks: bytes) -> list[bytes]:
    by_rank = {rank: token for token, rank in read_ranks(ranks).items()}
    return [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of neighbouring rows, with BLOCK_CHARS characters or one text more."""
    ids: list = []
    texts: list[str] = []
    total = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text or "")
            total += len(texts[-1])
            if total >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def _file(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the size of one vocabulary file


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every whole text.

    A task replays the merges over the distinct words of a block of its documents and
    remembers words for later blocks; no rows are shuffled, since a word's ids do not
    depend on other words. A null text counts as empty and has no ids; a null id stays
    null; repeated rows are encoded each; other columns are ignored; an empty table
    gives no rows. Pieces of special tokens in a text are ordinary text.
    """
    bound_batches(docs.sparkSession)
    ranks = _file(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(ranks.value, pattern)
        for docs_ids, texts in _gathered(batches):
            ids = coder(texts)
            for a in range(0, len(ids), BATCH_ROWS):
                part = ids[a : a + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(docs_ids[a : a + BATCH_ROWS], pa.int64()), pa.array([len(x) // 4 for x in part], pa.int64()), pa.array(part, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; null ids give null, an unknown id fails.

    A column of the new one's name, in any case, is replaced; an empty table gives no rows.
    """
    bound_batches(encoded.sparkSession)
    ranks = _file(encoded.sparkSession, ranks_path)
    given = encoded.columns
    encoded = bare(encoded)[0]
    kept = [f"_in{k}" for k, c in enumerate(given) if c.lower() != out_col.lower()]
    at, names = kept.index(column_at(given, ids_col)), [given[int(c[3:])] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _pieces(ranks.value).__getitem__
        for batch in batches:
            texts = [None if x is None else b"".join(map(piece, np.frombuffer(x, dtype="<u4").tolist())) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*kept, "_out"])

    schema = encoded.select(*kept).schema.add("_out", "binary")
    return encoded.select(*kept).mapInArrow(trimmed(run), schema).toDF(*names, out_col)
