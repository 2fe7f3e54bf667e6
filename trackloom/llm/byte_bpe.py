"""Byte-level BPE encoding and decoding by a vocabulary of merge ranks.

Distinct pre-tokens are encoded together, end to end with a mark between them, and each one once while a worker
remembers it. Merging takes the pair of lowest rank, leftmost first, from a queue with one bucket per rank: a three-level
bitmap finds the lowest rank that has entries, a bucket holds positions of a linked list of parts, and entries that a
merge made stale are skipped when they come up. n bytes take O(n log n), so a pre-token of megabytes is no special case.

Defined results: a null or empty text has no ids; special tokens' strings are ordinary text; rows that repeat a
``doc_id`` are encoded one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .pretokens import pattern, vocabulary_file

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens whose encoding a Python worker remembers; those that are new in one lot come on top.
CACHED_TOKENS = 400_000
#: Characters of text whose new pre-tokens are encoded together, about.
CHARS_AT_ONCE = 8_000_000
#: Bytes of pre-tokens whose large buckets are taken as arrays; entries of a bucket that isn't large, and how many such
#: buckets end that. They change the speed alone.
SHORT = 64
FEW, FEW_BUCKETS = 40, 60
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class RankQueue:
    """Positions by rank. 64 ranks to a leaf word of the bitmap, 64 leaves to a middle one."""

    def __init__(self, n_ranks: int):
        self.leaf = [0] * ((n_ranks >> 6) + 1)
        self.middle = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def add(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        self.leaf[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank and its bucket."""
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        word = self.middle[m]
        k = (m << 6) + (word & -word).bit_length() - 1
        word = self.leaf[k]
        rank = (k << 6) + (word & -word).bit_length() - 1
        self.leaf[k] ^= 1 << (rank & 63)
        if not self.leaf[k]:
            self.middle[m] ^= 1 << (k & 63)
            if not self.middle[m]:
                self.top ^= 1 << m
        return rank, self.buckets.pop(rank)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.base = max(ranks.values()) + 2
        self.queue = RankQueue(self.base)
        # Two neighbouring ids, as one number: the id that they merge to.
        self.merged: dict[int, int] = {ranks[p[:k]] * self.base + ranks[p[k:]]: rank for p, rank in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}
        self.keys = np.array(sorted(self.merged), np.int64)
        self.values = np.array([self.merged[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)])
        self.first = np.full((256, 256), -1)
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.first[piece[0], piece[1]] = rank

    @classmethod
    def load(cls, name: str) -> ByteBpe:
        with open(vocabulary_file(name), "rb") as lines:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)})

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token."""
        found = [self.ranks.get(piece) for piece in pieces]
        out = [[whole] for whole in found]
        for long_ in (False, True):
            open_ = [k for k, whole in enumerate(found) if whole is None and (len(pieces[k]) > SHORT) == long_]
            for k, ids in zip(open_, self._merge([pieces[k] for k in open_]) if open_ else ()):
                out[k] = ids
        return out

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        data = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        marks = np.cumsum([0, *(len(p) + 1 for p in pieces)])  # a mark before each pre-token, and one at the end
        ids, pairs = self.bytes[data], np.append(self.first[data[:-1], data[1:]], -1)
        ids[marks], pairs[marks], pairs[marks[1:] - 1] = -1, -1, -1
        n = len(data)
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        self._push(at, pairs[at])
        # ids[i]: the part that starts at i; pair[i]: what it and the next one merge to (-1: nothing, or no part starts here).
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        if max(map(len, pieces)) <= SHORT:
            self._merge_frequent(ids, pairs, after, before, np.repeat(np.arange(len(pieces) + 1), np.diff(marks, append=n)))
        ids, pair, after, before = ids.tolist(), pairs.tolist(), after.tolist(), before.tolist()
        queue, base, merged, buckets, add = self.queue, self.base, self.merged.get, self.queue.buckets, self.queue.add
        for rank, parts in buckets.items():
            buckets[rank] = np.concatenate(parts).tolist()
        bucket_of = buckets.get
        while (entry := queue.pop()) is not None:
            rank, positions = entry
            positions.sort()
            row, turn, lower = rank * base, 0, False
            for i in positions:
                turn += 1
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                k, h = after[j], before[i]
                ids[i], pair[j], after[i], before[k] = rank, -1, k, i
                new = pair[i] = merged(row + ids[k], -1)
                if new >= 0:
                    if (bucket := bucket_of(new)) is None:
                        add(new, [i])
                    else:
                        bucket.append(i)
                    lower = new < rank
                new = pair[h] = merged(ids[h] * base + rank, -1)
                if new >= 0:
                    if (bucket := bucket_of(new)) is None:
                        add(new, [h])
                    else:
                        bucket.append(h)
                    lower = lower or new < rank
                if lower:  # a lower rank is due before the rest of this bucket
                    if rest := positions[turn:]:
                        if rank in buckets:
                            buckets[rank] += rest
                        else:
                            add(rank, rest)
                    break
        out, i = [], 1
        for _ in pieces:
            own = []
            while ids[i] >= 0:
                own.append(ids[i])
                i = after[i]
            out.append(own)
            i += 1
        return out

    def _push(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        """Entries in the order of their ranks."""
        starts = np.flatnonzero(np.diff(ranks, prepend=-1)) if len(ranks) else ranks
        for rank, part in zip(ranks[starts].tolist(), np.split(positions, starts[1:])):
            if (bucket := self.queue.buckets.get(rank)) is None:
                self.queue.add(rank, [part])
            else:
                bucket.append(part)

    def _merged(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def _merge_frequent(self, ids: np.ndarray, pair: np.ndarray, after: np.ndarray, before: np.ndarray, owner: np.ndarray) -> None:
        """Takes the queue's buckets as arrays while they are large: of each pre-token the leftmost entry, so that what its
        merge brings about counts before the rest of the bucket, which goes back. ``owner``: the pre-token at each place."""
        queue, small = self.queue, 0
        while small < FEW_BUCKETS and (entry := queue.pop()) is not None:
            rank, parts = entry
            i = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            small += len(i) < FEW
            i = i[pair[i] == rank]  # without stale ones
            leftmost = np.ones(len(i), bool)
            leftmost[1:] = np.diff(owner[i]) > 0
            if not leftmost.all():
                rest = i[~leftmost]
                self._push(rest, np.full(len(rest), rank))
                i = i[leftmost]
            j = after[i]
            k, h = after[j], before[i]
            ids[i], pair[j], after[i], before[k] = rank, -1, k, i
            right, left = self._merged(rank * self.base + ids[k]), self._merged(ids[h] * self.base + rank)
            pair[i], pair[h] = right, left
            places, ranks = np.concatenate([i[right >= 0], h[left >= 0]]), np.concatenate([right[right >= 0], left[left >= 0]])
            order = np.argsort(ranks, kind="stable")
            self._push(places[order], ranks[order])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class _Numbered(dict):
    """Strings and their numbers, in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class TokenCoder:
    """Pre-tokens, each encoded once while it is remembered."""

    def __init__(self, name: str):
        import regex

        self.bpe, self.find = ByteBpe.load(name), regex.compile(pattern()).findall
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbered()
        #: By number: the ids as text, each after a comma, and the decoded bytes.
        self.ids: list[bytes] = []
        self.decoded: list[bytes] = []

    def number(self, text: str) -> list[int]:
        """The numbers of the text's pre-tokens, to be encoded by ``encode``."""
        return list(map(self.numbers.__getitem__, self.find(text)))

    def encode(self) -> None:
        """Encodes the pre-tokens numbered since the last call, together."""
        encoded = self.bpe.encode([token.encode() for token in islice(self.numbers, len(self.ids), None)])
        self.ids += [b",%d" * len(ids) % tuple(ids) for ids in encoded]
        self.decoded += map(self.bpe.decode, encoded)

    def digests(self, numbers: list[int]) -> tuple[int, str, str]:
        """(ids, SHA-256 of the ids, of what they decode to) of a text."""
        ids = b"".join(map(self.ids.__getitem__, numbers))
        decoded = b"".join(map(self.decoded.__getitem__, numbers))
        return ids.count(b","), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=1)
def token_coder(name: str) -> TokenCoder:
    """A Python worker keeps it, with what it remembers, for the tasks that follow."""
    return TokenCoder(name)


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int | None, str]]]:
    """The rows, ``CHARS_AT_ONCE`` at a time."""
    rows = ((doc_id, text.as_py()) for batch in batches for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)))

    def part(first: tuple[int | None, str]) -> Iterator[tuple[int | None, str]]:
        yield first
        size = len(first[1])
        while size < CHARS_AT_ONCE and (row := next(rows, None)) is not None:
            size += len(row[1])
            yield row

    while (first := next(rows, None)) is not None:
        yield part(first)


def encode_decode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_coder(ranks)
        for part in _at_once(batches):
            if len(coder.numbers) >= CACHED_TOKENS:
                coder.clear()
            held = [(doc_id, coder.number(text)) for doc_id, text in part]
            coder.encode()
            columns = zip(*((doc_id, *coder.digests(numbers)) for doc_id, numbers in held))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(digests, _SCHEMA)
