"""Packing documents into training sequences by bounded-space online best fit.

Every task tokenises its documents and packs their pieces as they come: a fixed number of sequences is open, a
bitset keyed by free space finds the open one that a piece fills best, and when no more may be open the fullest
closes. Pieces wait in a short look-ahead, whose longest are placed first. The pieces of sequences that are still open
at a task's end are packed once more in the same way over fewer tasks, so that many small tasks don't leave many
half-empty sequences: rows of a few numbers, at most those of the open sequences of a task; no text and no ids.

Defined results: a null or empty text is the end token alone; rows that repeat a ``doc_id`` are packed as separate
documents; only documents longer than a sequence are cut; an empty table gives no sequences; other columns are
ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, lean, materialise, text_or_empty
from .pretokens import Cache, is_plain, json_tokenizer

SEQUENCE_TOKENS = 2048
OPEN_SEQUENCES = 1024
#: Pieces that are placed together, longest first.
LOOK_AHEAD = 8_192
#: Pieces that one task of the second round packs, about.
LEFT_OPEN = 500_000
TOKENIZER = "word_bpe_49k.json"
END = 0
#: Distinct words whose ids a Python worker remembers, half of what it holds at most.
CACHED_WORDS = 700_000
#: Letters whose lower case and normal form no Unicode version disputes, then marks that can't belong to a contraction.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset"))])


class BestFit:
    """Open sequences by free space: bit ``f`` of ``free`` is set while a sequence with ``f`` tokens of room is open."""

    def __init__(self, capacity: int, open_limit: int, first: int = 0):
        self.capacity, self.open_limit, self.next = capacity, open_limit, first
        self.free, self.open = 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, room: int) -> int:
        stack = self.at[room]
        sequence = stack.pop()
        self.open -= 1
        if not stack:
            self.free ^= 1 << room
        return sequence

    def put(self, length: int) -> tuple[int, int, int | None]:
        """(sequence, offset, the sequence that has closed, if one has) for a piece of 1 to ``capacity`` tokens."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            sequence = self._take(room)
        else:
            room, sequence = self.capacity, self.next
            self.next += 1
        offset, left, closed = self.capacity - room, room - length, None
        if not left:
            return sequence, offset, sequence
        if self.open >= self.open_limit:
            fullest = (self.free & -self.free).bit_length() - 1
            if fullest >= left:
                return sequence, offset, sequence  # this one is the fullest
            closed = self._take(fullest)
        self.at[left].append(sequence)
        self.free |= 1 << left
        self.open += 1
        return sequence, offset, closed


class Packer:
    """Rows (their length fourth) placed by best fit; they come out when their sequence closes."""

    def __init__(self, capacity: int, open_limit: int, first: int):
        self.bins = BestFit(capacity, open_limit, first)
        self.waiting: list[tuple] = []
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def add(self, row: tuple) -> None:
        self.waiting.append(row)
        if len(self.waiting) >= LOOK_AHEAD:
            self.place()

    def place(self) -> None:
        for row in sorted(self.waiting, key=lambda r: -r[3]):
            sequence, offset, closed = self.bins.put(row[3])
            self.open.setdefault(sequence, []).append((*row, sequence, offset))
            if closed is not None:
                self.done += self.open.pop(closed)
        self.waiting = []

    def rows(self) -> pa.RecordBatch:
        """The rows of the sequences that have closed since the last call."""
        done, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[] for _ in _ARROW], _ARROW)], schema=_ARROW)

    def rest(self, again: bool) -> pa.RecordBatch:
        """The rows of the open sequences, to be packed ``again`` (without a place) or as they are."""
        self.place()
        self.done += [(*row[:5], None, None) if again else row for held in self.open.values() for row in held]
        return self.rows()


@kept_by_worker
@lru_cache(maxsize=1)
def encoder(name: str):
    """text -> its ids as little-endian unsigned 32-bit integers. White space only separates words for this kind of
    vocabulary, case is dropped and marks are split from letters, so each distinct word of a plain text is encoded
    once. A Python worker keeps what it has encoded for the tasks that follow."""
    tokenizer = json_tokenizer(name)

    def ids(text: str) -> bytes:
        found = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def word(text: str) -> bytes:
        split = _WORD(text)
        if split is None or (letters := split[1].lower()) == text:
            return ids(text)
        return words[letters] + (words[split[2]] if split[2] else b"")

    words = Cache(word, CACHED_WORDS)
    return lambda text: b"".join(map(words.__getitem__, text.split())) if is_plain(text) else ids(text)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = SEQUENCE_TOKENS, open_limit: int = OPEN_SEQUENCES) -> DataFrame:
    """One row per piece: what it holds and where it stands. ``sequence_id`` carries the task's number in its high bits,
    and is below 0 for sequences of the second round."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer), END.to_bytes(4, "little")
        packer = Packer(capacity, open_limit, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    packer.add((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield packer.rows()
        yield packer.rest(again=True)

    def packed_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, open_limit, -((TaskContext.get().partitionId() + 1) << 40))
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:5])):
                packer.add(row)
            yield packer.rows()
        yield packer.rest(again=False)

    # Written once: a task that runs again could place its pieces in another order.
    rows = materialise(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(lean(packed, keeps=True), _SCHEMA), "packed")
    open_ = rows.filter("sequence_id IS NULL")
    parts = max(1, -(-open_.count() // LEFT_OPEN))
    again = materialise(open_.repartition(parts, "doc_id", "piece").mapInArrow(lean(packed_again, keeps=True), _SCHEMA), "packed-again")
    return rows.filter("sequence_id IS NOT NULL").unionByName(again)
