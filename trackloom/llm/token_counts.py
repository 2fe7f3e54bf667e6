"""Token counts of documents without materialising ids.

Every task turns its documents into pre-token frequencies over a block's own vocabulary, and writes both, bucketed by
part of its blocks. The vocabularies are shuffled by pre-token, each distinct pre-token is tokenised once, its number of
pieces goes back to the blocks that hold it, which stay where they are, and a document's count is the sum of frequency
times pieces. A frequent pre-token is one entry for each block, however often it occurs.

Defined results: a null or empty text has no tokens; the strings of special tokens inside a text count as the
library has it by default (one token each); rows that repeat a ``doc_id`` are counted one by one; an empty table
gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import grow, pack_rows, shrink, unpack_rows
from .common import buckets_for, materialise_by, text_or_empty
from .pretokens import Cache, json_tokenizer, pattern, spaced_units

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: A block is closed at so many distinct units or characters, which bounds a task's memory.
BLOCK_UNITS = 250_000
BLOCK_CHARS = 64_000_000
#: Blocks whose frequencies a task holds when counts come back.
BLOCKS_PER_PART = 4
#: Characters of text a bucket of pre-tokens stands for.
CHARS_PER_BUCKET = 8_000_000
_BLOCKS = "part long, block long, data binary, tokens binary"
_ASKED = "block long, bucket int, places binary, tokens binary"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class _Block:
    """Frequencies of the documents since the last flush, over the pre-tokens seen since then."""

    def __init__(self, name: str):
        import regex

        self.find = regex.compile(pattern()).findall
        self.tokenizer = json_tokenizer(name)
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.units = Cache(self._ids, 1 << 62)
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.units.clear()
        self.docs, self.chars = [], 0

    def _number(self, token: str) -> int:
        return self.vocabulary.setdefault(token, len(self.vocabulary))

    def _ids(self, unit: str) -> list[int]:
        return [self._number(t) for t in self.find(unit)]

    def _plain(self, text: str) -> list[int]:
        if (units := spaced_units(text)) is not None:
            return list(chain.from_iterable(map(self.units.__getitem__, units)))
        spans = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)  # the library's own cuts
        return [self._number(text[a:b]) for _, (a, b) in spans]

    def add(self, doc_id: int | None, text: str) -> None:
        ids = self._plain(text) if not any(s in text for s in self.special) else [
            i for k, part in enumerate(self.cut(text)) if part for i in ([self._number(part)] if k % 2 else self._plain(part))
        ]
        token, times = np.unique(np.array(ids, np.uint32), return_counts=True)
        self.docs.append((doc_id, len(text.encode()), np.diff(token, prepend=np.uint32(0)), times.astype(np.uint32)))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or max(len(self.units), len(self.vocabulary)) >= BLOCK_UNITS

    def row(self, block: int) -> pa.RecordBatch:
        known = np.array([d[0] is not None for d in self.docs], np.int64)
        heads = np.array([[d[0] or 0 for d in self.docs], known, [d[1] for d in self.docs], [len(d[2]) for d in self.docs]], "<i8")
        body = np.concatenate([np.empty(0, "<u4"), *(d[2] for d in self.docs), *(d[3] for d in self.docs)]).astype("<u4")
        data = len(self.docs).to_bytes(8, "little") + heads.tobytes() + body.tobytes()
        columns = [block // BLOCKS_PER_PART], [block], [zstandard.compress(data, 3)], [_packed(self.vocabulary)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "data", "tokens"])


def _packed(tokens: Iterable[str]) -> bytes:
    return pack_rows(pa.table({"token": pa.array(tokens, pa.string())}))


def _unpacked(data: bytes) -> list[str]:
    return unpack_rows(data).column("token").to_pylist()


def _tally(data: bytes, counted: list[tuple[bytes, bytes]]) -> pa.Table:
    """The documents of one block: frequencies times the pieces of the block's pre-tokens, which come back by bucket."""
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:8], "little")
    doc_id, known, n_bytes, distinct = np.frombuffer(data, "<i8", 4 * n, 8).reshape(4, n)
    body = np.frombuffer(data, "<u4", offset=8 + 32 * n).astype(np.int64)
    gaps, times = body[: len(body) // 2], body[len(body) // 2 :]
    ends = np.cumsum(distinct)
    running = np.concatenate([[0], np.cumsum(gaps)])
    token = running[1:] - np.repeat(running[ends - distinct], distinct)
    pieces = np.zeros(int(token.max()) + 1 if len(token) else 0, np.int64)
    for places, number in counted:
        pieces[np.cumsum(grow(places, "<u4"))] = grow(number, "<u4")
    sums = np.concatenate([[0], np.cumsum(times * pieces[token])])
    return pa.table([pa.array(doc_id, mask=known == 0), pa.array(n_bytes), pa.array(sums[ends] - sums[ends - distinct])], schema=_COUNTS)


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The blocks' vocabularies by bucket."""
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts: dict[int, tuple[list[str], list[int]]] = {}
            for at, token in enumerate(_unpacked(data.as_py())):
                names, places = parts.setdefault(crc32(token.encode()) % buckets, ([], []))
                names.append(token)
                places.append(at)
            columns = [block] * len(parts), list(parts), [shrink(np.diff(np.array(p, "<u4"), prepend=np.uint32(0))) for _, p in parts.values()], [_packed(t) for t, _ in parts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "bucket", "places", "tokens"])


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the document is over ``limit`` tokens."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    buckets = buckets_for(docs.agg(F.sum(F.length("text"))).first()[0], CHARS_PER_BUCKET)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block(tokenizer)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py())
                if block.full():
                    yield block.row(number)
                    number += 1
                    block.clear()
        if block.docs:
            yield block.row(number)

    def counted(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A bucket's pre-tokens: each distinct one is tokenised once."""
        encode, seen = json_tokenizer(tokenizer), {}
        for tokens in rows["tokens"]:
            seen.update(dict.fromkeys(_unpacked(tokens), 0))
        names = list(seen)
        for k in range(0, len(names), 4096):
            part = names[k : k + 4096]
            seen.update(zip(part, (len(e.ids) for e in encode.encode_batch_fast(part, add_special_tokens=False))))
        pieces = [shrink(np.array([seen[t] for t in _unpacked(tokens)], "<u4")) for tokens in rows["tokens"]]
        return pd.DataFrame({"block": rows["block"], "places": rows["places"], "pieces": pieces})

    def tallied(left: pa.Table, right: pa.Table) -> pa.Table:
        answers: dict[int, list[tuple[bytes, bytes]]] = {}
        for r in right.to_pylist():
            answers.setdefault(r["block"], []).append((r["places"], r["pieces"]))
        parts = [_tally(data.as_py(), answers.get(block, [])) for block, data in zip(left.column("block").to_pylist(), left.column("data"))]
        return pa.concat_tables(parts) if parts else _COUNTS.empty_table()

    # Written once: a recomputed task could cut its blocks elsewhere.
    found = materialise_by(docs.mapInArrow(blocks, _BLOCKS), "pretokens", "part")
    asked = found.select("block", "tokens").mapInArrow(lambda batches: _asked(batches, buckets), _ASKED)
    pieces = asked.groupBy("bucket").applyInPandas(counted, "block long, places binary, pieces binary").withColumn("part", F.expr(f"block div {BLOCKS_PER_PART}"))
    counts = found.select("part", "block", "data").groupBy("part").cogroup(pieces.groupBy("part")).applyInArrow(tallied, "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
