"""Blocks of rows, and what blocks ask of the whole corpus.

A block holds the rows of one task up to a number of bytes, compressed, and is written once to the shared folder. The
table is bucketed by ``part`` (up to ``BLOCKS_PER_PART`` blocks of a task, one file), so answers come to the blocks and
texts are never shuffled. An operator that needs corpus-wide facts about the units of its texts (n-grams, shingles, byte strings)
sends each block's *distinct* units to buckets, and gets the answers back by block. A unit that occurs a million
times in a block is sent once, so neither a hot key nor a long text makes a large group; the number of buckets
grows with the data, the size of a block and of a bucket's share does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches_of, buckets_for, lean, materialise_by

#: A block is closed at so many bytes of all its columns.
BLOCK_BYTES = 6_000_000
#: Blocks that a task holds at once, compressed, when answers come back.
BLOCKS_PER_PART = 8
#: Rows that come to ``cut`` in one Arrow batch: ten thousand texts, Spark's number, are held twice by the JVM while it grows the batch.
ROWS_PER_BATCH = 2_000
#: Bytes of text that one bucket of distinct units stands for.
BYTES_PER_BUCKET = 12_000_000
#: Bits of a 64-bit hash that are compared; more only cost space.
HASH_BITS = 52


def pack_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return zstandard.compress(sink.getvalue(), 9)


def unpack_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row: strings as they are, other columns by their mean."""
    sizes = np.zeros(batch.num_rows)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        else:
            sizes += column.nbytes / max(1, batch.num_rows)
    return sizes.astype(np.int64)


def cut_blocks(docs: DataFrame, name: str = "blocks", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(part, block, n_bytes, data): the rows of ``docs`` in blocks, written to the shared folder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def block() -> pa.RecordBatch:
            columns = pa.array([number // BLOCKS_PER_PART], pa.int64()), pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_rows(pa.Table.from_batches(held))], pa.binary())
            return pa.RecordBatch.from_arrays(list(columns), ["part", "block", "n_bytes", "data"])

        for batch in batches:
            start, ends = 0, np.cumsum(_row_bytes(batch))
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
                start = stop
                if size >= block_bytes or start < len(ends):
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    with batches_of(docs.sparkSession, ROWS_PER_BATCH):
        return materialise_by(docs.mapInArrow(lean(cut), "part long, block long, n_bytes long, data binary"), name, "part")


def bucket_count(blocks: DataFrame) -> int:
    return buckets_for(blocks.agg(F.sum("n_bytes")).first()[0], BYTES_PER_BUCKET, least=32)


def text_bytes(rows: pa.Table, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the texts of a block end to end, a null as an empty one."""
    text = pc.fill_null(rows.column(column).cast(pa.large_string()), "").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    if not len(text):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shrink(numbers: np.ndarray, level: int = 1) -> bytes:
    """Numbers by byte plane, compressed: the empty high planes of small numbers take no room."""
    numbers = np.ascontiguousarray(numbers)
    return zstandard.compress(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes(), level)


def grow(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T.tobytes(), kind)


def _cut_hashes(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - HASH_BITS)


def _kind(most: int) -> str:
    return "u1" if most <= 255 else "<u2"


def runs(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values: as many steps as there are runs, whatever the values."""
    begins = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.empty(0, np.int64)
    return zip(numbers[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(numbers)])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket is a range of hashes; for fewer than 2^32 buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ask(block: int, hashes: np.ndarray, weights: np.ndarray, buckets: int, most: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows (block, bucket, hashes, weights) of a block's sorted distinct hashes, for the buckets that it has any of."""
    for bucket, a, b in runs(bucket_of(hashes, buckets)):
        part = _cut_hashes(hashes[a:b])
        yield block, bucket, shrink(np.diff(part, prepend=np.uint64(0))), shrink(np.minimum(weights[a:b], most).astype(_kind(most)))


ASKED = "block long, bucket int, hashes binary, weights binary"


def _total(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def total(rows: pd.DataFrame) -> pd.DataFrame:
        """A bucket's hashes over all blocks: each gets the sum of its weights (``most``: that or more)."""
        parts = [np.cumsum(grow(h, "<u8"), dtype=np.uint64) for h in rows["hashes"]]
        sizes, hashes = [len(p) for p in parts], np.concatenate(parts)
        del parts
        known, inverse = np.unique(hashes, return_inverse=True)
        del hashes
        sums = np.bincount(inverse, np.concatenate([grow(w, _kind(most)) for w in rows["weights"]]), len(known))
        sums, ends = np.minimum(sums, most).astype(_kind(most))[inverse], np.cumsum(sizes)
        totals = [shrink(sums[e - n : e]) for n, e in zip(sizes, ends)]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "totals": totals})

    return total


def corpus_totals(blocks: DataFrame, units: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], buckets: int, most: int = 255) -> DataFrame:
    """(block, bucket, totals): for a block's sorted distinct hashes, as ``units`` gives them with weights (how many
    documents of the block have them), the weights' sums over all blocks, ``most`` at most."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(ask(block, *units(unpack_rows(data.as_py())), buckets, most))
                columns = list(zip(*rows)) or [[]] * 4
                kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "bucket", "hashes", "weights"])

    return blocks.select("block", "data").mapInArrow(lean(asked), ASKED).groupBy("bucket").applyInPandas(lean(_total(most)), "block long, bucket int, totals binary")


def answers(totals: pa.Table, most: int = 255) -> np.ndarray:
    """The totals of one block, in the order of its sorted distinct hashes."""
    by = sorted(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist()))
    return np.concatenate([np.empty(0, _kind(most)), *(grow(t, _kind(most)) for _, t in by)])


def with_answers(blocks: DataFrame, found: DataFrame, make: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """``make(block, rows, what was found for it)`` for every block. ``found`` has a column ``block``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for block, data in zip(left.column("block").to_pylist(), left.column("data")):
            own = right.filter(pc.equal(right.column("block"), block)) if right.num_rows else right
            made.append(make(block, unpack_rows(data.as_py()), own).cast(kinds))
        return pa.concat_tables(made) if made else kinds.empty_table()

    answers = found.withColumn("part", F.expr(f"block div {BLOCKS_PER_PART}"))
    return blocks.select("part", "block", "data").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lean(joined), schema)
