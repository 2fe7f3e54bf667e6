"""Removal of byte strings that an earlier document has: threshold-bounded interval expansion on a BWT.

Every byte that a string of ``LENGTH`` bytes covers is removed if that string also starts in a document with a smaller
doc_id. The strings are dealt to shards by their minimizer (the smallest hash of the ``KMER``-byte pieces inside), so
equal strings always meet; neighbouring strings with one minimizer travel as one segment. Minimizers of only one
document are dropped first. In a shard, distinct segments are joined to texts of bounded size; for each, the
Burrows-Wheeler transform's intervals are extended backwards breadth first, which yields the common prefixes of
neighbouring suffixes by increasing length, and stops at ``LENGTH``: what is still together then is one string. A
string's smallest document goes back to the blocks, where it is smaller than the block's own; they cut their texts,
which are never shuffled.

Equal segments travel once for each block. A minimizer that more than ``HOT`` / 2 blocks share, or ``HOT_STRINGS`` strings
of a block, is dealt out string by string, so neither a passage of a third of all documents nor a long text full of one
header is a large group.

Defined results: a null text is empty; a null doc_id is larger than all others; rows that repeat a doc_id don't remove
each other's strings; a document shorter than ``LENGTH`` loses nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import answers, bucket_count, bucket_of, corpus_totals, cut_blocks, grow, mix, runs, shrink, text_bytes, with_answers
from .common import discard, lean, materialise

LENGTH = 50
#: Bytes of a piece. Pieces of 16 are shared by chance: the more documents, the more segments met strangers.
KMER = 24
#: From this sum (one or two for each block that has it, for one or more documents) a minimizer's strings are dealt one by
#: one, and from so many strings of one block.
HOT = 8_192
HOT_STRINGS = 8_192
#: Shards of segments for each bucket of minimizers: a bucket's are too many for one task's memory.
SHARDS_PER_BUCKET = 2
#: Strings in a segment at most, and symbols in a text whose BWT is built.
SEGMENT_STRINGS = 64
TEXT_SYMBOLS = 300_000
#: Symbols that are compared at once, as one number.
PACKED = 7
_FAR = np.iinfo(np.int64).max
_CHUNK = 1_000_000
_FACTORS = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)
_SENT = "block long, shard long, keys binary, least binary, sizes binary, data binary, items binary"
_FOUND = "block long, shard long, codes binary, ids binary, items binary"
_DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), 0, (1,))


def _piece_hashes(words: np.ndarray, size: int, places: np.ndarray | slice) -> np.ndarray:
    """Hashes of the pieces of ``size`` bytes, 8 at least, from some places on."""
    sums = np.uint64(0)
    for k, at in enumerate((*range(0, size - 8, 8), size - 8)):
        sums = sums + words[at : len(words) - (size - 8 - at)][places] * _FACTORS[k]
    return mix(sums)


def _minimizers(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, strings, minimizer) of all segments; made by chunks of whole documents."""
    done, inner, made = 0, length - KMER + 1, []
    while done < len(ends) - 1:
        last = max(done + 1, int(np.searchsorted(ends, ends[done] + _CHUNK, "right")) - 1)
        part, base = data[ends[done] : ends[last]], int(ends[done])
        n = len(part) - length + 1
        if n > 0:
            least, span = _piece_hashes(_words(part).copy(), KMER, slice(None)), 1
            while span * 2 <= inner:
                least, span = np.minimum(least[:-span], least[span:]), span * 2
            if span < inner:
                least = np.minimum(least[:n], least[inner - span : inner - span + n])
            edge = np.ones(n + 1, bool)  # where another minimizer or document begins
            np.not_equal(least[1:], least[:-1], out=edge[1:n])
            inside = ends[done + 1 : last] - base
            edge[inside[inside <= n]] = True
            cut = np.diff(np.concatenate([[0], inside, [len(part)]])) >= length  # documents with strings
            after = np.maximum(np.concatenate([inside, [len(part)]]) - length + 1, 0)
            edge[after[cut]] = True  # and where a document's strings end
            starts = np.flatnonzero(edge[:n])
            stops = np.append(starts[1:], n)
            doc = np.searchsorted(ends[done : last + 1] - base, starts, "right") - 1
            valid = starts + length <= ends[done + 1 + doc] - base
            starts, stops, doc = starts[valid], stops[valid], doc[valid] + done
            strings = stops - starts
            if (strings > SEGMENT_STRINGS).any():
                cuts = -(-strings // SEGMENT_STRINGS)
                turn = _turns(cuts)
                starts, stops, doc = np.repeat(starts, cuts) + turn * SEGMENT_STRINGS, np.repeat(stops, cuts), np.repeat(doc, cuts)
                strings = np.minimum(SEGMENT_STRINGS, stops - starts)
            made.append((doc, starts + base, strings, mix(least[starts])))  # mixed again: least values are small ones
        done = last
    empty = np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*made))) if made else (empty, empty, empty, np.empty(0, np.uint64))


def _turns(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2... for each of some counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _crowded(key: np.ndarray, start: np.ndarray, strings: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Of some segments' minimizers those that have ``HOT_STRINGS`` strings in distinct segments, told apart by three of
    their pieces."""
    last = start + strings + length - 1 - KMER
    first, middle, final = (_piece_hashes(words, KMER, at) for at in (start, (start + last) // 2, last))
    _, first = np.unique(mix(first + mix(middle + mix(final))) ^ key, return_index=True)
    known, inverse = np.unique(key[first], return_inverse=True)
    return known[np.bincount(inverse, strings[first], len(known)) >= HOT_STRINGS]


def block_units(length: int):
    def units(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """A block's minimizers with 1 or, if more documents have them, 2; ``HOT`` for those with many strings."""
        data, ends = text_bytes(rows)
        doc, start, strings, key = _minimizers(data, ends, length)
        if not len(key):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")  # documents stay in order
        own, at = key[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n = np.where(at[starts] == at[np.append(starts[1:], len(own)) - 1], 1, 2)
        known = own[starts]
        many = np.add.reduceat(strings[order], starts) >= HOT_STRINGS
        if many.any():
            some = np.isin(key, known[many])
            n[np.isin(known, _crowded(key[some], start[some], strings[some], _words(data), length))] = HOT
        return known, n

    return units


def _ids(rows: pa.Table) -> np.ndarray:
    return np.array([_FAR if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)


def _texts(data: np.ndarray | bytes, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Texts that lie end to end, as an Arrow array."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), pa.py_buffer(data)])


def _distinct(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(the number of each text's, distinct texts in the order of their first places)."""
    found = texts.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _sizes(texts: pa.LargeBinaryArray) -> np.ndarray:
    return np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.empty(0, np.int64)


def _symbols(texts: pa.LargeBinaryArray) -> np.ndarray:
    """The bytes of texts, end to end."""
    if not len(texts):
        return np.empty(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _segment_texts(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """``_distinct`` of the texts at some places, which are copied by parts: copies of one text don't add up."""
    numbers, kept, held = [], [], 0
    part = np.cumsum(sizes) // _CHUNK
    for a, b in zip(edges := np.flatnonzero(np.diff(part, prepend=-1)), [*edges[1:], len(part)]):
        n = sizes[a:b]
        number, texts = _distinct(_texts(data[np.repeat(start[a:b], n) + _turns(n)], n))
        numbers.append(number + held)
        kept.append(texts)
        held += len(texts)
    if not kept:
        return np.empty(0, np.int64), pa.array([], pa.large_binary())
    number, texts = _distinct(pa.concat_arrays(kept))
    return number[np.concatenate(numbers)], texts


def _segments(blocks: DataFrame, totals: DataFrame, buckets: int, length: int) -> DataFrame:
    """For every shard a block's distinct segments with their smallest document; for the block itself (a shard of its own,
    below 0) where each segment stands."""

    def make(block: int, rows: pa.Table, found: pa.Table) -> pa.Table:
        data, ends = text_bytes(rows)
        doc, start, strings, key = _minimizers(data, ends, length)
        times = answers(found, HOT)[np.unique(key, return_inverse=True)[1]]
        some = times > 1
        doc, start, strings, key, hot = doc[some], start[some], strings[some], key[some], times[some] >= HOT
        if hot.any():  # string by string
            n = strings[hot]
            at = np.repeat(start[hot], n) + _turns(n)
            own = _piece_hashes(_words(data), length, at)
            doc, start, key = np.concatenate([doc[~hot], np.repeat(doc[hot], n)]), np.concatenate([start[~hot], at]), np.concatenate([key[~hot], mix(own)])
            strings = np.concatenate([strings[~hot], np.ones(len(at), np.int64)])
        number, texts = _segment_texts(data, start, strings + length - 1)
        keys, least = np.empty(len(texts), np.uint64), np.full(len(texts), _FAR)
        keys[number] = key
        np.minimum.at(least, number, _ids(rows)[doc])
        shard = bucket_of(keys, buckets)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # segments are numbered by shard, then in order
        texts, keys, least = texts.take(pa.array(order)), keys[order], least[order]
        sizes, symbols = _sizes(texts), _symbols(texts).tobytes()
        stops = np.concatenate([[0], np.cumsum(sizes)])
        out = {name: [] for name in ("block", "shard", "keys", "least", "sizes", "data", "items")}
        for s, a, b in runs(shard[order]):
            row = block, s, shrink(keys[a:b]), shrink(least[a:b]), shrink(sizes[a:b].astype(np.uint8)), zstandard.compress(symbols[stops[a] : stops[b]], 3), None
            for name, x in zip(out, row):
                out[name].append(x)
        row = block, -1 - block, None, None, None, None, shrink(np.concatenate([doc, start, strings, place[number]]).astype("<u4"))
        for name, x in zip(out, row):
            out[name].append(x)
        kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
        return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds)], list(out))

    return with_answers(blocks, totals, make, _SENT)


def _packed(symbols: np.ndarray, width: int) -> np.ndarray:
    """From each place on ``width`` symbols as one number, zeros after the last."""
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(len(symbols), np.int64)
    for k in range(width):
        key <<= 9
        key |= padded[k : k + len(symbols)]
    return key


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of symbols under 512, by doubling from seven packed ones; only what is still together is
    sorted again. A rank is the first place of those that are together."""
    n, width = len(symbols), PACKED
    key = _packed(symbols, width)
    order, rank, places, suffixes = np.empty(n, np.int64), np.empty(n, np.int64), np.arange(n), np.arange(n)
    while len(places):
        sort = np.argsort(key)
        suffixes, key = suffixes[sort], key[sort]
        order[places] = suffixes
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(starts, append=len(key))
        rank[suffixes] = np.repeat(places[starts], sizes)
        together = np.repeat(sizes > 1, sizes)
        places, suffixes = places[together], suffixes[together]
        ahead = suffixes + width
        key = rank[suffixes] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        width *= 2
    return order, rank


def expand_intervals(symbols: np.ndarray, length: int, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, group of each of its places): suffixes with the same first ``length`` symbols share a group.
    ``room``: how many symbols stand before the next separator. Only suffixes with room for ``length`` then need have the
    right group: what is together beyond a separator is not extended.

    Level by level, an interval of suffixes that begin with some w is extended backwards by each symbol c before it;
    the last-to-first mapping carries the interval's bounds to those of cw. So a bound between neighbours q - 1 and q
    first appears one level after one that lies between their mapped-back places, and that level is their longest
    common prefix. Bounds of level ``length`` and more are not looked for. The first levels are compared at once, packed.
    """
    order, rank = suffix_order(symbols)
    n, packed = len(order), min(PACKED, length)
    bound = np.ones(n, bool)
    first, short = _packed(symbols, packed)[order], order > n - packed
    bound[1:] = (first[1:] != first[:-1]) | short[1:] | short[:-1]
    room = None if room is None else room[order]
    # Where the transform maps back to, from 1; the empty suffix is before all others.
    after = np.concatenate([rank[1:] + 1, [0]])[order] if n else np.empty(0, np.int64)
    open_ = np.flatnonzero(~bound)
    low, high = after[open_ - 1].astype(np.int32), after[open_].astype(np.int32)
    new, last, reach = bound.copy(), np.flatnonzero(bound), np.zeros(n + 1, np.int32)
    for level in range(packed, length):
        if not len(open_):
            break
        if room is not None and level % PACKED == 0:
            inside = room[open_] >= level
            open_, low, high = open_[inside], low[inside], high[inside]
        np.cumsum(new, out=reach[1:])
        hit = reach[high] > reach[low]
        new[last] = False
        last = open_[hit]
        new[last] = bound[last] = True
        open_, low, high = open_[~hit], low[~hit], high[~hit]
    return order, np.cumsum(bound) - 1


def string_minima(texts: pa.LargeBinaryArray, least: np.ndarray, length: int) -> np.ndarray:
    """The smallest document of every string of some segments, end to end."""
    sizes = _sizes(texts)
    stops = np.cumsum(sizes + 1)
    inside = np.ones(stops[-1], bool)
    inside[stops - 1] = False
    whole = np.zeros(stops[-1], np.int64)
    whole[inside] = _symbols(texts)
    whole[inside] += 1
    room = (np.repeat(stops - 1, sizes + 1) - np.arange(len(whole))).astype(np.uint8)
    string = room >= length
    order, group = expand_intervals(whole, length, room)
    value = np.where(string, np.repeat(least, sizes + 1), _FAR)[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    minima = np.empty(len(whole), np.int64)
    minima[order] = np.minimum.reduceat(value, starts)[group]
    return minima[string]


def _batches(key: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Runs of segments with several minimizers, cut only between those, once ``TEXT_SYMBOLS`` are together."""
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    before = np.concatenate([[0], np.cumsum(sizes + 1)])
    done = 0
    for at in begins:
        if before[at] - before[done] >= TEXT_SYMBOLS:
            yield slice(done, at)
            done = at
    if done < len(key):
        yield slice(done, len(key))


def _shard(length: int):
    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One shard: all blocks' segments, those with one minimizer and several texts by BWT."""
        if key[0] < 0:  # a block's places pass
            return rows[["block", "shard", "items"]].assign(codes=None, ids=None)[["block", "shard", "codes", "ids", "items"]]
        keys, least = (np.concatenate([grow(x, kind) for x in rows[name]]) for name, kind in (("keys", "<u8"), ("least", "<i8")))
        sizes = [grow(x, "u1") for x in rows["sizes"]]
        known, texts = _distinct(_texts(b"".join(map(zstandard.decompress, rows["data"])), np.concatenate(sizes)))
        ends = np.cumsum([len(x) for x in sizes])
        low = np.full(len(texts), _FAR)
        np.minimum.at(low, known, least)
        key = np.empty(len(texts), np.uint64)
        key[known] = keys
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        several = order[same | np.concatenate([same[1:], [False]])]
        sizes = _sizes(texts)
        strings = sizes - length + 1
        offset = np.cumsum(strings) - strings
        minima = np.repeat(low, strings)
        for part in _batches(key[several], sizes[several]):
            batch = several[part]
            n = strings[batch]
            minima[np.repeat(offset[batch], n) + _turns(n)] = string_minima(texts.take(pa.array(batch)), low[batch], length)
        codes, ids = [], []
        for a, b in zip([0, *ends], ends):
            own = known[a:b]
            n = strings[own]
            found = minima[np.repeat(offset[own], n) + _turns(n)]
            elsewhere = found < np.repeat(least[a:b], n)
            code = np.zeros(len(found), "<u4")
            distinct_ids, code[elsewhere] = np.unique(found[elsewhere], return_inverse=True)
            code[elsewhere] += 1
            codes.append(shrink(code))
            ids.append(shrink(distinct_ids))
        return pd.DataFrame({"block": rows["block"].to_numpy(), "shard": rows["shard"].to_numpy(), "codes": codes, "ids": ids, "items": None})

    return solve


def _covered(rows: pa.Table, items: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], data_size: int, length: int) -> np.ndarray:
    """Which bytes of a block go. ``found``: (0, or one more than the place among the ids) of each string, and the ids
    of documents of other blocks that have strings before all of this one's documents do."""
    ids = _ids(rows)
    edges = np.zeros(data_size + 1, np.int32)
    segments = items[:, 3].max() + 1 if len(items) else 0
    strings, least = np.zeros(segments, np.int64), np.full(segments, _FAR)
    strings[items[:, 3]] = items[:, 2]
    np.minimum.at(least, items[:, 3], ids[items[:, 0]])
    minima = np.repeat(least, strings)
    done = 0
    for code, other in found:
        elsewhere = np.flatnonzero(code)
        minima[done + elsewhere] = other[code[elsewhere].astype(np.int64) - 1]
        done += len(code)
    offset = np.cumsum(strings) - strings
    for k in range(0, len(items), 100_000):
        doc, start, n, at = items[k : k + 100_000].T
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(start, n) + turn
        gone = place[minima[np.repeat(offset[at], n) + turn] < np.repeat(ids[doc], n)]
        edges[gone] += 1  # a place is in one segment only
        edges[gone + length] -= 1
    return np.cumsum(edges[:-1], dtype=np.int32) > 0


def _cut(docs: DataFrame, make, schema: str | StructType, length: int) -> DataFrame:
    """``make(rows, bytes, ends, which bytes go)`` for every block of ``docs``."""
    blocks = cut_blocks(docs)
    buckets = bucket_count(blocks)
    totals = materialise(corpus_totals(blocks, block_units(length), buckets, HOT), "totals")
    sent = _segments(blocks, totals, buckets * SHARDS_PER_BUCKET, length)
    solved = materialise(sent.groupBy("shard").applyInPandas(lean(_shard(length)), _FOUND), "solved")
    discard(totals)

    def joined(_block: int, rows: pa.Table, right: pa.Table) -> pa.Table:
        own, *others = right.sort_by("shard").to_pylist()
        items = grow(own["items"], "<u4").astype(np.int64).reshape(4, -1).T
        data, ends = text_bytes(rows)
        found = [(grow(r["codes"], "<u4"), grow(r["ids"], "<i8")) for r in others]
        return make(rows, data, ends, _covered(rows, items, found, len(data), length))

    return with_answers(blocks, solved, joined, schema)


def _digest_rows(rows: pa.Table, data: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> pa.Table:
    removed, spans, digests = [], [], []
    for a, b in zip(ends[:-1], ends[1:]):
        part = gone[a:b]
        removed.append(int(part.sum()))
        spans.append(int((part & ~np.concatenate([[False], part[:-1]])).sum()) if removed[-1] else 0)
        digests.append(hashlib.sha256(data[a:b][~part].tobytes()).hexdigest())
    return pa.table([rows.column("doc_id"), pa.array(np.diff(ends)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return _cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _digest_rows, _DIGESTS, length)


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone``, and with each byte the rest of its character."""
    first = (data & 0xC0) != 0x80
    return np.logical_or.reduceat(gone, np.flatnonzero(first))[np.cumsum(first) - 1] if len(data) else gone


def _texts_left(texts: list[str | None], data: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> list[str | None]:
    """What is left of each text, one after another: places of a whole block's characters would be large."""
    left = []
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        part = gone[a:b]
        left.append(data[a:b][~_whole_characters(data[a:b], part)].tobytes().decode() if part.any() else text)
    return left


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs``, all columns, with what is left of each text. A character of which only some bytes go is
    left out whole; documents of which nothing is left go, and a null or empty text stays as it is."""
    names, schema = docs.columns, docs.schema

    def make(rows: pa.Table, data: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> pa.Table:
        texts = _texts_left(rows.column("text").to_pylist(), data, ends, gone)
        left = [bool(t) or a == b for t, a, b in zip(texts, ends[:-1], ends[1:])]
        at = rows.schema.get_field_index("text")
        return rows.set_column(at, "text", pa.array(texts, pa.string())).select(names).filter(pa.array(left, pa.bool_()))

    return _cut(docs, make, schema, length)
