"""Exact dedup against an index of historical digests.

The digests of a historical batch are grouped, and each shard of them gets a minimal perfect hash whose slots
hold the full digest and the locator of the group's winner. A new batch is grouped by digest first (so a text
with millions of copies is one row), then every group is looked up once: the slot's digest is compared byte for
byte, members join the historical group, and the others stay groups of their own.

Defined results: a null text counts as empty and all empty texts are equal; a null ``doc_id`` never wins over a
known one (a group of nulls alone keeps them); rows that repeat a ``doc_id`` with equal texts share an answer, and in the
stage one of them stays (``group_size`` counts rows); with different texts they are judged apart; an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, lean, materialise, one_row_each, text_or_empty

#: Distinct digests a shard's hash holds, about.
DIGESTS_PER_SHARD = 50_000
_SPACE = r"[\x20\x09-\x0D]+"
_GROUP = "digest binary, n_chars int, winner long, group_size long, holders long"
_ARROW = pa.schema([("digest", pa.binary()), ("n_chars", pa.int32()), ("winner", pa.int64()), ("group_size", pa.int64()), ("holders", pa.int64())])


def digest_of() -> Column:
    """SHA-256 of the text without white space."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(), _SPACE, "").cast("binary"), 256))


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars): ``n_chars`` are the original text's code points."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest"), F.length(text_or_empty()).alias("n_chars"))


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests: bit arrays by level, a rank gives the slot."""

    GAMMA = 1.6
    LEVELS = 48

    def __init__(self, digests: np.ndarray):
        words = digests.view("<u8").reshape(len(digests), 4) if len(digests) else np.empty((0, 4), "<u8")
        left = np.arange(len(digests))
        self.levels: list[np.ndarray] = []
        for level in range(self.LEVELS):
            if not len(left):
                break
            at = self._place(words[left], level, size := max(8, int(len(left) * self.GAMMA)))
            hits = np.bincount(at, minlength=size)
            self.levels.append(hits == 1)
            left = left[hits[at] != 1]
        if len(left):
            raise ValueError("digests must be distinct")
        self.base = np.cumsum([0, *(int(b.sum()) for b in self.levels)])
        self.ranks = [np.cumsum(b) for b in self.levels]

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (words[:, level % 4] ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            x = (x ^ words[:, (level + 1) % 4]) * np.uint64(0xC4CEB9FE1A85EC53)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest; -1, or any slot, for one that is not a member."""
        words = digests.view("<u8").reshape(len(digests), 4)
        out, left = np.full(len(digests), -1), np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            at = self._place(words[left], level, len(bits))
            found = bits[at]
            out[left[found]] = self.base[level] + self.ranks[level][at[found]] - 1
            left = left[~found]
        return out


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 32).copy()


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which are known): whole numbers throughout, as a double has no room for large ones."""
    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()


def _merge(history: pa.Table, batch: pa.Table) -> pa.Table:
    """Groups of one shard: the historical ones, with what the batch adds to them, and the batch's own."""
    history, batch = history.select(_ARROW.names).cast(_ARROW), batch.select(_ARROW.names).cast(_ARROW)
    if not history.num_rows or not batch.num_rows:
        return history if history.num_rows else batch
    known = _bytes(history["digest"])
    index = PerfectHash(known)
    order = np.empty(len(known), np.int64)
    order[index.slots(known)] = np.arange(len(known))  # slot -> locator of digest and winner
    asked = _bytes(batch["digest"])
    slot = index.slots(asked)
    row = order[np.maximum(slot, 0)]
    member = (slot >= 0) & (known[row] == asked).all(axis=1)
    old, new = history.take(pa.array(row[member])), batch.filter(pa.array(member))
    (old_id, old_known), (new_id, new_known) = _ids(old["winner"]), _ids(new["winner"])
    old_chars, new_chars = old["n_chars"].to_numpy(), new["n_chars"].to_numpy()
    lower = new_known & (~old_known | (new_id < old_id))
    newer = (new_chars > old_chars) | ((new_chars == old_chars) & lower)
    winner = pa.array(np.where(newer, new_id, old_id), pa.int64(), mask=~np.where(newer, new_known, old_known))
    held = [np.where(newer, new[c].to_numpy(), old[c].to_numpy()) for c in ("n_chars", "holders")]
    joined = pa.table([old["digest"], pa.array(held[0], pa.int32()), winner, pc.add(old["group_size"], new["group_size"]), pa.array(held[1], pa.int64())], schema=_ARROW)
    rest = np.ones(len(known), bool)
    rest[row[member]] = False
    return pa.concat_tables([joined, history.filter(pa.array(rest)), batch.filter(pa.array(~member))])


def digest_groups(digests: DataFrame) -> DataFrame:
    """One row per digest: the longest text's, then the smallest, doc_id, and how many rows have that id and length."""
    rows = digests.groupBy("digest", "doc_id", "n_chars").agg(F.count("*").alias("rows"))
    # The complement turns the order of all ids around, the smallest one's as well.
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("rank"), "rows")).alias("best")
    groups = rows.groupBy("digest").agg(best, F.sum("rows").alias("group_size"))
    return groups.select("digest", F.col("best.n_chars").alias("n_chars"), F.bitwise_not("best.rank").alias("winner"), "group_size", F.col("best.rows").alias("holders"))


def merge_groups(history: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """Both arguments as ``digest_groups`` gives them. Shards are cut by digest, so they are even."""
    # The new batch's digest is copied (concat): cogroup mixes up columns that both sides have from one relation.
    batch = batch.withColumn("digest", F.concat("digest", F.lit(b"")))
    keyed = [g.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))) for g in (history, batch)]
    grouped = [k.groupBy("shard") for k in keyed]
    return grouped[0].cogroup(grouped[1]).applyInArrow(lean(_merge), _GROUP)


def _groups(docs: DataFrame, history_to: int | None) -> tuple[DataFrame, DataFrame]:
    """(digests of every row, groups)."""
    digests = materialise(text_digests(docs), "digests")
    if history_to is None:
        low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
        history_to = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") <= history_to, F.lit(False))
    shards = buckets_for(digests.count(), DIGESTS_PER_SHARD)
    return digests, merge_groups(digest_groups(digests.filter(old)), digest_groups(digests.filter(~old)), shards)


def exact_dedup(docs: DataFrame, history_to: int | None = None) -> DataFrame:
    """Every row of ``docs`` with its group and whether it stays.

    Rows up to the id ``history_to`` (by default the middle of the ids) are the historical batch, the others the
    new one; the result doesn't depend on where the cut is.
    """
    digests, groups = _groups(docs, history_to)
    found = digests.join(groups.select("digest", "winner", "group_size"), "digest")
    return found.select("doc_id", F.col("winner").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one_each(docs: DataFrame, history_to: int | None = None) -> DataFrame:
    """One row of ``docs``, all columns, for each group: the one that stays, and of several such rows (same id, same
    text but for white space) the longest, then one with the smallest text."""
    groups = _groups(docs, history_to)[1]
    mark = lambda digest, size: F.concat(digest, F.unhex(F.lpad(F.hex(size), 8, "0")))
    keys = groups.select(F.col("winner").alias("doc_id"), mark(F.col("digest"), F.col("n_chars")).alias("mark"), F.col("holders").alias("copies"))
    return one_row_each(docs, mark(digest_of(), F.length(text_or_empty())), keys)


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
