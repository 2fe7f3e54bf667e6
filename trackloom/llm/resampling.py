"""Importance resampling towards a target: hashed word runs, log ratios by bucket, Gumbel noise, the highest scores drawn.

The runs are hashed by a byte automaton over whole Arrow buffers: a table gives each byte its class, differences give the
words' ends, and one table-driven CRC-32 register for every start is advanced a byte at a time, all starts together; the
register after a word goes on over the space and the word after it, so a pair of words costs its second word only. Words over
``STEPS`` bytes are finished by the C routine for the same CRC. Texts are read twice, to count buckets and to score; a
task sends ``buckets`` counts at most. Ranks come from ranges of the scores, so no task sees all rows.

Defined results: a null or empty text has no words, no features and weight 0; a null doc_id is hashed as an empty one and
loses ties; rows that repeat a doc_id are counted and drawn one by one, and where their scores are equal too any of them
comes first; without targets (an empty ``targets``, or no word in it) t and T are 0 and the formulas hold as they are; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import numbered, written
from .blocks import text_bytes
from .words import LOWER, slices, spans

BUCKETS, SEED, LEAST_WORDS, DRAWN_PERCENT = 10_000, 7, 20, 25
#: Bytes of a word over which all registers are advanced together.
STEPS = 64
_START = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def advance(registers: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers, each led over its own ``data[start : start + length]``; the longest words stand first while stepping."""
    order = np.argsort(lengths, kind="stable")[::-1]
    found, at, longest = registers[order], starts[order], lengths[order]
    active = len(order) - np.searchsorted(longest[::-1], np.arange(min(STEPS, longest[0] if len(order) else 0)), "right")
    for step, n in enumerate(active):
        now = found[:n]
        found[:n] = CRC[(now ^ data[at[:n] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for k in range(np.searchsorted(-longest, -STEPS, "left")):
        rest = data[at[k] + STEPS : at[k] + longest[k]].tobytes()
        found[k] = zlib.crc32(rest, int(found[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(found)
    out[order] = found
    return out


def feature_buckets(rows: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of words, rows of words, buckets of pairs, rows of pairs) of the rows' texts."""
    data, ends = text_bytes(rows)
    data = LOWER[data]
    starts, lengths, row = spans(data, ends)
    single = advance(np.full(len(starts), _START), data, starts, lengths)
    paired = np.flatnonzero(row[1:] == row[:-1])
    space = CRC[(single[paired] ^ np.uint32(32)) & np.uint32(255)] ^ (single[paired] >> np.uint32(8))
    double = advance(space, data, starts[paired + 1], lengths[paired + 1])
    return (single ^ _START) % np.uint32(buckets), row, (double ^ _START) % np.uint32(buckets), row[paired]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows in slices(batch):
                single, _, double, _ = feature_buckets(rows, buckets)
                total += np.bincount(single, minlength=buckets) + np.bincount(double, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    return texts.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; ``buckets`` numbers, whatever the tables' size."""
    spark = docs.sparkSession
    own = bucket_counts(docs, buckets).withColumnRenamed("n", "s")
    aim = bucket_counts(targets, buckets).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"])
    counts = both.orderBy("bucket").toPandas()
    n_own, n_aim = int(counts["s"].sum()), int(counts["t"].sum())
    s, t = counts["s"].to_numpy(np.float64), counts["t"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (n_own + buckets) / ((s + 1) * (n_aim + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""

    def sums(gain: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(gain)])
        at = np.searchsorted(row, np.arange(n + 1))
        return total[at[1:]] - total[at[:-1]]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                single, row, double, pair_row = feature_buckets(rows, len(gains))
                n_words = np.bincount(row, minlength=len(rows))
                n = n_words + np.bincount(pair_row, minlength=len(rows))
                total = sums(gains[single], row, len(rows)) + sums(gains[double], pair_row, len(rows))
                columns = [rows.column("doc_id").combine_chunks(), *map(pa.array, (n_words, n, total // np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the document's own hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT) -> DataFrame:
    """Every document's (doc_id, n_features, weight, score, rank); those that are not drawn have no rank."""
    weighed = weights(docs, bucket_gains(docs, targets, buckets))
    scored = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible")), "scored")
    drawn = (scored.filter("eligible").count() * percent) // 100
    placed = numbered(scored, [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    rank = F.when(F.col("eligible") & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


ORACLE = r"""
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
texts AS (SELECT false AS aim, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT true, NULL, coalesce(text, '') FROM benchmark),
split AS (SELECT row_number() OVER () AS k, aim, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
runs AS (SELECT k, aim, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS run FROM split),
kinds AS (SELECT run, hex(run) AS code FROM (SELECT DISTINCT run FROM runs)),
bytes AS (SELECT run, list_transform(range(0, len(code), 2), lambda i: ('0x' || code[i + 1:i + 2])::BIGINT) AS bytes FROM kinds),
hashed AS (SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM bytes, steps),
features AS (SELECT k, aim, bucket FROM runs JOIN hashed USING (run)),
counted AS (SELECT bucket, count(*) FILTER (NOT aim)::DOUBLE AS s, count(*) FILTER (aim)::DOUBLE AS t FROM features GROUP BY bucket),
sizes AS (SELECT count(*) FILTER (NOT aim)::DOUBLE AS ns, count(*) FILTER (aim)::DOUBLE AS nt FROM features),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (ns + 10000) / ((s + 1) * (nt + 10000)))) AS gain FROM counted, sizes),
means AS (SELECT k, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE NOT aim GROUP BY k),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) >= 20 AS eligible,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
    FROM split LEFT JOIN means USING (k) WHERE NOT aim),
placed AS (SELECT *, row_number() OVER (ORDER BY eligible DESC, score DESC, doc_id) AS place, count(*) FILTER (eligible) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * n // 100 THEN place END AS rank FROM placed"""
