"""Ranked lexical search by TPUT over term-partitioned postings.

Index: texts are cut into segments of bounded size, and a segment's postings are written for each term in chunks of
``CHUNK`` by falling impact, dealt out by term and segment. So a term that every document has is as many rows as there are
segments, and no list stands in one task. A posting is a row number within its segment.

Search, for all items at once: (1) the ``k`` heads of every list give partial scores, the exact scores of the best of
these documents are looked up, and the k-th highest is a lower bound; (2) every list of an item sends its entries over one
threshold, chosen so that a document which no list sends stays below the bound (chunks under it aren't opened); partial
scores may raise the bound, and what cannot reach it even with the most that its unseen lists allow is dropped; (3) exact
scores of what is left are looked up in the lists. All whole numbers, so the result is exact, ties too.

Defined results: a null or empty text has no terms, isn't counted as a document and never ranks; rows that repeat a doc_id
are documents of their own and may both rank, and a null doc_id loses ties; an item without terms, or whose terms no
document has, has no rows; rows that repeat an item_id are ranked one by one; terms in all documents may weigh 0;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import pack_rows, text_bytes, unpack_rows
from .common import broadcast_if, materialise, materialise_by
from .words import IN_WORD, LOWER, slices, spans

TOP = 10
#: Documents among the heads, times ``TOP``, whose exact scores are looked up for the first bound.
LEADERS = 5
#: By how much the threshold is lowered: lists send more, and fewer documents are left whose exact score is looked up.
LOWERED = 4
#: Bytes of text of a segment, and postings of a chunk.
SEGMENT_BYTES, CHUNK = 16_000_000, 1024
#: Into how many groups a list's segments, or an item's documents, are split before their best are compared.
SPREAD = 64
#: Segments whose number fits beside the task's in a whole number.
_PER_TASK = 1 << 24
_SEGMENTS = "segment long, n_docs long, n_terms long, ids array<long>, lengths array<long>, data binary"
_POSTINGS = "term string, segment long, chunk int, n_postings int, max_impact int, rows array<int>, impacts array<int>"


class Index(NamedTuple):
    """Segments with their documents, the asked terms' postings, and the corpus-wide numbers N and L."""

    segments: DataFrame
    postings: DataFrame
    n_docs: int
    n_terms: int


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def term_lists(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """((term, rows, tfs) of each distinct term, terms of each row) of the rows' texts."""
    data, ends = text_bytes(rows)
    data = LOWER[data]
    _, lengths, row = spans(data, ends)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data[IN_WORD[data]].tobytes()))
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tfs = np.unique(code * len(rows) + row, return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(coded.dictionary) + 1) * len(rows))
    lists = [_lists((pairs % max(1, len(rows))).astype(np.int32), starts), _lists(tfs.astype(np.int32), starts)]
    return pa.table([coded.dictionary.cast(pa.string()), *lists], ["term", "rows", "tfs"]), np.bincount(row, minlength=len(rows))


def cut_segments(docs: DataFrame) -> DataFrame:
    """Every document's terms, in segments: written once, texts aren't read again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() * _PER_TASK
        for batch in batches:
            for rows in slices(batch, slice_bytes=SEGMENT_BYTES):
                lists, lengths = term_lists(rows)
                columns = [[segment], [int((lengths > 0).sum())], [int(lengths.sum())], [rows.column("doc_id").to_pylist()], [lengths.tolist()], [pack_rows(lists)]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                names = ["segment", "n_docs", "n_terms", "ids", "lengths", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
                segment += 1

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _SEGMENTS), "segments")


def impacts_of(tfs: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's part of the score by its occurrences and its document's length, before the term's weight."""
    if len(lengths) and 75 * int(lengths.max()) * n_docs >= 2**63:
        lengths = lengths.astype(object)
    m = (100 - 75 + (75 * lengths * n_docs) // max(1, n_terms)).astype(np.int64)
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)


def impact_chunks(lists: pa.Table, lengths: np.ndarray, n_docs: int, n_terms: int, size: int = CHUNK) -> pa.Table:
    """(chunk, n_postings, max_impact, rows, impacts, and the list's number) of a segment, each list by falling impact."""
    rows, tfs = (lists.column(c).combine_chunks() for c in ("rows", "tfs"))
    rows, ends = rows.values.to_numpy(), rows.offsets.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(lists)), np.diff(ends))
    impacts = impacts_of(tfs.values.to_numpy().astype(np.int64), lengths[rows], n_docs, n_terms)
    order = np.lexsort((rows, -impacts, of))
    rows, impacts = rows[order], impacts[order].astype(np.int32)
    per_list = -(-np.diff(ends) // size)
    owner = np.repeat(np.arange(len(lists)), per_list)
    chunk = np.arange(len(owner)) - np.repeat(np.cumsum(per_list) - per_list, per_list)
    starts = ends[owner] + chunk * size
    cuts = np.append(starts, ends[-1:])
    columns = [owner, chunk.astype(np.int32), np.diff(cuts).astype(np.int32), impacts[starts], _lists(rows, cuts), _lists(impacts, cuts)]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["list", "chunk", "n_postings", "max_impact", "rows", "impacts"])


def build(docs: DataFrame, terms: DataFrame | None = None) -> Index:
    """The index of all documents; postings of the terms in ``terms`` (term) only, if given."""
    segments = cut_segments(docs)
    n_docs, n_terms = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, lengths, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                lists = unpack_rows(data.as_py())
                if not lists.num_rows:
                    continue
                chunks = impact_chunks(lists, lengths.values.to_numpy(), n_docs, n_terms, CHUNK)
                columns = [lists.column("term").combine_chunks().take(chunks.column("list")), pa.array(np.full(len(chunks), segment))]
                whole = pa.table([*columns, *chunks.columns[1:]], ["term", "segment", *chunks.column_names[1:]])
                yield from whole.combine_chunks().to_batches(max_chunksize=10_000)

    postings = segments.select("segment", "lengths", "data").mapInArrow(ordered, _POSTINGS)
    if terms is not None:
        postings = postings.join(terms.select("term").distinct(), "term", "left_semi")
    return Index(segments, materialise_by(postings, "postings", "term", "segment", deal=True), n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, q): how often each row of ``items`` has each of its terms. Written once."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), words.alias("words")).select("item", "item_id", F.explode("words").alias("term"))
    return materialise(rows.filter("term <> ''").groupBy("item", "item_id", "term").agg(F.count("*").alias("q")), "item-terms")


def _best(df: DataFrame, key: str, spread: Column, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key: first of each of its ``SPREAD`` groups, then of those; ``n`` is the place."""
    group = F.pmod(F.hash(spread), F.lit(SPREAD))
    some = df.withColumn("spread", group).withColumn("n", F.row_number().over(Window.partitionBy(key, "spread").orderBy(*order))).filter(F.col("n") <= k)
    return some.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("n") <= k).drop("spread")


def _kth(partials: DataFrame, k: int, name: str) -> DataFrame:
    """(item, name): the k-th highest partial score of each item that has so many."""
    best = _best(partials.select("item", "segment", "row", "partial"), "item", F.struct("segment", "row"), k, F.desc("partial"))
    return best.filter(F.col("n") == k).select("item", F.col("partial").alias(name))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk (segment, rows, impacts) has of the documents that it is asked for (asks)."""
    names = ["item", "segment", "row", "part"]
    for batch in batches:
        for start in range(0, batch.num_rows, _JOINED):
            some = batch.slice(start, _JOINED)
            rows, impacts, asks = (some.column(c) for c in ("rows", "impacts", "asks"))
            chunk = np.repeat(np.arange(some.num_rows), rows.value_lengths().to_numpy()) << 32
            asked_of, ask = np.repeat(np.arange(some.num_rows), asks.value_lengths().to_numpy()), asks.flatten()
            item, row, qw = (ask.field(c).to_numpy() for c in ("item", "row", "qw"))
            held, impacts = chunk + rows.flatten().to_numpy(), impacts.flatten().to_numpy()
            order = np.argsort(held, kind="stable")
            wanted = (asked_of << 32) + row
            at = order[np.minimum(np.searchsorted(held, wanted, sorter=order), len(order) - 1)]
            found = np.flatnonzero(held[at] == wanted)
            segment = some.column("segment").to_numpy()[asked_of[found]]
            columns = [item[found], segment, row[found], qw[found] * impacts[at[found]].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


#: Bytes of an ask, if it is alone in its list, and of asks that are broadcast; more are dealt out as the lists are.
ASK_BYTES, MOST_ASKED_BYTES = 120, 100_000_000
#: Joined chunks whose asks are answered together.
_JOINED = 256


def _exact(index: Index, lists: DataFrame, candidates: DataFrame, n_asks: int) -> DataFrame:
    """(item, segment, row, score) of ``candidates`` (item, segment, row): a list is asked for all of them at once."""
    wanted = candidates.join(lists.select("item", "term", "qw"), "item").groupBy("term", "segment").agg(F.collect_list(F.struct("item", "row", "qw")).alias("asks"))
    found = index.postings.select("term", "segment", "rows", "impacts").join(broadcast_if(wanted, n_asks, ASK_BYTES, MOST_ASKED_BYTES), ["term", "segment"])
    answers = found.select("segment", "rows", "impacts", "asks").mapInArrow(_answers, "item long, segment long, row int, part long")
    return answers.groupBy("item", "segment", "row").agg(F.sum("part").alias("score"))


def _partial_scores(asks: pa.Table) -> Callable[[pa.Table], pa.Table]:
    """What a segment makes of the entries that lists have sent it: the documents that can still reach their item's bound,
    with their score so far and the most that it can become. ``asks`` is of one block of items."""
    of_item: dict[int, list] = {}
    for r in asks.sort_by("item").to_pylist():
        of_item.setdefault(r["item"], []).append((r["term"], r["qw"], r["least"], r["unseen"], r["bound"]))
    kinds = pa.schema([("item", pa.int64()), ("segment", pa.int64()), ("row", pa.int32()), ("partial", pa.int64()), ("most", pa.int64())])

    def partial_scores(sent: pa.Table) -> pa.Table:
        sent = sent.sort_by([("term", "ascending"), ("chunk", "ascending")])
        terms, segment = sent.column("term").to_pylist(), sent.column("segment")[0].as_py()
        rows, impacts = (sent.column(c).combine_chunks() for c in ("rows", "impacts"))
        ends = rows.offsets.to_numpy()
        rows, impacts = rows.values.to_numpy(), impacts.values.to_numpy().astype(np.int64)
        starts = [k for k in range(len(terms)) if not k or terms[k] != terms[k - 1]]
        held = {terms[a]: (rows[ends[a] : ends[b]], impacts[ends[a] : ends[b]]) for a, b in zip(starts, [*starts[1:], len(terms)])}
        n, out = int(rows.max()) + 1, []
        for item, own in of_item.items():
            partial, seen, allowed, bound = np.zeros(n, np.int64), np.zeros(n, np.int64), sum(x[3] for x in own), own[0][4]
            for term, qw, least, unseen, _ in own:
                if term in held:
                    at, impact = held[term]
                    cut = len(impact) - np.searchsorted(impact[::-1], least)
                    partial[at[:cut]] += qw * impact[:cut]
                    seen[at[:cut]] += unseen
            most = partial + allowed - seen
            at = np.flatnonzero((partial > 0) & (most >= bound))
            out.append(pa.table([pa.array(np.full(len(at), item)), pa.array(np.full(len(at), segment)), pa.array(at.astype(np.int32)), pa.array(partial[at]), pa.array(most[at])], schema=kinds))
        return pa.concat_tables(out)

    return partial_scores


def search(index: Index, asked: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item of ``item_terms``."""
    postings = index.postings
    known = postings.groupBy("term").agg(F.sum("n_postings").alias("df"), F.max("max_impact").alias("top"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighed = asked.join(known, "term").withColumn("qw", F.col("q") * weight).filter("qw > 0")
    lists = materialise(weighed.select("item", "item_id", "term", "qw", (F.col("qw") * F.col("top")).alias("most")), "lists")
    n_lists, n_items = lists.count(), lists.select("item").distinct().count()

    # 1: list heads; the exact scores of the best documents among them give a bound that each item's k-th best reaches.
    entry = F.inline(F.arrays_zip(F.slice("rows", 1, k).alias("row"), F.slice("impacts", 1, k).alias("impact")))
    heads = _best(postings.filter("chunk = 0").select("term", "segment", entry), "term", F.col("segment"), k, F.desc("impact"))
    asks = broadcast_if(lists.select("item", "term", "qw"), n_lists, 100)
    partials = heads.join(asks, "term").groupBy("item", "segment", "row").agg(F.sum(F.col("qw") * F.col("impact")).alias("partial"))
    leaders = materialise(_best(partials, "item", F.struct("segment", "row"), LEADERS * k, F.desc("partial")).select("item", "segment", "row"), "leaders")
    led = _exact(index, lists, leaders, LEADERS * k * n_lists).withColumnRenamed("score", "partial")
    bounds = lists.join(_kth(led, k, "bound"), "item", "left").fillna(0, ["bound"])
    # The largest threshold for which a document that no list sends, with at most the threshold or the list's head in each,
    # stays below the bound: some lists give all of their heads, the others share what is left.
    by_most = Window.partitionBy("item").orderBy("most", "term")
    smaller = F.coalesce(F.sum("most").over(by_most.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = bounds.withColumns({"smaller": smaller, "others": F.count("*").over(Window.partitionBy("item")) - F.row_number().over(by_most) + 1})
    threshold = F.greatest(F.max(F.expr("(bound - 1 - smaller) div others")).over(Window.partitionBy("item")), F.lit(0))
    due = shared.withColumn("threshold", F.floor(threshold / LOWERED)).withColumns({"least": F.expr("threshold div qw + 1"), "unseen": F.least("most", "threshold")})
    due = materialise(due.select("item", "term", "qw", "most", "least", "unseen"), "thresholds")

    # 2: one threshold for all lists of an item; chunks of which nothing reaches it stay closed. What is sent goes to the
    # documents' segments, once however many items ask for it.
    least = due.groupBy("term").agg(F.min("least").alias("least_of_all"))
    opened = postings.join(broadcast_if(least, n_lists, 60), "term").filter(F.col("max_impact") >= F.col("least_of_all"))
    asks = due.join(bounds.select("item", "bound").distinct(), "item").select("item", "term", "qw", "least", "unseen", "bound").toArrow()
    sent = opened.select("segment", "term", "chunk", "rows", "impacts")
    open_ = materialise(sent.groupBy("segment").applyInArrow(_partial_scores(asks), "item long, segment long, row int, partial long, most long"), "partial-scores")
    better = open_.join(_kth(open_, k, "better"), "item", "left")
    candidates = materialise(better.filter(F.col("most") >= F.coalesce("better", F.lit(0))).select("item", "segment", "row"), "candidates")

    # 3: exact scores of what is left.
    scores = _exact(index, lists, candidates, candidates.count() * (n_lists // max(1, n_items) + 1)).filter("score > 0")
    named = scores.join(index.segments.select("segment", "ids"), "segment").select("item", "segment", "row", "score", F.get("ids", F.col("row")).alias("doc_id"))
    best = _best(named, "item", F.struct("segment", "row"), k, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("segment"), F.col("row"))
    return best.join(lists.select("item", "item_id").distinct(), "item").select("item_id", F.col("n").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    asked = item_terms(items)
    return search(build(docs, asked), asked, k)


ORACLE = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
sizes AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words))::BIGINT AS l FROM texts),
postings AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM texts) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sizes GROUP BY term, n),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * length * n) // l))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term), sizes GROUP BY item_id, doc_id),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10"""
