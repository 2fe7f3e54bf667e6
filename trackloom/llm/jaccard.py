"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class. The
shingles have a global order: how many sets hold them, then their hash. A set's prefix in that order finds its
candidates; the same order is cut into fragments of about equal weight, each fragment counts the partial overlaps of
the candidate pairs apart from the others, and the sums per pair decide.

Candidates come in rounds, so that a group of thousands of near copies isn't paired with itself: first every class
is compared with the smallest class that shares a prefix shingle with it, then with others that it isn't connected to
yet, and in the end every remaining pair with a common prefix shingle whose members are not connected. Pairs left out
are inside a component already, so no component is lost. Sizes, and the shingles that no other set has, rule pairs out
before their overlaps are counted.

Defined results: ASCII white space separates words and only A-Z are lower-cased; fewer words than ``SHINGLE`` are
one shingle; a text without words, or null, has no shingle and links with nothing; rows that repeat a ``doc_id`` are
judged one by one, by their texts; a null ``doc_id`` is never the smallest, and a component of nulls alone has the id
null; an empty table gives an empty result; other columns are ignored. Shingles count as equal when their 64-bit hashes
are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answers, bucket_count, corpus_totals, cut_blocks, grow, mix, shrink, text_bytes, with_answers
from .common import discard, lean, materialise, one_row_each, text_or_empty
from .components import components

SHINGLE = 5
PERCENT = 75
#: Rounds of pivots before the remaining pairs.
PIVOT_ROUNDS = 2
#: Fragments of the global order, and classes whose candidate pairs one group of a fragment holds, about.
FRAGMENTS = 16
CLASSES_PER_GROUP = 20_000
#: Classes of one shingle that are paired in one group, and copies of a large component's name.
PAIRED_AT_ONCE = 2_000
SALTS = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _STEP = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), np.uint64(base % (1 << 64)))]), dtype=np.uint64)[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of lower-cased bytes: sums of byte values times powers, mixed."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers(_BASE, n), dtype=np.uint64)])
        back = _powers(pow(_BASE, -1, 1 << 64), n)
        return starts, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(rows: pa.Table, shingle: int = SHINGLE, chunk: int = 250_000) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    data, ends = text_bytes(rows)
    steps = _powers(_STEP, max(shingle, 1))
    done = 0
    while done < len(ends) - 1:
        last = max(done + 1, int(np.searchsorted(ends, ends[done] + chunk, "right")) - 1)
        part = _LOWER[data[ends[done] : ends[last]]]
        bounds = ends[done : last + 1] - ends[done]
        whole = np.insert(part, bounds[1:-1], 32)  # a separator between the texts
        starts, words = word_hashes(whole)
        cut = np.searchsorted(starts, bounds + np.arange(len(bounds)))
        with np.errstate(over="ignore"):
            full = len(words) - shingle + 1
            rolled = mix(sum((words[k : k + full] * steps[k] for k in range(shingle)), np.uint64(0))) if full > 0 else np.empty(0, np.uint64)
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a >= shingle:
                    yield np.unique(rolled[a : b - shingle + 1])
                else:
                    short = (words[a:b] * _powers(_STEP, b - a)).sum(dtype=np.uint64) + np.uint64(b - a)
                    yield mix(np.array([short], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) if b > a else np.empty(0, np.uint64)
        done = last


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _needed(n: int | np.ndarray, percent: int):
    """The least overlap with any partner, which is at least ``percent`` of the set."""
    return -(-percent * n // 100)


def block_units(shingle: int):
    def units(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """A block's shingles and how many of its distinct sets have them."""
        seen, parts = set(), [np.empty(0, np.uint64)]
        for hashes in shingle_sets(rows, shingle):
            if len(hashes) and (digest := _digest(hashes)) not in seen:
                seen.add(digest)
                parts.append(hashes)
        return np.unique(np.concatenate(parts), return_counts=True)

    return units


def _sets(blocks: DataFrame, totals: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, digest; for one document of each set that may have partners, the shingles of more than
    one set as well, with the number of sets."""

    def make(_block: int, rows: pa.Table, found: pa.Table) -> pa.Table:
        units, seen = block_units(shingle)(rows)[0], set()
        counts = answers(found)
        sizes, digests, shingles, shared = [], [], [], []
        for hashes in shingle_sets(rows, shingle):
            n, digest = len(hashes), _digest(hashes)
            sizes.append(n)
            digests.append(digest if n else None)
            keep = None
            if n and digest not in seen:
                seen.add(digest)
                held = counts[np.searchsorted(units, hashes)]
                if (held > 1).sum() >= _needed(n, percent):
                    keep = hashes[held > 1], held[held > 1]
            shingles.append(shrink(keep[0]) if keep else None)
            shared.append(shrink(keep[1]) if keep else None)
        columns = rows.column("doc_id"), rows.column("mark"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(shingles, pa.binary()), pa.array(shared, pa.binary())
        return pa.table(list(columns), ["doc_id", "mark", "n_shingles", "digest", "shingles", "sets"])

    return with_answers(blocks, totals, make, "doc_id long, mark binary, n_shingles long, digest binary, shingles binary, sets binary")


def _band(n: np.ndarray | int, percent: int):
    """Sets of this band can only have partners in it and the two beside it."""
    return np.floor(np.log(n) / math.log(100 / percent) + 1e-9).astype(int)


def _tokens(classes: DataFrame, percent: int) -> DataFrame:
    """(cls, n, shared, band, token, place): the prefix of each class in the global order, without shingles of a single set;
    ``shared`` counts all that other sets have too, ``place`` is the shingle's in the whole order."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, n, shingles, sets in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, held = grow(shingles, "<u8"), grow(sets, "u1")
                length = n - _needed(n, percent) + 1 - (n - len(hashes))
                tokens = hashes[np.lexsort((hashes, held))[: max(length, 0)]]
                k = len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, cls, np.int64)), pa.array(np.full(k, n, np.int64)), pa.array(np.full(k, len(hashes), np.int64)), pa.array(np.full(k, _band(n, percent), np.int32)), pa.array(tokens.view(np.int64)), pa.array(np.arange(k) + (n - len(hashes)))], ["cls", "n", "shared", "band", "token", "place"])

    found = classes.filter("shingles IS NOT NULL").select("cls", "n", "shingles", "sets").mapInArrow(lean(prefixes), "cls long, n long, shared long, band int, token long, place long")
    return found


def _fitting(a: str, b: str, percent: int):
    """Whether the pair's sizes, what each could share with others, and the places of a common shingle allow the
    similarity: what stands before the first common one is lost, and a pair has to pass at that one."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    most = F.least(F.col(f"{a}shared"), F.col(f"{b}shared"), n - F.col(f"{a}place"), m - F.col(f"{b}place"))
    return most * 100 >= (n + m - most) * percent


def _pivot_pairs(tokens: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """(a, b): every class with one pivot of its prefix shingles' (in its own band and the next) that it isn't
    connected to: the smallest that fits, or by another order in later turns."""
    held = tokens.withColumn("label", F.col("cls")) if labels is None else tokens.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    order = F.col("cls") if not turn else F.xxhash64("cls", F.lit(turn))
    row = F.struct(order.alias("o"), "cls", "n", "shared", "place", "label")
    # The lowest and the highest: where one is the class itself or connected to it, the other may not be.
    pivots = held.groupBy("token", "band").agg(F.array_distinct(F.array(F.min(row), F.max(row))).alias("ps"))
    near = held.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    met = near.join(pivots, ["token", "band"]).withColumn("p", F.explode("ps")).select("cls", "n", "shared", "place", "label", F.col("p.o").alias("o"), F.col("p.cls").alias("p_cls"), F.col("p.n").alias("p_n"), F.col("p.shared").alias("p_shared"), F.col("p.place").alias("p_place"), F.col("p.label").alias("p_label"))
    found = met.filter((F.col("cls") != F.col("p_cls")) & (F.col("label") != F.col("p_label")) & _fitting("", "p_", percent))
    chosen = found.groupBy("cls").agg(F.min(F.struct("o", "p_cls")).alias("p"))
    return chosen.select(F.least("cls", "p.p_cls").alias("a"), F.greatest("cls", "p.p_cls").alias("b")).distinct()


def _rest_pairs(tokens: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs with a common prefix shingle that are not connected. A frequent shingle's classes are dealt to
    shares of about ``PAIRED_AT_ONCE``, each of which meets all of them in a group of its own."""
    held = materialise(tokens.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    shares = F.ceil(F.count("*") / PAIRED_AT_ONCE).cast("int")
    mixed = held.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), shares.alias("shares")).filter("low <> high").select("token", "shares")
    open_ = materialise(held.join(mixed, "token"), "open")
    x = open_.withColumn("share", F.pmod(F.xxhash64("cls"), "shares").cast("int")).alias("x")
    y = open_.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.label") != F.col("y.label")) & _fitting("x.", "y.", percent)
    return x.join(y, met).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def _order(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Where shingles stand in the global order, in 65,536 steps: by the number of sets, then by hash."""
    return held.astype(np.int64) << 8 | (hashes >> np.uint64(56)).astype(np.int64)


def fragment_edges(classes: DataFrame) -> list[int]:
    """Steps of the global order at which fragments of about equal weight begin, over the shingles of all classes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for shingles, sets in zip(*(c.to_pylist() for c in batch.columns)):
                total += np.bincount(_order(grow(shingles, "<u8"), grow(sets, "u1")), minlength=1 << 16)
        steps = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(total[steps])], ["step", "n"])

    found = classes.select("shingles", "sets").mapInArrow(lean(counted), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()  # 65,536 rows at most
    weight = np.cumsum([r["n"] for r in found])
    at = np.searchsorted(weight, np.arange(1, FRAGMENTS) * (weight[-1] if len(weight) else 0) / FRAGMENTS)
    return sorted({found[i]["step"] for i in at if i < len(found)})


def _linked(pairs: DataFrame, classes: DataFrame, edges: list[int], groups: int, percent: int) -> DataFrame:
    """The pairs that reach the threshold: partial overlaps by fragment, summed per pair. Pairs are dealt to groups one
    by one, so a class with many partners is no large group; each class goes once to every group that asks for it."""
    pairs = materialise(pairs.withColumn("share", F.pmod(F.xxhash64("a", "b"), F.lit(groups)).cast("int")), "pairs")
    asked = pairs.select("share", F.explode(F.array("a", "b")).alias("cls")).distinct()

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for share, cls, shingles, sets in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = grow(shingles, "<u8")
                own = np.searchsorted(edges, _order(hashes, grow(sets, "u1")), "right")
                rows += [(share, int(f), cls, hashes[own == f].tobytes()) for f in np.unique(own)]  # each sorted by hash
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["share", "fragment", "cls", "data"])

    cut = asked.join(classes.select("cls", "shingles", "sets"), "cls").select("share", "cls", "shingles", "sets").mapInArrow(lean(fragments), "share int, fragment int, cls long, data binary")

    def overlaps(sets: pa.Table, wanted: pa.Table) -> pa.Table:
        held = {c: np.frombuffer(d, "<u8") for c, d in zip(sets.column("cls").to_pylist(), sets.column("data").to_pylist())}
        a, b = wanted.column("a").to_pylist(), wanted.column("b").to_pylist()
        common = np.zeros(len(a), np.int64)
        for i, (p, q) in enumerate(zip(a, b)):
            x, y = held.get(p), held.get(q)
            if x is not None and y is not None:
                at = np.searchsorted(x, y)
                common[i] = (x[np.minimum(at, len(x) - 1)] == y).sum()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "common": common}).filter(pa.array(common > 0))

    wanted = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
    partial = cut.groupBy("share", "fragment").cogroup(wanted.groupBy("share", "fragment")).applyInArrow(lean(overlaps), "a long, b long, common long")
    sums = partial.groupBy("a", "b").agg(F.sum("common").alias("common"))
    sizes = classes.select("cls", "n")
    held = sums.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
    links = materialise(held.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"), "links")
    discard(pairs)
    return links


def _solve(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text, mark): (every row's doc_id, mark, n_shingles and digest; each digest's component, its
    number and its smallest doc_id)."""
    blocks = cut_blocks(docs)
    totals = materialise(corpus_totals(blocks, block_units(shingle), bucket_count(blocks)), "totals")
    sets = materialise(_sets(blocks, totals, shingle, percent), "sets")
    discard(blocks, totals)
    # Classes are numbered in the order of their smallest doc_id, as one doc_id may stand for several texts.
    groups = sets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"))
    groups = materialise(groups.orderBy(F.asc_nulls_last("least"), "digest").withColumn("cls", F.monotonically_increasing_id()), "groups")
    held = sets.filter("shingles IS NOT NULL").groupBy("digest").agg(F.first(F.struct("shingles", "sets"), True).alias("s"))
    classes = materialise(groups.join(held, "digest").select("cls", "n", "s.shingles", "s.sets"), "classes")
    tokens = materialise(_tokens(classes, percent), "tokens")
    edges, parts = fragment_edges(classes), max(1, -(-classes.count() // CLASSES_PER_GROUP))

    links, labels, done = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        pairs = _pivot_pairs(tokens, labels, turn, percent) if turn < PIVOT_ROUNDS else _rest_pairs(tokens, labels, percent)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "candidates")
        done = pairs if done is None else done.unionByName(pairs)
        new = _linked(pairs, classes, edges, parts, percent)
        links = new if links is None else links.unionByName(new)
        labels = materialise(components(links).select(F.col("id").alias("cls"), F.col("component_id").alias("label")), "labels")
    discard(classes, tokens)
    # A large component's smallest id goes out in copies, so that its classes needn't meet in one task.
    linked = groups.join(labels, "cls").withColumn("salt", F.pmod("cls", F.lit(SALTS)))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = linked.join(least, ["label", "salt"]).select("digest", "label", "component_id")
    alone = groups.join(labels, "cls", "left_anti").select("digest", F.col("cls").alias("label"), F.col("least").alias("component_id"))
    return sets.select("doc_id", "mark", "n_shingles", "digest"), named.unionByName(alone)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    sets, found = _solve(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("mark")), shingle, percent)
    return sets.join(found.select("digest", "component_id"), "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs``, all columns, of each component: that with the smallest doc_id and, among texts of one id,
    the smallest MD5. Texts without words all stay, rows that repeat id and text once."""
    mark = F.unhex(F.md5(text_or_empty().cast("binary")))
    sets, found = _solve(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark.alias("mark")), shingle, percent)
    rows = sets.groupBy("doc_id", "mark", "digest").agg(F.count("*").alias("copies"))
    joined = rows.filter("digest IS NOT NULL").join(found.select("digest", "label"), "digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark", "copies")).alias("r")
    keys = joined.groupBy("label").agg(first).select("r.doc_id", "r.mark", "r.copies").unionByName(rows.filter("digest IS NULL").select("doc_id", "mark", "copies"))
    return one_row_each(docs, mark, keys)
