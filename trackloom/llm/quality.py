"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of characters, up to ``ORDER`` long and over the spaces between words, for each language and for all
together ("*", for texts in a language without trusted ones). Its counts, discounts and back-off weights are tables sharded by n-gram.
Every block of documents sends its distinct n-grams, the n-grams are joined to the counts of all their suffixes
and contexts, the resulting probabilities go back to the blocks, and a document's perplexity is summed there. A
document is rejected when its perplexity is over its language's threshold.

Every language with good labelled documents has a model and a threshold of its own, however few they are; documents
without a language count as one more language. Each trains on all of them but those held back for its threshold: a quarter
(up to a half where they are few), those with the largest hashes of their ids. The threshold is the ``QUANTILE`` of the perplexities of all its good documents not trained on, moved half
the way (in logarithms) to the ``LOW_QUANTILE`` of its bad ones if that is higher, and raised by ``MARGIN`` spreads (the
larger of its own standard deviation and that of all languages) over the square root of how many good documents it is taken
from: so clean documents stay where a quantile says little, and the margin goes as documents come. Documents in a language
without any good labelled document are scored by "*", and nothing is rejected among them: there is nothing to take a
quantile of. The number of languages named in labelled documents is taken to be that of human languages: a row for each
comes to the driver. A chance below 1e-12 counts as that.

Defined results: a text without words, or null, has no perplexity and is kept; without trusted documents all are
kept; a null language uses the model "*", which all languages train; rows that repeat a ``doc_id`` are judged one by one;
contradicting or repeated labels count as bad if one says so; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .blocks import bucket_count, bucket_of, cut_blocks, grow, mix, runs, shrink, unpack_rows, with_answers
from .common import broadcast_if, discard, drop_shuffles, lean, materialise, materialise_by

ORDER = 5
#: Good documents that are held back for a threshold at least, if that leaves half of them to train on; and their share.
HELD_DOCS = 110
HELD_SHARE = 0.25
#: Bytes of the training documents' ids that are broadcast; above, the documents are shuffled by id.
MOST_CHOSEN = 256_000_000
QUANTILE = 0.99
LOW_QUANTILE = 0.05
#: Spreads, over the square root of their number, by which a quantile is raised: what a 95 % tolerance limit adds at twenty.
MARGIN = 6.0
POOLED = "*"
#: A symbol is a code point plus one, or the document's start; 0 is none. An n-gram is two whole numbers: ``lo`` has its
#: last three symbols, ``hi`` the two before them.
_BITS = 21
_START = 0x110001
_MASK = (1 << _BITS) - 1
_ASKED = "block long, bucket int, lang string, hi binary, lo binary"
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)
#: Symbols whose n-grams are made at once, and chances that are summed in one go.
_CHUNK = 250_000
_SUMMED = 1_000_000


class _Grams:
    """The n-grams of texts in one language: the distinct ones, and which of them stands at each place.

    A document is its words (runs without white space), each followed by one space; every character and space is
    predicted from up to ``ORDER - 1`` before it, over the ends of words, back to the document's start."""

    def __init__(self, texts: list[str]):
        parts, ends, done = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
        size = np.cumsum([len(t) + 1 for t in texts])
        bounds = np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, _CHUNK)).tolist()
        for first, stop in zip(bounds, [*bounds[1:], len(texts)]):  # by chunks of whole documents
            own = texts[first:stop]
            chars = np.frombuffer(("\n" + "\n".join(own) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            space = np.isin(chars, _SPACES)
            places = np.flatnonzero(~space[1:] | ~space[:-1]) + 1  # of several spaces the first stays
            ends.append(done + np.searchsorted(places, np.cumsum([len(t) + 1 for t in own]), "right"))
            parts.append(chars[places] + np.uint32(1))
            parts[-1][space[places]] = 33
            done += len(places)
        symbols, self.ends = np.concatenate(parts), np.concatenate(ends)
        parts = chars = space = places = None
        starts, self.before = np.concatenate([[0], self.ends[:-1]]), np.full(len(symbols), ORDER, np.uint8)
        for k in reversed(range(ORDER)):  # how many places stand before it in its document, ORDER or more as ORDER
            self.before[starts[starts + k < self.ends] + k] = k
        # Symbols are numbered in their order, so that most alphabets' n-grams fit into one word.
        self.symbols, seen = symbols, np.zeros(_START, bool)
        for a, b in self._chunks():  # an index is widened to 64 bits: by chunks
            seen[symbols[a:b]] = True
        self.alphabet = np.concatenate([[0], np.flatnonzero(seen), [_START]])
        number = np.zeros(int(self.alphabet[-2]) + 1, np.uint32)
        number[self.alphabet[:-1]] = np.arange(len(self.alphabet) - 1)
        for a, b in self._chunks():
            symbols[a:b] = number[symbols[a:b]]
        self.base = np.uint64(len(self.alphabet))
        self.wide = None
        if len(self.alphabet) ** ORDER >= 1 << 64:
            parts = [self._digits(a, b) for a, b in self._chunks()]
            self.wide = [np.unique(np.concatenate([np.unique(p[k]) for p in parts])) for k in (0, 1)]
        known = [np.unique(self._codes(a, b)) for a, b in self._chunks()]
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *known]))

    def _chunks(self) -> list[tuple[int, int]]:
        return [(k, min(k + _CHUNK, len(self.symbols))) for k in range(0, len(self.symbols), _CHUNK)]

    def _digits(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-gram that ends at each place: the numbers of its first two symbols, and of its last three."""
        near = self.symbols[max(0, first - ORDER + 1) : stop].astype(np.uint64)
        near = np.concatenate([np.zeros(stop - first + ORDER - 1 - len(near), np.uint64), near])
        back = [near[k : k + stop - first] for k in range(ORDER)]  # the first symbol of each n-gram, the second ...
        halves = back[0] * self.base + back[1], (back[2] * self.base + back[3]) * self.base + back[4]
        edge = np.flatnonzero(self.before[first:stop] < ORDER - 1)  # where the document's start is in sight
        before, none = self.before[first:stop][edge], np.uint64(0)
        whole = [np.where(before >= ORDER - 1 - k, back[k][edge], np.where(before == ORDER - 2 - k, self.base - np.uint64(1), none)) for k in range(ORDER)]
        halves[0][edge] = whole[0] * self.base + whole[1]
        halves[1][edge] = (whole[2] * self.base + whole[3]) * self.base + whole[4]
        return halves

    def _codes(self, first: int, stop: int) -> np.ndarray:
        hi, lo = self._digits(first, stop)
        if self.wide is None:
            return hi * self.base ** np.uint64(3) + lo
        hi, lo = (np.searchsorted(known, x).astype(np.uint64) for known, x in zip(self.wide, (hi, lo)))
        return hi * np.uint64(len(self.wide[1])) + lo

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(hi, lo) of the distinct n-grams, ascending."""
        size = self.base ** np.uint64(3) if self.wide is None else np.uint64(max(1, len(self.wide[1])))
        hi, lo = self.known // size, self.known % size
        if self.wide is not None:
            hi, lo = self.wide[0][hi], self.wide[1][lo]
        out = []
        for number, digits in ((hi, 2), (lo, 3)):
            value = np.zeros(len(number), np.int64)
            for k in reversed(range(digits)):
                value = value << _BITS | self.alphabet[number // self.base ** np.uint64(k) % self.base]
            out.append(value)
        return out[0], out[1]

    def counts(self) -> np.ndarray:
        n = np.zeros(len(self.known), np.int64)
        for a, b in self._chunks():
            n += np.bincount(np.searchsorted(self.known, self._codes(a, b)), minlength=len(n))
        return n

    def perplexities(self, logs: np.ndarray) -> list[float | None]:
        """``logs``: of the chances of the distinct n-grams."""
        running, done = np.zeros(len(self.symbols) + 1), 0.0
        for a, b in self._chunks():
            running[a + 1 : b + 1] = logs[np.searchsorted(self.known, self._codes(a, b))]
        for a in range(1, len(running), _SUMMED):
            part = running[a : a + _SUMMED]
            part[:] = done + np.cumsum(part)
            done = part[-1]
        sums, sizes = np.diff(running[self.ends], prepend=0.0), np.diff(self.ends, prepend=0)
        return [float(np.exp(-total / n)) if n else None for total, n in zip(sums.tolist(), sizes.tolist())]


def _by_language(rows: pa.Table, languages: frozenset[str]) -> tuple[list[str], Iterator[tuple[str, list[int], _Grams]]]:
    """(the model of each row, (model, its rows, their n-grams) one after another)."""
    language = [x if x in languages else POOLED for x in rows.column("lang").to_pylist()]
    texts = [x.as_py() or "" for x in rows.column("text")]
    at = {x: [i for i, y in enumerate(language) if y == x] for x in sorted(set(language))}
    return language, ((x, own, _Grams([texts[i] for i in own])) for x, own in at.items())


def _dealt(lang: str, hi: np.ndarray, lo: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, the order by bucket)."""
    hashes = mix(lo.astype(np.uint64) + mix(hi.astype(np.uint64) + np.uint64(crc32(lang.encode("utf-8", "replace")))))
    bucket = bucket_of(hashes, buckets)
    return bucket, np.argsort(bucket, kind="stable")


def _distinct_pairs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hi, lo, ascending; which of them each pair is)."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.ones(len(hi), bool)
    first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    inverse = np.empty(len(hi), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return hi[first], lo[first], inverse


def _size() -> Column:
    """How many symbols the n-gram has."""
    hi, lo = F.col("hi"), F.col("lo")
    return F.when(hi > _MASK, 5).when(hi > 0, 4).when(lo >= 1 << 2 * _BITS, 3).when(lo > _MASK, 2).when(lo > 0, 1).otherwise(0)


def _last(k: int) -> tuple[Column, Column]:
    """(hi, lo) of the last ``k`` symbols."""
    hi, lo = F.col("hi"), F.col("lo")
    none = F.lit(0).cast("long")
    return (hi if k == 5 else hi.bitwiseAND(F.lit(_MASK)) if k == 4 else none), (lo if k >= 3 else lo.bitwiseAND(F.lit((1 << k * _BITS) - 1)) if k else none)


def _last_of(size: Column, names: tuple[str, str]) -> list[Column]:
    """The last symbols, as many as ``size`` says."""
    return [F.coalesce(*(F.when(size == k, _last(k)[i]) for k in range(ORDER + 1))).alias(name) for i, name in enumerate(names)]


def _context(names: tuple[str, str]) -> list[Column]:
    """The n-gram without its last symbol."""
    hi, lo = F.col("hi"), F.col("lo")
    return [F.shiftright(hi, _BITS).alias(names[0]), F.shiftright(lo, _BITS).bitwiseOR(F.shiftleft(hi.bitwiseAND(F.lit(_MASK)), 2 * _BITS)).alias(names[1])]


def trusted_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good, bad, at) of labelled documents; ``at``, from 0 to 1, is a hash of the id."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return known.agg(F.min(good.cast("int")).alias("good"), (F.min("quality") == 0).alias("bad")).withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40))


def _key():
    return F.coalesce("lang", F.lit(POOLED))


def training_cuts(docs: DataFrame, known: DataFrame) -> dict[str, float]:
    """The hash below which each language trains on its good labelled documents; one of them is always left out."""
    n, middle, last = F.count("*").alias("n"), F.percentile_approx("at", 0.5, 10_000).alias("middle"), F.max("at").alias("last")
    found = docs.join(known.filter("good = 1"), "doc_id").groupBy(_key().alias("lang")).agg(n, middle, last).collect()  # a row for each labelled language
    return {r["lang"]: min(max(r["middle"], min(1 - HELD_SHARE, 1 - HELD_DOCS / r["n"])), r["last"]) for r in found}


def _labelled(rows: DataFrame, known: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """``rows`` with labels, and ``trained``: whether the model has seen the row's document. ``lang`` null is "*"."""
    own = [F.when(F.col("lang") == lang, F.lit(cut)) for lang, cut in cuts.items()]  # a literal for each labelled language; rows made in Python would start workers
    joined = rows.withColumn("lang", _key()).join(known, "doc_id").withColumn("cut", F.coalesce(*own, F.lit(None).cast("double")))
    return joined.withColumn("trained", F.coalesce((F.col("good") == 1) & (F.col("at") < F.col("cut")), F.lit(False)))


def thresholds(scored: DataFrame, known: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """(lang, threshold) of every language that has a good document not trained on. ``scored`` has doc_id, lang and
    perplexity."""
    tried = _labelled(scored.filter("perplexity IS NOT NULL").select("doc_id", "lang", "perplexity"), known, cuts).filter("NOT trained").withColumn("log", F.log("perplexity"))
    good, bad = (F.when(F.col(which), F.col("log")) for which in ("is_good", "bad"))
    tried = tried.withColumn("is_good", F.col("good") == 1)
    spread = lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))
    high, low = F.percentile_approx(good, QUANTILE, 10_000), F.percentile_approx(bad, LOW_QUANTILE, 10_000)
    own = tried.groupBy("lang").agg(high.alias("high"), low.alias("low"), spread(good).alias("spread"), F.count(good).alias("n"), F.avg(good).alias("mean")).filter("n > 0")
    every = tried.filter("is_good").join(F.broadcast(own.select("lang", "mean")), "lang").agg(spread(F.col("log") - F.col("mean"))).first()[0]
    limit = (F.col("high") + F.greatest("high", "low")) / 2 + MARGIN * F.greatest("spread", F.lit(every)) / F.sqrt("n")
    return own.select("lang", F.exp(limit).alias("threshold"))


def _train_grams(blocks: DataFrame, languages: frozenset[str]) -> DataFrame:
    """(lang, hi, lo, n): how often the training documents have each longest n-gram, by language and in all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for lang, _, grams in _by_language(unpack_rows(data.as_py()), languages)[1]:
                    hi, lo = grams.pairs()
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hi), pa.string()), pa.array(hi), pa.array(lo), pa.array(grams.counts())], ["lang", "hi", "lo", "n"])

    grams = blocks.select("data").mapInArrow(lean(counted), "lang string, hi long, lo long, n long")
    own = materialise(grams.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")), "own-grams")
    pooled = own.groupBy("hi", "lo").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "hi", "lo", "n")
    both = materialise(own.filter(F.col("lang") != POOLED).unionByName(pooled), "trusted-grams")
    discard(own)
    return both


def kneser_ney(top: DataFrame) -> DataFrame:
    """(lang, kind, hi, lo, value): kind 'chance' has the interpolated chance of an n-gram's last symbol (no symbols: of
    one never seen), kind 'rest' the weight that a context leaves to the next lower order."""
    sized = top.withColumn("level", _size())
    ends = F.array(*(F.struct(F.lit(k).alias("level"), _last(k)[0].alias("hi"), _last(k)[1].alias("lo")) for k in range(2, ORDER + 1)))
    tails = sized.select("lang", F.explode(F.filter(ends, lambda x: x["level"] <= F.col("level"))).alias("x")).select("lang", "x.*").distinct()
    continued = tails.select("lang", (F.col("level") - 1).alias("level"), *_last_of(F.col("level") - 1, ("hi", "lo"))).groupBy("lang", "level", "hi", "lo").agg(F.count("*").alias("n"))
    begins = F.coalesce(*(F.when(F.col("level") == k, F.shiftright("hi" if k > 3 else "lo", _BITS * ((k - 4) if k > 3 else (k - 1)))) for k in range(1, ORDER + 1))) == _START
    raw = sized.filter((F.col("level") == ORDER) | begins).select("lang", "level", "hi", "lo", "n")
    counts = materialise(raw.unionByName(continued), "counts")

    n = [F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]
    seen = counts.groupBy("lang", "level").agg(*(x.cast("double").alias(f"n{k + 1}") for k, x in enumerate(n)))
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(k / 2)), F.lit(0.0)), F.lit(float(k))) for k in (1, 2, 3)]
    discounts = seen.select("lang", "level", *(x.alias(f"d{k + 1}") for k, x in enumerate(d)))
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # Discounts: ORDER rows for each language.
    held = counts.join(F.broadcast(discounts), ["lang", "level"]).select("lang", "level", "hi", "lo", "n", less.alias("less"), *_context(("chi", "clo")))
    contexts = held.groupBy("lang", "chi", "clo").agg(F.sum("n").alias("total"), F.sum("less").alias("left"), F.count("*").alias("kinds"))
    weights = contexts.select("lang", "chi", "clo", (F.col("left") / F.col("total")).alias("rest"), "total", (1.0 / (F.col("kinds") + 1)).alias("unseen"))
    shares = materialise(held.join(weights, ["lang", "chi", "clo"]).select("lang", "level", "hi", "lo", ((F.col("n") - F.col("less")) / F.col("total")).alias("share"), "rest", "unseen"), "shares")
    lower, levels = None, []
    for level in range(1, ORDER + 1):
        at = shares.filter(F.col("level") == level)
        if lower is None:
            chances = at.select("lang", "hi", "lo", (F.col("share") + F.col("rest") * F.col("unseen")).alias("value"))
        else:  # the n-gram without its first symbol has been seen as well
            tail = lower.select("lang", F.col("hi").alias("thi"), F.col("lo").alias("tlo"), F.col("value").alias("below"))
            own = at.select("lang", "hi", "lo", "share", "rest", _last(level - 1)[0].alias("thi"), _last(level - 1)[1].alias("tlo"))
            chances = own.join(tail, ["lang", "thi", "tlo"]).select("lang", "hi", "lo", (F.col("share") + F.col("rest") * F.col("below")).alias("value"))
        lower = materialise(chances, "chances")
        levels.append(lower)
    rest = weights.select("lang", F.lit("rest").alias("kind"), F.col("chi").alias("hi"), F.col("clo").alias("lo"), F.col("rest").alias("value"))
    none = F.lit(0).cast("long")
    unseen = weights.filter("chi = 0 AND clo = 0").select("lang", F.lit("chance").alias("kind"), none.alias("hi"), none.alias("lo"), F.col("unseen").alias("value"))
    model = rest.unionByName(unseen)
    for known in levels:
        model = model.unionByName(known.select("lang", F.lit("chance").alias("kind"), "hi", "lo", "value"))
    model = materialise(model, "kneser-ney")
    discard(counts, shares, *levels)
    return model


def gram_chances(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(bucket, lang, hi, lo, chance) of distinct n-grams. Those that the counts have are found by one join; the others
    lose their first symbol, take the weight that their context leaves, and are looked up again."""
    chances = model.filter("kind = 'chance'").select("lang", F.col("hi").alias("thi"), F.col("lo").alias("tlo"), F.col("value").alias("chance"), _size().alias("size"))
    weights = model.filter("kind = 'rest'").select("lang", F.col("hi").alias("chi"), F.col("lo").alias("clo"), F.col("value").alias("rest"))
    asked, found = grams.select("bucket", "lang", "hi", "lo", _size().alias("level"), F.lit(1.0).alias("factor")), None
    for level in range(ORDER, -1, -1):  # after so many rounds the shortest have come to no symbols as well
        sought = asked.select("*", *_last_of(F.col("level"), ("thi", "tlo")))
        # Model rows with more symbols than any n-gram has by now aren't needed.
        looked = materialise(sought.join(chances.filter(F.col("size") <= level), ["lang", "thi", "tlo"], "left").select("bucket", "lang", "hi", "lo", "level", "factor", "chance"), "looked")
        drop_shuffles(grams.sparkSession)
        # Without any trusted text there is no chance at all to look up, and none is needed: nothing is rejected.
        done = F.col("chance").isNotNull() | (F.col("level") == 0)
        hits = looked.filter(done).select("bucket", "lang", "hi", "lo", (F.col("factor") * F.coalesce("chance", F.lit(1.0))).alias("chance"))
        found = hits if found is None else found.unionByName(hits)
        if level:
            context = looked.filter(~done).select("*", *_last_of(F.col("level"), ("thi", "tlo"))).withColumnsRenamed({"hi": "own_hi", "lo": "own_lo", "thi": "hi", "tlo": "lo"})
            context = context.select("bucket", "lang", "own_hi", "own_lo", "level", "factor", *_context(("chi", "clo")))
            asked = context.join(weights, ["lang", "chi", "clo"], "left").select("bucket", "lang", F.col("own_hi").alias("hi"), F.col("own_lo").alias("lo"), (F.col("level") - 1).alias("level"), (F.col("factor") * F.coalesce("rest", F.lit(1.0))).alias("factor"))
    return found


def score_blocks(blocks: DataFrame, model: DataFrame, languages: frozenset[str], make, schema: str) -> DataFrame:
    """``make(rows, perplexity of each row, model of each row)`` for every block."""
    buckets = bucket_count(blocks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for lang, _, grams in _by_language(unpack_rows(data.as_py()), languages)[1]:
                    hi, lo = grams.pairs()
                    bucket, order = _dealt(lang, hi, lo, buckets)
                    rows += [(block, k, lang, shrink(hi[order[a:b]]), shrink(lo[order[a:b]])) for k, a, b in runs(bucket[order])]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["block", "bucket", "lang", "hi", "lo"])

    def whole(rows: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """By language: the bucket's rows, how many n-grams each has, the distinct ones and which each is."""
        for lang, own in rows.groupby("lang"):
            his, los = [grow(x, "<i8") for x in own["hi"]], [grow(x, "<i8") for x in own["lo"]]
            sizes, pairs = np.array([len(x) for x in his]), _distinct_pairs(np.concatenate(his), np.concatenate(los))
            del his, los  # not held while the group goes on
            yield lang, own, sizes, pairs

    def distinct(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"bucket": key[0], "lang": lang, "hi": hi, "lo": lo}) for lang, _, _, (hi, lo, _) in whole(rows)]
        return pd.concat(found)

    def reply(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        chances = dict(iter(found.groupby("lang"))) if len(found) else {}
        for lang, own, sizes, (_, _, inverse) in whole(asked) if len(asked) else []:
            known = chances[lang]
            order = np.lexsort((known["lo"].to_numpy(), known["hi"].to_numpy()))
            logs = np.log(np.maximum(known["chance"].to_numpy(float)[order], 1e-12)).astype("<f4")[inverse]
            out.append(pd.DataFrame({"block": own["block"], "bucket": own["bucket"], "lang": lang, "logs": [shrink(x) for x in np.split(logs, np.cumsum(sizes)[:-1])]}))
        return pd.concat(out) if out else pd.DataFrame({"block": [], "bucket": [], "lang": [], "logs": []})

    def scored(_block: int, rows: pa.Table, replies: pa.Table) -> pa.Table:
        language, parts = _by_language(rows, languages)
        found = {(r["lang"], r["bucket"]): r["logs"] for r in replies.to_pylist()}
        scores: list[float | None] = [None] * rows.num_rows
        for lang, at, grams in parts:
            hi, lo = grams.pairs()
            bucket, order = _dealt(lang, hi, lo, buckets)
            logs = np.zeros(len(hi))
            logs[order] = np.concatenate([np.empty(0, "<f4"), *(grow(found[lang, k], "<f4") for k in np.unique(bucket).tolist())])
            for i, score in zip(at, grams.perplexities(logs)):
                scores[i] = score
        return make(rows, scores, language)

    asked = materialise_by(blocks.select("block", "data").mapInArrow(lean(ask), _ASKED), "asked-grams", "bucket", deal=True)
    grams = asked.groupBy("bucket").applyInPandas(lean(distinct), "bucket int, lang string, hi long, lo long")
    chances = gram_chances(grams, model)
    replies = asked.groupBy("bucket").cogroup(chances.groupBy("bucket")).applyInPandas(lean(reply), "block long, bucket int, lang string, logs binary")
    return with_answers(blocks, replies, scored, schema)


def _languages_ready(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def _judged(docs: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``docs``, as ``row``, with ``model``, ``perplexity``, ``threshold`` and ``kept``."""
    docs = _languages_ready(docs).select(*dict.fromkeys([*names, "doc_id", "text", "lang"]))
    known = materialise(trusted_labels(labels), "labels")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    cuts = training_cuts(ids.select("doc_id", "lang"), known)
    chosen = _labelled(ids.select("doc_id", "lang"), known, cuts).filter("trained").select("doc_id", F.col("lang").alias("key")).distinct()
    chosen = materialise(chosen, "chosen")
    chosen = broadcast_if(chosen, chosen.count(), 40, MOST_CHOSEN)
    train = ids.join(chosen, "doc_id").filter(_key() == F.col("key")).select("doc_id", "text", "lang")
    trusted = cut_blocks(train, "trusted")
    grams = _train_grams(trusted, frozenset(cuts))
    languages = frozenset(r[0] for r in grams.select("lang").distinct().collect())  # of those in ``cuts``, and "*"
    model = kneser_ney(grams)
    discard(trusted, grams)
    row = docs.select(*names).schema

    def scored(rows: pa.Table, scores: list[float | None], language: list[str]) -> pa.Table:
        whole = pa.StructArray.from_arrays([pa.concat_arrays(rows.column(c).chunks) for c in names], names)
        columns = {"row": whole, "doc_id": rows.column("doc_id").cast(pa.int64()), "lang": rows.column("lang").cast(pa.string()), "model": pa.array(language, pa.string()), "perplexity": pa.array(scores, pa.float64())}
        return pa.table(columns)

    schema = StructType([StructField("row", row), *StructType.fromDDL("doc_id long, lang string, model string, perplexity double").fields])
    blocks = cut_blocks(docs)
    rows = materialise(score_blocks(blocks, model, languages, scored, schema), "scored")
    discard(blocks, model)
    limits = F.broadcast(materialise(thresholds(rows, known, cuts).withColumnRenamed("lang", "key"), "thresholds"))  # a row for each labelled language
    judged = rows.join(limits, _key() == F.col("key"), "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))
    return judged.withColumn("kept", F.col("perplexity").isNull() | (F.col("perplexity") <= F.col("threshold")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the model used, perplexity, its threshold, and whether the document is kept."""
    return _judged(docs, labels, ["doc_id"]).select("doc_id", "model", "perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    return _judged(docs, labels, docs.columns).filter("kept").select("row.*")
