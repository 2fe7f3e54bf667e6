"""Quality rules: a table of thresholds, compiled into one projection without user functions.

A rule bounds a measure of the text, or its share of another measure in hundredths, so that all comparisons are between
whole numbers. ``measures`` gives every measure of one text as a struct of one expression: words and lines are split once
and held by a lambda's variable, so nothing is computed twice however many rules there are. Words in repeated windows are
found by sorting a text's windows of three words beside their places: n log n of one text, no shuffle, no other row needed.

Defined results: a null or empty text has no words and fails ``words``; a share of nothing (no words, no lines) breaks no
rule; rows that repeat a doc_id are judged one by one; stop words are looked for in the list of the document's language, and
where that is null or has no list in all lists, but only languages with a list can fail for them; an empty table gives an
empty result; a table without a ``lang`` column is judged as if all languages were null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``measure``, or 100 * ``measure`` / ``per``, is to be ``least`` at least and ``most`` at most."""

    name: str
    measure: str
    per: str | None = None
    least: int | None = None
    most: int | None = None


#: The contract's own rules: a text that breaks one of them has ``base_failed``.
BASE_RULES = (Rule("words", "n_words", least=50), Rule("repeats", "n_repeat_words", "n_words", most=50))
#: The method's rules. Bounds as in published rule sets for web text, widened for languages of long words.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=250, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("marks", "n_marks", "word_chars", most=20),
    Rule("digits", "n_digits", "word_chars", most=20),
    Rule("capitals", "n_capitals", "word_chars", most=40),
    Rule("same_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=30),
    Rule("stop_words", "n_stop_words", "n_stop_scope", least=2),
)
#: Frequent function words of each language.
STOP_WORDS = {
    "de": ["das", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu"],
    "en": ["and", "be", "have", "in", "is", "of", "that", "the", "to", "with"],
    "es": ["con", "de", "el", "en", "es", "la", "las", "los", "por", "que", "un", "una", "y"],
    "fr": ["de", "des", "en", "est", "et", "la", "le", "les", "par", "que", "qui", "un", "une"],
}
#: Characters as the contract and the rules name them.
SPACES, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
MARKS, BULLETS, ELLIPSES = r"[^\p{L}\p{M}\p{Nd}\x20\x09-\x0D]", ("-", "*", "•", "●"), ("...", "…")
LINE_END, WINDOW = "\n", 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated_places(words: Column) -> Column:
    """The starts of the windows that stand at two places or more, ascending."""
    n = F.size(words)
    shifted = [F.slice(words, F.lit(k + 1), n).alias(f"w{k}") for k in range(WINDOW)]
    windows = F.slice(F.arrays_zip(*shifted, F.sequence(F.lit(0), n).alias("start")), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))
    same = lambda a, b: reduce(and_, (a[f"w{k}"] == b[f"w{k}"] for k in reversed(range(WINDOW))))
    found = lambda s: F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)), x["start"]).when(same(x, F.get(s, i + 1)), x["start"]))
    return F.sort_array(F.array_compact(_let(F.sort_array(windows), found)))


def _covered(places: Column) -> Column:
    """How many words windows at ``places`` cover together."""
    reach = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(reach, F.lit(0), lambda a, b: a + b)


def _stop_words(words: Column, lang: Column) -> Column:
    every = sorted({w for found in STOP_WORDS.values() for w in found})
    among = lambda known: F.size(F.filter(words, lambda w: w.isin(sorted({*known, *map(str.capitalize, known)}))))
    out = F.when(lang == "", F.lit(0))
    for name, known in STOP_WORDS.items():
        out = out.when(lang == name, among(known))
    return out.otherwise(among(every))


def measures(text: Column, lang: Column) -> Column:
    """A struct of whole numbers: what ``BASE_RULES`` and ``RULES`` can bound."""
    text, lang = F.coalesce(text, F.lit("")), F.lower(F.coalesce(lang, F.lit("?")))
    scope = F.when(lang.isin(sorted(STOP_WORDS)), F.lit(1)).otherwise(0)

    def of(x: Column) -> Column:
        words, lines = x["words"], x["lines"]
        starting = lambda marks: F.size(F.filter(lines, lambda line: reduce(or_, (F.startswith(F.ltrim(line), F.lit(m)) for m in marks))))
        ending = lambda marks: F.size(F.filter(lines, lambda line: reduce(or_, (F.endswith(F.rtrim(line), F.lit(m)) for m in marks))))
        found = {
            "n_words": F.size(words), "word_chars": F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": _let(_repeated_places(words), _covered),
            "n_marks": F.regexp_count(text, F.lit(MARKS)), "n_digits": F.regexp_count(text, F.lit(r"\p{Nd}")), "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "n_bullet_lines": starting(BULLETS), "n_ellipsis_lines": ending(ELLIPSES),
            "n_stop_words": _stop_words(words, lang), "n_stop_scope": F.size(words) * scope,
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in found.items()))

    words = F.array_remove(F.split(text, SPACES + "+"), "")
    lines = F.filter(F.split(text, LINE_END), lambda line: F.trim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    return _let(F.struct(words.alias("words"), lines.alias("lines")), of)


def broken(rules: Sequence[Rule], values: Column) -> Column:
    """The names of the rules that ``values`` (a struct of ``measures``) breaks, in the table's order."""

    def breaks(rule: Rule) -> Column:
        value, whole = (values[rule.measure], F.lit(1)) if rule.per is None else (100 * values[rule.measure], values[rule.per])
        out = F.lit(False)
        out = out if rule.least is None else out | (value < rule.least * whole)
        return out if rule.most is None else out | (value > rule.most * whole)

    return F.array_compact(F.array(*(F.when(breaks(r), F.lit(r.name)) for r in rules)))


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, measures, failed): every document's measures and the names of the rules that it breaks."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col("text"), lang).alias("measures"))
    return measured.withColumn("failed", broken([*BASE_RULES, *rules], F.col("measures")))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    found = judged(docs, rules)
    base = F.arrays_overlap("failed", F.array(*(F.lit(r.name) for r in BASE_RULES)))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *(F.col(f"measures.{c}").alias(c) for c in columns), base.alias("base_failed"), (F.size("failed") == 0).alias("kept"), F.array_join("failed", ",").alias("failed"))


def _oracle() -> str:
    """The same in SQL, from the same tables of rules and words."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    among = lambda known: f"len(list_filter(words, lambda w: list_contains({listed(sorted({*known, *map(str.capitalize, known)}))}, w)))"
    stop = " ".join(f"WHEN lang = '{g}' THEN {among(ws)}" for g, ws in STOP_WORDS.items())
    every = among([w for ws in STOP_WORDS.values() for w in ws])

    def breaks(r: Rule) -> str:
        value, whole = (r.measure, "1") if r.per is None else (f"100 * {r.measure}", r.per)
        bounds = ([f"{value} < {r.least} * {whole}"] if r.least is not None else []) + ([f"{value} > {r.most} * {whole}"] if r.most is not None else [])
        return f"CASE WHEN {' OR '.join(bounds)} THEN '{r.name}' END"

    count = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    either = lambda made, marks: " OR ".join(made.format(m) for m in marks)
    names = lambda rules: f"list_filter([{', '.join(map(breaks, rules))}], lambda x: x IS NOT NULL)"
    return rf"""
WITH texts AS (SELECT doc_id, lower(coalesce(lang, '?')) AS lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, i, words[i:i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
reach AS (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3), 3) AS r FROM found WHERE n > 1),
repeats AS (SELECT doc_id, sum(r) AS n_repeat_words FROM reach GROUP BY doc_id),
measures AS (SELECT doc_id, len(words) AS n_words, length(text) - {count(SPACES)} AS word_chars, {count(SYMBOLS)} AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {count(MARKS)} AS n_marks,
    {count(r"\p{Nd}")} AS n_digits, {count(r"\p{Lu}")} AS n_capitals, len(list_filter(lines, lambda l: {either("starts_with(ltrim(l), '{}')", BULLETS)})) AS n_bullet_lines,
    len(list_filter(lines, lambda l: {either("ends_with(rtrim(l), '{}')", ELLIPSES)})) AS n_ellipsis_lines, CASE {stop} ELSE {every} END AS n_stop_words,
    CASE WHEN lang IN ({", ".join(f"'{g}'" for g in STOP_WORDS)}) THEN len(words) ELSE 0 END AS n_stop_scope FROM split LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, {names(BASE_RULES)} AS base, {names(RULES)} AS own FROM measures)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, len(base) > 0 AS base_failed, len(base) + len(own) = 0 AS kept, array_to_string(list_concat(base, own), ',') AS failed FROM judged"""


ORACLE = _oracle()
