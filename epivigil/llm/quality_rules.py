"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WINDOW = 5

# Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "with", "be", "by", "on", "not", "he", "as", "at", "or", "from", "this", "have", "are",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "den", "dem", "zu", "von", "mit", "sich", "auf", "für", "im", "als",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "dans", "pour", "pas", "sur", "du", "au", "en", "il", "elle",
    "el", "los", "las", "y", "se", "por", "con", "una", "para", "del", "su", "al", "lo", "como",
)


class Rule(NamedTuple):
    """``measure`` (SQL over the base columns) must lie between ``low`` and ``high``; texts of fewer words than ``words`` are let pass."""

    name: str
    measure: str
    low: float | None
    high: float | None
    words: int = 0


#: The production thresholds. Base measures: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_stop_words, n_upper, n_bullets.
RULES = (
    Rule("length", "n_words", 10, None),
    Rule("mean_word_length", "word_chars / n_words", 2.0, 20.0, 10),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.25, 10),
    Rule("stop_words", "n_stop_words", 1, None, 40),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5, 10),
    Rule("repeated_words", "n_repeat_words / n_words", None, 0.2, 10),
    Rule("upper_case", "n_upper / word_chars", None, 0.5, 10),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once; inside a function argument Spark would repeat it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words of 5-word windows that the text has twice or more, the first one included."""
    n = F.size(words)
    last = n - (WINDOW - 1)

    def of_windows(windows: Column) -> Column:
        marked = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

        def of_sorted(s: Column) -> Column:
            same = lambda x, j, step: F.coalesce(F.get(s, j + step)["w"] == x["w"], F.lit(False))
            twice = F.filter(F.transform(s, lambda x, j: F.when(same(x, j, -1) | same(x, j, 1), x["i"])), lambda i: i.isNotNull())
            # each window covers its words up to the next such window
            return _let(F.array_sort(twice), lambda at: F.aggregate(F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(F.array_sort(marked), of_sorted))

    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(_let(windows, of_windows))


def _count_of(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def measures(text: str = "text") -> Column:
    """All base measures of a text as one struct of longs; a null text is an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda x: F.trim(F.translate(x, SPACES[1:], " " * 5)) != ""

    def of_text(x: Column) -> Column:
        def of_words(w: Column) -> Column:
            def of_lines(y: Column) -> Column:
                stop = F.size(F.array_intersect(F.transform(w, lambda a: F.lower(a)), F.array(*[F.lit(s) for s in STOP_WORDS])))
                solid = F.translate(x, SPACES, "")
                parts = {
                    "n_words": F.size(w), "word_chars": F.length(solid), "n_symbols": _count_of(x, SYMBOLS),
                    "n_lines": F.size(y), "n_dup_lines": F.size(y) - F.size(F.array_distinct(y)), "n_repeat_words": _repeated(w),
                    "n_stop_words": stop, "n_upper": F.length(solid) - F.length(F.regexp_replace(solid, r"\p{Lu}", "")),
                }
                return F.struct(*[v.cast("long").alias(k) for k, v in parts.items()])

            return _let(F.filter(F.split(x, "\n", -1), has_word), of_lines)

        return _let(F.filter(F.split(x, WORD_GAP, -1), lambda a: a != ""), of_words)

    return _let(t, of_text)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of base measures breaks."""
    broken = []
    for r in rules:
        m = F.expr(f"try_divide({r.measure.replace(' / ', ', ')})" if " / " in r.measure else r.measure).cast("double")
        out = F.lit(False)
        if r.low is not None:
            out = out | (m < r.low)
        if r.high is not None:
            out = out | (m > r.high)
        broken.append(F.when((F.col("n_words") >= r.words) & out, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 10, most_repeated: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base measures, ``base_failed``, the names of broken rules and ``kept`` for every row of ``docs`` (``keep`` columns and text).

    Words are runs of other characters than space, tab and line ends. A null or empty text has no words and fails the base rule
    (fewer than ``min_words`` words, or more than ``most_repeated`` percent in repeated windows). Repeated rows are judged one by
    one; an empty table gives no rows; other columns are not read.
    """
    # a generator, because no filter is pushed through it: a filter on a measure would otherwise copy all measures once for each use
    m = docs.select(*keep, F.inline(F.array(measures())))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = m.withColumn("base_failed", failed).withColumn("broken", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
