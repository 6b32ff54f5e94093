"""Quality rules as a short-circuit cascade of column expressions."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.words import SPACE_CHARACTERS, word_array

# The symbols that count as such.
SYMBOLS = "#*$%&|<>"
# Digits and marks of ASCII; endings of a line that was cut; list marks at its start.
MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CUT_LINE = "(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z"
LIST_LINE = "\\A[\\x20\\x09-\\x0D]*[-*•]"
#: Words of a window that repeats.
WINDOW = 8
#: Rows of the sample that costs and selectivities are measured on.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """A name and, for a text column, the condition under which a text is rejected."""

    name: str
    rejects: Column


def _chars(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.length(F.translate(_chars(text), SPACE_CHARACTERS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(_chars(text)) - F.length(F.translate(_chars(text), SYMBOLS, ""))).cast("long")


def n_marks(text: Column) -> Column:
    """Digits and marks of ASCII."""
    return (F.length(_chars(text)) - F.length(F.translate(_chars(text), MARKS, ""))).cast("long")


def _filled_lines(text: Column) -> Column:
    return F.filter(F.split(_chars(text), "\n"), lambda line: F.length(F.translate(line, SPACE_CHARACTERS, "")) > 0)


def _share_of_lines(text: Column, pattern: str, tenths: int) -> Column:
    """Whether more than ``tenths`` tenths of at least three lines with a word match."""
    fits = lambda own: (F.size(own) > 2) & (10 * F.size(F.filter(own, lambda line: line.rlike(pattern))) > tenths * F.size(own))
    return _let(_filled_lines(text), fits)


def has_frequent_word(text: Column, tenths: int) -> Column:
    """Whether one word is more than ``tenths`` tenths of all words.

    In sorted order such a word is a run of equal hashes that is longer than that
    share, so it covers one of the places that lie the share apart; from the first
    place of each such hash the run must reach over the whole share.
    """
    def decide(order: Column) -> Column:
        share = F.floor(F.size(order) * tenths / 10).cast("int")
        reaches = lambda k: F.get(order, F.array_position(order, F.get(order, k)).cast("int") - 1 + share) == F.get(order, k)
        places = F.sequence(F.lit(0), F.size(order) - 1, F.greatest(share, F.lit(1)))
        return F.when(F.size(order) == 0, F.lit(False)).otherwise(F.exists(places, lambda k: F.coalesce(reaches(k), F.lit(False))))

    return _let(F.sort_array(F.transform(word_array(text), lambda w: F.xxhash64(w))), decide)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = _filled_lines(text)
    return F.aggregate(F.array(lines), F.lit(0).cast("long"), lambda _, own: (F.size(own) - F.size(F.array_distinct(own))).cast("long"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def n_repeat_words(text: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text has twice or more, each word once.

    Windows are 64-bit hashes that double their reach (1, 2, 4, 8 words), so a text
    costs a few steps per word.  Repeated hashes are looked for in sorted order, and
    only where there are any are the covered words counted: the gaps between the
    starts of repeated windows, ``window`` at most each.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def widened(reach: int):
        def widen(own: Column) -> Column:
            left, right = F.slice(own, 1, F.size(own) - reach), F.slice(own, reach + 1, F.size(own) - reach)
            return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))

        return widen

    def covered(hashes: Column) -> Column:
        def count(order: Column) -> Column:
            # starts of windows whose hash has a neighbour in sorted order
            def marked(k: Column) -> Column:
                own = F.get(order, k)["h"]
                return F.coalesce(own == F.get(order, k - 1)["h"], F.lit(False)) | F.coalesce(own == F.get(order, k + 1)["h"], F.lit(False))

            places = F.transform(F.filter(F.sequence(F.lit(0), F.size(order) - 1), marked), lambda k: F.get(order, k)["i"])
            sum_up = lambda starts: F.aggregate(
                starts, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
                lambda acc, s: F.struct((acc["n"] + F.least(F.lit(window), s - acc["last"])).alias("n"), s.alias("last")),
            )["n"]
            return _let(F.array_sort(places), sum_up)

        return _let(F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("i")))), count)

    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        reach = 1
        while reach < window:
            hashes = _let(hashes, widened(reach))
            reach *= 2
        decide = lambda own: F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0)).otherwise(covered(own))
        return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(hashes, decide))

    return _let(word_array(text), of_words).cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``."""
    text = F.col(text_col)
    return docs.withColumns({f.__name__: f(text) for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)})


def own_rules(text_col: str = "text") -> list[Rule]:
    """Rules with measures that nothing else needs, so that the cascade alone decides which texts they run over."""
    text = F.col(text_col)
    return [
        Rule("marks", 2 * n_marks(text) > word_chars(text)),
        Rule("frequent_word", has_frequent_word(text, 3)),
        Rule("cut_lines", (F.contains(text, F.lit("...")) | F.contains(text, F.lit("…"))) & _share_of_lines(text, CUT_LINE, 3)),
        Rule("list_lines", _share_of_lines(text, LIST_LINE, 9)),
    ]


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules on whole texts; a clean text of prose passes all of them."""
    text = F.col(text_col)
    return [
        Rule("few_words", n_words(text) < 20),
        Rule("repeats", 100 * n_repeat_words(text) > 30 * n_words(text)),
        Rule("symbols", 10 * n_symbols(text) > word_chars(text)),
        Rule("word_length", (word_chars(text) > 40 * n_words(text)) | (word_chars(text) < 2 * n_words(text))),
        Rule("duplicate_lines", 2 * n_dup_lines(text) > F.size(F.split(_chars(text), "\n"))),
        *own_rules(text_col),
    ]


def order_rules(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS, prepare=None) -> list[Rule]:
    """The rules by rejections per second on a sample, best first.

    The sample is the ``rows`` rows whose hashed row numbers are smallest, so it is
    spread over the whole table, hot texts included.  ``prepare`` adds to it what the
    rules find there for nothing.  It is kept while each rule runs over it alone: the
    time beyond that of an empty rule is its cost, the share that it rejects its
    selectivity.  The order changes only how much work a text takes, never its
    verdict.  Rules that reject nothing come last, the cheapest first.
    """
    share = min(1.0, 2 * rows / max(1, docs.count()))
    drawn = docs.withColumn("__draw", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**30)))
    sample = drawn.filter(F.col("__draw") <= int(share * 2**30)).orderBy("__draw").limit(rows).drop("__draw")
    sample = (sample if prepare is None else prepare(sample)).cache()
    sample.count()

    def run(condition: Column) -> tuple[float, int, int]:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            total, hits = sample.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0))).first()
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        return best, hits, total

    floor = run(F.lit(False))[0]
    found = []
    for rule in rules:
        spent, hits, total = run(rule.rejects)
        found.append((rule, max(spent - floor, 1e-4), hits / max(1, total)))
    sample.unpersist()
    return [rule for rule, cost, share in sorted(found, key=lambda x: (-x[2] / x[1], x[1]))]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, NULL if none does; a rule runs only where all before it passed."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def filter_quality(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` without the texts that a rule rejects, rules ordered on a sample; NULL and empty texts have too few words."""
    rules = order_rules(docs.select(text_col), default_rules(text_col) if rules is None else rules)
    return docs.filter(cascade(rules).isNull())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every row.

    Returns ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` (fewer than 20 words, or more than 30 % of
    them in repeated windows) and ``kept`` (no rule of the cascade rejects).  NULL
    and empty texts have no words and fail; repeated rows and NULL identifiers stay.
    Texts are read whole.  Extra columns are ignored, an empty table gives none.

    The five measures are wanted for every row, so rules on them cost a comparison;
    :func:`own_rules` run inside the cascade only, on texts that all rules before
    let pass.  The order comes from a sample on which the measures are at hand too.
    """
    def prepare(rows: DataFrame) -> DataFrame:
        return measures(rows, "__text").withColumn("__lines", F.size(F.split(_chars(F.col("__text")), "\n")))

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    few = F.col("n_words") < 20
    repeats = 100 * F.col("n_repeat_words") > 30 * F.col("n_words")
    rules = [
        Rule("few_words", few),
        Rule("repeats", repeats),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("word_chars")),
        Rule("word_length", (F.col("word_chars") > 40 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("__lines")),
        *own_rules("__text"),
    ]
    verdict = cascade(order_rules(texts, rules, prepare=prepare))
    return prepare(texts).select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (few | repeats).alias("base_failed"), verdict.isNull().alias("kept"),
    )
