"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in column expression over the words and lines of the whole text; a rule is a row
``(measure, low, high)`` of the threshold table, and the verdict of a document is the conjunction of all rules.
No user function, no shuffle, no join: the plan is scan -> project.

The stop words are those of four languages; their rule says nothing about others.  A language column that names one of
the four holds a text to the rule, whatever it looks like, and one that names another language exempts it.  Without
either, a text is exempt that holds letters which none of the four writes, or whose short words come back all over the
text as function words do (see :func:`uncovered`).

Defined results: a null text counts as empty (no words); an empty text fails (fewer than ``MIN_WORDS`` words);
repeated rows are judged one by one; extra columns pass through untouched in :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import fresh, let, text_or_empty

# White space between words, symbols, and frequent function words of four languages.
WORD_BREAK = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "as", "be", "with", "by",
           "this", "are", "at", "an", "from", "or", "not", "but", "have", "he", "she", "they", "we", "you"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "que", "est", "en", "du", "pour", "dans", "qui", "par",
           "sur", "au", "pas", "avec", "ce", "il", "elle", "sont"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht",
           "ein", "eine", "als", "auch", "es", "an", "für", "in", "er"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su",
           "para", "es", "al", "lo", "como", "a"],
}

#: Codes of the languages of the stop words.
COVERED = (*STOP_WORDS, "eng", "fra", "fre", "deu", "ger", "spa")
#: The code at the beginning of a language column.
LANG_CODE = r"^\s*([a-z]{2,3})([^a-z]|$)"
#: Letters that the four languages write.
COVERED_LETTERS = "A-Za-zÀÂÄÆÇÈÉÊËÎÏÑÔÖÙÛÜŸŒÁÍÓÚàâäæçèéêëîïñôöùûüÿœáíóúßẞªº"
#: Share of other letters, or of words that are later mentions of a short word, from which a text is in another language.
MIN_OTHER_LETTERS = 0.02
MIN_REPEATED_SHORT = 0.05
SHORT = r"^\p{L}{1,4}$"

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


class Rule(NamedTuple):
    """One row of the threshold table: ``low <= measure <= high`` must hold (None: no bound)."""

    measure: str
    low: float | None
    high: float | None


#: The threshold table.  Ratios are per word, but ``dup_lines`` is per line that has a word.
RULES: tuple[Rule, ...] = (
    Rule("n_words", MIN_WORDS, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("bangs_per_word", None, 0.25),
    Rule("stop_words_per_word", 0.04, None),
    Rule("dup_lines_per_line", None, 0.5),
    Rule("repeat_words_per_word", None, MAX_REPEAT_PERCENT / 100),
)


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without white space."""
    return F.filter(F.split(text, WORD_BREAK, -1), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(A_WORD))


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are among ``chars``."""
    return F.length(F.regexp_replace(text, "[^" + chars + "]+", ""))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """A 64-bit hash of every run of ``window`` (a power of two) words: runs are doubled 1 -> 2 -> 4 -> 8."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def doubled(h: Column, step: int) -> Column:
        if step == window:
            return F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0)))
        pairs = F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
        return let(pairs, lambda g: doubled(g, 2 * step))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))


def repeat_words(grams: Column, window: int = WINDOW) -> Column:
    """Words covered by a window (given as hashes, in order) that occurs at least twice in the same text.

    Texts without a repeated window stop after a linear distinct test; the others sort (hash, position) pairs and
    add up the covered positions, so no text costs more than n log n.
    """
    def repeated(pairs: Column) -> Column:
        return F.sort_array(F.filter(F.transform(pairs, lambda e, k: F.when(
            (e["h"] == F.get(pairs, k - 1)["h"]) | (e["h"] == F.get(pairs, k + 1)["h"]), e["i"])),
            lambda i: i.isNotNull()))

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = F.aggregate(
        let(pairs, repeated), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i + window - a["end"])).alias("n"),
                              (i + window).alias("end")),
        lambda a: a["n"])
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(F.lit(0)).cast("long")


def uncovered(text: Column, words: Column, lang: Column | None) -> Column:
    """Is this text, by its language column, letters or function words, in none of the languages of the stop words?

    Function words of any language are short and come back; a short word that only follows itself does not count.
    """
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    other = F.length(F.regexp_replace(text, rf"\P{{L}}+|[{COVERED_LETTERS}]+", ""))
    changes = F.filter(F.transform(words, lambda w: F.lower(w)),
                       lambda w, i: (i == 0) | (w != F.lower(F.coalesce(F.get(words, i - 1), F.lit("")))))
    back = let(F.filter(changes, lambda w: w.rlike(SHORT)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = (letters > 0) & ((other >= MIN_OTHER_LETTERS * letters) | (back >= MIN_REPEATED_SHORT * F.size(words)))
    if lang is None:
        return out
    code = F.regexp_extract(F.lower(F.coalesce(lang.cast("string"), F.lit(""))), LANG_CODE, 1)
    return F.when(code.isin(*COVERED), F.lit(False)).when(code != "", F.lit(True)).otherwise(out)


def measures(docs: DataFrame, text_col: str = "text",
             lang_col: str | None = "lang") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the words and lines of each text, and the measures as expressions over them."""
    lang = F.col(f"`{lang_col}`") if lang_col in docs.columns else None
    text, words, lines, grams, n, nl, reps = (fresh(docs.columns, x) for x in (
        "text__", "words__", "lines__", "grams__", "n_words__", "n_lines__", "n_repeat__"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    df = docs.withColumn(text, text_or_empty(f"`{text_col}`"))
    df = df.withColumns({words: words_of(F.col(text)), lines: lines_of(F.col(text))})
    df = df.withColumn(grams, window_hashes(F.col(words)))
    df = df.withColumns({n: F.size(words).cast("long"), nl: F.size(lines).cast("long"),
                         reps: repeat_words(F.col(grams))})
    t, w, per_word, per_line = F.col(text), F.col(words), F.greatest(F.col(n), F.lit(1)), F.greatest(F.col(nl), F.lit(1))
    word_chars = F.length(F.regexp_replace(t, WORD_BREAK, "")).cast("long")
    symbols, dup = count_chars(t, SYMBOLS).cast("long"), F.col(nl) - F.size(F.array_distinct(F.col(lines)))
    return df, {
        "n_words": F.col(n),
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": F.col(reps),
        "mean_word_chars": word_chars / per_word,
        "symbols_per_word": symbols / per_word,
        "bangs_per_word": count_chars(t, "!") / per_word,
        "stop_words_per_word": F.size(F.filter(w, lambda x: F.lower(x).isin(stop))) / per_word,
        "dup_lines_per_line": dup / per_line,
        "repeat_words_per_word": F.col(reps) / per_word,
        "uncovered": uncovered(t, w, lang),
    }


def verdict(measure: dict[str, Column], rules: Sequence[Rule] = RULES) -> Column:
    """The threshold table as one boolean expression; the stop-word rule passes in languages it does not cover."""
    out = F.lit(True)
    for r in rules:
        one = F.lit(True)
        if r.low is not None:
            one = one & (measure[r.measure] >= F.lit(r.low))
        if r.high is not None:
            one = one & (measure[r.measure] <= F.lit(r.high))
        out = out & (one | measure["uncovered"] if r.measure == "stop_words_per_word" else one)
    return out


def base_failed(measure: dict[str, Column]) -> Column:
    n = measure["n_words"]
    return (n < MIN_WORDS) | (100 * measure["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: Sequence[Rule] = RULES, lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: the id, the counts, ``base_failed`` and ``kept``."""
    cols = dict.fromkeys([id_col, text_col, *([lang_col] if lang_col in docs.columns else [])])
    df, m = measures(docs.select(*[F.col(f"`{c}`") for c in cols]), text_col, lang_col)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), *[m[c].alias(c) for c in counts],
                     base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES,
              lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    df, m = measures(docs, text_col, lang_col)
    return df.filter(~base_failed(m) & verdict(m, rules)).select(*[F.col(f"`{c}`") for c in docs.columns])
