"""Word and character measures of a text column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a whitespace split of Unicode text breaks on (White_Space and the
# four separator controls).
WHITESPACE = "(?U)[\\s\\x1c-\\x1f]+"

# The English stop-word list text profiling drops by default.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those "
    "am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def words(text: Column) -> Column:
    """Whitespace-separated words; leading and trailing blanks give no word."""
    return F.array_remove(F.split(text, WHITESPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def char_count(text: Column) -> Column:
    """Code points, not bytes."""
    return F.length(text)


def is_stop_word(word: Column, stop_words=STOP_WORDS) -> Column:
    return F.lower(word).isin(list(stop_words))


def kept_words(text: Column, stop_words=STOP_WORDS) -> Column:
    """The words of a text that are not stop words, in order."""
    return F.filter(words(text), lambda w: ~is_stop_word(w, stop_words))


def text_or_nan(text: Column) -> Column:
    """A missing text is read as the one word `nan`."""
    return F.coalesce(text.cast("string"), F.lit("nan"))
