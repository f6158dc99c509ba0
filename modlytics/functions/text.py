"""Column functions on comment text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's default English stop words that can occur in cleaned text.
# The entries with an apostrophe are left out; cleaning turns it into a space.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor "
    "not only own same so than too very s t can will just don should now would could ought cannot"
).split()


def clean_text(text: Column) -> Column:
    """Lower case, everything but letters becomes one space; null becomes empty."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " ")
    return F.trim(letters)


def text_length(text: Column, null_as_zero: bool = False) -> Column:
    """Length in code points.  Log rows count a missing text as 0; training rows stay null."""
    length = F.length(text)
    return F.coalesce(length, F.lit(0)) if null_as_zero else length


def preview(text: Column, size: int = 100, always: bool = False) -> Column:
    """The first ``size`` characters and "...".

    Log records mark only texts that were cut; queue tables mark every one.
    """
    cut = F.concat(F.substring(text, 1, size), F.lit("..."))
    return cut if always else F.when(F.length(text) > size, cut).otherwise(text)


def tokenize(clean: Column) -> Column:
    """Words of two letters or more of an already cleaned text."""
    return F.filter(F.split(clean, " "), lambda word: F.length(word) >= 2)


def remove_stop_words(tokens: Column, words=STOP_WORDS) -> Column:
    """Drop stop words, keeping order and repeats of the others."""
    words = list(words)
    return F.filter(tokens, lambda word: ~word.isin(words)) if words else tokens


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` adjacent tokens, joined by a space.

    ``tokens`` is read several times: pass a column of the frame, not an expression.
    """
    runs, kept = tokens, []
    for size in range(1, high + 1):
        if size > 1:
            count = F.greatest(F.size(tokens) - (size - 1), F.lit(0))
            runs = F.zip_with(
                F.slice(runs, F.lit(1), count),
                F.slice(tokens, F.lit(size), count),
                lambda left, right: F.concat_ws(" ", left, right),
            )
        if size >= low:
            kept.append(runs)
    return F.concat(*kept)
