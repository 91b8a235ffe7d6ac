"""Counts and rates of a text, from one array of its words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkspark.functions.text import PAUSE, W

# Fillers of one and of two words, and what counts as a contraction.
SINGLE_FILLERS = ("um", "uh", "well", "like")
DOUBLE_FILLERS = ("you know", "i mean", "kind of", "sort of")
CONTRACTION = rf"(?i)(?<!{W}){W}+'(?:t|s|re|ve|ll|m|d)(?!{W})|(?<!{W})(?:gonna|wanna|gotta|kinda|gimme|lemme|dunno)(?!{W})"
# End of fixed values.


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, PAUSE, "")), F.lit(f"{W}+"), F.lit(0))


def plain_words(text: Column) -> Column:
    """ASCII words with hyphens and apostrophes inside, as re-punctuation compares them."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, PAUSE, " ")), F.lit("[A-Za-z0-9'-]+"), F.lit(0))


def filler_count(words: Column) -> Column:
    one = F.size(F.filter(words, lambda w: w.isin(*SINGLE_FILLERS)))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return (one + F.size(F.filter(pairs, lambda p: F.coalesce(p.isin(*DOUBLE_FILLERS), F.lit(False))))).cast("long")


def pause_count(text: Column, kind: str) -> Column:
    mark = f"<pause:{kind}>"
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def char_count(text: Column, char: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def space_before_punctuation(text: Column) -> Column:
    return F.regexp_count(F.regexp_replace(text, PAUSE, " "), F.lit(" +[.,?!;:]")).cast("long")


def rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def sentence_count(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit("<pause:long>"), F.lit(" ")), F.lit("<pause:short>"), F.lit(" "))
    return F.greatest(F.size(F.filter(F.split(bare, "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != "")), F.lit(1))


def surface_features(text: Column, words: Column) -> dict[str, Column]:
    n = F.size(words)
    return {
        "tokens": n.cast("double"),
        "filler_rate": rate(filler_count(words), n),
        "pause_rate": rate(pause_count(text, "short") + pause_count(text, "long"), n),
        "tokens_per_sentence": rate(n, sentence_count(text)),
    }


def contraction_rate(text: Column, words: Column) -> Column:
    return F.regexp_count(text, F.lit(CONTRACTION)) / F.greatest(F.size(words), F.lit(1))


def cache_key(*parts: Column) -> Column:
    """sha256 over the parts, each followed by NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\0"))]), 256)
