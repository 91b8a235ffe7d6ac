r"""Normalisation of transcripts as column expressions.

Words are runs of [\p{L}\p{N}_]: bare \w means other characters in Java than elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"

# Rewrite rules (pattern, replacement), in the order in which they apply.
CHAT_RULES = [
    (r"⌈\p{Nd}*", ""),
    (r"\p{Nd}*⌉\p{Nd}*", ""),
    (r"⌊\p{Nd}*", ""),
    (r"\p{Nd}*⌋\p{Nd}*", ""),
    (r"&\{[a-z]=\S+\s*", ""),
    (r"\s*&\}[a-z]=\S+", ""),
    (r"\[%[^\]]*\]", ""),
    (r"&=\S+", ""),
    (r"ʔ", ""),
    (r"(?<![\p{L}\p{N}_'-])X+(?![\p{L}\p{N}_'-])", ""),
    (r"(?<=[\p{L}\p{N}_])_(?=[\p{L}\p{N}_])", " "),
    (r"(?<=[a-zA-Z]):+", ""),
    (r"\+/\.", "."),
    (r"\+\.\.\.", "..."),
    (r"\(\.\.\)", "<pause:long>"),
    (r"\(\.\)", "<pause:short>"),
]
SWITCHBOARD_RULES = [
    (r"[\p{L}\p{N}_]*\[[\p{L}\p{N}_]+\]-", " "),
    (r"\[laughter-([^\]]+)\]", "$1"),
    (r"\[[^\]/]*/([^\]]*)\]", "$1"),
    (r"\{([^}]*)\}", "$1"),
    (r"<[be]_aside>", " "),
    (r"\[[^\]]*\]", " "),
    (r"(?<=[\p{L}\p{N}_])_\p{Nd}+", ""),
]
NXT_RULES = [
    (r"\[vocalsound:[^\]]*\]|\[disfmarker\]|\[gap\]|\[transformerror\]", " "),
    (r"([A-Za-z])_", "$1"),
]
PUNCTUATION_RULES = [
    (r"[ \t]+([.,?!;:])", "$1"),
    (r"(?<!\.)(?:\.{2}|\.{4,})(?!\.)", "."),
]
PAUSE = r"<pause:[\p{L}\p{N}_]+>"
# Typographic characters and what stands for them.
TYPOGRAPHY = ("\u2018\u2019\u201c\u201d\u2010\u2011\u2012\u2013\u2014\u2015\u00a0\u2009\u200a\u202f", "''\"\"------    ")
# End of fixed values.


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def squeeze(text: Column) -> Column:
    """Runs of whitespace to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_chat(text: Column) -> Column:
    return squeeze(rewrite(text, CHAT_RULES))


def clean_switchboard(text: Column) -> Column:
    return squeeze(rewrite(text, SWITCHBOARD_RULES))


def clean_nxt(text: Column) -> Column:
    return F.regexp_replace(squeeze(rewrite(text, NXT_RULES)), r"(?U)\s+([,.!?;:])", "$1")


def normalize_punctuation(text: Column) -> Column:
    """No blanks before punctuation; runs of dots become one, but for three."""
    return rewrite(text, PUNCTUATION_RULES)


def normalize_typography(text: Column) -> Column:
    return F.replace(F.translate(text, *TYPOGRAPHY), F.lit("…"), F.lit("..."))


def strip_special(text: Column) -> Column:
    """Pauses vanish: what stood at both sides of one touches."""
    return squeeze(F.regexp_replace(text, PAUSE, ""))


def strip_pauses(text: Column) -> Column:
    """Pauses become blanks."""
    return squeeze(F.regexp_replace(text, PAUSE, " "))


CLEANERS = {"chat": clean_chat, "switchboard": clean_switchboard, "nxt": clean_nxt}
KEEPS_EMPTIED_ROWS = {"chat"}
