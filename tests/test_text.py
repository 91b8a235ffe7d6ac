"""Normalisation and counts on strings of our own."""

import pytest
from pyspark.sql import functions as F

from talkspark.functions import counts, text


def _apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


CHAT = [
    ("so (.) there (..) it is", "so <pause:short> there <pause:long> it is"),
    ("⌈3 fine3⌉ by ⌊ you4⌋5", "fine by you"),
    ("room C4 and gate B12", "room C4 and gate B12"),
    ("&=cough ah &=sigh", "ah"),
    ("&{l=FR bon jour &}l=FR then", "bon jour then"),
    ("a [% whispered] b", "a b"),
    ("XX what X ? X-ray XY 'X", "what ? X-ray XY 'X"),
    ("ʔX ʔand", "and"),
    ("e_mail and O_K", "e mail and O K"),
    ("wai:::t a mi:n", "wait a min"),
    ("stop +/.", "stop ."),
    ("and then +...", "and then ..."),
    ("  many\t blanks   ", "many blanks"),
    ("&=x", ""),
]
SWITCHBOARD = [
    ("[noise] hi [silence]", "hi"),
    ("go[ing]- going", "going"),
    ("[laughter-sure] ok", "sure ok"),
    ("[libary/library] card", "library card"),
    ("{brunchy} thing", "brunchy thing"),
    ("<b_aside> wait <e_aside> go", "wait go"),
    ("it_1 was_12_3 R&D", "it was R&D"),
]
NXT = [("[vocalsound:cough] yes [gap] , no", "yes, no"), ("the D_V_D_ .", "the DVD."), ("[transformerror] [disfmarker]", "")]
PUNCTUATION = [("so .", "so."), ("a , b ; c : d ! e ?", "a, b; c: d! e?"), ("x ..", "x."), ("x ... y", "x... y"), ("x .....", "x."), ("x . .", "x."), ("<pause:long> .", "<pause:long>."), ("fine.", "fine.")]


@pytest.mark.parametrize(("f", "cases"), [(text.clean_chat, CHAT), (text.clean_switchboard, SWITCHBOARD), (text.clean_nxt, NXT), (text.normalize_punctuation, PUNCTUATION)])
def test_rules(spark, f, cases):
    assert _apply(spark, f, [a for a, _ in cases]) == [b for _, b in cases]
    assert _apply(spark, text.normalize_punctuation, _apply(spark, text.normalize_punctuation, [a for a, _ in cases])) == _apply(spark, text.normalize_punctuation, [a for a, _ in cases])


def test_pauses_and_typography(spark):
    assert _apply(spark, text.strip_special, ["a<pause:x>b  c"]) == ["ab c"]
    assert _apply(spark, text.strip_pauses, ["a<pause:x>b  c"]) == ["a b c"]
    assert _apply(spark, text.normalize_typography, ["“a” ‘b’—c… d e"]) == ["\"a\" 'b'-c... d e"]


def test_tokens_and_fillers(spark):
    assert _apply(spark, counts.tokens, ["Don't <pause:long>naïve Über_x 3!", ""]) == [["don", "t", "naïve", "über_x", "3"], []]
    assert _apply(spark, lambda c: counts.filler_count(counts.tokens(c)), ["Um, you know, I mean it; well", "like", "", "kind of sort of kind"]) == [4, 1, 0, 2]
    assert _apply(spark, lambda c: counts.pause_count(c, "short"), ["<pause:short><pause:short> <pause:long>"]) == [2]
    assert _apply(spark, counts.space_before_punctuation, ["a , b\t. <pause:long> ."]) == [2]
    assert _apply(spark, counts.sentence_count, ["a. b! c", "", "..."]) == [3, 1, 1]


def test_rates(spark):
    rows = spark.createDataFrame([("Um it's gonna be. <pause:short> fine",), ("",)], "x string")
    words = counts.tokens(F.col("x"))
    got = rows.select(*[c.alias(k) for k, c in counts.surface_features(F.col("x"), words).items()], counts.contraction_rate(F.col("x"), words).alias("c")).collect()
    assert [round(v, 6) for v in got[0]] == [6.0, round(1 / 6, 6), round(1 / 6, 6), 3.0, round(2 / 6, 6)]
    assert list(got[1]) == [0.0] * 5


def test_cache_key(spark):
    import hashlib

    assert _apply(spark, lambda c: counts.cache_key(F.lit("v"), c), ["t"]) == [hashlib.sha256(b"v\0t\0").hexdigest()]
