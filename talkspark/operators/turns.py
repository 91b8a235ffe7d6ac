"""Utterances to monologues: gaps and islands by speaker, over backchannels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspark.functions.counts import tokens
from talkspark.functions.text import squeeze

# Words that alone make a backchannel, and those that the telephone corpus adds.
BACKCHANNELS = ("okay", "ok", "yeah", "yep", "yes", "no", "right", "mhm", "mm", "uhhuh", "sure", "oh", "hm", "hmm", "gotcha", "good")
TELEPHONE_BACKCHANNELS = (*BACKCHANNELS, "um", "hum", "uh", "huh")
# End of fixed values.
MIN_TOKENS, MAX_BACKCHANNEL_TOKENS = 30, 3


def is_backchannel(words: Column, lexicon: tuple[str, ...] = BACKCHANNELS, most: int = MAX_BACKCHANNEL_TOKENS) -> Column:
    return F.size(words).between(1, most) & F.forall(words, lambda w: w.isin(*lexicon))


def number(stem: Column, kind: str, n: Column) -> Column:
    return F.format_string(f"%s#{kind}_%04d", stem, n)


def build_monologues(utterances: DataFrame, *, keys: tuple[str, ...] = ("source", "stem"), lexicon: tuple[str, ...] = BACKCHANNELS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """utterances: keys, pos, utterance_id, speaker, text. One shuffle by the keys serves windows, islands and numbers.

    A speaker's words go on over others' backchannels, which are dropped, until another
    speaker says something; the first row always begins a turn. Monologues of fewer than
    ``min_tokens`` words are dropped before they are numbered.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    rows = utterances.withColumn("anchor", ~is_backchannel(tokens(F.col("text")), lexicon) | (F.row_number().over(w) == 1))
    rows = rows.withColumn("owner", F.last(F.when(F.col("anchor"), F.col("speaker")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("turned", F.coalesce((F.col("owner") != F.lag("owner").over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("island", F.sum("turned").over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("speaker") == F.col("owner"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "utterance_id", "text")))
    out = rows.groupBy(*keys, "island", F.col("owner").alias("speaker")).agg(parts.alias("parts"))
    out = out.withColumn("text", squeeze(F.array_join(F.col("parts.text"), " "))).withColumn("n_tokens", F.size(tokens(F.col("text"))))
    out = out.where(F.col("n_tokens") >= min_tokens).withColumn("seq", F.row_number().over(W.partitionBy(*keys).orderBy("island")))
    return out.select(*keys, number(F.col(keys[-1]), "mono", F.col("seq")).alias("monologue_id"), "seq", "speaker", "text", F.col("parts.utterance_id").alias("utterance_ids"), "n_tokens")


def first_per_stem(rows: DataFrame, limit: int, keys: tuple[str, ...] = ("source", "stem"), order: str = "seq") -> DataFrame:
    """The first rows of each stem."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= limit).drop("_n")
