"""Decorated views over the driver's tables: the markup that the raw tables lack, by arithmetic on ids, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.functions import counts, text
from talkspark.operators.turns import build_monologues


def _pick(n: Column, texts: dict[int, Column], other: Column) -> Column:
    out = None
    for k, t in texts.items():
        out = F.when(n == k, t) if out is None else out.when(n == k, t)
    return out.otherwise(other)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.posexplode(F.split("text", "[.\\n]+")).alias("i", "t"))
    return rows.withColumn("t", F.trim("t")).where("t <> ''").withColumn("i", F.col("i").cast("long"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, stem, conv_id, pos, utterance_id, speaker, text), with pauses, fillers, backchannels and empty rows."""
    s, t = sentences(spark, sf_dir), F.col("t")
    own = _pick((F.col("conv_id") + F.col("turn") + F.col("i")) % 6, {0: F.concat(F.lit("<pause:long> "), t, F.lit(" .")), 1: F.concat(F.lit("um "), t, F.lit(" ..")), 2: F.concat(F.lit("well you know "), t, F.lit(" , <pause:short>")), 3: F.concat(t, F.lit(" ..."))}, F.concat(t, F.lit(".")))
    pos = F.col("turn") * 100000 + F.col("i") * 2
    other = F.when(F.col("role") == "user", "assistant").otherwise("user")
    more = _pick((F.col("turn") + F.col("i")) % 4, {0: F.lit("Yeah ."), 1: F.lit("ok <pause:short> right"), 2: F.lit("yeah yeah yeah yeah")}, F.lit(""))
    rows = s.select("conv_id", pos.alias("pos"), F.col("role").alias("speaker"), own.alias("text"))
    extra = s.where((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("i")) % 4 == 0).select("conv_id", (pos + 1).alias("pos"), F.when((F.col("conv_id") + F.col("i")) % 5 == 0, F.col("role")).otherwise(other).alias("speaker"), more.alias("text"))
    rows = rows.unionByName(extra)
    stem = F.col("conv_id").cast("string")
    return rows.select(F.lit("CONV").alias("source"), stem.alias("stem"), "conv_id", "pos", F.concat_ws("#", stem, F.col("pos").cast("string")).alias("utterance_id"), "speaker", "text")


def marked(spark: SparkSession, sf_dir: str, corpus: str) -> DataFrame:
    """(conv_id, turn, i, text) with a corpus's markup."""
    t, lit = F.col("t"), F.lit
    texts = {
        "chat": {0: F.concat(lit("⌈2 "), t, lit(" ⌉2 &=laugh (.) word_two")), 1: F.concat(lit("&{l=SPA "), t, lit(" &}l=SPA +...")), 2: F.concat(lit("u:m "), t, lit(" (..) +/.")), 3: F.concat(lit("X "), t, lit(" XX [% a note] ʔuh X-ray"))},
        "switchboard": {0: F.concat(lit("[silence] "), t, lit(" w[ord]- them_1")), 1: F.concat(lit("[laughter-yes] {gonna} "), t), 2: F.concat(lit("<b_aside> "), t, lit(" <e_aside> [bidness/business]")), 3: lit("[noise]")},
        "nxt": {0: F.concat(lit("[vocalsound:laugh] "), t, lit(" T_V_ .")), 1: F.concat(t, lit(" [disfmarker] , so")), 2: lit("[gap] [transformerror]")},
    }
    return sentences(spark, sf_dir).select("conv_id", "turn", "i", _pick((F.col("conv_id") + F.col("turn") + F.col("i")) % 5, texts[corpus], t).alias("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of monologues and their words without fillers, with typographic characters now and then; two styles, three types of meetings."""
    m = build_monologues(utterances(spark, sf_dir))
    plain = F.array_join(F.filter(counts.tokens(F.col("text")), lambda w: ~w.isin(*counts.SINGLE_FILLERS)), " ")
    conv = F.col("stem").cast("long")
    formal = F.when((conv + F.col("seq")) % 3 == 0, F.concat(F.lit("“"), plain, F.lit("”…"))).otherwise(F.concat(plain, F.lit(".")))
    style = F.when(conv % 2 == 0, "casual").otherwise("semi_formal")
    return m.select("source", "stem", "seq", F.concat_ws("#", "monologue_id", style, F.lit("v1")).alias("pair_id"), style.alias("style"), F.concat(F.col("speaker"), F.lit("-"), (conv % 17).cast("string")).alias("speaker"), text.normalize_punctuation(F.col("text")).alias("spoken_text"), formal.alias("formal_text"), "monologue_id", F.lit("{}").alias("metadata"), F.concat(F.lit("type"), (conv % 3).cast("string")).alias("meeting_type"), (conv * 1000 + F.col("seq")).alias("pos"))


_LEXICON = "'okay','ok','yeah','yep','yes','no','right','mhm','mm','uhhuh','sure','oh','hm','hmm','gotcha','good'"
SENT = r"""sent as (select conv_id, turn, role, i, trim(s) t from (select conv_id, turn, role, unnest(regexp_split_to_array(text, '[.\n]+')) s, unnest(range(len(regexp_split_to_array(text, '[.\n]+')))) i from conversations) where trim(s) <> '')"""
UTT = (
    SENT
    + """, utt as (select conv_id, turn * 100000 + i * 2 pos, role speaker, case (conv_id + turn + i) % 6 when 0 then '<pause:long> ' || t || ' .' when 1 then 'um ' || t || ' ..' when 2 then 'well you know ' || t || ' , <pause:short>' when 3 then t || ' ...' else t || '.' end txt from sent
union all select conv_id, turn * 100000 + i * 2 + 1, case when (conv_id + i) % 5 = 0 then role when role = 'user' then 'assistant' else 'user' end, case (turn + i) % 4 when 0 then 'Yeah .' when 1 then 'ok <pause:short> right' when 2 then 'yeah yeah yeah yeah' else '' end from sent where (conv_id * 7 + turn * 3 + i) % 4 = 0)"""
)


def words_sql(x: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({x}, '<pause:[\p{{L}}\p{{N}}_]+>', '', 'g')), '[\p{{L}}\p{{N}}_]+')"


def squeeze_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def fillers_sql(w: str) -> str:
    return f"(len(list_filter({w}, lambda x: x in ('um','uh','well','like'))) + len(list_filter(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]), lambda p: p in ('you know','i mean','kind of','sort of'))))::bigint"


def punct_sql(x: str) -> str:
    y = rf"regexp_replace({x}, '[ \t]+([.,?!;:])', '\1', 'g')"
    for _ in range(2):
        y = rf"regexp_replace({y}, '(^|[^.\x01])\.\.\.($|[^.])', '\1' || chr(1) || '\2', 'g')"
    return rf"replace(regexp_replace({y}, '\.{{2,}}', '.', 'g'), chr(1), '...')"


MONO = (
    UTT
    + f""", bc as (select *, {words_sql("txt")} w, row_number() over (partition by conv_id order by pos) rn from utt),
an as (select *, not (len(w) between 1 and 3 and len(list_filter(w, lambda x: x not in ({_LEXICON}))) = 0) or rn = 1 anchor from bc),
ow as (select *, last_value(case when anchor then speaker end ignore nulls) over (partition by conv_id order by pos rows between unbounded preceding and current row) owner from an),
tu as (select *, case when owner <> lag(owner) over (partition by conv_id order by pos) then 1 else 0 end turned from ow),
isl as (select *, sum(turned) over (partition by conv_id order by pos rows between unbounded preceding and current row) island from tu),
mj as (select conv_id, island, owner speaker, {squeeze_sql("string_agg(txt, ' ' order by pos)")} txt from isl where speaker = owner group by conv_id, island, owner),
mo as (select *, row_number() over (partition by conv_id order by island) seq, len({words_sql("txt")})::int n_tokens from mj where len({words_sql("txt")}) >= 30)"""
)
PAIRS = (
    MONO
    + f""", pv as (select 'CONV' source, conv_id::varchar stem, seq, case when conv_id % 2 = 0 then 'casual' else 'semi_formal' end style, speaker || '-' || (conv_id % 17) speaker, {punct_sql("txt")} spoken_text,
  case when (conv_id + seq) % 3 = 0 then '“' || f || '”…' else f || '.' end formal_text, conv_id || '#mono_' || printf('%04d', seq) monologue_id, 'type' || (conv_id % 3) meeting_type, conv_id * 1000 + seq pos
  from (select *, array_to_string(list_filter({words_sql("txt")}, lambda x: x not in ('um','uh','well','like')), ' ') f from mo))"""
)
