"""One query for each operator, over the decorated views, and the SQL that most can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.functions import counts, text
from talkspark.operators import evaluate, formats, pairs as pairing, split, stats, turns
from talkspark.plans import views
from talkspark.plans.views import MONO, PAIRS, SENT, UTT, fillers_sql, punct_sql, squeeze_sql, words_sql
from talkspark.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _utt(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return views.utterances(spark, sf_dir).select("conv_id", "pos", *[c.alias(k) for k, c in columns.items()])


def _r(c: Column) -> Column:
    return F.round(c, 9)




def _t() -> Column:
    return F.col("text")


def _words() -> Column:
    return counts.tokens(_t())


_U = f"with {UTT} select conv_id, pos, "


@query(f"{_U} len({words_sql('txt')})::bigint n from utt")
def tok_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, n=F.size(_words()).cast("long"))


@query(f"{_U} {fillers_sql('w')} n from (select *, {words_sql('txt')} w from utt)")
def filler_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, n=counts.filler_count(_words()))


@query(f"{_U} len(regexp_extract_all(txt, '<pause:short>'))::bigint short, len(regexp_extract_all(txt, '<pause:long>'))::bigint long from utt")
def pause_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, short=counts.pause_count(_t(), "short"), long=counts.pause_count(_t(), "long"))


@query(rf"""{_U} len(regexp_extract_all(txt, ','))::bigint commas, len(regexp_extract_all(txt, '\?'))::bigint questions, len(regexp_extract_all(txt, '\.'))::bigint periods, len(regexp_extract_all(txt, '!'))::bigint exclaims,
len(regexp_extract_all(regexp_replace(txt, '<pause:[\p{{L}}\p{{N}}_]+>', ' ', 'g'), ' +[.,?!;:]'))::bigint space_before from utt""")
def punct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, commas=counts.char_count(_t(), ","), questions=counts.char_count(_t(), "?"), periods=counts.char_count(_t(), "."), exclaims=counts.char_count(_t(), "!"), space_before=counts.space_before_punctuation(_t()))


_SURFACE = f"""len(w)::double tokens, case when len(w) > 0 then {fillers_sql("w")} / len(w) else 0.0 end filler_rate,
case when len(w) > 0 then len(regexp_extract_all(txt, '<pause:(?:short|long)>')) / len(w) else 0.0 end pause_rate,
case when len(w) > 0 then len(w) / greatest(len(list_filter(regexp_split_to_array(regexp_replace(txt, '<pause:(?:short|long)>', ' ', 'g'), '[.!?]+'), lambda s: trim(s) <> '')), 1) else 0.0 end tokens_per_sentence"""


@query(f"with {UTT}, f as (select conv_id, pos, {_SURFACE} from (select *, {words_sql('txt')} w from utt)) select conv_id, pos, tokens, round(filler_rate::double, 9) filler_rate, round(pause_rate::double, 9) pause_rate, round(tokens_per_sentence::double, 9) tokens_per_sentence from f")
def surface_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, **{k: _r(v) for k, v in counts.surface_features(_t(), _words()).items()})


@query(rf"""with {SENT}, x as (select conv_id, turn, i, case when i % 3 = 0 then 'It''s ' || t || ' gonna don''t' else t end txt from sent)
select conv_id, turn, i, round((len(regexp_extract_all(txt, '(?i)\b(?:it|don)''(?:t|s)\b|\bgonna\b')) / greatest(len({words_sql("txt")}), 1))::double, 9) rate from x""")
def contraction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("i") % 3 == 0, F.concat(F.lit("It's "), F.col("t"), F.lit(" gonna don't"))).otherwise(F.col("t"))
    rows = views.sentences(spark, sf_dir).withColumn("text", body)
    return rows.select("conv_id", "turn", "i", _r(counts.contraction_rate(_t(), _words())).alias("rate"))


def _chain(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, $r${pattern}$r$, $r${by}$r$, 'g')"
    return x


_NOT = r"[^\p{L}\p{N}_'-]"
_CHAT_1 = [(r"⌈\d*", ""), (r"\d*⌉\d*", ""), (r"⌊\d*", ""), (r"\d*⌋\d*", ""), (r"&\{[a-z]=\S+\s*", ""), (r"\s*&\}[a-z]=\S+", ""), (r"\[%[^\]]*\]", ""), (r"&=\S+", ""), ("ʔ", ""), (rf"({_NOT})", "\\1\x01"), (rf"(^|\x01)X+($|{_NOT})", r"\1\2"), ("\x01", ""), (r"([\p{L}\p{N}])_([\p{L}\p{N}])", r"\1 \2"), (r"([\p{L}\p{N}])_([\p{L}\p{N}])", r"\1 \2"), (r"([a-zA-Z]):+", r"\1"), (r"\+/\.", "."), (r"\+\.\.\.", "..."), (r"\(\.\.\)", "<pause:long>"), (r"\(\.\)", "<pause:short>")]
_SWB = [(r"[\p{L}\p{N}_]*\[[\p{L}\p{N}_]+\]-", " "), (r"\[laughter-([^\]]+)\]", r"\1"), (r"\[[^\]/]*/([^\]]*)\]", r"\1"), (r"\{([^}]*)\}", r"\1"), ("<[be]_aside>", " "), (r"\[[^\]]*\]", " "), (r"([\p{L}\p{N}_])_\d+(?:_\d+)*", r"\1")]
_NXT = [(r"\[vocalsound:[^\]]*\]|\[disfmarker\]|\[gap\]|\[transformerror\]", " "), (r"([A-Za-z])_", r"\1")]
_MARKED = {
    "chat": "when 0 then '⌈2 ' || t || ' ⌉2 &=laugh (.) word_two' when 1 then '&{l=SPA ' || t || ' &}l=SPA +...' when 2 then 'u:m ' || t || ' (..) +/.' when 3 then 'X ' || t || ' XX [% a note] ʔuh X-ray'",
    "switchboard": "when 0 then '[silence] ' || t || ' w[ord]- them_1' when 1 then '[laughter-yes] {gonna} ' || t when 2 then '<b_aside> ' || t || ' <e_aside> [bidness/business]' when 3 then '[noise]'",
    "nxt": "when 0 then '[vocalsound:laugh] ' || t || ' T_V_ .' when 1 then t || ' [disfmarker] , so' when 2 then '[gap] [transformerror]'",
}


def _marked_sql(corpus: str, cleaned: str, keep: bool) -> str:
    return f"with {SENT}, mk as (select conv_id, turn, i, case (conv_id + turn + i) % 5 {_MARKED[corpus]} else t end txt from sent) select * from (select conv_id, turn, i, {cleaned} as text from mk)" + ("" if keep else " where text <> ''")


@query(_marked_sql("chat", squeeze_sql(_chain("txt", _CHAT_1)), True))
def clean_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.clean(views.marked(spark, sf_dir, "chat"), "chat")


@query(_marked_sql("switchboard", squeeze_sql(_chain("txt", _SWB)), False))
def clean_swb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.clean(views.marked(spark, sf_dir, "switchboard"), "switchboard")


@query(_marked_sql("nxt", _chain(squeeze_sql(_chain("txt", _NXT)), [(r"\s+([,.!?;:])", r"\1")]), False))
def clean_nxt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.clean(views.marked(spark, sf_dir, "nxt"), "nxt")


@query(f"{_U} {punct_sql('txt')} as text from utt")
def norm_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, text=text.normalize_punctuation(_t()))


@query(f"with {PAIRS} select stem, seq, replace(translate(formal_text, '‘’“”‐‑‒–—―', '''''\"\"------'), '…', '...') as text from pv")
def norm_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).select("stem", F.col("seq").cast("long").alias("seq"), text.normalize_typography(F.col("formal_text")).alias("text"))


_P = r"regexp_replace(txt, '<pause:[\p{L}\p{N}_]+>', '%s', 'g')"


@query(f"{_U} {squeeze_sql(_P % '')} as text from utt")
def strip_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, text=text.strip_special(_t()))


@query(f"{_U} {squeeze_sql(_P % ' ')} as text from utt")
def strip_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, text=text.strip_pauses(_t()))


_STYLE_SQL = "case style " + " ".join(f"when '{k}' then '{t}' || chr(10) || '{i}'" for k, (t, i) in formats.STYLES.items()) + " end"
_WRAP = f"{_STYLE_SQL} || chr(10) || chr(10) || 'Input:' || chr(10) || formal_text || chr(10) || chr(10) || 'Output:'"


@query(f"with {PAIRS} select stem, seq, {_WRAP} as input, spoken_text target from pv")
def build_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pairs(spark, sf_dir)
    rows = formats.format_pairs(p, "seq2seq").select("monologue_id", "input", "target")
    return rows.select(F.substring_index("monologue_id", "#", 1).alias("stem"), F.substring_index("monologue_id", "_", -1).cast("long").alias("seq"), "input", "target")


@query(f"with {PAIRS} select stem, seq, case when seq % 4 = 3 then null else trim(formal_text) end as text from pv")
def extract_formal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.format_pairs(views.pairs(spark, sf_dir), "seq2seq")
    seq = F.substring_index("monologue_id", "_", -1).cast("long")
    # a fourth without marks, a fourth cut off before the second mark
    wrapped = F.when(seq % 4 == 3, F.lit("no marks")).when(seq % 4 == 2, F.regexp_replace("input", "\n\nOutput:$", "")).otherwise(F.col("input"))
    return rows.select(F.substring_index("monologue_id", "#", 1).alias("stem"), seq.alias("seq"), formats.extract_formal(wrapped).alias("text"))


@query(f"{_U} sha256('v2' || chr(0) || 'model' || chr(0) || txt || chr(0)) as k from utt")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utt(spark, sf_dir, k=counts.cache_key(F.lit("v2"), F.lit("model"), _t()))


@query(f"with {MONO} select conv_id::varchar stem, conv_id || '#mono_' || printf('%04d', seq) monologue_id, seq::bigint seq, speaker, txt as text, n_tokens::bigint n_tokens from mo")
def turn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = turns.build_monologues(views.utterances(spark, sf_dir))
    return m.select("stem", "monologue_id", F.col("seq").cast("long").alias("seq"), "speaker", "text", F.col("n_tokens").cast("long").alias("n_tokens"))


@query(f"with {MONO} select conv_id::varchar stem, seq::bigint seq from mo where seq <= 1")
def limit_per_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.first_per_stem(turns.build_monologues(views.utterances(spark, sf_dir)), 1).select("stem", F.col("seq").cast("long").alias("seq"))


def _dist(keys: list[str], rows: DataFrame) -> DataFrame:
    return rows.select(*keys, "metric", F.col("n").cast("long").alias("n"), *[_r(F.col(c)).alias(c) for c in ("min", "max", "mean", "median")])


_DIST = "count(*)::bigint n, round(min(value), 9) as min, round(max(value), 9) as max, round(avg(value), 9) as mean, round(median(value), 9) as median"


@query(f"with {MONO} select speaker, 'n_tokens' metric, {_DIST} from (select speaker, n_tokens::double value from mo) group by speaker")
def turn_stats_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = stats.unpivot(turns.build_monologues(views.utterances(spark, sf_dir)), ["speaker"], {"n_tokens": F.col("n_tokens")})
    return _dist(["speaker"], stats.distributions(long, ["speaker"]))


_PM = f"""pw as (select *, {words_sql("spoken_text")} sw, {words_sql("formal_text")} fw from pv),
pm as (select source, stem, style, unnest(['spoken.tokens','spoken.fillers','spoken.pause_short','spoken.pause_long','formal.tokens','formal.fillers','reduction_ratio']) metric,
 unnest([len(sw)::double, {fillers_sql("sw")}::double, len(regexp_extract_all(spoken_text, '<pause:short>'))::double, len(regexp_extract_all(spoken_text, '<pause:long>'))::double, len(fw)::double, {fillers_sql("fw")}::double, (case when len(sw) > 0 then len(fw) / len(sw) else 0 end)::double]) value from pw)"""


@query(f"with {PAIRS}, {_PM} select source, stem, metric, {_DIST} from pm group by grouping sets ((source, stem, metric), (source, metric))")
def stem_and_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dist(["source", "stem"], stats.pair_statistics(views.pairs(spark, sf_dir)))


@query(f"with {PAIRS} select source, count(*)::bigint n_pairs, count(distinct speaker)::bigint n_unique_speakers, array_to_string(list_sort(list(distinct speaker)), ',') speakers from pv group by source")
def pair_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.speakers(views.pairs(spark, sf_dir))
    return out.select("source", F.col("n_pairs").cast("long").alias("n_pairs"), F.col("n_unique_speakers").cast("long").alias("n_unique_speakers"), F.array_join("speakers", ",").alias("speakers"))


@query(f"with {PAIRS} select stem, seq, round((case when len(s) > 0 then len(f) / len(s) else 0 end)::double, 9) ratio from (select stem, seq, {words_sql('spoken_text')} s, {words_sql('formal_text')} f from pv)")
def pair_reduction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).select("stem", F.col("seq").cast("long").alias("seq"), _r(counts.rate(F.size(counts.tokens(F.col("formal_text"))), F.size(counts.tokens(F.col("spoken_text"))))).alias("ratio"))


@query(f"""with {PAIRS}, f as (select style, {_SURFACE} from (select style, spoken_text txt, {words_sql("spoken_text")} w from pv)),
l as (select style, unnest(['tokens','filler_rate','pause_rate','tokens_per_sentence']) feature, unnest([tokens::double, filler_rate::double, pause_rate::double, tokens_per_sentence::double]) v from f),
g as (select feature, avg(v) filter (style = 'casual') cm, avg(v) filter (style = 'semi_formal') sm, var_samp(v) filter (style = 'casual') cv, var_samp(v) filter (style = 'semi_formal') sv, count(*) filter (style = 'casual') cn, count(*) filter (style = 'semi_formal') sn from l group by feature),
p as (select *, ((cn - 1) * cv + (sn - 1) * sv) / (cn + sn - 2) ps from g), d as (select *, case when ps > 0 then (sm - cm) / sqrt(ps) else 0 end d from p),
m as (select max(abs(d)) filter (feature in ('filler_rate','tokens_per_sentence')) a, max(abs(d)) b from d)
select feature, round(cm, 8) casual_mean, round(sm, 8) semi_formal_mean, round(d, 8) cohens_d, case feature when 'tokens' then null when 'tokens_per_sentence' then 'semi_formal_higher' else 'casual_higher' end expected,
case feature when 'tokens' then null when 'tokens_per_sentence' then d > 0 else d < 0 end matches_expected, feature in ('filler_rate','tokens_per_sentence') used_for_verdict, round(a, 8) max_abs_d, round(b, 8) max_abs_d_all, a < 0.2 collapsed from d, m""")
def style_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.style_separation(views.pairs(spark, sf_dir), "spoken_text")
    return out.withColumns({c: F.round(c, 8) for c in ("casual_mean", "semi_formal_mean", "cohens_d", "max_abs_d", "max_abs_d_all")})


@query(f"with {PAIRS}, c as (select speaker, meeting_type, count(*) n from pv group by all) select speaker, meeting_type from (select *, row_number() over (partition by speaker order by n desc, meeting_type) r from c) where r = 1")
def speaker_majority_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.majority_type(views.pairs(spark, sf_dir))


@query(f"with {PAIRS} select stem, case when stem::bigint % 4 = 0 then 'unknown' else arg_min(meeting_type, pos) end meeting_type from pv group by stem")
def stem_meeting_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pairs(spark, sf_dir)
    return split.stem_types(p.withColumn("meeting_type", F.when(F.col("stem").cast("long") % 4 != 0, F.col("meeting_type"))))


@query(f"with {MONO} select conv_id::varchar stem, seq::bigint seq, conv_id % 2 = 0 from_cache, case when conv_id % 2 = 0 then 'kept ' else 'new ' end || {squeeze_sql(_P % '')} response from mo")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = turns.build_monologues(views.utterances(spark, sf_dir)).withColumn("user", text.strip_special(_t()))
    kept = m.where(F.col("stem").cast("long") % 2 == 0)
    key = counts.cache_key(F.lit("v"), F.lit("model"), F.col("user"))
    # of equal texts in odd and even conversations, the cache has the even ones' key
    odd = m.where(F.col("stem").cast("long") % 2 == 1).select(key.alias("key"))
    cache = kept.select(key.alias("key"), F.concat(F.lit("kept "), "user").alias("response")).join(odd, "key", "left_anti")
    rows, _ = pairing.with_responses(m, "user", cache, lambda system, user: f"new {user}", "", "model", "v")
    return rows.select("stem", F.col("seq").cast("long").alias("seq"), "from_cache", "response")


@query(f"""with {UTT}, n as (select *, row_number() over (partition by conv_id order by pos) k from (select conv_id, pos, speaker, {squeeze_sql("txt")} txt from utt))
select conv_id::varchar stem, conv_id || '#' || printf('%04d', k) utterance_id, upper(speaker) speaker, txt as text, k * 10 t_start_ms, k * 10 + 7 t_end_ms from n""")
def chat_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views.utterances(spark, sf_dir)
    line = lambda x, k: F.concat(F.lit("*"), F.upper(x["speaker"]), F.lit(":\t"), text.squeeze(x["text"]), F.lit("\n\t"), F.lit("\x15"), ((k + 1) * 10).cast("string"), F.lit("_"), ((k + 1) * 10 + 7).cast("string"), F.lit("\x15"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "speaker", "text"))), line), "\n")
    docs = u.groupBy("stem").agg(body.alias("body")).select(F.concat("stem", F.lit(".cha")).alias("file"), F.concat(F.lit("@Begin\n@Languages:\teng\n\n"), "body", F.lit("\n@End")).alias("content"))
    return files.parse_chat(docs).select("stem", "utterance_id", "speaker", "text", "t_start_ms", "t_end_ms")


@query(f"""with {SENT}, n as (select conv_id, case when turn % 2 = 0 then 'A' else 'B' end side, i, turn, t, turn * 3 + i s from sent)
select conv_id::varchar stem, row_number() over (partition by conv_id order by s, side, turn, i)::bigint pos, conv_id || '#' || side || '_' || printf('%04d', turn * 1000 + i) utterance_id, side speaker, {squeeze_sql("t")} as text, (s * 1000 + 500)::bigint t_start_ms from n""")
def interleave_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sentences(spark, sf_dir).withColumn("side", F.when(F.col("turn") % 2 == 0, "A").otherwise("B")).withColumn("s", F.col("turn") * 3 + F.col("i"))
    line = lambda x: F.concat(F.lit("sw-"), F.format_string("%04d", x["turn"] * 1000 + x["i"]), F.lit(" "), x["s"].cast("string"), F.lit(".5 "), (x["s"] + 1).cast("string"), F.lit(".25 "), text.squeeze(x["t"]))
    docs = s.groupBy("conv_id", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "i", "s", "t"))), line), "\n").alias("content"))
    docs = docs.select(F.concat(F.col("conv_id").cast("string"), "side", F.lit("-ms98-a-trans.text")).alias("file"), "content")
    return files.parse_switchboard(docs).select("stem", "pos", "utterance_id", "speaker", "text", "t_start_ms")


@query(f"""with {SENT} select conv_id::varchar stem, row_number() over (partition by conv_id order by turn * 3 + i, turn % 2, turn, i)::bigint pos, conv_id || '#s' || (turn * 1000 + i) utterance_id, case when turn % 2 = 0 then 'name' || conv_id else conv_id || '.B' end speaker, {squeeze_sql("t")} || case when i % 2 = 0 then '. [vocalsound:laugh]' else '' end as text, ((turn * 3 + i) * 1000)::bigint t_start_ms from sent""")
def nxt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sentences(spark, sf_dir).withColumn("agent", F.when(F.col("turn") % 2 == 0, "A").otherwise("B"))
    n = lambda x: (x["turn"] * 1000 + x["i"]).cast("string")
    space = 'xmlns:nite="http://nite.sourceforge.net/"'
    word = lambda x: F.concat(F.array_join(F.transform(F.split(text.squeeze(x["t"]), " "), lambda w, k: F.concat(F.lit('<w nite:id="w'), n(x), F.lit("."), k.cast("string"), F.lit('">'), w, F.lit("</w>"))), ""), F.when(x["i"] % 2 == 0, F.concat(F.lit('<w punc="true" nite:id="p'), n(x), F.lit('">.</w><vocalsound type="laugh" nite:id="v'), n(x), F.lit('"/>'))).otherwise(F.lit("")))
    last = lambda x: F.when(x["i"] % 2 == 0, F.concat(F.lit("v"), n(x))).otherwise(F.concat(F.lit("w"), n(x), F.lit("."), (F.size(F.split(text.squeeze(x["t"]), " ")) - 1).cast("string")))
    segment = lambda x: F.concat(F.lit('<segment nite:id="s'), n(x), F.lit('" transcriber_start="'), (x["turn"] * 3 + x["i"]).cast("string"), F.lit('"><nite:child href="f#id(w'), n(x), F.lit(".0)..id("), last(x), F.lit(')"/></segment>'))
    rows = s.groupBy("conv_id", "agent").agg(F.array_sort(F.collect_list(F.struct("turn", "i", "t"))).alias("x"))
    wrap = lambda f: F.concat(F.lit(f"<root {space}>"), F.array_join(F.transform("x", f), ""), F.lit("</root>"))
    base = F.concat_ws(".", F.col("conv_id").cast("string"), "agent")
    docs = rows.select(F.inline(F.array(F.struct(F.concat(base, F.lit(".words.xml")).alias("file"), wrap(word).alias("content")), F.struct(F.concat(base, F.lit(".segments.xml")).alias("file"), wrap(segment).alias("content")))))
    meetings = rows.where("agent = 'A'").select(F.concat(F.lit('<meetings><meeting type="scenario" observation="'), F.col("conv_id").cast("string"), F.lit('"><speaker nxt_agent="A" global_name="name'), F.col("conv_id").cast("string"), F.lit('" role="PM"/></meeting></meetings>')).alias("content"))
    return files.parse_nxt(docs, files.nxt_speakers(meetings)).select("stem", "pos", "utterance_id", "speaker", "text", "t_start_ms")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pairs(spark, sf_dir)
    rows = formats.format_pairs(p, "seq2seq").withColumn("seq", F.substring_index("monologue_id", "_", -1).cast("long")).withColumn("stem", F.substring_index("monologue_id", "#", 1))
    return rows.select("pair_id", "stem", "seq", "style", "input", F.when(F.col("seq") % 3 != 0, F.col("target")).alias("reference"), F.when(F.col("seq") % 5 != 0, F.concat(F.lit("well , "), "target")).otherwise(F.lit("")).alias("prediction"))


@query(f"""with {PAIRS}, s as (select case when seq % 5 <> 0 then 'well , ' || spoken_text else '' end p, case when seq % 3 <> 0 then spoken_text else '' end r from pv),
b as (select 'prediction' side, p txt from s union all select 'reference', r from s), w as (select *, {words_sql("txt")} w from b),
l as (select side, unnest(['tokens','fillers','pause_short','pause_long','commas','questions','periods','exclaims','space_before_punct']) metric, unnest([len(w)::double, {fillers_sql("w")}::double, len(regexp_extract_all(txt, '<pause:short>'))::double, len(regexp_extract_all(txt, '<pause:long>'))::double, len(regexp_extract_all(txt, ','))::double, len(regexp_extract_all(txt, '\\?'))::double, len(regexp_extract_all(txt, '\\.'))::double, len(regexp_extract_all(txt, '!'))::double, len(regexp_extract_all(regexp_replace(txt, '<pause:[\\p{{L}}\\p{{N}}_]+>', ' ', 'g'), ' +[.,?!;:]'))::double]) value from w
union all select 'ratio', unnest(['length_pred_over_ref','empty_prediction']), unnest([(case when len({words_sql("r")}) > 0 then len({words_sql("p")}) / len({words_sql("r")}) else 0 end)::double, (trim(p) = '')::int::double]) from s)
select side, metric, {_DIST} from l group by all""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dist(["side"], evaluate.evaluate(_predictions(spark, sf_dir)))


def _p_sql(x: str) -> str:
    """P(spoken) by the query's weights."""
    w = words_sql(x)
    sentences = f"greatest(len(list_filter(regexp_split_to_array(regexp_replace({x}, '<pause:(?:short|long)>', ' ', 'g'), '[.!?]+'), lambda s: trim(s) <> '')), 1)"
    contractions = rf"len(regexp_extract_all({x}, '(?i)[\p{{L}}\p{{N}}_]+''(?:t|s|re|ve|ll|m|d)\b|\b(?:gonna|wanna|gotta|kinda|gimme|lemme|dunno)\b'))"
    return f"1 / (1 + exp(-(0.2::double + 8.0::double * case when len({w}) > 0 then {fillers_sql(w)} / len({w}) else 0.0::double end - 0.05::double * case when len({w}) > 0 then len({w}) / {sentences} else 0.0::double end + 6.0::double * {contractions} / greatest(len({w}), 1))))"


@query(f"""with {PAIRS}, s as (select style, trim(formal_text) f, case when seq % 5 <> 0 then 'well , ' || spoken_text else '' end p, case when seq % 3 <> 0 then spoken_text else '' end r from pv),
v as (select style, {_p_sql("f")} a, {_p_sql("p")} b, {_p_sql("r")} c from s),
l as (select style, unnest(['input','prediction','delta','reference']) metric, unnest([a, b, b - a, c]) value from v)
select style, metric, {_DIST} from l group by grouping sets ((style, metric), (metric))""")
def spokenness_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda rows, body, out: evaluate.logistic_score(rows, body, {"filler_rate": 8.0, "tokens_per_sentence": -0.05, "contraction_rate": 6.0}, 0.2, out)
    return _dist(["style"], evaluate.spoken_shift(_predictions(spark, sf_dir), score))


@query()
def spokenness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pairs(spark, sf_dir)
    model, _ = evaluate.train_spokenness(p)
    return evaluate.score_spokenness(p.select("pair_id", "spoken_text"), "spoken_text", model).select("pair_id", F.round("p_spoken", 6).alias("p_spoken"))


@query()
def split_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_by_speaker(views.pairs(spark, sf_dir)).select("pair_id", "speaker", "split")


_PART = "case when {n} < 13 then 'train' when {n} < 15 then 'validation' else 'test' end"


@query(f"""with {PAIRS}, s as (select speaker, {_PART.format(n="split_part(speaker, '-', 2)::int")} split from pv)
select split, count(*)::bigint n_rows, count(distinct speaker)::bigint n_speakers, array_to_string(list_sort(list(distinct speaker)), ',') speakers, case split when 'train' then 0.8::double else 0.1::double end ratio, 42 seed, 'speaker_aware_greedy' strategy from s group by split""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pairs(spark, sf_dir).withColumn("split", F.expr(_PART.format(n="cast(substring_index(speaker, '-', -1) as int)")))
    return split.split_manifest(rows, (0.8, 0.1, 0.1), 42).withColumn("speakers", F.array_join("speakers", ","))


@query()
def sample_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample_balanced(views.pairs(spark, sf_dir), target=200).select("monologue_id", "speaker", "meeting_type")


_PIECES = r"regexp_extract_all(%s, '<pause:[\p{L}\p{N}_]+>|[A-Za-z0-9''-]+')"
_PAUSES = "list_transform(list_filter(range(1, len({t}) + 1), lambda i: {t}[i][1] = '<'), lambda i: {{'n': len(list_filter({t}[1:i], lambda x: x[1] <> '<')), 'p': {t}[i]}})"


@query(f"with {UTT} select conv_id, pos, array_to_string(list_transform({_PAUSES.format(t='t')}, lambda x: x.n || x.p), ',') positions from (select *, {_PIECES % 'txt'} t from utt)")
def pause_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.transform(pairing.pause_positions(_t()), lambda x: F.concat(x["n"].cast("string"), x["pause"]))
    return _utt(spark, sf_dir, positions=F.array_join(at, ","))


_BARE = squeeze_sql(r"regexp_replace(spoken_text, '<pause:[\p{L}\p{N}_]+>', ' ', 'g')")
_AT = "array_to_string(list_transform(list_filter(ps, lambda x: x.n = {n}), lambda x: x.p), ' ')"
_RESTORED = f"array_to_string(list_transform(range(1, len(w) + 2), lambda i: coalesce(g[i], '') || case when i > len(w) then '' when {_AT.format(n='i - 1')} <> '' then {_AT.format(n='i - 1')} || ' ' || w[i] else w[i] end), '') || case when {_AT.format(n='len(w)')} <> '' then ' ' || {_AT.format(n='len(w)')} else '' end"


@query(f"""with {PAIRS}, a as (select stem, seq, spoken_text, regexp_replace({_BARE}, ' ,', ',', 'g') a, {_PIECES % 'spoken_text'} t from pv),
q as (select *, {_PAUSES.format(t="t")} ps, regexp_extract_all(a, '[A-Za-z0-9''-]+') w, regexp_split_to_array(a, '[A-Za-z0-9''-]+') g from a), z as (select *, {_RESTORED} z from q)
select stem, seq, case when seq % 3 = 0 then 'word_mismatch' else 'ok' end reason, case when seq % 3 = 0 then spoken_text else {punct_sql("z")} end as text from z""")
def repunct(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.strip_pauses(F.col("spoken_text"))
    p = views.pairs(spark, sf_dir).withColumn("answer", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("other "), plain)).otherwise(F.regexp_replace(plain, " ,", ",")))
    return pairing.repunctuate(p).select("stem", F.col("seq").cast("long").alias("seq"), "reason", F.col("spoken_text").alias("text"))


@query(f"""with {MONO} select conv_id || '#mono_' || printf('%04d', seq) || '#casual#v2-zero-shot' pair_id, {punct_sql("txt")} spoken_text, '"' || {squeeze_sql(_P % "")} || '"' formal_text,
'{{"finish_reason": "stop","model":"m","model_alias":"m","prompt_version":"v2-zero-shot","from_cache":false}}' metadata from mo""")
def to_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = turns.build_monologues(views.utterances(spark, sf_dir))
    none = spark.createDataFrame([], pairing.CACHE_SCHEMA)
    made, _ = pairing.to_pairs(m, none, lambda system, user: (f"“{user}”", {"finish_reason": "stop"}), model="m")
    return made.select("pair_id", "spoken_text", "formal_text", "metadata")


@query(f"with {PAIRS} select monologue_id, [{{'role': 'user', 'content': {_WRAP}}}, {{'role': 'assistant', 'content': spoken_text}}]::json::varchar messages from pv")
def format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.format_pairs(views.pairs(spark, sf_dir), "chat").select("monologue_id", F.to_json("messages").alias("messages"))


@query("with h as (select event_id pos, event_id % 7 step, event_id % 3 k, value from events) select case when k = 0 then 'eval' else 'train' end series, step::bigint step, round(value, 9) loss, pos from h where step <> 6 and k < 2")
def log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.col("event_id") % 3).withColumn("s", F.col("event_id") % 7)
    h = e.select(F.col("event_id").alias("pos"), F.when(F.col("s") != 6, F.col("s")).alias("step"), F.when(F.col("k") < 2, F.col("value") * F.when(F.col("k") == 0, 2).otherwise(1)).alias("loss"), F.when(F.col("k") == 0, F.col("value")).alias("eval_loss"))
    return evaluate.loss_series(h).select("series", "step", _r(F.col("loss")).alias("loss"), "pos")


_TELEPHONE = MONO.replace("'yeah yeah yeah yeah'", "'um hum'").replace(views._LEXICON, views._LEXICON + ",'um','hum','uh','huh'")


@query(f"with {_TELEPHONE} select conv_id::varchar stem, seq::bigint seq, speaker, txt as text from mo")
def turn_merge_telephone(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views.utterances(spark, sf_dir).withColumn("text", F.when(F.col("text") == "yeah yeah yeah yeah", "um hum").otherwise(F.col("text")))
    m = turns.build_monologues(u, lexicon=files.CORPORA["switchboard"].backchannels)
    return m.select("stem", F.col("seq").cast("long").alias("seq"), "speaker", "text")


@query("select conv_id || '.cha' file, 'Turn' as name, string_agg(role || ' ' || turn, '|' order by turn) as vals from conversations group by conv_id union all select distinct conv_id || '.cha', unnest(['Begin', 'End']), '' from conversations")
def chat_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda x: F.concat(F.lit("@Turn:\t"), x["role"], F.lit("\n\t"), x["turn"].cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), line), "\n*X:\tno header\n")
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(body.alias("body"))
    docs = docs.select(F.concat(F.col("conv_id").cast("string"), F.lit(".cha")).alias("file"), F.concat(F.lit("@Begin\n"), "body", F.lit("\n@End")).alias("content"))
    return files.chat_headers(docs).select("file", F.explode("headers").alias("name", "vals")).withColumn("vals", F.array_join("vals", "|"))


@query("select distinct conv_id || '.' || (conv_id % 3) stem from conversations where conv_id % 2 = 0")
def stem_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    name = F.concat(c.cast("string"), F.lit("."), (c % 3).cast("string"), F.when(c % 2 == 0, ".cha").otherwise(".chat"))
    return files.stems(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(name.alias("file")), ".cha")


@query("select conv_id::varchar stem, turn::int n_tokens, case when turn % 2 = 0 then text end as text from conversations where turn % 3 <> 0")
def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text")
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("stem"), F.col("turn").alias("n_tokens"), t, F.lit(1).alias("more")), {"ignoreNullFields": "false"})
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.when(F.col("turn") % 3 == 0, F.lit(" \t")).otherwise(line).alias("value"))
    return files.parse_jsonl(lines, "stem string, n_tokens int, text string", ("stem",))


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


@query(_values([(k, *v) for k, v in formats.STYLES.items()], "style, style_token, instruction"))
def style_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.style_table(spark)


@query(_values([(k, *v) for k, v in formats.MODELS.items()], "model, format, hub_id"))
def model_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.model_table(spark)
