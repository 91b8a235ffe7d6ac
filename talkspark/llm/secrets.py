r"""Secret scans by a trigram inverted index (operator 1).

DataFrame and SQL functions only. ``trigram_query`` derives from each rule's regex a
Boolean query over trigrams: an OR of ANDs that every text with a match satisfies. The
index holds a posting (trigram, row key) for each trigram of the rules' vocabulary and each
text that has it, over folded text; postings of one clause are intersected by OR-ing one bit
a trigram, and only rows that satisfy some clause of a rule are verified by its regex.
Rules without mandatory trigrams (``hex``) scan every text. The candidates (a key and rule names) are
staged, so that Spark knows their size when it chooses how to bring them to the texts: to all
executors where they are few, else by a shuffle.

Spans are leftmost non-overlapping matches by rule, in code points, end exclusive. Texts
are read whole: the pieces between matches give the offsets, so no text is cut. Running sums over
matches go in blocks of about the square root of their number, so very long texts with very
many matches stay far from quadratic time.

Nulls: a null text counts as empty; a null doc_id is kept. Repeated rows each get their
own, equal row. Ties: spans of different rules may overlap or start together, and each counts,
in the order of the rules. An empty table gives an empty result. Extra columns are ignored;
``redact`` returns them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import Staged, fresh, read_table, row_key

_parse, _C = re._parser.parse, re._constants


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1  # characters of the group


#: The contract's rules, in its order, then further ones. Patterns mean the same in Java and Python.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: For rules that scan every text: a regex that holds wherever the rule has a match, cheaper than the rule's own matches.
FULL_SCAN = {"hex": r"[0-9a-f]{24}"}

_MOST = 64  # strings or clauses kept; beyond it conjuncts are dropped, which only widens the query


def _exact(items: list) -> set[str] | None:
    """The folded strings that a piece of a regex matches, if they are few."""
    out = {""}
    for op, arg in items:
        if op is _C.LITERAL and arg < 128:
            more = {chr(arg).lower()}
        elif op is _C.IN and all(o is _C.LITERAL and a < 128 for o, a in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op is _C.SUBPATTERN:
            more = _exact(arg[3])
        elif op is _C.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT) and (arg[0], arg[1]) == (0, 1):
            more = _exact(arg[2])
            more = more and more | {""}
        else:
            more = None
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams; a folded text with a match has all trigrams of at least one. None: no mandatory trigrams."""
    clauses: list[frozenset[str]] = [frozenset()]

    def conjoin(strings: set[str]) -> None:
        nonlocal clauses
        if all(len(s) >= 3 for s in strings) and len(clauses) * len(strings) <= _MOST:
            clauses = list(dict.fromkeys(c | {s[i : i + 3] for i in range(len(s) - 2)} for c, s in product(clauses, sorted(strings))))

    def walk(items: list) -> None:
        run = {""}
        for item in items:
            op, arg = item
            more = _exact([item])
            if more is not None and len(run) * len(more) <= _MOST:
                run = {a + b for a in run for b in more}
                continue
            conjoin(run)
            run = {""}
            if more is not None:
                run = more
            elif op is _C.SUBPATTERN:
                walk(arg[3])
            elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        conjoin(run)

    walk(list(_parse(pattern)))
    clauses = [c for c in clauses if not any(d < c for d in clauses)]
    return None if frozenset() in clauses else clauses


def posting_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, rid): which texts have which of the vocabulary's trigrams, folded."""
    folded = docs.select("rid", F.lower("body").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams]))
    return folded.select("rid", F.explode(has).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(rid, kinds): rows whose postings satisfy some clause of a rule's query."""
    bits = []
    for rule in rules:
        for n, clause in enumerate(trigram_query(rule.pattern) or ()):
            bits += [(rule.kind, n, g, 1 << i, (1 << len(clause)) - 1) for i, g in enumerate(sorted(clause))]
    grams = sorted({b[2] for b in bits})
    by_gram = F.create_map(*[x for g in grams for x in (F.lit(g), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("clause"), F.lit(bit).cast("long").alias("bit"), F.lit(full).cast("long").alias("full")) for k, n, gg, bit, full in bits if gg == g]))])
    hits = posting_index(docs, grams).select("rid", F.inline(by_gram[F.col("gram")]))
    met = hits.groupBy("rid", "kind", "clause", "full").agg(F.bit_or("bit").alias("got")).where("got = full")
    return met.groupBy("rid").agg(F.collect_set("kind").alias("kinds"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """The items in blocks of about the square root of their number."""
    wide = F.ceil(F.sqrt(F.size(items))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / wide).cast("int") - 1), lambda k: F.slice(items, k * wide + 1, wide))
    return F.when(F.size(items) > 0, cut).otherwise(F.filter(F.array(items), lambda x: F.lit(False)))


def running(items: Column, zero: Column, onward: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit`` of what came before each item and the item; ``onward`` moves that on. Block by block, so that arrays that grow stay short."""
    none = F.array().cast(f"array<{kind}>")

    def within(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(onward(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def starts(blocks: Column) -> Column:
        step = lambda acc, block: F.struct(F.aggregate(block, acc["at"], onward).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    return bind(_blocks(items), lambda blocks: bind(starts(blocks), lambda at: F.flatten(F.transform(blocks, lambda block, i: within(block, F.get(at, i))))))


SPAN = "struct<start:int,ord:int,end:int,kind:string>"


HIT = "struct<gap:int,hit:int,ok:boolean>"


def hits_of(text: Column, rule: Rule) -> Column:
    """array<struct(gap, hit, ok)> of the rule's matches: the code points before each since the last one and in it, and whether it passes."""
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("grp"))
    found = F.filter(found, lambda x: x["hit"].isNotNull())
    return F.transform(found, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), (F.char_length(x["grp"]) >= rule.least).alias("ok")))


def spans_by_rule(text: Column, kinds: Column, rules: tuple[Rule, ...]) -> Column:
    """All spans by start, then rule; ``kinds`` are the rules with an index that the text is a candidate of."""
    parts = []
    for n, rule in enumerate(rules):
        indexed = trigram_query(rule.pattern) is not None
        test = F.array_contains(kinds, rule.kind) if indexed else text.rlike(FULL_SCAN.get(rule.kind, rule.pattern))
        hits = F.when(test, hits_of(text, rule)).otherwise(F.array().cast(f"array<{HIT}>"))
        parts.append(F.struct(F.lit(n).alias("ord"), F.lit(rule.kind).alias("kind"), hits.alias("hits")))

    def spans(r: Column) -> Column:
        onward = lambda at, x: at + x["gap"] + x["hit"]
        span = lambda at, x: F.struct((at + x["gap"]).alias("start"), r["ord"].alias("ord"), onward(at, x).alias("end"), F.when(x["ok"], r["kind"]).alias("kind"))
        return running(r["hits"], F.lit(0), onward, span, SPAN)

    found = F.filter(F.array(*parts), lambda r: F.size(r["hits"]) > 0)
    return F.array_sort(F.filter(F.flatten(F.transform(found, spans)), lambda x: x["kind"].isNotNull()))


def _candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    slim = docs.select(row_key().alias("rid"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    return Staged(docs.sparkSession, "secrets").put(candidates(slim, tuple(r for r in rules if trigram_query(r.pattern) is not None)), "candidates")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row a document: rid, doc_id, body (the text, null: empty) and spans by start, then rule."""
    out = docs.select(row_key().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body")).join(_candidates(docs, rules), "rid", "left")
    return out.select("rid", "doc_id", "body", spans_by_rule(F.col("body"), F.col("kinds"), rules).alias("spans"))


def covered(text: Column, spans: Column, by: str) -> Column:
    """The text with ``by`` for the characters of the spans (by start); spans that overlap or touch become one."""
    seen = running(spans, F.lit(-1), lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.struct(F.greatest(at, F.lit(0)).alias("free"), x["start"].alias("start"), (x["start"] > at).alias("new")), "struct<free:int,start:int,new:boolean>")

    def gaps(block: Column) -> Column:
        """The text before each run; a block's part of the text is cut out first, so that none is counted through from its start."""
        low = F.element_at(block, 1)["free"]
        part = F.struct(low.alias("low"), F.substring(text, low + 1, F.element_at(block, -1)["start"] - low).alias("text"))
        return bind(part, lambda p: F.transform(block, lambda x: F.substring(p["text"], x["free"] - p["low"] + 1, x["start"] - x["free"])))

    runs = bind(F.filter(seen, lambda x: x["new"]), lambda heads: F.flatten(F.transform(_blocks(heads), gaps)))
    return F.array_join(F.concat(runs, F.array(F.substring(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.char_length(text)))), by)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The documents with each secret's characters replaced by [SECRET]; overlapping spans become one. n_chars follows the text."""
    rid, kinds, spans = (fresh(docs, c) for c in ("rid", "kinds", "spans"))
    out = docs.withColumn(rid, row_key()).join(_candidates(docs, rules).withColumnsRenamed({"rid": rid, "kinds": kinds}), rid, "left")
    out = out.withColumn(spans, spans_by_rule(F.coalesce(F.col("text"), F.lit("")), F.col(kinds), rules))
    out = out.withColumn("text", F.when(F.size(spans) > 0, covered(F.col("text"), F.col(spans), "[SECRET]")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: reduce(lambda a, b: a | b, [x["kind"] == r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", label), ",").alias("spans"))


def oracle() -> str:
    """DuckDB SQL for op1_secrets: every rule scans every text."""
    parts = [
        f"""select r, {n} ord, '{rule.kind}' kind, {rule.least} least, regexp_extract_all(t, $re${rule.pattern}$re$, 0) hit, regexp_extract_all(t, $re${rule.pattern}$re$, {rule.group}) grp, regexp_split_to_array(t, $re${rule.pattern}$re$) gap from d"""
        for n, rule in enumerate(BASE_RULES + MORE_RULES)
    ]
    base = ",".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') n_{r.kind}" for r in BASE_RULES)
    return f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
m as ({" union all ".join(parts)}),
u as (select r, ord, kind, least, unnest(range(1, len(hit) + 1)) i, unnest(hit) hit, unnest(grp) grp, unnest(gap[1:len(hit)]) gap from m),
s as (select r, ord, kind, i, length(grp) >= least ok, length(hit) n, sum(length(gap) + length(hit)) over (partition by r, ord order by i) stop from u),
f as (select r, ord, kind, stop - n st, stop en from s where ok),
g as (select r, {counts},
  string_agg(kind || ':' || st::bigint || ':' || en::bigint, ',' order by st, ord) filter (kind in ({base})) b,
  string_agg(kind || ':' || st::bigint || ':' || en::bigint, ',' order by st, ord) spans from f group by r)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans from d left join g using (r)"""
