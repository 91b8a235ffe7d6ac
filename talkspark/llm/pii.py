r"""Personal data: patterns propose, checksums confirm, context words adjust a score (operator 5).

Kinds email, ip, card (Luhn) and phone follow the contract; iban (mod-97), ssn, routing
(weighted sum mod 10), imei (Luhn) and mac are added. A span's score, in hundredths, starts from
its kind, rises by ``STEP`` where one of the kind's context words stands within ``NEAR``
characters before or after it, and falls by as much beside words of other numbers (order,
invoice, version). Base spans all stay, whatever their score; a span of an added kind counts
only from ``LEAST`` on, so a bare number with nine or fifteen digits needs its context.

Whole texts, in Python over Arrow batches; a text without ``@`` or digits costs two substring
tests. Every pattern is written so that no part of a text is read more than a bounded number
of times, so very long texts and runs of digits take time in proportion.

Nulls: a null text counts as empty; a null doc_id is kept. Repeated rows get equal results.
Ties: spans of different kinds may overlap, and each counts. An empty table gives an empty
result. Extra columns are ignored. Offsets are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import chunked, keyed, read_table

BASE = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits is tried at its start alone: from the middle it would fail, too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Patterns of the added kinds, of ASCII words.
ADDED = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "routing": r"\b[0-9]{9}\b",
    "imei": r"\b[0-9]{15}\b",
    "mac": r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b",
}
KINDS = (*BASE, *ADDED)
#: Hundredths that a kind starts from, and the words (of folded text) that raise its score.
CONTEXT = {
    "email": (80, r"\b(?:e-?mail|contact|write|address|correo|courriel)\b"),
    "ip": (50, r"\b(?:ip|host|server|address|login|client)\b"),
    "card": (60, r"\b(?:card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta)\b"),
    "phone": (60, r"\b(?:phone|call|tel|mobile|fax|telefon|telefono)\b"),
    "iban": (80, r"\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "ssn": (50, r"\b(?:ssn|social|security|taxpayer)\b"),
    "routing": (20, r"\b(?:routing|aba|bank|transit|account)\b"),
    "imei": (20, r"\b(?:imei|device|handset)\b"),
    "mac": (60, r"\b(?:mac|ethernet|adapter|interface)\b"),
}
ELSE = r"\b(?:order|invoice|version|serial|isbn|ticket)\b"
STEP, NEAR, LEAST = 30, 40, 50
_ADDED = {k: re.compile(p, re.A) for k, p in ADDED.items()}
_CONTEXT = {k: (n, re.compile(p, re.A)) for k, (n, p) in CONTEXT.items()}
_ELSE = re.compile(ELSE, re.A)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _iban(hit: str) -> str | None:
    """The run may go on into words in capitals: up to three are left out."""
    for _ in range(4):
        if mod97(hit.replace(" ", "")):
            return hit
        hit = hit.rpartition(" ")[0] or hit
    return None


def _ssn(hit: str) -> str | None:
    return hit if hit[:3] not in ("000", "666") and hit[0] != "9" and hit[4:6] != "00" and hit[7:] != "0000" else None


def _routing(hit: str) -> str | None:
    return hit if hit != "0" * 9 and sum(int(c) * w for c, w in zip(hit, (3, 7, 1) * 3, strict=True)) % 10 == 0 else None


#: What a checksum leaves of a match.
_CHECK = {"iban": _iban, "ssn": _ssn, "routing": _routing, "imei": lambda hit: hit if luhn(hit) else None, "mac": lambda hit: hit}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, each found from its @: the local part is the run before it, not past the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def score(text: str, kind: str, start: int, end: int) -> int:
    base, words = _CONTEXT[kind]
    near = [x.translate(_FOLD) for x in (text[max(0, start - NEAR) : start], text[end : end + NEAR])]
    hit = lambda p: any(p.search(x) for x in near)
    return max(0, min(100, base + STEP * hit(words) - STEP * hit(_ELSE)))


def find(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score) by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    small = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or "0") <= 255
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    found = [(k, a, b, score(text, k, a, b)) for k, a, b in out]
    for kind, pattern in _ADDED.items():
        for m in pattern.finditer(text):
            if (left := _CHECK[kind](m[0])) is not None:
                end = m.start() + len(left)
                if (n := score(text, kind, m.start(), end)) >= LEAST:
                    found.append((kind, m.start(), end, n))
    return found


_DIGIT = re.compile(r"[0-9]")
SPANS = "array<struct<kind:string,start:int,end:int,score:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: rid, doc_id and spans (kind, start, end, score in hundredths) by kind, then start."""
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches):
            spans = []
            for raw in texts:
                t = raw.decode("utf-8", "replace")
                found = find(t) if "@" in t or _DIGIT.search(t) else []
                spans.append([{"kind": k, "start": a, "end": b, "score": n} for k, a, b, n in found])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(spans, kind_of)], ["rid", "doc_id", "spans"])

    docs = keyed(docs)
    return docs.mapInArrow(work, f"rid string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_spans, scores (in hundredths, in the order of spans) and score (the highest, 0 to 1)."""
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    extra = [F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"), (F.coalesce(F.array_max("spans.score"), F.lit(0)).cast("double") / 100).alias("score")]
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), *extra)


_SQL_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_SQL_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: (ascii(d[length(d) - i + 1]) - 48) * (2 - i % 2) - case when (ascii(d[length(d) - i + 1]) - 48) * (2 - i % 2) > 9 then 9 else 0 end)) % 10 = 0"
_SQL_MOD97 = "length(replace(h, ' ', '')) between 15 and 34 and list_reduce(list_transform(string_split(replace(h, ' ', '')[5:] || replace(h, ' ', '')[1:4], ''), lambda c: case when ascii(c) > 64 then ascii(c) - 55 else ascii(c) - 48 end), lambda a, x: (a * case when x > 9 then 100 else 10 end + x) % 97) = 1"
_SQL_SHORTER = r"regexp_replace(%s, '\x20[A-Z0-9]+$', '')"


def oracle() -> str:
    """DuckDB SQL for op5_pii: the contract's patterns as they stand, and the added kinds."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", **ADDED}
    small = "coalesce(try_cast(ltrim(p, '0') as int), case when ltrim(p, '0') = '' then 0 else 256 end) <= 255"
    ends = ["hit"]
    for _ in range(3):
        ends.append(_SQL_SHORTER % ends[-1])
    kept = {
        "email": "hit",
        "ip": f"case when len(list_filter(string_split(hit, '.'), lambda p: {small})) = 4 then hit end",
        "card": f"case when length(d) between 13 and 19 and {_SQL_LUHN} then hit end",
        "phone": "case when length(d) between 9 and 15 then hit end",
        "iban": f"list_filter([{', '.join(ends)}], lambda h: {_SQL_MOD97})[1]",
        "ssn": "case when hit[1:3] not in ('000', '666') and hit[1] <> '9' and hit[5:6] <> '00' and hit[8:11] <> '0000' then hit end",
        "routing": "case when d <> '000000000' and list_sum(list_transform(range(1, 10), lambda i: (ascii(d[i]) - 48) * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0 then hit end",
        "imei": f"case when {_SQL_LUHN} then hit end",
        "mac": "hit",
    }
    parts = []
    for n, kind in enumerate(KINDS):
        found = f"select r, regexp_extract_all(t, $re${patterns[kind]}$re$) hit, regexp_split_to_array(t, $re${patterns[kind]}$re$) gap from d"
        rows = f"select r, unnest(range(1, len(hit) + 1)) i, unnest(hit) hit, unnest(gap[1:len(hit)]) gap from ({found})"
        ranged = f"select r, hit, {_SQL_DIGITS} d, sum(length(gap) + length(hit)) over (partition by r order by i) - length(hit) st from ({rows})"
        parts.append(f"select r, {n} ord, '{kind}' kind, st::bigint st, st::bigint + length(k) en, {CONTEXT[kind][0]} base, $re${CONTEXT[kind][1]}$re$ words from (select r, st, {kept[kind]} k from ({ranged})) where k is not null")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # the context's pattern is a constant within each part
    scored = [f"select r, ord, kind, st, en, greatest(0, least(100, base + {STEP} * (regexp_matches(b, words) or regexp_matches(a, words))::int - {STEP} * (regexp_matches(b, $re${ELSE}$re$) or regexp_matches(a, $re${ELSE}$re$))::int)) score from (select x.*, {lower.format(f't[greatest(st - {NEAR}, 0) + 1:st]')} b, {lower.format(f't[en + 1:en + {NEAR}]')} a from ({p}) x join d using (r))" for p in parts]
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in BASE)
    return f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
s as (select * from ({" union all ".join(scored)}) where kind in ({base}) or score >= {LEAST}),
g as (select r, {counts}, count(*) n_spans, max(score) top,
  string_agg(kind || ':' || st || ':' || en, ',' order by ord, st) filter (kind in ({base})) b,
  string_agg(kind || ':' || st || ':' || en, ',' order by ord, st) spans, string_agg(score::varchar, ',' order by ord, st) scores from s group by r)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint n_{k}" for k in BASE)}, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_spans, 0)::bigint n_spans, coalesce(scores, '') scores, coalesce(top, 0)::double / 100 score
from d left join g using (r)"""


def brute_force(docs: list[tuple]) -> list[tuple]:
    """op5's base columns from the contract's patterns as they stand, for tests."""
    digits = lambda s: _NOT_DIGIT.sub("", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    out = []
    for doc_id, text in docs:
        found = [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]
        out.append((doc_id, *[sum(f[0] == k for f in found) for k in BASE], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    return out
