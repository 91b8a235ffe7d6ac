r"""Benchmark decontamination by suffix arrays of the training text (operator 7).

The training text is worked on in shards: at most ``SHARD`` words of a chunk of at most
``CHUNK_BYTES`` of documents, or of one document. A shard gets a suffix array over its words, as
ids of the benchmark's vocabulary, sorted by the first ``window`` words; it is sparse: suffixes
whose first two words occur nowhere in the benchmark in a row cannot start a match and are
left out. The windows of all test suffixes, each distinct one once, are searched in it by
bisection; windows whose first two words the shard doesn't have cannot be in it. Runs of
windows on one diagonal are the longest verbatim matches, located where they are asked for.

The benchmark is broadcast in parts of at most ``part_words`` words and ``part_bytes`` of raw text
(an item beyond that goes in pieces that overlap by a window less a word), whose arrays the
executors build, about 90 bytes a word. There is one pass over the documents for each part; passes
are merged by document, so a benchmark of any size has exact results. Nothing is shuffled
when one part holds it. Words are compared by 64-bit hashes.

Nulls: a null text has no words; an item without words has no window; a null item_id
matches but is not listed. Repeated rows get equal results; items that repeat count once by
their id. Repeated words and windows cost time in proportion to the text. Very long texts are worked
on whole. Empty tables: no documents, or nothing contaminated. Extra columns are ignored;
``remove_contaminated`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import chunked, fresh, keyed, read_table, row_key
from talkspark.llm.hashing import ALNUM, word_edges, word_hashes

MATCH = "array<struct<item_id:string,item_at:int,doc_at:int,words:int>>"
SHARD = 1 << 17

#: An item, or a piece of one: its id, the number of its words before the piece, its text, whether it is a piece.
Item = tuple[object, int, bytes, bool]


class TestSuffixes:
    """The distinct windows of some benchmark items, as sorted rows of word ids."""

    def __init__(self, items: list[Item], window: int) -> None:
        self.window, self.names = window, [None if i[0] is None else str(i[0]) for i in items]
        words, offsets = word_hashes([i[2] for i in items] or [b""], ALNUM)
        self.vocabulary = np.unique(words)
        ids = (np.searchsorted(self.vocabulary, words) + 1).astype(np.uint32)
        n = np.diff(offsets)
        width = np.minimum(n, window)
        count = np.where(n > 0, n - width + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        within = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        keys = _keys(_rows(ids, offsets[:-1][item] + within, offsets[1:][item], window))
        order = np.argsort(keys, kind="stable")
        first = _firsts(keys[order])
        self.low = keys[order[first]]
        self.width = width[item[order[first]]]
        # where each distinct window stands in the items
        self.cut = np.concatenate([first, [len(order)]])
        self.item, self.at = item[order], (within + np.array([i[1] for i in items] or [0], np.int64)[item])[order]
        head = offsets[:-1][item[order[first]]] + within[order[first]]
        second = np.where(self.width > 1, ids[np.minimum(head + 1, max(len(ids) - 1, 0))].astype(np.int64), 0) if len(ids) else np.zeros(0, np.int64)
        self.pairs = (ids[head].astype(np.int64) << 32 | second) if len(ids) else np.zeros(0, np.int64)  # sorted, as the windows are
        short = np.flatnonzero(self.width < window)
        self.high = self.low.copy() if len(short) else self.low
        if len(short):  # a window of fewer words ends at the last suffix that begins with it
            rows = self.low[short].view(np.uint8).reshape(len(short), -1)[:, :-1].copy().view(">u4")
            rows[np.arange(window)[None] >= self.width[short][:, None]] = 0xFFFFFFFF
            self.high[short] = _keys(rows)
        # the sets of items that windows have: most have one item's
        self.sets: list[tuple[str, ...]] = []
        place: dict[tuple[int, ...], int] = {}
        self.set_of = np.zeros(len(self.low), np.int64)
        for k, (a, b) in enumerate(zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True)):
            key = (int(self.item[a]),) if b - a == 1 else tuple(np.unique(self.item[a:b]).tolist())
            if key not in place:
                place[key] = len(self.sets)
                self.sets.append(tuple({self.names[i] for i in key if self.names[i] is not None}))
            self.set_of[k] = place[key]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


def _rows(ids: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """The ids from each start on, zeros from its text's end on."""
    at = start[:, None] + np.arange(window)
    table = np.concatenate([ids, np.zeros(window, np.uint32)])[at]
    table[at >= end[:, None]] = 0
    return table


def _keys(table: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings in the rows' order; a byte at the end keeps numpy from stripping zeros."""
    raw = np.ones((len(table), 4 * table.shape[1] + 1), np.uint8)
    raw[:, :-1] = np.ascontiguousarray(table.astype(">u4")).view(np.uint8).reshape(len(table), 4 * table.shape[1])
    return raw.view(f"S{raw.shape[1]}").ravel()


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where sorted values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, number in it) of all numbers in [low, high)."""
    count = high - low
    return np.repeat(np.arange(len(low)), count), np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def occurrences(texts: list[bytes], tests: TestSuffixes, shard: int = SHARD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By shard: (word offsets by text, text of each word, then by occurrence: word, distinct window); at least one."""
    hashes, offsets = word_hashes(texts, ALNUM)
    ids = tests.ids(hashes)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    after = np.zeros(len(ids), np.int64)
    after[:-1] = np.where(text_of[1:] == text_of[:-1], ids[1:], 0)
    alone = ids.astype(np.int64) << 32
    starts = np.flatnonzero((ids > 0) & (_member(tests.pairs, alone | after) | _member(tests.pairs, alone)))
    empty = np.zeros(0, np.int64)
    if not len(starts):
        yield offsets, text_of, empty, empty
    for a in range(0, len(starts), shard):
        start = starts[a : a + shard]
        keys = _keys(_rows(ids, start, offsets[1:][text_of[start]], tests.window))
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        here = np.unique(np.concatenate([alone[start] | after[start], alone[start]]))
        test = _ranges(np.searchsorted(tests.pairs, here, "left"), np.searchsorted(tests.pairs, here, "right"))[1]
        which, at = _ranges(np.searchsorted(array, tests.low[test], "left"), np.searchsorted(array, tests.high[test], "right"))
        yield offsets, text_of, start[order[at]], test[which]


def shard_hits(texts: list[bytes], tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """(word offsets by text, whether each word is hit, the names of each text's items)."""
    found: list[set[str]] = [set() for _ in texts]
    marks = None
    for offsets, text_of, at, test in occurrences(texts, tests):
        if marks is None:
            marks = np.zeros(len(text_of) + tests.window + 1, np.int64)
        if len(at):
            marks += np.bincount(at, minlength=len(marks)) - np.bincount(at + tests.width[test], minlength=len(marks))
            many = len(tests.sets)
            for code in np.unique(text_of[at] * many + tests.set_of[test]).tolist():
                found[code // many].update(tests.sets[code % many])
    return offsets, np.cumsum(marks)[: len(text_of)] > 0, found


def longest_matches(texts: list[bytes], tests: TestSuffixes) -> list[list[dict]]:
    """Each text's longest verbatim matches and their places: runs of windows along a diagonal. As large as the result."""
    parts = list(occurrences(texts, tests))
    offsets, text_of = parts[0][:2]
    at, test = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    which, place = _ranges(tests.cut[test], tests.cut[test + 1])
    text, at, width = text_of[at[which]], at[which] - offsets[text_of[at[which]]], tests.width[test[which]]
    item, item_at = tests.item[place], tests.at[place]
    order = np.lexsort((at, at - item_at, item, text))
    text, at, width, item, item_at = text[order], at[order], width[order], item[order], item_at[order]
    out: list[list[dict]] = [[] for _ in texts]
    if len(at):
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (at[1:] - item_at[1:] != at[:-1] - item_at[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        for a, b in zip(first.tolist(), [*(first[1:] - 1).tolist(), len(at) - 1], strict=True):
            out[text[a]].append({"item_id": tests.names[item[a]], "item_at": int(item_at[a]), "doc_at": int(at[a]), "words": int(at[b] - at[a] + width[b])})
    return out


_built: dict[str, TestSuffixes] = {}


def _tests(sent: Broadcast) -> TestSuffixes:
    """A part's windows, built once in each Python worker."""
    name, items, window = sent.value
    if name not in _built:
        _built.clear()
        _built[name] = TestSuffixes(items, window)
    return _built[name]


def split_item(item_id: object, text: bytes, window: int, part_words: int, part_bytes: int) -> list[Item]:
    """The item, or overlapping pieces of one that is too long for a part."""
    _, starts, ends, _ = word_edges([text], ALNUM)
    if len(starts) <= part_words and len(text) <= part_bytes:
        return [(item_id, 0, text, False)]
    out, at = [], 0
    while at == 0 or at + window <= len(starts):
        stop = min(at + part_words, len(starts), max(at + window, int(np.searchsorted(ends, starts[at] + part_bytes, "right")) if len(starts) else 0))
        out.append((item_id, at, text[starts[at] : ends[stop - 1]] if stop > at else b"", True))
        at = max(at + 1, stop - window + 1)
        if stop == len(starts):
            break
    return out


def broadcast_parts(benchmark: DataFrame, window: int, part_words: int, part_bytes: int) -> list[Broadcast]:
    """The items in parts of a checked size; the driver holds one part at a time."""
    context, parts = benchmark.sparkSession.sparkContext, []
    part: list[Item] = []
    words = size = 0

    def close() -> None:
        nonlocal part, words, size
        parts.append(context.broadcast((uuid.uuid4().hex, part, window)))
        part, words, size = [], 0, 0

    for item_id, text in benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).cast("binary")).toLocalIterator():
        for piece in split_item(item_id, bytes(text), window, part_words, part_bytes):
            n = len(word_edges([piece[2]], ALNUM)[1])
            if part and (words + n > part_words or size + len(piece[2]) > part_bytes):
                close()
            part.append(piece)
            words, size = words + n, size + len(piece[2])
    close()
    return parts


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())]))
_OUT = "rid string, doc_id {id}, n_words long, runs array<struct<s:int,e:int>>, items array<string>, matches " + MATCH


def _pass(docs: DataFrame, sent: Broadcast, matches: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _tests(sent)
        for batch, texts in chunked(batches):
            offsets, hit, found = shard_hits(texts, tests)
            runs: list[list[dict]] = [[] for _ in texts]
            for i in np.flatnonzero([bool(f) for f in found] | np.array([hit[a:b].any() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])).tolist():
                e = np.diff(hit[offsets[i] : offsets[i + 1]].astype(np.int8), prepend=0, append=0)
                runs[i] = [{"s": int(s), "e": int(t)} for s, t in zip(np.flatnonzero(e == 1), np.flatnonzero(e == -1), strict=True)]
            located = longest_matches(texts, tests) if matches else [[] for _ in texts]
            columns = [batch.column("rid"), batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(runs, _RUNS), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(located, _MATCHES)]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n_words", "runs", "items", "matches"])

    return docs.mapInArrow(work, _OUT.format(id=docs.schema["doc_id"].dataType.simpleString()))


def find_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, part_words: int = 1 << 19, part_bytes: int = 8 << 20, matches: bool = False) -> DataFrame:
    """One row a document: rid, doc_id, n_words, n_hit, items (sorted) and, if asked for, matches (item_id, item_at, doc_at, words)."""
    docs = keyed(docs)
    parts = broadcast_parts(benchmark, window, part_words, part_bytes)
    if len(parts) == 1:
        out = _pass(docs, parts[0], matches)
    else:
        every = None
        for part in parts:
            more = _pass(docs, part, matches).where(F.size("runs") > 0).select("rid", "runs", "items", "matches")
            every = more if every is None else every.unionByName(more)
        join = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        merged = every.groupBy("rid").agg(join("runs"), join("items"), join("matches"))
        none = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [], window))
        words = _pass(docs, none, False).select("rid", "doc_id", "n_words")
        or_none = lambda c: F.coalesce(c, F.array().cast(merged.schema[c].dataType)).alias(c)
        out = words.join(merged, "rid", "left").select("rid", "doc_id", "n_words", or_none("runs"), or_none("items"), or_none("matches"))
    covered = F.aggregate("runs", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda a, r: F.struct(F.greatest(a["to"], r["e"]).alias("to"), (a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["to"], r["s"]))).alias("n")), lambda a: a["n"])
    return out.select("rid", "doc_id", "n_words", covered.alias("n_hit"), "items", "matches")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20) -> F.Column:
    return (F.col(n_hit) > 0) & (share * F.col(n_hit) >= F.col(n_words))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, part_words: int = 1 << 19, part_bytes: int = 8 << 20, share: int = 20) -> DataFrame:
    """The documents without those contaminated, as they are: rows pass through, and only a benchmark of several parts joins by a row key."""
    parts = broadcast_parts(benchmark, window, part_words, part_bytes)
    if len(parts) > 1:
        rid = fresh(docs, "rid")
        bad = find_matches(docs, benchmark, window=window, part_words=part_words, part_bytes=part_bytes).where(contaminated(share=share)).select(F.col("rid").alias(rid)).distinct()
        return docs.withColumn(rid, row_key()).join(bad, rid, "left_anti").drop(rid)
    sent = parts[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _tests(sent)
        for batch, texts in chunked(batches, "text"):
            offsets, hit, _ = shard_hits(texts, tests)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
            yield batch.filter(pa.array((n_hit == 0) | (share * n_hit < np.diff(offsets))))

    return docs.mapInArrow(work, docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """op7's rows by plain loops, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        words = split(text)
        w = min(window, len(words))
        for i in range(len(words) - w + 1 if w else 0):
            windows.setdefault(tuple(words[i : i + w]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for w in {len(k) for k in windows}:
            for i in range(len(words) - w + 1):
                if (k := tuple(words[i : i + w])) in windows:
                    hit.update(range(i, i + w))
                    found |= windows[k]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out


#: DuckDB SQL for op7_decontaminate: windows of 13 words, and whole items that have fewer, joined by their text.
ORACLE = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select item_id, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i, w from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') k from bw),
ns as (select distinct n from win),
dw as (select r, n, unnest(range(1, len(w) - n + 2)) i, w from d, ns where len(w) >= n),
hits as (select r, i, n, item_id from (select r, i, n, array_to_string(w[i:i + n - 1], ' ') k from dw) x join win using (n, k)),
pos as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from hits) group by r),
it as (select r, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') names from hits group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) contaminated
from d left join pos using (r) left join it using (r)"""
