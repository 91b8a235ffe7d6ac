r"""Suffix-array dedup of repeated passages by a distributed difference-cover algorithm (operator 4).

Each byte goes that is covered by a ``width``-byte string which also starts in a document with a
smaller doc_id; all strings are judged on the input.

1. Suffixes are dealt out by content: a suffix's anchor is the least hash of the ``GRAM``-byte
   strings in its first ``width`` bytes, so suffixes with equal first ``width`` bytes share it, and
   neighbours mostly do. Anchors that only one document has cannot start a repeat; they are
   counted in packed buckets, and only runs of suffixes with shared anchors go on, with the
   text they need.
2. Each bucket of runs gets its suffix array by the difference cover {1, 2} mod 3: triples of
   the sampled suffixes are sorted and named, the string of names is sorted in turn until
   all names differ, the remaining suffixes are ranked by their first byte and the
   next sample, and both are merged.
   Before, equal runs count once, and strings whose hash no other document has are left out.
3. Adjacent suffixes of the array are compared over their first ``width`` bytes; in a group of
   equal ones, all but those of the smallest doc_id are repeats.
4. Repeats go back to their documents as byte ranges, are joined, and cut.

Strings with an anchor that ``HOT`` documents or more have, or that is frequent within a chunk, are dealt out one by one by their own hash, so that
no anchor's surroundings gather in one bucket. Whole documents that repeat an earlier one are cut without going through 1 to 3, and of runs
that repeat within a task's texts, only the smallest document's goes to a bucket; so a
text or passage that a third of all documents has never meets in one task in full.

Nulls: a null text counts as empty; documents with null doc_id neither lose bytes nor take
them from others. Rows with one doc_id don't count as earlier than each other. Empty tables
give empty results. Extra columns are ignored. Texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import Staged, chunked, clashes, keyed, numbered, read_table
from talkspark.llm.hashing import _CODE, _power_tables, mix
from talkspark.llm.jaccard import send_tokens, shared_tokens

WIDTH, GRAM = 50, 20
BUCKET_BYTES = 24_000_000  # of input text for each bucket
ARRAY_BYTES = 1 << 19  # of text for each suffix array, or all of one anchor
HOT = 60_000  # documents of an anchor from which on its strings are dealt out one by one
SEEN = 100_000  # runs that a task remembers


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text`` (numbers from 1)."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    # ends in zeros, so that the names of the first part don't run into the second
    t = np.concatenate([text.astype(np.int64), np.zeros(6 - n % 3, np.int64)])
    m = len(t) - 3
    one, two = np.arange(1, m, 3), np.arange(2, m, 3)
    sample = np.concatenate([one, two])
    base = int(t.max()) + 1
    if base < 1 << 21:
        triple = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    else:  # names are too many for one number: name the pairs first
        pairs = np.unique(t[sample] * base + t[sample + 1], return_inverse=True)[1]
        triple = pairs * base + t[sample + 2]
    distinct, name = np.unique(triple, return_inverse=True)
    if len(distinct) < len(sample):
        order = suffix_order(name + 1)
    else:
        order = np.argsort(name, kind="stable")
    rank = np.zeros(m + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    # the rest: by their first number and the sample that follows
    rest = np.arange(0, m, 3)
    width = len(sample) + 2
    rest_key = t[rest] * width + rank[rest + 1]
    by = np.argsort(rest_key, kind="stable")
    rest, rest_key = rest[by], rest_key[by]
    # merge: against 1 mod 3 by (number, rank), against 2 mod 3 by (number, number, rank)
    sorted_sample = sample[order]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    less_one = np.searchsorted(t[ones] * width + rank[ones + 1], rest_key)
    # two numbers as one, then the rank: kept apart from overflow by naming the pairs
    pair = np.unique(np.concatenate([t[twos] * base + t[twos + 1], t[rest] * base + t[rest + 1]]), return_inverse=True)[1]
    two_key, rest_two = pair[: len(twos)] * width + rank[twos + 2], pair[len(twos) :] * width + rank[rest + 2]
    less_two = np.searchsorted(two_key, rest_two)
    place = np.empty(len(rest) + len(sample), np.int64)
    at_rest = np.arange(len(rest)) + less_one + less_two
    place[at_rest] = rest
    taken = np.zeros(len(place), bool)
    taken[at_rest] = True
    place[~taken] = sorted_sample
    return place[place < n]


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each position of the joined texts, whether a whole string of ``width`` starts there). Texts are followed by one byte."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(buf)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    starts = ends - np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    fits = np.zeros(n + 1, np.int32)
    long = ends - 1 - starts >= width
    fits[starts[long]] += 1
    fits[ends[long] - width] -= 1
    whole = np.cumsum(fits[:n]) > 0
    if n < width + 1:
        return np.zeros(n, np.uint64), whole
    power, inverse = _power_tables(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODE[buf] * power, dtype=np.uint64)])
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    reach, span = h, 1
    want = width - gram + 1
    while span * 2 <= want:
        reach = np.minimum(reach[:-span], reach[span:])
        span *= 2
    reach = np.minimum(reach[: len(reach) - (want - span)], reach[want - span :])
    out = np.zeros(n, np.uint64)
    out[: len(reach)] = reach
    return out, whole


def periodic(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Whether the anchor stands twice in the string of ``width`` bytes at each position of the joined texts: a matter of the string alone.

    The other strings with one anchor's occurrence are ``width - gram + 1`` at most, in ``2 * width - gram`` bytes of text.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n, want = len(buf), width - gram + 1
    out = np.zeros(n, bool)
    if n < width + 1:
        return out
    power, inverse = _power_tables(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODE[buf] * power, dtype=np.uint64)])
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]) & ~np.uint64(63)
    at = np.arange(len(h), dtype=np.uint64) & np.uint64(63)  # a window has fewer than 64 places

    def least(x: np.ndarray) -> np.ndarray:
        span = 1
        while span * 2 <= want:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        return np.minimum(x[: len(x) - (want - span)], x[want - span :])

    low, high = least(h | at) & np.uint64(63), np.uint64(63) - (least(h | (np.uint64(63) - at)) & np.uint64(63))
    out[: len(low)] = low != high
    return out


def _anchor_sets(texts: list[bytes]) -> list[np.ndarray]:
    anchor, whole = anchors(texts)
    sets, at = [], 0
    for t in texts:
        e = at + len(t) + 1
        a = anchor[at:e][whole[at:e]]
        sets.append(np.unique(a[np.concatenate([[True], a[1:] != a[:-1]])]) if len(a) else a)
        at = e
    return sets


def _by_slot(did: np.ndarray, start: np.ndarray, end: np.ndarray, slots: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    slot = did % slots
    order = np.argsort(slot, kind="stable")
    for s in np.unique(slot):
        some = order[slice(*np.searchsorted(slot[order], [s, s + 1]))]
        yield int(s), did[some].tobytes(), start[some].tobytes(), end[some].tobytes()


_RUNS = "kind int, slot int, dids binary, ids binary, starts binary, ends binary, lengths binary, anchors binary, data binary"


def send_runs(docs: DataFrame, slots: int) -> DataFrame:
    """docs: (did, id, z, tokens, hot). kind 0: runs of suffixes with shared anchors, by anchor; kind 1: ranges known to repeat, by document.

    Strings with an anchor that very many documents have, and periodic ones, go one by one, by their own hash; where a
    document has such a string again before it ends, it goes once, with all the bytes that the chain covers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, seen = zstandard.ZstdDecompressor(), {}

        def flush(dids: list, ids: list, texts: list, tokens: list, hots: list) -> pa.RecordBatch | None:
            anchor, whole = anchors(texts)
            token = ((anchor >> np.uint64(32)) % np.uint64(slots)).astype(np.int64) << 32 | anchor.astype(np.uint32)
            alone = whole & periodic(texts)
            whole = whole & ~alone
            alone = np.flatnonzero(alone)
            new = whole & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1]])
            last = whole & np.concatenate([(anchor[1:] != anchor[:-1]) | ~whole[1:], [True]])
            first, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
            rows: dict[int, list] = {}
            known: tuple[list, list, list] = ([], [], [])
            at = 0

            def repeated(did: int, doc: int, start: int, end: int, piece: bytes) -> bool:
                """Whether this task has seen the piece in a smaller document; its range is then known."""
                before = seen.get(piece)
                if before is not None and before < doc:
                    if known[0] and known[0][-1] == did and known[1][-1] <= start <= known[2][-1]:
                        known[2][-1] = max(known[2][-1], end)
                    else:
                        known[0].append(did)
                        known[1].append(start)
                        known[2].append(end)
                    return True
                if before is None or doc < before:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[piece] = doc
                return False

            for did, doc, text, own, hot in zip(dids, ids, texts, tokens, hots, strict=True):
                a, b = np.searchsorted(first, [at, at + len(text) + 1])
                tok = token[first[a:b]]
                common = set(hot.tolist())
                singles: dict[bytes, list[list[int]]] = {}  # of a string sent by itself: where its chains start and end

                def single(i: int, text: bytes = text, singles: dict = singles) -> None:
                    chains = singles.setdefault(text[i : i + WIDTH], [])
                    if chains and i <= chains[-1][1]:
                        chains[-1][1] = i + WIDTH
                    else:
                        chains.append([i, i + WIDTH])

                c, d = np.searchsorted(alone, [at, at + len(text) + 1])
                for i in (alone[c:d] - at)[np.isin(token[alone[c:d]], own)].tolist():
                    single(i)
                for s, e, k in zip((first[a:b] - at)[m := np.isin(tok, own)].tolist(), (stop[a:b] - at)[m].tolist(), tok[m].tolist(), strict=True):
                    piece = text[s : e + WIDTH - 1]
                    if repeated(did, doc, s, e + WIDTH - 1, piece):
                        continue
                    if k not in common:
                        rows.setdefault(k >> 32, []).append((did, doc, s, e + WIDTH - 1, piece, k))
                        continue
                    for i in range(s, e):
                        single(i)
                for one, chains in singles.items():
                    h = int.from_bytes(hashlib.blake2b(one, digest_size=7).digest())
                    for s, e in chains:
                        if not repeated(did, doc, s, e, one):
                            rows.setdefault((h >> 32) % slots, []).append((did, doc, s, e, one, h))
                at += len(text) + 1
            out = []
            for slot, some in rows.items():
                data = zstandard.compress(b"".join(x[4] for x in some), 1)
                out.append((0, slot, *(np.array([x[i] for x in some], np.int64).tobytes() for i in range(4)), np.array([len(x[4]) for x in some], np.int64).tobytes(), np.array([x[5] for x in some], np.int64).tobytes(), data))
            if known[0]:
                out += [(1, s, d, None, a, e, None, None, None) for s, d, a, e in _by_slot(*(np.array(x, np.int64) for x in known), slots)]
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32(), pa.int32(), *[pa.binary()] * 7])], ["kind", "slot", "dids", "ids", "starts", "ends", "lengths", "anchors", "data"])

        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = unzip.decompress(batch.column("z")[i].as_py())
                if held[0] and size + len(text) > 1 << 20:
                    if (row := flush(*held)) is not None:
                        yield row
                    held, size = ([], [], [], [], []), 0
                size += len(text)
                for into, x in zip(held, (batch.column("did")[i].as_py(), batch.column("id")[i].as_py(), text, *(np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("tokens", "hot"))), strict=True):
                    into.append(x)
        if held[0] and (row := flush(*held)) is not None:
            yield row

    return docs.select("did", "id", "z", "tokens", "hot").mapInArrow(work, _RUNS)


def repeats(pieces: list[bytes], ids: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each piece, the positions at which a string starts that also starts in a piece of a smaller id."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    begin = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), sizes)
    usable = np.arange(len(text)) + width <= (begin + sizes)[piece]
    order = suffix_order(text)
    order = order[usable[order]]
    if not len(order):
        return [np.zeros(0, np.int64)] * len(pieces)
    words = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    same = np.ones(len(order) - 1, bool)
    live = np.arange(len(same))
    for k in range(width):  # adjacent suffixes, byte by byte, as long as they agree
        ok = words[order[live] + k] == words[order[live + 1] + k]
        same[live[~ok]] = False
        live = live[ok]
    group = np.cumsum(np.concatenate([[0], ~same]))
    owner = ids[piece[order]]
    least = np.minimum.reduceat(owner, np.flatnonzero(np.concatenate([[True], ~same])))
    found = np.sort(order[owner > least[group]])
    cut = np.searchsorted(found, np.concatenate([begin, [len(text)]]))
    return [found[cut[i] : cut[i + 1]] - begin[i] for i in range(len(pieces))]


def find_repeats(runs: DataFrame, slots: int) -> DataFrame:
    """(slot by document, dids, starts, ends): byte ranges covered by repeated strings."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                data, at = zstandard.decompress(r["data"]), 0
                for k, did, doc, s, e, n in zip(*(np.frombuffer(r[c], np.int64).tolist() for c in ("anchors", "dids", "ids", "starts", "ends", "lengths")), strict=True):
                    runs.append((k, did, doc, s, e, data[at : at + n]))
                    at += n
        # suffixes that can be equal have one anchor: arrays of whole anchors, those with one text apart
        runs.sort(key=lambda x: (x[0], x[2]))
        known: tuple[list, list, list] = ([], [], [])
        groups, size, some = [], 0, []
        for _, g in groupby(runs, key=lambda x: x[0]):
            first: dict[bytes, int] = {}
            texts = []
            for _, did, doc, s, e, piece in g:  # of equal runs, the smallest document's goes on
                if first.setdefault(piece, doc) < doc:
                    known[0].append(did)
                    known[1].append(s)
                    known[2].append(e)
                else:
                    texts.append((did, doc, s, e, piece))
            if len(first) == 1:
                continue
            more = sum(len(x[4]) for x in texts)
            if some and size + more > ARRAY_BYTES:
                groups.append(some)
                size, some = 0, []
            some.extend(texts)
            size += more
        if known[0]:
            for row in _by_slot(*(np.array(x, np.int64) for x in known), slots):
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], ["slot", "dids", "starts", "ends"])
        for some in [*groups, some] if some else groups:
            found = repeats([x[4] for x in some], np.array([x[1] for x in some], np.int64))
            dids, starts, ends = [], [], []
            for (did, _, s, end, piece), at in zip(some, found, strict=True):
                if len(at) and len(piece) == WIDTH:  # a string by itself stands for its chain
                    dids.append(np.full(1, did, np.int64))
                    starts.append(np.full(1, s, np.int64))
                    ends.append(np.full(1, end, np.int64))
                elif len(at):
                    cut = np.flatnonzero(np.diff(at) > WIDTH) + 1
                    a = at[np.concatenate([[0], cut])] + s
                    e = at[np.concatenate([cut - 1, [len(at) - 1]])] + s + WIDTH
                    dids.append(np.full(len(a), did, np.int64))
                    starts.append(a)
                    ends.append(e)
            if dids:
                for row in _by_slot(*(np.concatenate(x) for x in (dids, starts, ends)), slots):
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], ["slot", "dids", "starts", "ends"])

    return runs.groupBy("slot").applyInArrow(work, "slot int, dids binary, starts binary, ends binary")


def _collect_ranges(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, cuts): each document's ranges, joined where they touch."""
    parts = [[np.zeros(0, np.int64)] for _ in range(3)]
    for batch in batches:
        for r in batch.to_pylist():
            for into, c in zip(parts, ("dids", "starts", "ends"), strict=True):
                into.append(np.frombuffer(r[c], np.int64))
    did, start, end = (np.concatenate(x) for x in parts)
    order = np.lexsort((start, did))
    did, start, end = did[order], start[order], end[order]
    at = np.searchsorted(did, ids := np.unique(did))
    cuts = []
    for a, b in zip(at, [*at[1:], len(did)], strict=True):
        s, e = start[a:b], np.maximum.accumulate(end[a:b])
        new = np.concatenate([[True], s[1:] > e[:-1]])
        first = np.flatnonzero(new)
        cuts.append(np.stack([s[first], e[np.concatenate([first[1:] - 1, [len(s) - 1]])]], 1).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cuts, pa.binary())], ["did", "cuts"])


def _collect_tokens(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, tokens, hot): each document's shared anchors, and those of them that HOT documents or more have, or many in one chunk."""
    dids, toks, dfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
    for batch in batches:
        for r in batch.to_pylist():
            dids.append(np.repeat(np.frombuffer(r["dids"], np.int64), np.frombuffer(r["counts"], np.uint32)))
            toks.append(np.frombuffer(r["tokens"], np.int64))
            dfs.append(np.frombuffer(r["df"], np.uint16))
    did, tok, df = np.concatenate(dids), np.concatenate(toks), np.concatenate(dfs)
    order = np.argsort(did, kind="stable")
    did, tok, hot = did[order], tok[order], df[order] >= HOT
    at = np.searchsorted(did, ids := np.unique(did))
    parts = list(zip(at, [*at[1:], len(did)], strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([tok[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([tok[a:b][hot[a:b]].tobytes() for a, b in parts], pa.binary())], ["did", "tokens", "hot"])


def zipped(docs: DataFrame) -> DataFrame:
    """(did, id, z): texts in compressed form, before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(1)
        for batch, texts in chunked(batches):
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("id"), pa.array([zip_.compress(t) for t in texts], pa.binary())], ["did", "id", "z"])

    return docs.select("did", "id", "body").mapInArrow(work, "did long, id long, z binary")


def cut_repeats(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """One row a document: rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left)."""
    spark = docs.sparkSession
    st = Staged(spark, "suffixes")
    rows = keyed(docs).withColumn("id", F.col("doc_id").cast("long"))
    docs = numbered(rows)
    describe = lambda: docs.select("rid", "doc_id", "id", "did", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha"))
    meta = st.put(describe(), "meta")
    if again := clashes(meta):
        docs = numbered(rows, again)
        meta = st.put(describe(), "meta-again")
    firsts = st.put(meta.where(f"n_bytes >= {WIDTH} and id is not null").groupBy("sha").agg(F.min(F.struct("id", "did")).alias("f")).select("sha", "f.id", "f.did"), "firsts")
    slots = max(8, -(-(meta.agg(F.sum("n_bytes")).collect()[0][0] or 0) // BUCKET_BYTES))
    shared = shared_tokens(send_tokens(docs.where("id is not null"), _anchor_sets, slots), slots, HOT)
    tokens = st.put(shared.groupBy("slot").applyInArrow(_collect_tokens, "did long, tokens binary, hot binary").join(firsts.select("did"), "did", "left_semi"), "tokens")
    texts = zipped(docs.where("id is not null"))
    runs = st.put(send_runs(texts.join(tokens, "did"), slots), "runs")
    ranges = find_repeats(runs.where("kind = 0").drop("kind"), slots).unionByName(runs.where("kind = 1").select("slot", "dids", "starts", "ends"))
    cuts = st.put(ranges.groupBy("slot").applyInArrow(_collect_ranges, "did long, cuts binary"), "cuts")
    st.drop("runs", "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text, spans = unzip.decompress(batch.column("z")[i].as_py()), np.frombuffer(batch.column("cuts")[i].as_py(), np.int64).reshape(-1, 2)
                edges = [0, *spans.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([batch.column("did"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.binary()]))], ["did", "removed", "spans", "kept_sha", "kept"])

    done = texts.join(cuts, "did").select("did", "z", "cuts").mapInArrow(cut, "did long, removed long, spans long, kept_sha string, kept binary").dropDuplicates(["did"])
    out = meta.join(firsts.select("sha", F.col("id").alias("first")), "sha", "left").join(done, "did", "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
    zero = F.lit(0).cast("long")
    columns = [pick(F.col("n_bytes"), F.col("removed"), zero).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("spans"), zero).alias("n_spans"), pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha"), F.col("sha")).alias("kept_sha256")]
    if with_text:
        bodies = docs.select("rid", "body").dropDuplicates(["rid"])
        return out.join(bodies, "rid").select("rid", "doc_id", "n_bytes", *columns, pick(F.lit(b""), F.col("kept"), F.col("body")).alias("kept"))
    return out.select("rid", "doc_id", "n_bytes", *columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read_table(spark, sf_dir, "documents")).drop("rid")


def brute_force(docs: list[tuple], width: int = WIDTH) -> list[tuple]:
    """op4's rows from a dictionary of all strings, for tests."""
    first: dict[bytes, int] = {}
    bodies = [(d, (t or "").encode()) for d, t in docs]
    for d, b in bodies:
        if d is not None:
            for i in range(len(b) - width + 1):
                k = b[i : i + width]
                if k not in first or d < first[k]:
                    first[k] = d
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - width + 1):
                if first[b[i : i + width]] < d:
                    gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


#: DuckDB SQL for op4_suffix_dedup: every 50-byte string, in hex. For tables of some megabytes.
ORACLE = """
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
q as (select r, doc_id, k, n, substr(h, 1024 * k + 1, 1122) c from (select r, doc_id, h, length(h) // 2 - 49 n, unnest(range(0, (length(h) // 2 - 49 + 511) // 512)) k from d where length(h) >= 100 and doc_id is not null)),
p as (select r, doc_id, 512 * k + j i, substr(c, 2 * j + 1, 100) g from (select r, doc_id, k, c, unnest(range(0, least(512, n - 512 * k))) j from q)),
f as (select g, min(doc_id) low from p group by g),
x as (select r, i from p join f using (g) where doc_id > low),
o as (select r, i, sum(fresh) over (partition by r order by i) k from (select r, i, (i > lag(i, 1, -1000) over (partition by r order by i) + 50)::int fresh from x)),
t as (select r, k, min(i) a, max(i) + 50 b from o group by r, k),
u as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) z from t),
g as (select r, sum(b - a) gone, count(*) n, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) kept from u join d using (r) group by r)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from d left join g using (r)"""
