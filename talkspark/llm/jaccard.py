r"""N-gram Jaccard join by prefix trees (operator 2).

A document's set holds the 64-bit hashes of its distinct k-word shingles. Two documents link
when their sets' Jaccard similarity is at least ``percent`` / 100. The result is exact (up to
64-bit hash collisions) and has one row a document with its component; links within groups
of copies are not listed one by one.

1. Documents with equal sets form a class; one of each class goes on.
2. Every set's tokens go to buckets by their hash, packed; a bucket counts in how many
   documents a token is, up to ``CAP``, and tells the documents which of their tokens
   others have. Tokens with CAP documents in one chunk of text are known to be at the cap
   there and then, so that the hottest tokens' document lists never meet in one task.
3. Global order of tokens: rarest first, then by hash. A set of n tokens can only link when it
   shares one of its first n - ceil(percent n / 100) + 1 tokens. Most sets have more tokens than
   that which no other document has, and are done.
4. The sets that share a prefix token meet in blocks: first with the smallest of each token's
   list (a star, so that a group of near copies costs its size), then, where a list still
   spans several components, the members of like size: sizes are graded so that sets
   that can link are in one grade or two neighbouring ones. Where these are more than ``FEW``, their tokens are dealt by
   hash to more parts than two sets that link can differ in; so they are equal in several, and of a set's
   parts those that most sets have can be left out: sets meet that are equal in one of the rarer parts, however many
   share a token or a passage. In a block the sets form
   a prefix tree with compressed paths; each set walks the tree, nodes share partial
   overlaps, and subtrees are pruned where overlap so far plus remaining length is too small.
5. Components of the links by star rounds over tables.

Nulls: a null text has no words; documents without words have n_shingles 0, link with nothing
and are their own component. A null doc_id counts as none (a component of only such is null).
Repeated rows are in one class. Ties of a component's smallest doc_id are one value, and of a token's
rank go by hash. Empty tables give empty results. Extra columns are ignored; ``keep_one`` returns
them as they are. Long texts are worked on whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspark.llm.common import Staged, chunked, clashes, fresh, keyed, numbered, read_table, row_key
from talkspark.llm.components import components
from talkspark.llm.hashing import mix, shingle_sets

CAP = 64  # documents of a token from which on its exact count doesn't matter
BUCKET_TOKENS = 2_000_000
BLOCK = 128
FEW = 8 * BLOCK  # sets of like size with a common token, up to which they meet all with all: each goes to 8 blocks at most


def needed(percent: int, a: int, b: int) -> int:
    """The least overlap with which sets of a and b tokens link."""
    return -(-percent * (a + b) // (100 + percent))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(rid, doc_id, did, n, cls): the size and digest of each document's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches):
            sets = shingle_sets(texts, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("did"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())],
                ["rid", "doc_id", "did", "n", "cls"],
            )

    return docs.mapInArrow(work, f"rid string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, did long, n long, cls binary")


_PACKED = "slot int, kind int, dids binary, counts binary, keys binary"


def _runs(dids: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """Run lengths of equal document ids, the rows being sorted by them."""
    at = np.flatnonzero(np.concatenate([[True], dids[1:] != dids[:-1]])) if len(dids) else np.zeros(0, np.int64)
    return dids[at].tobytes(), np.diff(np.concatenate([at, [len(dids)]])).astype(np.uint32).tobytes()


def _split(slots: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each slot, both being sorted by slot."""
    if not len(slots):
        return
    at = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    for a, b in zip(at, [*at[1:], len(slots)], strict=True):
        yield int(slots[a]), values[a:b]


def send_tokens(docs: DataFrame, sets_of: Callable[[list[bytes]], list[np.ndarray]], buckets: int) -> DataFrame:
    """Packed tokens: kind 0 to count, kind 1 keys known to be at the cap, kind 2 documents' tokens at the cap (slot by chance)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches):
            sets = sets_of(texts)
            h = np.concatenate(sets)
            if not len(h):
                continue
            did = np.repeat(np.asarray(batch.column("did"), np.int64), [len(s) for s in sets])
            slot, key = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), h.astype(np.uint32)
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            hot = count[inverse] >= CAP
            out: list[tuple] = []
            order = np.flatnonzero(~hot)
            order = order[np.argsort(slot[order], kind="stable")]
            for b, some in _split(slot[order], order):  # the buckets that the chunk has, however many there are
                out.append((b, 0, *_runs(did[some], key[some]), key[some].tobytes()))
            if hot.any():
                full = slot[hot].astype(np.int64) << 32 | key[hot]
                at_cap = np.unique(h[hot])
                of = ((at_cap >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                at_cap = at_cap[by := np.argsort(of, kind="stable")].astype(np.uint32)
                for b, some in _split(of[by], at_cap):
                    out.append((b, 1, b"", b"", np.unique(some).tobytes()))
                out.append((int(did[0] % buckets), 2, *_runs(did[hot], full), full.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], ["slot", "kind", "dids", "counts", "keys"])

    return docs.select("did", "body").mapInArrow(work, _PACKED)


def shared_tokens(packed: DataFrame, buckets: int, cap: int = CAP) -> DataFrame:
    """Counts each bucket's tokens; packed (slot by document, dids, counts, tokens, df) of the tokens with two documents or more.

    df stops at ``cap`` (16 bits); tokens that a chunk knows to be at the cap are there at once.
    """

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        dids, keys, capped, through = [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 1:
                    capped.append(np.frombuffer(r["keys"], np.uint32))
                    continue
                d = np.repeat(np.frombuffer(r["dids"], np.int64), np.frombuffer(r["counts"], np.uint32))
                if r["kind"] == 0:
                    dids.append(d)
                    keys.append(np.frombuffer(r["keys"], np.uint32))
                else:
                    through.append((d, np.frombuffer(r["keys"], np.int64)))
        did, tok, df = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if keys:
            key32, d = np.concatenate(keys), np.concatenate(dids)
            order = np.argsort(key32, kind="stable")
            key32, d = key32[order], d[order]
            new = np.concatenate([[True], key32[1:] != key32[:-1]])
            at = np.flatnonzero(new)
            count = np.diff(np.concatenate([at, [len(key32)]]))
            if capped:
                count[np.isin(key32[at], np.concatenate(capped))] = cap
            each = np.minimum(np.repeat(count, np.diff(np.concatenate([at, [len(key32)]]))), cap)
            more = each >= 2
            did, tok, df = d[more], np.int64(bucket) << 32 | key32[more].astype(np.int64), each[more]
        for d, t in through:
            did, tok, df = np.concatenate([did, d]), np.concatenate([tok, t]), np.concatenate([df, np.full(len(t), cap, np.int64)])
        slot = did % buckets
        order = np.lexsort((did, slot))
        did, tok, df, slot = did[order], tok[order], df[order].astype(np.uint16), slot[order]
        for s, some in _split(slot, np.arange(len(slot))):
            d, c = _runs(did[some], tok[some])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([d], pa.binary()), pa.array([c], pa.binary()), pa.array([tok[some].tobytes()], pa.binary()), pa.array([df[some].tobytes()], pa.binary())], ["slot", "dids", "counts", "tokens", "df"])

    return packed.groupBy("slot").applyInArrow(work, "slot int, dids binary, counts binary, tokens binary, df binary")


def prefixes(shared: DataFrame, reps: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(token, did, n): the prefix tokens, shared by others, of the sets that have fewer tokens of their own than their prefix; n is the set's size."""

    def work(sizes: pa.Table, packed: pa.Table) -> pa.Table:
        dids, toks, dfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for r in packed.to_pylist():
            dids.append(np.repeat(np.frombuffer(r["dids"], np.int64), np.frombuffer(r["counts"], np.uint32)))
            toks.append(np.frombuffer(r["tokens"], np.int64))
            dfs.append(np.frombuffer(r["df"], np.uint16))
        did, tok, df = np.concatenate(dids), np.concatenate(toks), np.concatenate(dfs)
        order = np.lexsort((tok, df, did))
        did, tok = did[order], tok[order]
        ids, n = np.asarray(sizes.column("did"), np.int64), np.asarray(sizes.column("n"), np.int64)
        a, b = np.searchsorted(did, ids, "left"), np.searchsorted(did, ids, "right")
        left = n - (percent * n + 99) // 100 + 1 - (n - (b - a))  # prefix tokens beyond those of its own
        take = np.clip(left, 0, b - a)
        at = np.repeat(a - np.cumsum(take) + take, take) + np.arange(take.sum())
        return pa.table({"token": pa.array(tok[at]), "did": pa.array(np.repeat(ids, take)), "n": pa.array(np.repeat(n, take))})

    left = reps.withColumn("slot", F.pmod("did", F.lit(buckets)).cast("int")).select("slot", "did", "n").groupBy("slot")
    return left.cogroup(shared.groupBy("slot")).applyInArrow(work, "token long, did long, n long").dropDuplicates()


def _member(x: np.ndarray, seg: np.ndarray) -> int:
    at = np.searchsorted(x, seg)
    at[at == len(x)] = 0
    return int((x[at] == seg).sum())


def tree_links(sets: list[np.ndarray], comps: list, percent: int, piece: int = 64) -> list[tuple[int, int]]:
    """Links that join all that the sets' links join, as index pairs; sets of one comp are known to be joined."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    sets, size = [sets[i] for i in order], [len(sets[i]) for i in order]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict = {}
    for i, j in enumerate(order):
        parent[i] = root(first.setdefault(comps[j], i))
    shared = [0]
    for x, y in zip(sets, sets[1:], strict=False):
        n = min(len(x), len(y))
        differ = x[:n] != y[:n]
        shared.append(int(differ.argmax()) if differ.any() else n)
    # the tree: (from, to) of the sorted sets, the node's tokens sets[from][start:end], children
    nodes: list[tuple] = []

    def build(lo: int, hi: int, start: int) -> int:
        """Iterative over an explicit stack: trees may be as deep as a block has sets."""
        pending, made = [(lo, hi, start, -1)], -1
        while pending:
            a, b, s, up = pending.pop()
            end = size[a] if b - a == 1 else min(shared[a + 1 : b])
            me = len(nodes)
            nodes.append((a, b, s, end, min(size[a:b]), max(size[a:b]), []))
            if up >= 0:
                nodes[up][6].append(me)
            else:
                made = me
            if b - a > 1:
                cuts = [a, *[i for i in range(a + 1, b) if shared[i] == end], b]
                pending += [(c, d, end, me) for c, d in zip(cuts, cuts[1:], strict=False)]
        return made

    top, links = build(0, len(sets), 0), []
    # the anchor walks first; later, a set joined to it need not: what it could link is joined, or walks itself
    members: dict[int, int] = {}
    for i in range(len(sets)):
        members[root(i)] = members.get(root(i), 0) + 1
    anchor, walked = max(range(len(sets)), key=lambda i: (members[root(i)], -i)), set()
    for i in [anchor, *(i for i in range(len(sets)) if i != anchor)]:
        x = sets[i]
        if i != anchor and root(i) == root(anchor):
            continue
        walked.add(i)
        stack = [(top, 0)]
        while stack:
            at, overlap = stack.pop()
            lo, hi, start, end, least, most, children = nodes[at]
            if 100 * min(len(x), most) < percent * len(x) or 100 * len(x) < percent * least:
                continue
            if hi - lo == 1 and (lo in walked or root(lo) == root(i)):
                continue
            need, tokens, ok = needed(percent, len(x), max(least, -(-percent * len(x) // 100))), sets[lo], True
            for a in range(start, end, piece):
                seg = tokens[a : min(a + piece, end)]
                overlap += _member(x, seg)
                done = a + len(seg)
                rest = len(x) - int(np.searchsorted(x, seg[-1], "right"))
                if overlap + min(rest, most - done) < need:
                    ok = False
                    break
            if not ok:
                continue
            if hi - lo > 1:
                stack += [(c, overlap) for c in children]
            elif overlap * (100 + percent) >= percent * (len(x) + size[lo]) and root(lo) != root(i):
                parent[root(lo)] = root(i)
                links.append((order[i], order[lo]))
    return links


def join_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: (block, did, comp). Links (a, b) found in each block."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, comps, hashes = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                ids.append(r["did"])
                comps.append(r["comp"])
                hashes.append(np.frombuffer(r["tokens"], np.uint64))
        found = tree_links(hashes, comps, percent)
        yield pa.RecordBatch.from_arrays([pa.array([ids[x[i]] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = members.join(sets, "did").select("block", "did", "comp", "tokens")
    return rows.groupBy("block").applyInArrow(work, "a long, b long")


def size_grade(n: Column, percent: int) -> Column:
    """Sets that can link are of one grade or of neighbouring ones."""
    if percent == 100:
        return n
    return F.floor(F.log(n) / math.log(100 / percent) + 1e-9).cast("long")


def grade_parts(grade: int, percent: int) -> tuple[int, int]:
    """(parts, the most of them in which two linking sets of the grade differ)."""
    most = grade if percent == 100 else math.ceil((100 / percent) ** (grade + 1)) + 1
    differ = 2 * most * (100 - percent) // (100 + percent)
    return differ + 2 + differ // 6, differ  # some to spare, so that few sets have as many empty parts


def part_keys(tokens: np.ndarray, grade: int, percent: int) -> np.ndarray:
    """A key for each part of the set that isn't empty, equal where the part's tokens are.

    Two sets that link agree in at least parts - differ parts. Where all of these could be empty, both sets have as many
    empty ones, and share a key for that.
    """
    parts, differ = grade_parts(grade, percent)
    part = (mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums, which = np.add.reduceat(mix(tokens[order]), at), part[at].astype(np.uint64)
    if parts - len(at) >= parts - differ:
        sums, which = np.append(sums, np.uint64(0)), np.append(which, np.uint64(parts))
    return mix(mix(sums ^ mix(which + np.uint64(1))) + np.uint64(grade)).view(np.int64)


def part_blocks(members: DataFrame, sets: DataFrame, percent: int, piece: int = 1 << 16) -> DataFrame:
    """members: (grade, did, comp). (grade, block, did, comp, spare): a row for each set and key of its parts.

    Two sets that link differ in at most d parts. So of all keys in one order, they share one among the first d + 1 of
    each of them, and a set can do without any ``spare`` keys that come last.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, held = [], [], 0

        def out() -> pa.RecordBatch:
            grade, did, comp, spare = np.repeat(np.array(rows, np.int64), [len(k) for k in keys], axis=0).T
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (grade, np.concatenate(keys), did, comp, spare)], ["grade", "block", "did", "comp", "spare"])

        for batch in batches:
            for grade, did, comp, tokens in zip(*(batch.column(c) for c in ("grade", "did", "comp", "tokens")), strict=True):
                keys.append(part_keys(np.frombuffer(tokens.as_buffer(), np.uint64), grade.as_py(), percent))
                spare = max(0, len(keys[-1]) - grade_parts(grade.as_py(), percent)[1] - 1)
                rows.append((grade.as_py(), did.as_py(), comp.as_py(), spare))
                held += len(keys[-1])
                if held >= piece:
                    yield out()
                    keys, rows, held = [], [], 0
        if held:
            yield out()

    return members.join(sets, "did").select("grade", "did", "comp", "tokens").mapInArrow(work, "grade long, block long, did long, comp long, spare long")


def rare_parts(parts: DataFrame) -> DataFrame:
    """(block, did, comp) of the rows by which sets meet: those of parts that others have, without each set's ``spare`` most common ones."""
    common = parts.groupBy("block").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    place = F.row_number().over(Window.partitionBy("grade", "did").orderBy(F.desc("sets"), "block"))
    return parts.join(common, "block").withColumn("place", place).where("place > spare").select("block", "did", "comp")


def link_classes(docs: DataFrame, st: Staged, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((rid, doc_id, did, n, cls) of the documents, (cls, component, component_id) of the classes of equal sets)."""
    rows = keyed(docs)
    docs = numbered(rows)
    meta = st.put(describe(docs, k), "meta")
    if again := clashes(meta):
        docs = numbered(rows, again)
        meta = st.put(describe(docs, k), "meta-again")
    classes = st.put(meta.where("n > 0").groupBy("cls").agg(F.min("did").alias("did"), F.max("n").alias("n"), F.min("doc_id").alias("low")), "classes")
    total = meta.agg(F.sum("n")).collect()[0][0] or 0
    buckets = max(8, -(-total // BUCKET_TOKENS))
    shared = shared_tokens(send_tokens(docs, lambda texts: shingle_sets(texts, k), buckets), buckets)
    # a set links at best with one that has a token more
    able = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    posts = st.put(prefixes(shared, able, percent, buckets), "posts")

    # stars: each token's list with its smallest document
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("did", "n")).alias("c")).where("m > 1").select("token", F.col("c.did").alias("center"), F.col("c.n").alias("center_n"))
    stars = st.put(posts.join(lists, "token").select("center", "center_n", "did", "n").where("center <> did").dropDuplicates(["center", "did"]), "stars")
    width = stars.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    members = stars.join(width, "center").withColumn("part", F.pmod(F.xxhash64("did"), F.col("parts")))
    heads = members.select("center", "part").dropDuplicates().select("center", "part", F.col("center").alias("did"))
    members = members.select("center", "part", "did").unionByName(heads).select(F.xxhash64("center", "part").alias("block"), "did", F.col("did").alias("comp"))
    wanted = st.put(stars.select("did").union(stars.select(F.col("center").alias("did"))).dropDuplicates(), "wanted")

    def pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches):
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())], ["did", "tokens"])

    sets = st.put(docs.select("did", "body").join(wanted, "did", "left_semi").mapInArrow(pack_sets, "did long, tokens binary").dropDuplicates(["did"]), "sets")
    links = st.put(join_blocks(members, sets, percent), "links-1")
    comps = components(links, st, "star")

    # a star of one block had all its pairs tested; of a larger one that still spans components, the members of a grade of
    # sizes meet again; where these are many, those alone that are equal in a part of their tokens
    large = stars.join(width.where("parts > 1"), "center")
    spread = large.select("center", "did", "n").unionByName(large.select("center", F.col("center").alias("did"), F.col("center_n").alias("n")).dropDuplicates(["center"]))
    spread = spread.join(comps.withColumnRenamed("node", "did"), "did", "left").select("center", "did", F.coalesce("comp", "did").alias("comp"), size_grade(F.col("n"), percent).alias("own"))
    # written, so that what follows counts before it shuffles by center
    spread = st.put(spread.select("*", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("grade")), "spread")
    several = spread.groupBy("center", "grade").agg((F.min("comp") < F.max("comp")).alias("several"), F.max(F.col("own") == F.col("grade")).alias("own"), (F.count(F.lit(1)) > FEW).alias("many")).where("several and own").select("center", "grade", "many")
    again = st.put(spread.drop("own").join(several, ["center", "grade"]), "again")
    if not again.isEmpty():
        many = again.where("many").select("grade", "did", "comp").dropDuplicates()
        by_part = rare_parts(st.put(part_blocks(many, sets, percent), "parts"))
        parts = st.put(again.where("not many").select(F.xxhash64("center", "grade").alias("block"), "did", "comp").unionByName(by_part), "meet")
        sums = parts.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("m"), F.min("did").alias("low"), F.max("did").alias("high"), F.bit_xor(F.xxhash64("did")).alias("all"))
        sums = sums.groupBy("block").agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("main"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_xor("all").alias("all")).where("m > main.m")
        # the same sets meet once, though they have several parts or lists in common
        sums = sums.groupBy("m", "main", "low", "high", "all").agg(F.min("block").alias("block"))
        sums = sums.select("block", F.col("main.comp").alias("main"), F.ceil(F.col("main.m") / BLOCK).alias("mains"), F.ceil((F.col("m") - F.col("main.m")) / BLOCK).alias("others"))
        # in chunks: those outside the main component with all of it and with one another
        rest = st.put(parts.join(sums, "block"), "rest")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        inside, outside = rest.where("comp = main"), rest.where("comp <> main")
        part = lambda n: F.pmod(F.xxhash64("did"), n)
        with_main = inside.withColumn("j", upto(F.col("others"))).withColumn("i", part(F.col("mains"))).unionByName(outside.withColumn("j", part(F.col("others"))).withColumn("i", upto(F.col("mains"))))
        pairs = outside.withColumn("i", part(F.col("others"))).withColumn("j", upto(F.col("others"))).where("i <> j")
        blocks = with_main.select(F.xxhash64("block", F.lit(0), "i", "j").alias("block"), "did", "comp").unionByName(pairs.select(F.xxhash64("block", F.lit(1), F.least("i", "j"), F.greatest("i", "j")).alias("block"), "did", "comp"))
        links = links.unionByName(st.put(join_blocks(blocks, sets, percent), "links-2"))
        comps = components(links, st, "all")
    st.drop("sets", "posts")

    classes = classes.join(comps.withColumnRenamed("node", "did"), "did", "left").withColumn("component", F.coalesce("comp", "did")).drop("comp", "did", "n")
    classes = st.put(classes, "grouped")
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    return meta, st.put(classes.join(lows, "component").select("cls", "component", "component_id"), "components")


def link_components(docs: DataFrame, *, k: int = 4, percent: int = 85) -> DataFrame:
    """One row a document: rid, doc_id, did, n_shingles, cls, component (of classes) and component_id."""
    meta, classes = link_classes(docs, Staged(docs.sparkSession, "jaccard"), k, percent)
    out = meta.join(classes, "cls", "left")
    # documents without words: each is its own component
    return out.select("rid", "doc_id", "did", F.col("n").alias("n_shingles"), "cls", F.col("component"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those of which another of their component stays (the one with the smallest doc_id, then row key).

    Documents without words all stay; rows that repeat wholly leave one. The one that stays is
    found class by class, then component by component, so that no row of a group meets the others.
    """
    st = Staged(docs.sparkSession, "keep")
    meta, classes = link_classes(docs, st, k, percent)
    worded = meta.where("n > 0")
    best = worded.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
    best = best.join(classes, "cls").groupBy("component").agg(F.min("best").alias("best"))
    rid, stays = fresh(docs, "rid"), fresh(docs, "stays")
    best = st.put(best.select(F.col("best.rid").alias(rid), F.lit(True).alias(stays)), "best")
    out = docs.withColumn(rid, row_key()).join(best, rid, "left")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = out.where(F.col(stays) | ~has_words)
    # rows that share a key are repeated rows: one of each stays, unless they are empty
    again = st.put(worded.groupBy("rid").count().where("count > 1").select(F.col("rid").alias(rid)), "again")
    if not again.isEmpty():
        twice = fresh(docs, "twice")
        out = out.join(again.withColumn(twice, F.lit(True)), rid, "left")
        out = out.where(F.col(twice).isNull()).unionByName(out.where(F.col(twice)).dropDuplicates([rid]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def brute_force(docs: list[tuple], k: int = 4, percent: int = 85) -> list[tuple]:
    """op2's rows by comparing all pairs, for tests."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(docs)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    where: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        both: dict[int, int] = {}
        for g in s:
            for j in where[g]:
                if j > i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                group[root(j)] = root(i)
    low: dict[int, object] = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return [(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(docs)]


#: DuckDB SQL for op2_jaccard: shingles joined by their text, links followed to the end. For tables of some thousand documents.
ORACLE = r"""
with recursive d as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct r, array_to_string(w[i:i + n - 1], ' ') g from (select r, w, least(4, len(w)) n, unnest(range(1, len(w) - least(4, len(w)) + 2)) i from d where len(w) > 0)),
c as (select r, count(*) n from s group by r),
p as (select a.r x, b.r y, count(*) k from s a join s b on a.g = b.g and a.r < b.r group by all),
l as (select x, y from p join c cx on cx.r = x join c cy on cy.r = y where 100 * k >= 85 * (cx.n + cy.n - k)),
e as (select x, y from l union all select y, x from l),
reach as (select r, r t from c union select reach.r, e.y from reach join e on e.x = reach.t),
m as (select reach.r, min(d.doc_id) low from reach join d on d.r = reach.t group by reach.r)
select doc_id, coalesce(n, 0)::bigint n_shingles, case when n is null then doc_id else low end component_id from d left join c using (r) left join m using (r)"""
