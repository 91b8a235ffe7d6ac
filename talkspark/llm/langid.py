"""Language ID by nearest centroids of TF-IDF vectors of byte n-grams (operator 8).

A text's vector holds hashed counts of its byte bigrams and trigrams (letters folded,
other ASCII bytes as blanks), square-rooted, weighted by IDF and normalised. Each language
gets several centroids by spherical k-means; a text takes the language of the centroid with
the largest cosine. It is rejected where its distance, one less that cosine, is above the
bound of that language for texts of its length: its cosine is below ``slack`` times the
``strict`` quantile of those of labelled texts, and of pieces of them, that the centroids were not
made from. Short texts are farther from any centroid, so lengths are graded by powers of two.

Fitting reads at most about ``rows_per_language`` labelled rows of each language, chosen by a
hash of the row (a documented bound: 500 by default, 2 x as a hard limit), as at most
``FEATURES_SENT`` counts each; one language's vectors are dense at a time. Scoring
reads every whole text once, some rows at a time, and shuffles nothing. The number of
languages is a small dimension.

Nulls and texts without letters: ``und``, score 0, rejected. Rows with null lang or null doc_id
are not learned from. Without any row to learn from, all are ``und``. Of equally near centroids
the first by language counts. Repeated rows get equal results. Very long texts are worked on
whole. Extra columns are ignored; ``keep_identified`` returns them as they are. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import chunked, keyed, read_table, row_key

DIM = 1 << 12  # of each n-gram order
ROWS = 256  # texts whose dense vectors are in memory at a time
FEATURES_SENT = 4096  # distinct n-grams of a labelled text that the fit gets at most, the most frequent
GRADES = 24  # of lengths: 2**g bytes and more
SENT = 1 << 16  # bytes of a labelled text that the bounds are measured with
LEAST_GRADED = 20  # texts that a bound needs; grades with fewer take the next longer one's
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _slots(two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (two * np.uint32(2654435761)) >> np.uint32(20), ((three * np.uint32(2246822519)) >> np.uint32(20)) + np.uint32(DIM)


_BLANKS = np.concatenate(_slots(np.array([0x2020], np.uint32), np.array([0x202020], np.uint32))).astype(np.int64)


def counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts by text and hashed n-gram, whether the text has a letter)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    letters = np.add.reduceat(_ASCII_LETTER[raw].astype(np.int64), np.concatenate([[0], ends[:-1]])) > 0
    for i in np.flatnonzero(~letters):
        letters[i] = any(c.isalpha() for c in texts[i].decode("utf-8", "replace"))
    b = _FOLD[raw].astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    starts = np.concatenate([[0], ends[:-1]])
    # runs of blanks tell nothing
    slot2, slot3 = _slots(two, three)
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        if e - s > 1:
            out[i, :DIM] = np.bincount(slot2[s : e - 1], minlength=DIM)
            out[i, DIM:] = np.bincount(slot3[s : max(s, e - 2)], minlength=2 * DIM)[DIM:]
    out[:, _BLANKS] = 0
    return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def grade(texts: list[bytes]) -> np.ndarray:
    return np.array([min(max(len(t), 1).bit_length() - 1, GRADES - 1) for t in texts], np.int64)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    bounds: np.ndarray  # the least cosine that a centroid takes, by the text's length grade

    def score(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if len(texts) > ROWS:
            parts = [self.score(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]
            return [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        tf, letters = counts(texts)
        cosine = _unit(np.sqrt(tf) * self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        top = np.where(letters, np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1), 0.0)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], top, ~letters | (top < self.bounds[best, grade(texts)])


def pieces(text: bytes) -> list[bytes]:
    """The text, and a piece of it at each shorter length grade, from places spread over it."""
    out, n = [text], 1 << 4
    while n < len(text):
        at = (len(text) - n) * (n % 97) // 97
        out.append(text[at : at + n])
        n *= 2
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], held: list[tuple[bytes, str]], *, clusters: int = 4, steps: int = 8, strict: float = 0.02, slack: float = 0.9, seed: int = 5) -> Model:
    """rows: (n-gram slots, their counts, language); held: (text, language) for the bounds, none of them among rows."""
    rows = sorted(rows, key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))
    if not rows:
        return Model([], np.ones(2 * DIM), np.zeros((0, 2 * DIM)), np.zeros((0, GRADES)))
    seen = np.bincount(np.concatenate([r[0] for r in rows]), minlength=2 * DIM)
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    rng, names, centroids = np.random.default_rng(seed), [], []
    for lang in sorted({r[2] for r in rows}):
        own = np.zeros((sum(r[2] == lang for r in rows), 2 * DIM), np.float32)
        for i, (slot, n, _) in enumerate(r for r in rows if r[2] == lang):
            own[i, slot] = np.sqrt(n)
        own = _unit(own * idf)
        c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
        for _ in range(steps):
            near = (own @ c.T).argmax(1)
            c = _unit(np.stack([own[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))]))
        names += [str(lang)] * len(c)
        centroids.append(c)
    model = Model(names, idf, np.concatenate(centroids).astype(np.float32), np.zeros((len(names), GRADES)))
    # what texts of a language's own reach, by length: a bound a language and grade
    reached: dict[tuple[str, int], list[float]] = {}
    for text, lang in held:
        parts = pieces(text)
        cosine = model.score(parts)[1]
        for g, value in zip(grade(parts).tolist(), cosine.tolist(), strict=True):
            reached.setdefault((str(lang), g), []).append(value)
    for k, lang in enumerate(names):
        bound = 0.0
        for g in reversed(range(GRADES)):
            values = reached.get((lang, g), [])
            if len(values) >= LEAST_GRADED:
                found = slack * float(np.quantile(values, strict))
                bound = min(bound, found) if bound else found
            model.bounds[k, g] = bound
        # longer texts than those of the sample: as its longest
        longest = max((g for g in range(GRADES) if len(reached.get((lang, g), [])) >= LEAST_GRADED), default=None)
        if longest is not None:
            model.bounds[k, longest:] = model.bounds[k, longest]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, *, rows_per_language: int = 500, **options: float) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not totals:
        return fit([], [])
    # about rows_per_language of each language by a hash of the row, a fifth of them for the bounds
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, rows_per_language / n)))])[F.col("lang")]
    chosen = known.where(F.pmod(F.xxhash64(F.lit(11), row_key()), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * rows_per_language * len(totals))
    chosen = chosen.select(F.col("text").cast("binary").alias("body"), "lang", (F.pmod(F.xxhash64(F.lit(12), row_key()), F.lit(5)) == 0).alias("held"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches, most=ROWS):
            tf, letters = counts(texts)
            slots, tally, bodies = [], [], []
            for row, ok, text, held in zip(tf, letters, texts, batch.column("held").to_pylist(), strict=True):
                at = np.flatnonzero(row) if ok and not held else np.zeros(0, np.int64)
                at = np.sort(at[np.argsort(-row[at], kind="stable")[:FEATURES_SENT]])
                slots.append(at.astype(np.uint16).tobytes())
                tally.append(row[at].tobytes())
                bodies.append(text[:SENT] if ok and held else b"")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(slots, pa.binary()), pa.array(tally, pa.binary()), pa.array(bodies, pa.binary())], ["lang", "slots", "tally", "body"])

    rows = chosen.mapInArrow(describe, "lang string, slots binary, tally binary, body binary").collect()
    own = [(np.frombuffer(bytes(s), np.uint16).astype(np.int64), np.frombuffer(bytes(n), np.float32), lang) for lang, s, n, _ in rows if s]
    return fit(own, [(bytes(t), lang) for lang, _, _, t in rows if t], **options)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row a document: rid, doc_id, lang_pred, score, rejected."""
    model = model or train(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches):
            lang, score, rejected = model.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["rid", "doc_id", "lang_pred", "score", "rejected"])

    docs = keyed(docs)
    return docs.mapInArrow(work, f"rid string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents without those rejected, as they are: rows pass through, nothing is joined."""
    model = model or train(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches, "text"):
            yield batch.filter(pa.array(~model.score(texts)[2]))

    return docs.mapInArrow(work, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
