"""Toxicity by cumulative-link ordinal regression on sparse words (operator 3).

P(grade <= k) = sigmoid(b_k - w . x): one weight vector for all of the ordered thresholds
b_1 < b_2 < ...; x holds log(1 + count) of the chosen
words and word beginnings, all more common in toxic texts; their weights are not negative, so
such a word never lowers the severity. The result carries the expected
severity, the sum over k of P(grade >= k).

Labels are 0 or 1, so the grades above 0 are made from them: words that are far more common
in toxic labelled texts form a lexicon, and toxic texts are graded 1 to ``levels`` by
quantiles of how many of them they hold. Labels with more than two levels are taken as grades.

Fitting reads at most about ``rows_per_class`` labelled rows of each label (a documented bound,
3000 by default, 2 x as a hard limit) as at most ``TOKENS_SENT`` distinct tokens each, those of the
smallest hashes, so the driver gets at most 8 bytes x TOKENS_SENT a row; rows weigh so that the
classes count as in the whole table. Scoring reads every whole text once, with a model of at
most ``features`` weights, and shuffles nothing.

Nulls: a null text has no words; a null doc_id has no label; rows of labels with nulls are not
learned from. Without two labels to learn from, every severity is 0. Of several labels of a
doc_id the highest counts; ties of the chosen words go by their hash. Repeated rows get equal
results. Very long texts are scored whole, in pieces of work bounded by their own size. Empty tables
give empty results. Extra columns are ignored. Tokens are compared by 32-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import chunked, keyed, read_table
from talkspark.llm.hashing import ALNUM, prefix_hashes, word_hashes

PREFIXES = (4, 5, 6)
TOKENS_SENT = 4096


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words and of longer words' first 4, 5 and 6 bytes, their texts), in the order of the texts."""
    hashes, offsets = word_hashes(texts, ALNUM)
    text = np.searchsorted(offsets, np.arange(len(hashes)), "right") - 1
    more = prefix_hashes(texts, ALNUM, PREFIXES)
    text = np.concatenate([text, *[text[i] for i, _ in more]])
    order = np.argsort(text, kind="stable")
    return (np.concatenate([hashes, *[h for _, h in more]])[order] >> np.uint64(32)).astype(np.uint32), text[order]


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, P(grade >= 1)) of each text."""
        if not len(self.thresholds):
            return np.zeros(len(texts)), np.zeros(len(texts))
        hashes, text_of = tokens(texts)
        z = np.zeros(len(texts))
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = np.flatnonzero(self.words[at] == hashes)
            pair, n = np.unique(text_of[known] * len(self.words) + at[known], return_counts=True)
            z = np.bincount(pair // len(self.words), weights=np.log1p(n) * self.weights[pair % len(self.words)], minlength=len(texts))
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None] - z[:, None], -50, 50)))
        return above.sum(1), above[:, 0]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int, float]], *, levels: int = 3, features: int = 4096, l2: float = 1e-4, steps: int = 2000) -> Model:
    """rows: (distinct word hashes, their counts, label, weight)."""
    rows = sorted((r for r in rows), key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    label = np.array([r[2] for r in rows], np.int64)
    none = Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(0))
    if len(set(label.tolist())) < 2:
        return none
    weight = np.array([r[3] for r in rows])
    weight = weight / weight.sum()
    words = np.concatenate([r[0] for r in rows])
    tally = np.concatenate([r[1] for r in rows]).astype(float)
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    vocabulary, inverse = np.unique(words, return_inverse=True)
    toxic = label > 0
    with_t = np.bincount(inverse, weights=toxic[doc], minlength=len(vocabulary))
    with_n = np.bincount(inverse, weights=~toxic[doc], minlength=len(vocabulary))
    p, q = (with_t + 0.5) / (toxic.sum() + 1), (with_n + 0.5) / ((~toxic).sum() + 1)
    odds = np.log(p / (1 - np.minimum(p, 1 - 1e-9))) - np.log(q / (1 - np.minimum(q, 1 - 1e-9)))
    seen = with_t + with_n
    # deviations from one rate in both classes, in standard deviations
    r = seen / len(rows)
    score = np.abs(with_t / max(toxic.sum(), 1) - with_n / max((~toxic).sum(), 1)) / np.sqrt(np.maximum(r * (1 - r), 1e-9) * (1 / max(toxic.sum(), 1) + 1 / max((~toxic).sum(), 1)))
    keep = np.flatnonzero((seen >= 3) & (odds > 1) & (score > 4))
    keep = np.sort(keep[np.argsort(-score[keep], kind="stable")[:features]])
    if not len(keep):
        return none
    if label.max() > 1:
        names = np.unique(label)
        grade = np.searchsorted(names, label)
    else:
        lexicon = np.zeros(len(vocabulary), bool)
        lexicon[keep] = odds[keep] > 2
        hits = np.bincount(doc, weights=np.log1p(tally) * lexicon[inverse], minlength=len(rows))
        cuts = np.quantile(hits[toxic], np.arange(1, levels) / levels)
        grade = np.where(toxic, 1 + np.searchsorted(cuts, hits, "right"), 0)
    top = int(grade.max())
    slot = np.full(len(vocabulary), -1)
    slot[keep] = np.arange(len(keep))
    use = slot[inverse] >= 0
    d, f, v = doc[use], slot[inverse[use]], np.log1p(tally[use])
    w, b = np.zeros(len(keep)), np.linspace(1.0, top, top)
    m, s = np.zeros(len(keep) + top), np.zeros(len(keep) + top)
    below = grade[:, None] < np.arange(1, top + 1)[None]  # grade < k
    for t in range(1, steps + 1):  # full-batch Adam on the sum of the thresholds' logistic losses, which share w
        z = np.bincount(d, weights=v * w[f], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(b[None] - z[:, None], -50, 50)))  # P(grade < k)
        g = (p - below) * weight[:, None]
        gw = -np.bincount(f, weights=v * g.sum(1)[d], minlength=len(keep)) + l2 * w / 100
        grad = np.concatenate([gw, g.sum(0)])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w, b = np.maximum(w - move[: len(keep)], 0), np.sort(b - move[len(keep) :])
    return Model(vocabulary[keep], w, b)


def train(docs: DataFrame, labels: DataFrame, *, rows_per_class: int = 3000, **options: float) -> Model:
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a grade
    if len(totals) < 2:
        return fit([])
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_class / n)))])[F.col("toxic")]
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * rows_per_class * len(totals))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches):
            hashes, text_of = tokens(texts)
            offsets = np.searchsorted(text_of, np.arange(len(texts) + 1))
            each = [[x[:TOKENS_SENT] for x in np.unique(hashes[a:b], return_counts=True)] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([w.tobytes() for w, _ in each], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in each], pa.binary())], ["toxic", "words", "tally"])

    body = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    # the sample has a bounded size, so it is the side to send
    rows = body.join(F.broadcast(chosen), "doc_id").select("toxic", "body").mapInArrow(count, "toxic int, words binary, tally binary").limit(2 * rows_per_class * len(totals)).collect()
    got = {k: sum(r["toxic"] == k for r in rows) for k in totals}
    return fit([(np.frombuffer(bytes(w), np.uint32), np.frombuffer(bytes(n), np.int32), k, totals[k] / max(got[k], 1)) for k, w, n in rows], **options)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: rid, doc_id, severity (expected grade), p_toxic (P(grade >= 1)), toxic."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches):
            severity, p = model.severity(texts)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(severity), pa.array(p), pa.array(p >= 0.5)], ["rid", "doc_id", "severity", "p_toxic", "toxic"])

    docs = keyed(docs)
    return docs.mapInArrow(work, f"rid string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, p_toxic double, toxic boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return grade(docs, train(docs, read_table(spark, sf_dir, "labels"))).drop("rid")


def brute_force(docs: list[tuple], model: Model) -> list[tuple]:
    """op3's rows (doc_id, severity, p_toxic, toxic) by plain loops over a fitted model, for tests."""
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    out = []
    for doc_id, text in docs:
        tally: dict[int, int] = {}
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
            for part in (word, *(word[:n] for n in PREFIXES if len(word) > n)):
                # a beginning's hash depends on its length: that of a longer word with it
                h = tokens([word])[0].tolist()
                key = h[0] if part is word else h[1 + [n for n in PREFIXES if len(word) > n].index(len(part))]
                tally[key] = tally.get(key, 0) + 1
        z = sum(math.log1p(n) * weights.get(k, 0.0) for k, n in tally.items())
        above = [1 / (1 + math.exp(max(-50.0, min(50.0, b - z)))) for b in model.thresholds.tolist()]
        out.append((doc_id, sum(above), above[0] if above else 0.0, bool(above) and above[0] >= 0.5))
    return out
