"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are a text's distinct words, their stems (the first ``STEM``
characters), pairs of neighbours and pairs with one word between, hashed to
``2**BITS`` slots.  FTRL-proximal has a rate for each
coordinate and an L1 term that leaves most weights at zero; only the others
(some thousands) reach the driver and, from there, the scoring tasks.

Learning takes at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id, in
one task; this bound is the only limit, and every row is scored by its whole
text in one pass without a shuffle.

Defined cases: a null text is empty, and an empty text has the score of the
bias alone; without any learnable label every score is 0; a null or repeated
label counts once per doc_id, as toxic if any says so; a null doc_id hashes as
the empty text and is held out; of rows that repeat a doc_id the least text
trains, and all are scored; other columns of documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm._text import codes_of, combine, slices, word_hashes, words_of

BITS = 22
STEM = 4
SAMPLE = 16_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
_STEM = np.uint64(0xA0761D6478BD642F)
_SKIP = np.uint64(0xD6E8FEB86659FD93)


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, stem, pair and skip-pair of every text, in no order and with repeats."""
    words, counts = words_of(column)
    codes, distinct = codes_of(words)
    hashes = word_hashes(distinct)[codes]
    stems = word_hashes([w[:STEM] for w in distinct])[codes] ^ _STEM
    rows = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    shift = np.uint64(64 - BITS)
    slots, places = [combine(hashes) >> shift, combine(stems) >> shift], [rows, rows]
    for step, salt in ((1, np.uint64(0)), (2, _SKIP)):
        if len(hashes) > step:
            here = rows[:-step] == rows[step:]
            slots.append(combine(hashes[:-step][here] ^ salt, hashes[step:][here]) >> shift)
            places.append(rows[:-step][here])
    return np.concatenate(places), np.concatenate(slots).astype(np.int64)


class Ftrl:
    """FTRL-proximal; the last coordinate is the bias, which L1 spares."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        for part in slices(batch, "text"):
            rows, slots = features(part.column("text"))
            pairs = np.unique(rows << BITS | slots)
            cuts = np.searchsorted(pairs >> BITS, np.arange(part.num_rows + 1))
            marks = part.column("toxic").to_pylist()
            examples += ((pairs[a:b].astype(np.int32) & ((1 << BITS) - 1), y) for a, b, y in zip(cuts[:-1], cuts[1:], marks))
    if not examples:
        return
    model = Ftrl(1 << BITS)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            model.learn(*examples[k])
    every = np.arange((1 << BITS) + 1)
    w = model.weights(every)
    at = np.append(np.flatnonzero(w[:-1]), 1 << BITS)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["slot", "weight"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of the model, the bias last; both empty without labels. ``labels`` has doc_id and toxic."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` short rows
    once = texts.groupBy("doc_id", "rank", "toxic").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions("rank", "doc_id")
    rows = once.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_training, "slot long, weight double").collect()  # the non-zero weights
    rows.sort()
    return np.array([r["slot"] for r in rows], dtype=np.int64), np.array([r["weight"] for r in rows])


def _scoring(slots: np.ndarray, weights: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[slots[:-1]] = weights[:-1]
        for batch in batches:
            for part in slices(batch, "text"):
                if len(slots):
                    rows, at = features(part.column("text"))
                    used = table[at] != 0
                    pairs = np.unique(rows[used] << BITS | at[used])
                    total = weights[-1] + np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=part.num_rows)
                    score = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
                else:
                    score = np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(score)], [*columns, "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], key: str = "doc_id") -> DataFrame:
    """``key`` and score (0 to 1) of every row."""
    return docs.select(key, "text").mapInArrow(_scoring(*model, [key]), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of four fifths of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    scored = score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
