"""Supervised subword embeddings: a linear text classifier over hashed word and character n-gram vectors.

A document is the average of the vectors of its words' features: words, pairs of words, and their n-grams of MIN_GRAM to MAX_GRAM
bytes of UTF-8 (a space stands at the word's ends), hashed into BUCKETS rows. A softmax layer stands on the average. numpy
learns vectors and layer together by stochastic gradient descent.

Training rows are a bounded sample, SAMPLE_ROWS of the rows offered (the smallest hashes of their ids, a documented
parameter: the model's size does not grow with the corpus). Of each, the whole text is learnt from: tasks count its features,
BUCKETS numbers at most, and only these counts are collected. Scoring covers all rows and all words. As average and layer
are linear, each feature adds a fixed amount to the logit, so that scoring is one gather over a batch's bytes.

Cases: null and empty texts score as the bias says. Null labels and labels without a document are not learnt from; no
labels at all give 0.5. Repeated ids are scored each; if they offer more than SAMPLE_ROWS texts, the least by id, digest of
the text and label are learnt from. One class only gives scores near that class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE_ROWS = 4000
MIN_GRAM, MAX_GRAM = 2, 4
BUCKETS, DIM = 1 << 17, 16
EPOCHS, RATE, SEED = 5, 0.5, 7
#: Times that a pair of equal words counts.
SAME_PAIR = 4


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the vector table, document) of the words' and of the n-grams' features of documents that stand one after
    the other in data; a part at a time."""
    n = len(offsets) - 1
    # a space before each document and two after the last, so that each word has one on both sides
    framed = np.full(len(data) + n + 1, 32, np.uint8)
    framed[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
    starts, ends, docs = common.word_bounds(framed, offsets + np.arange(n + 1))
    if not len(starts):
        return
    words = common.Rolling(framed, 5).of(starts, ends)
    yield (words % np.uint64(BUCKETS)).astype(np.int64), docs
    # pairs of words; a pair of equal words also has a row that all such pairs share, as runs of one word read alike
    pairs = np.flatnonzero(docs[1:] == docs[:-1])
    with np.errstate(over="ignore"):
        yield (common.mix(words[pairs] * np.uint64(3) + words[pairs + 1], 11) % np.uint64(BUCKETS)).astype(np.int64), docs[pairs]
    same = pairs[words[pairs] == words[pairs + 1]]
    yield np.full(len(same) * SAME_PAIR, BUCKETS - 1), np.repeat(docs[same], SAME_PAIR)
    # every position that begins an n-gram within a framed word, and how far that word goes
    lengths = ends - starts + 2
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(int(lengths.sum())) + np.repeat(starts - 1 - first, lengths)
    left = np.repeat(ends + 1, lengths) - at
    owner = np.repeat(docs, lengths)
    packed = np.where(common._SPACE[framed], 32, framed)[at].astype(np.uint64)
    wide = packed.copy()
    for k in range(1, MAX_GRAM):
        wide[:-k] |= packed[k:] << np.uint64(8 * k)
        if k + 1 >= MIN_GRAM:
            fits = left > k
            yield (common.mix(wide[fits], k) % np.uint64(BUCKETS)).astype(np.int64), owner[fits]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vector table that a whole text has, ascending, and how often."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    parts = [rows for rows, _ in features(data, np.array([0, len(data)]))]
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> tuple[np.ndarray, float]:
    """From counted texts: (amount of each row of the table to the logit of label 1, bias)."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    y = np.array(labels, np.int64)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(docs)):
            rows, counts = docs[i]
            weights = (counts / max(1, counts.sum())).astype(np.float32)
            mean = weights @ vectors[rows]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y[i]] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # the average spreads the step over its rows; a row counts by its square root, so that rare ones move too
            vectors[rows] -= rate * 10 * np.outer(weights, back)
    if not len(y):
        return np.zeros(BUCKETS, np.float32), 0.0
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def logits(data: np.ndarray, offsets: np.ndarray, amounts: np.ndarray, bias: float) -> np.ndarray:
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for rows, docs in features(data, offsets):
        total += np.bincount(docs, amounts[rows], n)
        count += np.bincount(docs, minlength=n)
    return bias + total / np.maximum(count, 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = [counted(t) for t in batch.column("text").to_pylist()]
        packed = [pa.array([zlib.compress(d[k].astype("<i4").tobytes(), 1) for d in docs], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *packed], ["id", "digest", "rows", "counts"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> tuple[np.ndarray, float]:
    """The model from at most SAMPLE_ROWS rows of labels (id_col, label_col) and their whole texts. The sample is drawn from
    the labels alone, so that its ids can be broadcast and no text is shuffled."""
    spark = docs.sparkSession
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label"))
    sample = spark.createDataFrame(sample.orderBy(F.xxhash64("_label_id"), "_label_id", "_label").limit(SAMPLE_ROWS).collect(), sample.schema)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    offered = texts.join(F.broadcast(sample), F.col("id") == F.col("_label_id")).select("id", F.sha2("text", 256).alias("digest"), "_label")
    chosen = offered.orderBy("id", "digest", "_label").limit(SAMPLE_ROWS).collect()
    wanted = spark.createDataFrame(list({(r["id"], r["digest"]) for r in chosen}), offered.drop("_label").schema)
    ids = F.broadcast(wanted.select("id").distinct())
    found = texts.join(ids, "id", "left_semi").withColumn("digest", F.sha2("text", 256)).join(F.broadcast(wanted), ["id", "digest"], "left_semi").select("id", "digest", "text")
    packed = T.StructType([found.schema["id"], found.schema["digest"], T.StructField("rows", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    counts = found.mapInArrow(_count, packed).groupBy("id", "digest").agg(F.first("rows").alias("rows"), F.first("counts").alias("counts"))  # copies count alike
    array = lambda b: np.frombuffer(zlib.decompress(b), "<i4").astype(np.int64)
    have = {(r["id"], r["digest"]): (array(r["rows"]), array(r["counts"])) for r in counts.collect()}
    return train([have[r["id"], r["digest"]] for r in chosen], [int(r["_label"] != 0) for r in chosen])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs without text_col, with score_col (double, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (text_col, score_col)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        amounts, bias = shared.value
        for batch in common.slices(batches, "_text", 2 << 20):
            z = logits(*common.bytes_of(batch.column("_text")), amounts.astype(np.float64), bias)
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, score_col])

    return docs.select(*kept, common.text_column(docs, text_col).alias("_text")).mapInArrow(run, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = fit(docs, labels.where(~held_out("doc_id")))
    scored = score(docs.withColumn("held_out", held_out("doc_id")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
