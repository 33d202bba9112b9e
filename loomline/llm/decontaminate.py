"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and characters beyond ASCII, in lower case. Documents and benchmark items that share a
seed, MATCH words in a row, are joined. Each pair is tiled: from long to short, the longest matches of words that are not
yet marked are found by running Karp-Rabin hashes and marked, until none of MATCH words is left. The share of the item's
words under tiles is its coverage, whatever the order in which its passages stand; from COVERAGE on, the document is
contaminated.

A tile's words all lie under seeds, so only those parts of a document take part. The benchmark's seeds are broadcast if
there are at most BROADCAST_SEEDS; beyond that, seeds are joined by a shuffle, with the same tiling after it.

Cases: null or empty texts and items match nothing, nor do items of fewer than MATCH words; items without an id are left
out. Repeated rows and items are tested each and give repeated pairs, texts of one id are kept apart, and rows without an
id give pairs without one; both ways of joining give the same rows. Very long texts are tested whole. Of equally long
matches the first in the item, then in the text, is marked. An empty benchmark or table gives no pairs. Other columns are
ignored, or kept where documents are returned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MATCH, COVERAGE = 5, 0.5
#: First length that the tiling looks for; it grows where longer matches turn up.
FIRST_LENGTH = 20
BROADCAST_SEEDS = 2_000_000

_INK = np.zeros(256, bool)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = True
_SEPARATED = np.where(_INK, np.arange(256), 32).astype(np.uint8)


def worded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the words of texts."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    data = _SEPARATED[np.frombuffer(b"".join(parts), np.uint8)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    starts, ends, docs = common.word_bounds(data, offsets)
    return common.Rolling(data, 6).of(starts, ends), docs


def seeds_of(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place among the words) of each run of MATCH words."""
    h, d, at = common.shingles(words, docs, MATCH)
    whole = at + MATCH <= len(words)
    whole[whole] &= docs[at[whole] + MATCH - 1] == d[whole]
    return h[whole], d[whole], at[whole]


# --- tiling ------------------------------------------------------------------------------------------------------


def tiles(item: list[int], text: list[int]) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in item, place in text, length), by running Karp-Rabin matching. Words of text under 0 match
    nothing."""
    marked_item, marked_text = bytearray(len(item)), bytearray(len(text))
    out: list[tuple[int, int, int]] = []
    length = max(MATCH, min(FIRST_LENGTH, len(item), len(text)))
    while True:
        matches = _matches(item, text, marked_item, marked_text, length)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        for i, j, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            if not any(marked_item[i : i + n]) and not any(marked_text[j : j + n]):
                marked_item[i : i + n] = marked_text[j : j + n] = b"\1" * n
                out.append((i, j, n))
            # a match cut by a longer one comes again, shorter, with a later length or the same
        if matches and any(not any(marked_item[i : i + length]) and not any(marked_text[j : j + length]) for i, j, n in matches):
            continue
        if length > 2 * MATCH:
            length //= 2
        elif length > MATCH:
            length = MATCH
        elif not matches:
            return out


def _matches(item: list[int], text: list[int], marked_item: bytearray, marked_text: bytearray, length: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of at least `length` words."""
    places = defaultdict(list)
    for j, h in _running(text, marked_text, length):
        places[h].append(j)
    best = []
    reached: dict[int, int] = {}  # diagonal -> where its last match ended
    for i, h in _running(item, marked_item, length):
        for j in places.get(h, ()):
            if reached.get(j - i, -1) > i:
                continue
            n = 0
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not marked_item[i + n] and not marked_text[j + n]:
                n += 1
            if n >= length:
                best.append((i, j, n))
                reached[j - i] = i + n
    return best


def _running(words: list[int], marked: bytearray, length: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each run of `length` unmarked words; the hash runs along."""
    base, mod = 1_000_003, (1 << 61) - 1
    top = pow(base, length - 1, mod)
    h = run = 0
    for k, word in enumerate(words):
        if marked[k] or word < 0:
            h = run = 0
            continue
        if run == length:
            h -= words[k - length] * top
            run -= 1
        h = (h * base + word) % mod
        run += 1
        if run == length:
            yield k - length + 1, h


def covered(item: list[int], hits: list[tuple[int, int]]) -> int:
    """The words of item under tiles, given hits (place in text, place in item) of seeds."""
    known: dict[int, int] = {}
    for at, place in hits:
        for k in range(MATCH):
            known[at + k] = item[place + k]
    text, last = [], None
    for at in sorted(known):
        if last is not None and at != last + 1:
            text.append(-1)
        text.append(known[at])
        last = at
    return sum(n for _, _, n in tiles(item, text))


# --- joins -------------------------------------------------------------------------------------------------------

_PAIR = "item_id long, n_words long, n_matched long, coverage double"


class Bench:
    """The benchmark's seeds and words, for tasks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        words, docs = worded([t for _, t in items])
        h, d, at = seeds_of(words, docs)
        first = np.searchsorted(docs, np.arange(len(items)))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], d[order], (at - first[d])[order]
        cut = np.split((words >> np.uint64(3)).astype(np.int64), first[1:]) if len(items) else []
        self.words = [c.tolist() for c in cut]
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def pairs(self, texts: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """Of each place in texts with a seed: (item, words of item, words under tiles)."""
        h, d, at = seeds_of(*worded(texts))
        maybe = np.flatnonzero(self.low[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        left, right = np.searchsorted(self.hash, h[maybe], "left"), np.searchsorted(self.hash, h[maybe], "right")
        hits = defaultdict(list)
        for k in np.flatnonzero(right > left).tolist():
            for s in range(left[k], right[k]):
                hits[int(d[maybe[k]]), int(self.item[s])].append((int(at[maybe[k]]), int(self.place[s])))
        out = defaultdict(list)
        for (doc, item), found in sorted(hits.items()):
            out[doc].append((item, len(self.words[item]), covered(self.words[item], found)))
        return out


def _bench(bench: DataFrame, item_col: str, text_col: str) -> "Bench | None":
    """The benchmark for broadcasting, or None if it is too large for that."""
    sized = bench.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    if sized > 6 * BROADCAST_SEEDS:  # a word and its space take two bytes at least, six on average
        return None
    rows = bench.select(F.col(item_col).cast("long"), common.text_column(bench, text_col)).collect()
    return Bench(sorted((r[0], r[1]) for r in rows if r[0] is not None))


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item that it covers: doc_id, item_id, n_words, n_matched, coverage."""
    small = _bench(bench, item_col, item_text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_column(docs, text_col).alias("_text"))
    if small is None:
        return _joined(source, bench.select(F.col(item_col).cast("long").alias("item_id"), common.text_column(bench, item_text_col).alias("_text"))).drop("key")
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in common.slices(batches, "_text", 2 << 20):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[k], known.ids[i], n, m, m / n) for k, pairs in known.pairs(batch.column("_text").to_pylist()).items() for i, n, m in pairs if m >= COVERAGE * n]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "n_words", "n_matched", "coverage"])

    return source.mapInArrow(run, f"doc_id long, {_PAIR}")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size, with `key`, that of keyed(): seeds meet by a shuffle."""
    docs, items = keyed(docs, "doc_id", "key"), keyed(items.where("item_id IS NOT NULL"), "item_id", "item")

    def seeds(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, "_text"):
                words, owner = worded(batch.column("_text").to_pylist())
                h, d, at = seeds_of(words, owner)
                at = at - np.searchsorted(owner, np.arange(batch.num_rows))[d]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(d)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int64))], [key, "seed", "at"])

        return run

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text"):
            h, owner = worded(batch.column("_text").to_pylist())
            cut = np.split((h >> np.uint64(3)).astype(np.int64), np.searchsorted(owner, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([c.tolist() for c in cut], pa.list_(pa.int64()))], ["item", "words"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            n = [len(r["words"]) for r in rows]
            m = [covered(r["words"], [(h["at"], h["place"]) for h in r["hits"]]) for r in rows]
            numbers = [pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array([x / y for x, y in zip(m, n, strict=True)], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item"), *numbers], ["key", "item", "n_words", "n_matched", "coverage"])

    # rows of one id and text are tiled once, and then stand for each of them
    texts = items.dropDuplicates(["item"])
    own = texts.select("item", "_text").mapInArrow(seeds("item"), "item long, seed long, at long").withColumnRenamed("at", "place")
    met = docs.select("key", "_text").mapInArrow(seeds("key"), "key long, seed long, at long").join(own, "seed")
    hits = met.groupBy("key", "item").agg(F.collect_set(F.struct("at", "place")).alias("hits"))
    pairs = hits.join(texts.select("item", "_text").mapInArrow(words, "item long, words array<long>"), "item")
    pairs = pairs.mapInArrow(tiled, "key long, item long, n_words long, n_matched long, coverage double").where(F.col("coverage") >= COVERAGE)
    whole = pairs.join(items.select("item", "item_id"), "item").join(docs.select("key", "doc_id"), "key")
    return whole.select("doc_id", "item_id", "n_words", "n_matched", "coverage", "key")


def keyed(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """rows (with _text) and a hash of id and text."""
    return rows.withColumn(key, F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col("_text")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that cover no benchmark item: null and empty texts stay, repeated rows stay or go together, rows without
    an id are judged like others, other columns stay, and an empty table gives no rows."""
    bench = common.read(spark, sf_dir, "benchmark")
    small = _bench(bench, "item_id", "text")
    if small is None:
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs, "text").alias("_text"))
        items = bench.select(F.col("item_id").cast("long").alias("item_id"), common.text_column(bench, "text").alias("_text"))
        gone = _joined(source, items).select(F.col("key").alias("_gone")).distinct()
        key = F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"].cast("long"), common.text_column(docs, "text"))
        return docs.join(gone, key == F.col("_gone"), "left_anti")
    shared, columns = spark.sparkContext.broadcast(small), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in common.slices(batches, "_text", 2 << 20):
            found = known.pairs(batch.column("_text").to_pylist())
            clean = [k for k in range(batch.num_rows) if not any(m >= COVERAGE * n for _, n, m in found.get(k, ()))]
            yield batch.select(columns).take(pa.array(clean, pa.int64()))

    return docs.withColumn("_text", common.text_column(docs, "text")).mapInArrow(run, T.StructType(docs.schema.fields))
