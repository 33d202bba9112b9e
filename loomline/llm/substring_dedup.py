"""Removal of long repeated byte strings, by suffix arrays over shared neighbourhoods.

A byte goes if a string of LENGTH bytes that covers it also starts at another place, in this or in another document. Each
window of LENGTH bytes picks an anchor by its content alone: the GRAM bytes in it with the least hash, the first of equals.
Equal windows have equal anchors at equal places, so that windows need to meet only within the occurrences of one anchor.
The windows of a document that picked one occurrence stand in a row; with the bytes they cover they are its context.

1. A pass writes a row for each occurrence: anchor, fingerprint of the context, place. Equal contexts are counted by
partial aggregation: from two on, all their windows repeat. 2. Of anchors with several contexts, each distinct context is
fetched once. A task names the aligned blocks of its contexts, sorts the suffixes of all those names by Lyndon groups
(suffix_array) and reads off which runs of blocks another context shares. Only windows whose whole blocks are shared can
repeat; their hashes within the anchor decide. 3. Anchors with over MOST_CONTEXTS distinct contexts are not gathered in a
task: their windows' hashes are counted by Spark instead. 4. Repeated windows go back to all occurrences of their context
and are merged by document.

Cases: null and empty texts have no bytes; texts under LENGTH bytes lose nothing; long texts are worked on whole, one of
over 256 MB is an error. Strings that overlap in one document
count. Repeated rows are each other's copies, also under one id. Ties of hashes go to the first place. Empty tables give
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .suffix_array import suffix_array

LENGTH, GRAM, BLOCK = 400, 64, 80
MOST_CONTEXTS = 2000
#: Contexts whose names share one suffix array, unless one anchor has more.
TOGETHER = 4000
#: Low bits of a packed hash that hold its place in a slice of documents.
_PLACE = 28


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor's hash, its place, first and last window that picked it) with places in data, and the rolling
    hash of data."""
    rolling = common.Rolling(data, 31)
    span = LENGTH - GRAM + 1
    empty = np.zeros(0, np.int64)
    if len(data) >> _PLACE:
        raise ValueError(f"a text of over {1 << _PLACE} bytes")
    if len(data) < LENGTH:
        return empty, empty.astype(np.uint64), empty, empty, empty, rolling
    at = np.arange(len(data) - GRAM + 1)
    grams = rolling.windows(GRAM)
    packed = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | at.astype(np.uint64)
    # least of every run of `span`: least to the end of a block of `span`, and least from the start of the next
    padded = np.append(packed, np.full(-len(packed) % span, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - LENGTH + 1
    picked = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    whole = np.arange(windows) + LENGTH <= offsets[1:][doc]
    heads = np.flatnonzero(whole & np.append(True, (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]))
    tails = np.flatnonzero(whole & np.append((picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1]) | ~whole[1:], True))
    anchors = picked[heads]
    return doc[heads], grams[anchors], anchors, heads, tails, rolling


def _rows(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text"):
            data, offsets = common.bytes_of(batch.column("_text"))
            doc, gram, at, first, last, rolling = occurrences(data, offsets)
            with np.errstate(over="ignore"):
                context = common.mix(rolling.of(first, last + LENGTH) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(doc)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array((at - offsets[doc]).astype(np.int64)), pa.array((at - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                [key, "anchor", "context", "at", "lead", "n"],
            )

    return run


def repeated_windows(anchors: np.ndarray, leads: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Of each window of each context, whether another context of its anchor has it; one after the other. Contexts of
    one anchor stand together."""
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    rolling, second = common.Rolling(data, 33), common.Rolling(data, 34)
    # whole blocks, aligned at the anchor: numbers low..high-1 of each context
    low = -(leads // BLOCK)
    high = (sizes - leads) // BLOCK
    many = high - low
    owner = np.repeat(np.arange(len(texts)), many)
    inner = np.arange(int(many.sum())) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
    number = inner + low[owner]
    start = base[owner] + leads[owner] + number * BLOCK
    with np.errstate(over="ignore"):
        names = common.mix(rolling.of(start, start + BLOCK) + anchors[owner] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 35)
    # the names of all contexts, each closed by a separator, in one suffix array
    place = np.arange(len(names)) + owner
    string = np.full(len(names) + len(texts), -1, np.int64)
    string[place] = np.unique(names, return_inverse=True)[1]
    sorted_ = suffix_array(string)
    common_run = np.zeros(len(string) + 1, np.int64)
    left, right = sorted_[:-1], sorted_[1:]
    going = np.arange(len(left))
    for k in range(int(many.max(initial=0))):
        a, b = left[going] + k, right[going] + k
        inside = (a < len(string)) & (b < len(string))
        going, a, b = going[inside], a[inside], b[inside]
        going = going[(string[a] == string[b]) & (string[a] >= 0)]
        common_run[going] += 1  # place in the array: run shared with the next suffix
    shared = np.zeros(len(string), np.int64)
    shared[sorted_] = np.maximum(common_run[: len(sorted_)], np.append(0, common_run[: len(sorted_) - 1])) if len(sorted_) else 0
    # windows: the blocks wholly within each have to be a shared run
    of = np.repeat(np.arange(len(texts)), counts)
    window = np.arange(int(counts.sum())) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    offset = window - leads[of]
    from_, to = -(-offset // BLOCK), (offset + LENGTH) // BLOCK
    first_place = np.concatenate(([0], np.cumsum(many + 1)[:-1]))
    maybe = np.flatnonzero(shared[first_place[of] + from_ - low[of]] >= to - from_)
    begin = base[of[maybe]] + window[maybe]
    with np.errstate(over="ignore"):
        offset_of = common.mix(anchors[of[maybe]] + offset[maybe].astype(np.uint64), 37)
        h1, h2 = (common.mix(r.of(begin, begin + LENGTH) ^ offset_of, 38) for r in (rolling, second))
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    group = np.cumsum(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) - 1 if len(order) else order
    out = np.zeros(len(of), bool)
    out[maybe[order]] = np.bincount(group)[group] > 1 if len(order) else False
    return out


def _runs(flags: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Of each context: starts and ends (exclusive) of its runs of flagged windows, in turn."""
    out = []
    base = 0
    for n in counts.tolist():
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags[base : base + n].astype(np.int8), [0]))))
        out.append(edge.tolist())
        base += n
    return out



def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (of id and text), doc_id, text and runs: starts and ends of windows that repeat, in bytes, unmerged."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_column(docs, text_col).alias("_text")).withColumn("key", F.xxhash64("doc_id", "_text"))
    rows = common.saved(source.select("key", "_text").mapInArrow(_rows("key"), "key long, anchor long, context long, at long, lead int, n int"), "anchors")
    kinds = rows.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("key", "at", "lead", "n")).alias("one"))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("times").alias("most")).where("kinds > 1 OR most > 1")
    kinds = common.saved(kinds.join(several, "anchor").select("anchor", "context", "times", "kinds", "one.*"), "kinds")
    whole = kinds.where("times > 1").select("anchor", "context", F.array(F.lit(0), F.col("n")).alias("runs"))

    # fetch each context of the other anchors once; a document is read for all that it stands for
    wanted = kinds.where("kinds > 1").groupBy("key").agg(F.collect_list(F.struct("anchor", "context", "at", "lead", "n", "kinds")).alias("wanted"))
    texts = source.select("key", "_text").join(wanted, "key")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text", 1 << 20):
            out = []
            for text, wants in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                out += [(w["anchor"], w["context"], w["lead"], w["n"], w["kinds"], text[w["at"] - w["lead"] : w["at"] - w["lead"] + w["n"] - 1 + LENGTH]) for w in wants]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)], ["anchor", "context", "lead", "n", "kinds", "bytes"])

    contexts = common.saved(texts.mapInArrow(fetch, "anchor long, context long, lead int, n int, kinds long, bytes binary"), "contexts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        seen: set = set()

        def judged(rows: list[tuple]) -> pa.RecordBatch:
            anchor, context, lead, n, texts_ = zip(*rows, strict=True)
            flags = repeated_windows(np.array(anchor, np.int64).view(np.uint64), np.array(lead, np.int64), np.array(n, np.int64), list(texts_))
            runs = _runs(flags, np.array(n))
            some = [k for k, r in enumerate(runs) if r]
            return pa.RecordBatch.from_arrays([pa.array([anchor[k] for k in some], pa.int64()), pa.array([context[k] for k in some], pa.int64()), pa.array([runs[k] for k in some], pa.list_(pa.int32()))], ["anchor", "context", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "lead", "n", "bytes")), strict=True):
                if len(waiting) >= TOGETHER and row[0] != waiting[-1][0]:
                    yield judged(waiting)
                    waiting, seen = [], set()
                if row[:2] not in seen:  # repeated rows of a document fetch a context again
                    seen.add(row[:2])
                    waiting.append(row)
        if waiting:
            yield judged(waiting)

    few = contexts.where(F.col("kinds") <= MOST_CONTEXTS).repartition("anchor").sortWithinPartitions("anchor")
    found = few.select("anchor", "context", "lead", "n", "bytes").mapInArrow(compare, "anchor long, context long, runs array<int>")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "bytes", 1 << 19):
            data, base = common.bytes_of(batch.column("bytes"))
            n, lead = batch.column("n").to_numpy().astype(np.int64), batch.column("lead").to_numpy().astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), n)
            window = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            begin = base[of] + window
            anchor = batch.column("anchor").to_numpy().view(np.uint64)
            with np.errstate(over="ignore"):
                offset = common.mix(anchor[of] + (window - lead[of]).astype(np.uint64), 37)
            hashes = [common.mix(common.Rolling(data, seed).of(begin, begin + LENGTH) ^ offset, 38).view(np.int64) for seed in (33, 34)]
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(pa.array(of)), batch.column("context").take(pa.array(of)), pa.array(window.astype(np.int32)), *map(pa.array, hashes)], ["anchor", "context", "window", "h1", "h2"])

    # exact for anchors of any number of contexts: counts by window, folded before the shuffle
    many = contexts.where(F.col("kinds") > MOST_CONTEXTS).dropDuplicates(["anchor", "context"]).select("anchor", "context", "lead", "n", "bytes").mapInArrow(windows, "anchor long, context long, window int, h1 long, h2 long")
    often = many.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    hot = many.join(often, ["h1", "h2"]).groupBy("anchor", "context").agg(F.flatten(F.transform(F.collect_list("window"), lambda w: F.array(w, w + 1))).alias("runs"))

    found = whole.unionByName(found.unionByName(hot).join(whole.select("anchor", "context"), ["anchor", "context"], "left_anti"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda i: i % 2 == 0), lambda i: F.struct((F.col("at") - F.col("lead") + F.col("runs")[i]).alias("a"), (F.col("at") - F.col("lead") + F.col("runs")[i + 1] - 1 + LENGTH).alias("b")))
    marks = rows.select("key", "anchor", "context", "at", "lead").join(found, ["anchor", "context"]).select("key", F.explode(pairs).alias("r")).groupBy("key").agg(F.array_sort(F.collect_set("r")).alias("runs"))
    return source.join(marks, "key", "left")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (starts and ends of the maximal removed runs, in bytes) and kept (binary: the bytes left)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text"):
            lengths, cuts, left = [], [], []
            for text, runs in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                merged: list[dict] = []
                for r in runs or ():
                    if merged and r["a"] <= merged[-1]["b"]:
                        merged[-1]["b"] = max(merged[-1]["b"], r["b"])
                    else:
                        merged.append(dict(r))
                lengths.append(len(text))
                cuts.append([(m["a"], m["b"]) for m in merged])
                edges = [0, *(x for m in merged for x in (m["a"], m["b"])), len(text)]
                left.append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in c] for c in cuts], pa.list_(pair)), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return spans(docs, id_col, text_col).select("doc_id", "_text", "runs").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<a: bigint, b: bigint>>, kept binary")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
