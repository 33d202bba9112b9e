"""Token ids in a compact block format: static range asymmetric numeral system.

write_tokens() tokenises documents in ascending id order, counts every id over the whole corpus, scales the counts to one
shared frequency table of 2**BITS slots, and encodes the ids in independent blocks of whole documents. In a block, LANES
interleaved states take the ids in turn; every CHECKPOINT steps the states and the place in the word stream are kept, so
that the parts of a block decode in parallel. Checksums guard words, states and ids. read_tokens() decodes all blocks of a
file split at once: numpy steps through them side by side.

The text is shuffled once, by range of id; ids, tables and blocks are then written and read in place. A block holds
whole documents and knows its place in its part, so that reading needs no shuffle: starts come from the sums of parts, one
row a partition of the range shuffle.

Cases: null and empty texts have the end id alone. Strings of special tokens in a text become these tokens, as the library
has it. Very long texts are tokenised whole and fill a block of their own. Rows without an id come first. Repeated ids
follow one another in any order. An empty table writes an empty file. Other columns are ignored. An altered block fails
the read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS = 18
LANES = 64
BLOCK_TOKENS = 1 << 16
#: Blocks that one task encodes or decodes side by side.
TOGETHER = 48
CHECKPOINT = 512
_LOW = np.uint64(1 << 31)
#: Distinct chunks whose ids a Python worker remembers.
REMEMBERED = 1_000_000


# --- tokens ------------------------------------------------------------------------------------------------------


class Tokens:
    """Ids of texts by the tokenizers library. The vocabulary drops white space and never looks across it, so that each
    chunk between white space goes through the library once and is remembered, by two hashes of its bytes. The ids of a
    batch are gathered from the remembered ones by numpy."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(content)
        model = json.loads(content)
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        #: How the tokens begin that the library looks for before all else.
        self.marks = {t["content"][:2] for t in model["added_tokens"]}
        suffix = model["model"]["end_of_word_suffix"]
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for token, i in model["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        # chunks: hashes in ascending order, and where their ids stand in flat
        self.key = self.check = np.zeros(0, np.uint64)
        self.start = self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by end_id; their number in each text)."""
        data, offsets = common.bytes_of(texts)
        starts, ends, docs = common.word_bounds(data, offsets)
        check = common.words_hashed(data, starts, ends, 15)
        key, first, of = np.unique(common.words_hashed(data, starts, ends, 14), return_index=True, return_inverse=True)
        if (check != check[first][of]).any():  # two chunks of one hash
            ids = [[*e.ids, end_id] for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint16), np.array([len(x) for x in ids])
        check = check[first]
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        have = known.copy()
        have[known] = self.check[at[known]] == check[known]
        new = np.flatnonzero(~have)
        fresh = self._encoded([data[starts[k] : ends[k]].tobytes().decode() for k in first[new].tolist()])
        flat = np.concatenate((self.flat, np.frombuffer(b"".join(fresh), "<u2")))
        start, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        start[have], count[have] = self.start[at[have]], self.count[at[have]]
        count[new] = [len(x) // 2 for x in fresh]
        start[new] = len(self.flat) + np.cumsum(count[new]) - count[new]
        self._remember(key, check, start, count, flat, np.flatnonzero(~known))
        size = count[of]
        before = np.cumsum(size) - size
        total = np.bincount(docs, size, len(texts)).astype(np.int64) + 1
        out = np.full(int(total.sum()), end_id, np.uint16)
        place = np.arange(int(size.sum()))
        out[place + np.repeat(docs, size)] = flat[place + np.repeat(start[of] - before, size)]
        return out, total

    def _remember(self, key: np.ndarray, check: np.ndarray, start: np.ndarray, count: np.ndarray, flat: np.ndarray, new: np.ndarray) -> None:
        # new: those of a hash that no remembered chunk has
        if len(self.key) + len(new) > REMEMBERED:  # go on with the chunks of this batch
            place = np.arange(int(count.sum()))
            self.flat = flat[place + np.repeat(start - np.cumsum(count) + count, count)]
            self.key, self.check, self.start, self.count = key, check, np.cumsum(count) - count, count
            self.words = {}
            return
        columns = [np.concatenate((old, more[new])) for old, more in ((self.key, key), (self.check, check), (self.start, start), (self.count, count))]
        order = np.argsort(columns[0], kind="stable")
        self.key, self.check, self.start, self.count = (c[order] for c in columns)
        self.flat = flat

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each chunk."""
        # below U+0300, but for one capital, neither composing nor lower case changes where words end
        plain = [max(c) < "\u0300" and "\u0130" not in c and not any(m in c for m in self.marks) for c in chunks]
        cut = [self._cut(c.lower()) for c, p in zip(chunks, plain, strict=True) if p]
        self._learn(list(set().union(*cut).difference(self.words)))
        rest = [c for c, p in zip(chunks, plain, strict=True) if not p]
        others = (np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(rest, add_special_tokens=False))
        get, cuts = self.words.__getitem__, iter(cut)
        return [b"".join(map(get, next(cuts))) if p else next(others) for p in plain]

    def _cut(self, chunk: str) -> list[str]:
        """The words of a chunk; letters alone, or with one sign behind them, need no pattern."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def _learn(self, words: list[str]) -> None:
        """All words in one call; each ends with the one id that has the vocabulary's mark of a word's end."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u2")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words):
            coded, at = ids.tobytes(), 0
            for word, end in zip(words, (ends * 2).tolist(), strict=True):
                self.words[word] = coded[at:end]
                at = end
        else:
            for word, encoded in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
                self.words[word] = np.array(encoded.ids, "<u2").tobytes()


@lru_cache(maxsize=2)
def _tokens(content: bytes) -> Tokens:
    return Tokens(content)


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, seq, at and ids (binary, unsigned 16-bit): parts and places in them follow the order of id_col; `at`
    ids of the part come before."""
    spark = docs.sparkSession
    with open(path, "rb") as file:
        content = file.read(64 << 20)
    if len(content) >= 64 << 20:
        raise ValueError(f"{path} is no vocabulary: over 64 MB")
    shared = spark.sparkContext.broadcast(content)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_column(docs, text_col).alias("_text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        known = _tokens(shared.value)
        for batch in common.slices(batches, "_text", 2 << 20):
            ids, total = known(batch.column("_text"), end_id)
            n, ends = len(total), np.cumsum(total)
            column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(at + ends - total), column], ["doc_id", "part", "seq", "at", "ids"])
            seq, at = seq + n, at + int(ends[-1])

    return ordered.mapInArrow(run, "doc_id long, part int, seq long, at long, ids binary")


def counted(tokens: DataFrame) -> np.ndarray:
    """How often each 16-bit id occurs in the whole of tokens; at most 65,536 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(common.bytes_of(batch.column("ids"))[0].view("<u2"), minlength=1 << 16)
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS; an id that occurs has 1 at least."""
    whole = 1 << BITS
    out = np.zeros(len(counts), np.int64)
    (seen,) = np.nonzero(counts)
    if not len(seen):
        out[0] = whole
        return out
    out[seen] = np.maximum(1, np.floor(counts[seen] * (whole / counts.sum())))
    order = seen[np.argsort(-out[seen], kind="stable")]
    over, k = int(out.sum()) - whole, 0
    while over:  # take from, or give to, the most frequent
        step = min(over, int(out[order[k]]) // 2) if over > 0 else over
        out[order[k]] -= step
        over -= step
        k = (k + 1) % len(order)
    return out


# --- blocks ------------------------------------------------------------------------------------------------------


class Model:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
        self.filler = int(np.argmax(freq))

    def encode(self, blocks: list[np.ndarray]) -> list[dict]:
        """Of each block of ids: words, states at the checkpoints, places of the checkpoints in the words."""
        order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
        steps = [-(-len(blocks[k]) // LANES) for k in order]
        ids = np.full((steps[0], len(blocks), LANES), self.filler, np.uint16)
        for row, k in enumerate(order):
            flat = np.full(steps[row] * LANES, self.filler, np.uint16)
            flat[: len(blocks[k])] = blocks[k]
            ids[: steps[row], row] = flat.reshape(-1, LANES)
        steps = np.array(steps)
        words, out = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
        x = np.full((len(blocks), LANES), _LOW)
        kept: dict[int, np.ndarray] = {}
        low, bits = np.uint64(32), np.uint64(BITS)
        for t in range(steps[0] - 1, -1, -1):
            n = int(np.searchsorted(-steps, -t, "left"))  # blocks that have a step t
            y, s = x[:n], ids[t, :n]
            f = self.freq[s]
            full = y >= (f << np.uint64(63 - BITS))
            out[t, :n], words[t, :n] = full, y.astype(np.uint32)
            y = np.where(full, y >> low, y)
            q = y // f
            x[:n] = (q << bits) + (y - q * f) + self.start[s]
            if t % CHECKPOINT == 0:
                kept[t] = x[:n].copy()
        made: list[dict] = [{}] * len(blocks)
        for row, k in enumerate(order):
            marks = range(0, int(steps[row]), CHECKPOINT)
            sums = np.concatenate(([0], np.cumsum(out[: steps[row], row].sum(axis=1))))
            made[k] = {"words": words[: steps[row], row][out[: steps[row], row]], "states": np.stack([kept[t][row] for t in marks]), "places": sums[list(marks)]}
        return made

    def decode(self, blocks: list[dict]) -> list[np.ndarray]:
        """The ids of each block: words, states, places and n, the number of ids."""
        parts = []  # (steps, block, first step, place)
        bases = np.concatenate(([0], np.cumsum([len(b["words"]) for b in blocks])))
        for k, b in enumerate(blocks):
            steps = -(-b["n"] // LANES)
            parts += [(min(CHECKPOINT, steps - t), k, t, i) for i, t in enumerate(range(0, steps, CHECKPOINT))]
        parts.sort(key=lambda p: -p[0])
        steps = np.array([p[0] for p in parts])
        x = np.stack([blocks[k]["states"][i] for _, k, _, i in parts])
        at = np.array([bases[k] + blocks[k]["places"][i] for _, k, _, i in parts])
        stream = np.concatenate([b["words"] for b in blocks] + [np.zeros(LANES, np.uint32)]).astype(np.uint64)
        ids = np.zeros((steps[0], len(parts), LANES), np.uint16)
        mask, bits, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
        for t in range(steps[0]):
            n = int(np.searchsorted(-steps, -t, "left"))
            y = x[:n]
            place = y & mask
            s = self.slot[place]
            ids[t, :n] = s
            y = self.freq[s] * (y >> bits) + place - self.start[s]
            short = y < _LOW
            order = np.cumsum(short, axis=1)
            x[:n] = np.where(short, (y << low) | stream[np.minimum(at[:n, None] + order - 1, len(stream) - 1)], y)
            at[:n] += order[:, -1]
        whole = [np.zeros(-(-b["n"] // LANES) * LANES, np.uint16) for b in blocks]
        for row, (n, k, t, i) in enumerate(parts):
            whole[k][t * LANES : (t + n) * LANES] = ids[:n, row].ravel()
            after = blocks[k]["states"][i + 1] if i + 1 < len(blocks[k]["states"]) else _LOW
            if not (x[row] == after).all():
                raise ValueError("a block's states do not meet: it was altered")
        return [w[: b["n"]] for w, b in zip(whole, blocks, strict=True)]


_BLOCK = "part int, at long, n_tokens long, doc_ids array<long>, lengths array<long>, words binary, states binary, places binary, crc_coded long, crc_ids long"


def encoded(tokens: DataFrame, freq: np.ndarray) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        waiting: list[tuple] = []  # (part, ids before it, document ids, id arrays)
        block: tuple | None = None
        size = 0
        for batch in batches:
            data, offsets = common.bytes_of(batch.column("ids"))
            data = data.view("<u2")
            for k, (doc, part, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "at")), strict=True)):
                if block and (size >= BLOCK_TOKENS or part != block[0] or at != block[1] + size):
                    waiting.append(block)
                    block = None
                if block is None:
                    block, size = (part, at, [], []), 0
                ids = data[offsets[k] // 2 : offsets[k + 1] // 2]
                block[2].append(doc)
                block[3].append(ids)
                size += len(ids)
            if len(waiting) >= TOGETHER:
                yield _rows(model, waiting)
                waiting = []
        if block:
            waiting.append(block)
        if waiting:
            yield _rows(model, waiting)

    return tokens.select("doc_id", "part", "at", "ids").mapInArrow(run, _BLOCK)


def _rows(model: Model, blocks: list[tuple]) -> pa.RecordBatch:
    ids = [np.concatenate(b[3]) for b in blocks]
    rows = []
    for (part, at, docs, pieces), whole, made in zip(blocks, ids, model.encode(ids), strict=True):
        words, states, places = made["words"].astype("<u4").tobytes(), made["states"].astype("<u8").tobytes(), made["places"].astype("<i8").tobytes()
        crc = zlib.crc32(places, zlib.crc32(states, zlib.crc32(words)))
        rows.append({"part": part, "at": at, "n_tokens": len(whole), "doc_ids": docs, "lengths": [len(p) for p in pieces], "words": words, "states": states, "places": places, "crc_coded": crc, "crc_ids": zlib.crc32(whole.astype("<u4").tobytes())})
    types = {"part": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "words": pa.binary(), "states": pa.binary(), "places": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.int64())) for c in rows[0]], list(rows[0]))


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes `blocks` and `table` into folder."""
    spark = docs.sparkSession
    tokens = common.saved(tokenised(docs, path, end_id, id_col, text_col), "tokens")
    freq = table(counted(tokens))
    (seen,) = np.nonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in seen], "id int, freq long").coalesce(1).write.parquet(f"{folder}/table")
    encoded(tokens, freq).write.parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary: little-endian unsigned 32-bit)."""
    freq = np.zeros(1 << 16, np.int64)
    for row in spark.read.parquet(f"{folder}/table").collect():  # 65,536 rows at most
        freq[row["id"]] = row["freq"]
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row a part, as many as the range shuffle had partitions
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select(F.col("part").alias("_part"), "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            rows = batch.to_pylist()
            for r in rows:
                if zlib.crc32(r["places"], zlib.crc32(r["states"], zlib.crc32(r["words"]))) != r["crc_coded"]:
                    raise ValueError("a block's words or states were altered")
            ids = model.decode([{"n": r["n_tokens"], "words": np.frombuffer(r["words"], "<u4"), "states": np.frombuffer(r["states"], "<u8").reshape(-1, LANES), "places": np.frombuffer(r["places"], "<i8")} for r in rows])
            for r, whole in zip(rows, ids, strict=True):
                whole = whole.astype("<u4")
                if zlib.crc32(whole.tobytes()) != r["crc_ids"]:
                    raise ValueError("a block's ids were altered")
                ends = np.cumsum(r["lengths"])
                begins = ends - r["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["before"] + r["at"], pa.int64()), pa.array([whole[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    placed = blocks.join(F.broadcast(parts), F.col("part") == F.col("_part")).drop("_part")
    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch(spark, "rans")
    write_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    tokens = read_tokens(spark, folder)
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
