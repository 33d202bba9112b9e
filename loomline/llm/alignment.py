"""Alignment of two tokenizers' tokens over the same bytes, and how often pairs of their ids meet in a corpus.

Both encode a text's bytes with a space before them. Where tokens of both end at one byte they close a group. Groups are found
by skipping along a diagonal: at the current shift of indexes, slices of the two end arrays are compared, doubling while they
are equal and halving where they are not, so that a stretch of one-to-one tokens costs few comparisons; a group of other
shape is resolved by stepping the side that is behind, which gives its links and changes the shift.

1. A pass over the texts encodes and aligns them. Documents stand in blocks: the block's distinct pairs of ids with the
number of its documents that hold them, and for each document which of these it has linked how often. 2. Pairs are summed
over blocks, and an id's highest count is found. 3. Counts come back to the blocks that hold the pair, one row a pair and
block, and each block adds up its documents. Texts and tokens are not shuffled, and no table of all pairs is held anywhere.

Chunks between single spaces are encoded once and remembered: the first vocabulary's pattern breaks before a space that
something else follows, and no piece of the second has a space behind another character (else whole texts are encoded).

Cases: null and empty texts, and those whose bytes by either vocabulary are not the space and the text, have no tokens and
zeros. Very long texts are encoded and aligned whole, in linear time, and fill a block of their own. Repeated rows count each
as a document. Ties in the highest count are all counted as best. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

#: Bytes of text that are aligned at once, and distinct links of documents that close a block; both bound a task's memory.
TEXT_BYTES, BLOCK_LINKS = 1 << 20, 1 << 21
#: Chunks that a Python worker remembers in each of two generations, and the longest of them.
REMEMBERED, _LONGEST = 300_000, 64
#: Tokens at the begin of a stretch that are compared one by one.
_SHORT = 4
#: Pairs and links in one written row, and the place of a block's first pair in the order of its rows.
_ROW_PAIRS, _ROW_LINKS, _FIRST = 1 << 14, 1 << 15, -(1 << 40)


# --- the two vocabularies ----------------------------------------------------------------------------------------


def byte_signs() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: printable ones as they are, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Vocabularies:
    def __init__(self, first: bytes, second: bytes):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(first)
        self.a.encode_special_tokens = True
        signs, tokens = byte_signs(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.a_bytes[i] = bytes(map(signs.__getitem__, token)) if all(c in signs for c in token) else b""
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Whether texts may be cut before spaces for the second vocabulary.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        #: Chunk -> ids by both; None where a text with it is not cut. Two generations.
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        #: Chunks in `known` without ids of their own.
        self.odd: set[str] = set()
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        # an id's decimal digits with what follows: a comma within a group, a bar or semicolon at its end
        self.written = [b"%d%c" % (i, c) for tokens, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(tokens)) for c in (b",", last.encode())]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of a space and each text by both, as little-endian unsigned 32-bit numbers; none where either does not give
        back the bytes."""
        spaced = [" " + t for t in texts]
        first = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        second = self.b.encode(texts, num_threads=1)
        sizes = np.array([len(t.encode()) for t in spaced], np.int64)
        flat, ends, same = [], [], np.ones(len(texts), bool)
        for ids, size in ((first, self.a_size), (second, self.b_size)):
            flat.append(array("I", chain.from_iterable(ids)))
            ends.append(np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64)))
            total = np.append(0, np.cumsum(size[np.frombuffer(flat[-1], np.uint32)])) if flat[-1] else np.zeros(1, np.int64)
            same &= np.diff(total[ends[-1]]) == sizes
        # texts whose sizes agree are compared at once, and one by one only if these are not all equal
        alike, join, a_bytes, b_bytes = np.flatnonzero(same).tolist(), b"".join, self.a_bytes.__getitem__, self.b_bytes.__getitem__
        equal = lambda some: join(map(a_bytes, chain.from_iterable(first[k] for k in some))) == join(map(b_bytes, chain.from_iterable(second[k] for k in some))) == "".join(spaced[k] for k in some).encode()
        if not equal(alike):
            alike = [k for k in alike if equal([k])]
        out = [_NONE] * len(texts)
        (a, b), (a_ends, b_ends) = (x.tobytes() for x in flat), ((4 * e).tolist() for e in ends)
        for k in alike:
            out[k] = (a[a_ends[k] : a_ends[k + 1]], b[b_ends[k] : b_ends[k + 1]])
        return out

    def ids(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """encode(), by chunks between spaces where no other white space is beside them; texts without characters have none."""
        cut = [t.split(" ") if t and self.cuts else [""] for t in texts]
        if len(self.known) > REMEMBERED:
            self.old, self.known, self.odd = self.known, {}, set()
        known, odd, new = self.known, self.odd, []
        for chunk in set().union(*cut).difference(known):
            if chunk in self.old:
                known[chunk] = self.old[chunk]
                if not known[chunk] or known[chunk] == _NONE:
                    odd.add(chunk)
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                known[chunk] = None
                odd.add(chunk)
            else:
                new.append(chunk)
        for k in range(0, len(new), 4096):  # some at once: their encodings are large
            ids = self.encode(new[k : k + 4096])
            known.update(zip(new[k : k + 4096], ids, strict=True))
            odd.update(c for c, x in zip(new[k : k + 4096], ids, strict=True) if x == _NONE)
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            both = list(map(known.__getitem__, chunks))
            if not odd.isdisjoint(chunks):  # one look-up each, where a search of `both` would compare pairs
                out.append(_NONE if None not in both or not text else self.encode([text])[0])
            else:
                a, b = zip(*both, strict=True)
                out.append((b"".join(a), b"".join(b)))
        for chunk in new:
            if len(chunk) > _LONGEST:
                del known[chunk]
                odd.discard(chunk)
        return out


_NONE = (b"", b"")


@lru_cache(maxsize=1)
def vocabularies(first: bytes, second: bytes) -> Vocabularies:
    return Vocabularies(first, second)


# --- alignment ---------------------------------------------------------------------------------------------------


def aligned(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Ends a and b ascend and have one last value. Returns (starts in a, starts in b, lengths) of the one-to-one stretches,
    and the places in a and in b of the links of all other groups. A stretch of length 0 closes such a group: its starts
    are the places behind it."""
    starts_a, starts_b, lengths, links_a, links_b = [], [], [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        if a[i] == b[j]:
            begun_a, begun_b, near = i, j, min(i + _SHORT, n)
            i, j = i + 1, j + 1
            while i < near and a[i] == b[j]:  # most stretches are short: slices cost more than they skip
                i, j = i + 1, j + 1
            if i == near < n:
                step = 2
                while i < n and a[i : i + step] == b[j : j + step]:  # the last values are equal, so that both end together
                    i, j, step = i + step, j + step, step * 2
                if i >= n:
                    i = n
                else:
                    while step > 1:
                        step >>= 1
                        if a[i : i + step] == b[j : j + step]:
                            i, j = i + step, j + step
            starts_a.append(begun_a)
            starts_b.append(begun_b)
            lengths.append(i - begun_a)
        else:
            x, y = a[i], b[j]
            while x != y:
                links_a.append(i)
                links_b.append(j)
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            links_a.append(i)
            links_b.append(j)
            i, j = i + 1, j + 1
            starts_a.append(i)
            starts_b.append(j)
            lengths.append(0)
    return starts_a, starts_b, lengths, links_a, links_b


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


class Aligned:
    """Documents' tokens and groups; `of_a` names the document of each token of the first side."""

    def __init__(self, texts: list[str], v: Vocabularies):
        both = v.ids(texts)
        self.a, self.b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in zip(*both, strict=True)) if both else (np.zeros(0, np.int64),) * 2
        self.n_a, self.n_b = (np.array([len(x[k]) // 4 for x in both], np.int64) for k in (0, 1))
        # byte ranges of documents follow one another, so that documents' ends close groups
        stretch_a, stretch_b, length, link_a, link_b = (np.array(x, np.int64) for x in aligned(np.cumsum(v.a_size[self.a]).tolist(), np.cumsum(v.b_size[self.b]).tolist()))
        one_a, one_b, whole = _places(stretch_a, length), _places(stretch_b, length), length == 0
        self.of_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.closes_a, self.closes_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        self.closes_a[one_a] = self.closes_b[one_b] = True
        self.closes_a[stretch_a[whole] - 1] = self.closes_b[stretch_b[whole] - 1] = True
        self.link_a, self.link_b = np.concatenate((one_a, link_a)), np.concatenate((one_b, link_b))
        self.n_groups = np.bincount(self.of_a[self.closes_a], minlength=len(texts))
        self.n_links = np.bincount(self.of_a[self.link_a], minlength=len(texts))

    def written(self, v: Vocabularies) -> list[bytes]:
        """Each document's groups as text: ids of a group joined by commas, the sides by a bar, groups by semicolons."""
        group_a = np.cumsum(self.closes_a) - self.closes_a
        group_b = np.cumsum(self.closes_b) - self.closes_b
        behind_a, behind_b = np.flatnonzero(self.closes_a) + 1, np.append(0, np.flatnonzero(self.closes_b) + 1)
        total = len(self.a) + len(self.b)
        place_a = np.arange(len(self.a)) + behind_b[group_a]
        place_b = np.arange(len(self.b)) + behind_a[group_b]
        cells = np.zeros(total, np.int64)
        cells[place_a] = 2 * self.a + self.closes_a
        cells[place_b] = 2 * (len(v.a_bytes) + self.b) + self.closes_b
        cell, ends = v.written.__getitem__, np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(map(cell, cells[s:e].tolist()))[:-1] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


# --- blocks ------------------------------------------------------------------------------------------------------

_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_DOC = pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in _NUMBERS), ("groups_sha256", pa.string())])
_BLOCK = f"block string, seq long, pairs array<long>, counts array<int>, docs array<struct<doc_id:long,{','.join(f'{c}:long' for c in _NUMBERS)},groups_sha256:string>>, linked binary"


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, one after another."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype("<u4").tobytes() for c in columns))


def _block(name: str, parts: list[tuple]) -> pa.RecordBatch:
    """Rows of a block: slices of its distinct pairs in order, then some documents each, with what they have of the pairs."""
    pairs, place, counts = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True, return_counts=True)
    rows = [(_FIRST + k, pairs[k : k + _ROW_PAIRS], counts[k : k + _ROW_PAIRS], None, None) for k in range(0, len(pairs), _ROW_PAIRS)]
    begun = 0
    for docs, sizes, keys, times in parts:
        own, ends = place[begun : begun + len(keys)], np.append(0, np.cumsum(sizes))
        begun += len(keys)
        start = 0
        while start < len(docs):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + _ROW_LINKS, "right")) - 1)
            few = slice(ends[start], ends[stop])
            rows.append((len(rows), None, None, docs[start:stop], _packed(sizes[start:stop], own[few], times[few])))
            start = stop
    seq, *columns = zip(*rows, strict=True)
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(_DOC), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(seq, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["block", "seq", "pairs", "counts", "docs", "linked"])


def blocks(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents aligned, in blocks of rows (see _block). A pair is the first side's id times 2**32, plus the second's.
    Write the table before use: a block's name is new in each attempt."""
    shared = bpe.vocabulary(docs.sparkSession, first), bpe.vocabulary(docs.sparkSession, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(shared[0].value, shared[1].value)
        task = TaskContext.get()
        name = lambda: f"{task.partitionId()}-{task.taskAttemptId()}-{made}"
        parts, held, made = [], 0, 0
        for batch in common.slices(batches, "_text", TEXT_BYTES):
            x = Aligned(batch.column("_text").to_pylist(), v)
            numbers = (n.tolist() for n in (x.n_a, x.n_b, x.n_groups, x.n_links))
            rows = [dict(zip(_DOC.names, (*r[:-1], hashlib.sha256(r[-1]).hexdigest() if r[-1] else ""), strict=True)) for r in zip(batch.column("doc_id").to_pylist(), *numbers, x.written(v), strict=True)]
            doc, key = x.of_a[x.link_a], x.a[x.link_a] << 32 | x.b[x.link_b]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
            parts.append((rows, np.bincount(doc[heads], minlength=len(rows)), key[heads], np.diff(np.append(heads, len(doc)))))
            held += len(heads)
            if held >= BLOCK_LINKS:
                yield _block(name(), parts)
                parts, held, made = [], 0, made + 1
        if parts:
            yield _block(name(), parts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_column(docs, text_col).alias("_text")).mapInArrow(run, _BLOCK)


def pair_counts(held: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (whether no pair of its first id has more)."""
    counts = held.where("docs IS NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    counts = common.saved(counts, "pairs")
    most = counts.groupBy(F.shiftrightunsigned("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    # a row an id of the first vocabulary, whose file's size is checked: small whatever the corpus
    return counts.join(F.broadcast(most), F.shiftrightunsigned("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(held: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of blocks, with n_best and count_sum."""
    conf = held.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")  # most rows are one number; bytes bound the others
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    wanted = held.where("docs IS NULL").select("block", "seq", F.posexplode("pairs").alias("place", "pair"))
    # the counts of best pairs are negative
    back = wanted.join(counts, "pair").select("block", (F.col("seq") + F.col("place")).alias("seq"), F.when(F.col("best"), -F.col("count")).otherwise(F.col("count")).alias("count"))
    rows = back.unionByName(held.where("docs IS NOT NULL").select("block", "seq", "docs", "linked"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's counts come first, in the order of its pairs, then its documents."""
        known: list[np.ndarray] = []
        counts = np.zeros(0, np.int64)
        ended = False  # whether documents were the last that came
        for batch in batches:
            plain = np.asarray(batch.column("docs").is_null())
            edges = [0, *(np.flatnonzero(plain[1:] != plain[:-1]) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if e == s:
                    continue
                if plain[s]:
                    known = [] if ended else known
                    known.append(batch.column("count").slice(s, e - s).to_numpy())
                    ended = False
                    continue
                if not ended:
                    counts, ended = np.concatenate(known) if known else counts[:0], True
                for k in range(s, e):
                    yield _scores(batch.column("docs")[k].as_py(), batch.column("linked")[k].as_py(), counts)

    return rows.select("block", "seq", "count", "docs", "linked").repartition("block").sortWithinPartitions("block", "seq").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _scores(docs: list[dict], linked: bytes, counts: np.ndarray) -> pa.RecordBatch:
    numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(linked), "<u4").astype(np.int64)
    sizes, (place, times) = numbers[: len(docs)], numbers[len(docs) :].reshape(2, -1)
    # documents without links have no share of a sum: those with links follow one another
    some = np.flatnonzero(sizes)
    heads = (np.cumsum(sizes) - sizes)[some]
    total, best = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    if len(some):
        value = counts[place]
        total[some] = np.add.reduceat(np.abs(value) * times, heads)
        best[some] = np.add.reduceat(np.where(value < 0, times, 0), heads)
    columns = [pa.array([d[c] for d in docs], pa.int64()) for c in ("doc_id", *_NUMBERS)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(best), pa.array(total), pa.array([d["groups_sha256"] for d in docs], pa.string())], ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = common.saved(blocks(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "aligned")
    return scored(held, pair_counts(held))
