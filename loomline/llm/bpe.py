"""Byte-level byte-pair encoding and decoding by backtracking over an Aho-Corasick automaton.

encode() and decode() map documents to token ids and back without a shuffle. A pre-token's bytes stand as Latin-1 text in
the automaton, which names the longest token at each position in one pass. The encoder takes the longest token, checks
that it can follow the token before it (memoised: the merges of the two tokens' bytes give just these two), else tries
the next shorter one, else goes back a token. This gives the ids that merging by rank gives, in time linear in the length.

Cases: a null or empty text has no ids and decodes to no bytes; null ids too. Very long texts are encoded whole, in time
linear in their length. Repeated rows are encoded each. There are no ties: ranks differ. An empty table gives no rows.
Other columns are kept by name as they are; the two new columns' names are parameters, so that they need not clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Distinct pre-tokens, chunks and pairs that a Python worker remembers each, in two generations: when the young one is full
#: it becomes the old one, and what is used again comes back from there.
REMEMBERED = 200_000


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for piece, rank in ranks.items():
            self.automaton.add_word(piece.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.words = _Known(self.word, 64)
        self.chunks = _Known(self.chunk, 64)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives token, by definition of the encoding: merging the adjacent pair of lowest
        rank, the leftmost first. A single byte gives itself twice; None where merging never gives token."""
        if token not in self.split:
            piece, ranks = self.token[token], self.ranks
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                rank, best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.split[token] = (token, token) if len(parts) == 1 else (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def follows(self, last: int, token: int) -> bool:
        """Whether token can stand after last (-1 at the start): merging both tokens' bytes gives these two again. Undoes
        the merges of both, the latest first, and looks for a merge across their border that would have come before."""
        key = last << 32 | token  # one number: the collector of cycles need not look at it
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.halves(token) is not None and (last < 0 or self._fit(last, token))
        return known

    def _fit(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while self.ranks.get(self.token[left] + self.token[right], 1 << 60) >= limit:
            inner = self.halves(left)[1] if left > right else left
            if inner != left:
                left, limit = inner, left
                continue
            inner = self.halves(right)[0]
            if inner != right:
                right, limit = inner, right + 1
                continue
            inner = self.halves(left)[1]
            if inner == left:
                return True
            left, limit = inner, left
        return False

    def prefix(self, token: int) -> int:
        """The longest shorter token that token begins with, or -1."""
        known = self.shorter.get(token)
        if known is None:
            piece = self.token[token]
            known = self.shorter[token] = next((self.ranks[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ranks), -1)
        return known

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest = [-1] * len(piece)
        reach = [0] * len(piece)
        token = self.token
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - len(token[rank])
            if end + 1 > reach[start]:
                reach[start], longest[start] = end + 1, rank
        open_at = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, trying = 0, longest[0]
        while at < len(piece):
            last = out[-1] if out else -1
            while trying >= 0 and not (open_at[at + len(token[trying])] and self.follows(last, trying)):
                trying = self.prefix(trying)
            if trying >= 0:
                out.append(trying)
                at += len(token[trying])
                trying = longest[at] if at < len(piece) else -1
            elif out:
                open_at[at] = 0
                at -= len(token[last])
                trying = out.pop()
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def word(self, word: str) -> bytes:
        return np.array(self.encode(word.encode()), "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a space and chunk, which has to begin and end with other than white space: the pattern then always
        breaks before that space and before a next one."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsafe
        return b"".join(map(self.words.__getitem__, self.find(" " + chunk)))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        self.words.age()
        self.chunks.age()
        if len(self.fits) > 2 * REMEMBERED:
            self.fits.clear()
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _Unsafe
            head = b"".join(map(self.words.__getitem__, self.find(first)))
            return head + b"".join(map(self.chunks.__getitem__, rest))
        except _Unsafe:
            return b"".join(map(self.words.__getitem__, self.find(text)))


class _Unsafe(Exception):
    """A text with runs of white space, which is not cut at its spaces."""


class _Known(dict):
    """Key -> make(key); long keys are not kept."""

    def __init__(self, make, longest: int):
        super().__init__()
        self.make, self.longest = make, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


def ranked(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


@lru_cache(maxsize=2)
def coder(content: bytes, pattern: str) -> Coder:
    return Coder(ranked(content), pattern)


@lru_cache(maxsize=2)
def pieces(content: bytes) -> list[bytes]:
    """The bytes of each id."""
    ranks = ranked(content)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


common.kept(coder.cache_clear)
common.kept(pieces.cache_clear)


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast; its size is checked (a vocabulary does not grow with the corpus)."""
    with open(path, "rb") as file:
        content = file.read(64 << 20)
    if len(content) >= 64 << 20:
        raise ValueError(f"{path} is no vocabulary: over 64 MB")
    return spark.sparkContext.broadcast(content)


def _decoded(ids: list[bytes], token: list[bytes]) -> pa.Array:
    piece = token.__getitem__
    return pa.array([b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in ids], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", bytes_col: str | None = None) -> DataFrame:
    """docs without text_col, with ids_col (binary: little-endian unsigned 32-bit ids) and count_col; with bytes_col, if
    named, as decode() gives it, from the same Python worker: decode() after encode() has a task hold two workers, which
    Spark gives to either in turn, so that in the end all of them remember what the coder does."""
    shared = vocabulary(docs.sparkSession, path)
    kept = [c for c in docs.columns if c not in (text_col, ids_col, count_col, bytes_col)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())])
    if bytes_col:
        schema.add(bytes_col, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(shared.value, pattern)
        for batch in common.slices(batches, "_text", 2 << 20):
            ids = [known.ids(t) if t else b"" for t in batch.column("_text").to_pylist()]
            columns = [*(batch.column(c) for c in kept), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [_decoded(ids, known.token)] * bool(bytes_col), schema.names)

    return docs.select(*kept, common.text_column(docs, text_col).alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """encoded with bytes_col (binary), what ids_col stands for."""
    shared = vocabulary(encoded.sparkSession, path)
    kept = [c for c in encoded.columns if c != bytes_col]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = pieces(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _decoded(batch.column(ids_col).to_pylist(), token)], [*kept, bytes_col])

    return encoded.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    both = encode(docs, path, pattern, bytes_col="bytes")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, common.read(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each document; the module's cases hold."""
    import public_tokenizers

    return digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
