"""Phrases whose words stand together more often than apart, by multikey quicksort of suffix pointers.

1. A pass over the texts cuts them into pieces and words and keeps each slice as its distinct words and their codes, so that
texts are read once. Words are counted by language; a word of a language stands as a 64-bit key from here on, after a check
that no two words share one (else keys are salted anew). 2. Words under LEAST occurrences end suffixes, and so do pairs of
neighbours under LEAST: filters of bounded size hold the frequent ones and let a few others pass, which costs time and no
result. Suffixes, up to MOST_WORDS words from each place, are folded where equal within a task. 3. Suffixes are routed by
their leading two words, in parts of many rows; those of a pair with more than one task should hold by all words, so that
tasks count parts of its phrases, which are summed. 4. A task sorts pointers to its suffixes three ways by the word at the
current depth: smaller, equal, larger. The weight of the equal part is the count of the phrase; it goes on at the next word.
Parts under LEAST are abandoned. 5. Counts are joined to the cuts of each phrase; arithmetic is by decimals.

Cases: null and empty texts have no words; a null language is NO_LANG. Ties in the score go to the smallest cut, in the order to
the higher count, then to the phrase by bytes. Repeated rows count each. Very long texts are a slice of their own. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST, MOST_WORDS, TOP, NO_LANG = 100, 5, 2000, "und"
#: Suffixes that a task sorts, about; a pair with more is dealt by all words.
LEAF_ROWS = 200_000
#: Suffixes that a task holds to fold equal ones.
FOLDED = 1_000_000
#: Bits of a filter: this many a key, a power of two within these bounds.
FILTER_BITS, LEAST_BITS, MOST_FILTER = 16, 1 << 16, 1 << 29
_SLICE_BITS = 1 << 18
#: Bytes of text in a slice whose distinct words are one list.
SLICE_BYTES = 4 << 20

_TABLE = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b < 91 else b for b in range(256))


# --- words -------------------------------------------------------------------------------------------------------


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def encoded(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, words, counts and codes (32-bit, compressed) of slices of the texts: code 0 ends a piece, code k is words[k - 1]."""

    def rows(texts: dict[str, list[bytes]]) -> pa.RecordBatch:
        out = []
        for lang, parts in texts.items():
            known = _Codes({b"\n": 0})
            codes = np.fromiter(map(known.__getitem__, filter(None, b"\n".join(parts).translate(_TABLE).replace(b"\n", b" \n ").split(b" "))), np.uint32)
            counts = np.bincount(codes, minlength=len(known))[1:]
            again = (codes[1:] == 0) & (codes[:-1] == 0)
            out.append((lang, [w.decode() for w in list(known)[1:]], counts, zstandard.ZstdCompressor(level=1).compress(codes[np.append(True, ~again)].astype("<u4").tobytes() if len(codes) else b"")))
        langs, words, counts, codes = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), pa.array(codes, pa.binary())], ["lang", "words", "counts", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = {}, 0
        for batch in common.slices(batches, "_text", SLICE_BYTES):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_text"), strict=True):
                content = text.as_buffer().to_pybytes()
                texts.setdefault(lang, []).append(content)
                held += len(content)
            if held >= SLICE_BYTES:
                yield rows(texts)
                texts, held = {}, 0
        if texts:
            yield rows(texts)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG))
    return docs.select(lang.alias("lang"), common.text_column(docs, text_col).alias("_text")).mapInArrow(run, "lang string, words array<string>, counts array<long>, codes binary")


def counted_words(held: DataFrame) -> tuple[DataFrame, int]:
    """lang, word, n and key of each word of a language, and the salt with which no two share a key."""
    counts = common.saved(held.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n")), "words")
    for salt in range(8):
        keyed = counts.withColumn("key", F.xxhash64("lang", "word", F.lit(salt)))
        if keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1 OR key = 0").isEmpty():  # 0 stands for no word
            return keyed, salt
    raise RuntimeError("words without keys of their own")


# --- filters -----------------------------------------------------------------------------------------------------


def _probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(common.mix(keys, seed) & np.uint64(bits - 1)).astype(np.int64) for seed in (31, 32)]


def bloom(keys: DataFrame, name: str = "key") -> np.ndarray:
    """A filter over the keys (long): one byte holds eight bits. MOST_FILTER bounds it whatever the corpus; what it lets
    pass besides is dropped later, where all is counted exactly."""
    bits = min(MOST_FILTER, max(LEAST_BITS, 1 << max(1, keys.count() * FILTER_BITS - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                order = np.sort(at)
                for k in np.unique(order // _SLICE_BITS).tolist():
                    part = parts.setdefault(k, np.zeros(_SLICE_BITS, bool))
                    part[order[np.searchsorted(order, k * _SLICE_BITS) : np.searchsorted(order, (k + 1) * _SLICE_BITS)] - k * _SLICE_BITS] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(p).tobytes() for p in parts.values()], pa.binary())], ["part", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                parts[k] = parts.get(k, np.uint8(0)) | np.frombuffer(part, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["part", "bits"])

    schema, out = "part int, bits binary", np.zeros(max(bits, _SLICE_BITS) // 8, np.uint8)
    for row in keys.select(name).mapInArrow(mark, schema).repartition("part").mapInArrow(unite, schema).toLocalIterator():
        out[row["part"] * _SLICE_BITS // 8 : (row["part"] + 1) * _SLICE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out[: bits // 8]


def passes(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    first, second = (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 for at in _probes(keys, 8 * len(table)))
    return (first & second).astype(bool)


# --- suffixes ----------------------------------------------------------------------------------------------------


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(common.mix(a, 41) * np.uint64(3) + b, 42)


class _Slice:
    """Keys along a slice; 0 stands for the end of a piece and for words that the filter drops."""

    def __init__(self, codes: bytes, keys: np.ndarray, words: np.ndarray):
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(codes), "<u4")
        keys = keys.view(np.uint64)
        self.along = np.append(np.append(np.uint64(0), np.where(passes(keys, words), keys, np.uint64(0)))[codes], np.zeros(MOST_WORDS, np.uint64))
        self.places = np.flatnonzero((self.along[:-1] != 0) & (self.along[1:] != 0))
        self.pairs = pair_key(self.along[self.places], self.along[self.places + 1])

    def suffixes(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffixes (a row each, ended by 0) and how often they stand here; the pairs of each pass the filter."""
        good = np.zeros(len(self.along), bool)
        good[self.places[passes(self.pairs, pairs)]] = True
        at = np.flatnonzero(good)
        rows, open_rows = np.zeros((len(at), MOST_WORDS), np.uint64), np.ones(len(at), bool)
        rows[:, 0] = self.along[at]
        for k in range(1, MOST_WORDS):
            open_rows &= good[at + k - 1]
            rows[open_rows, k] = self.along[at[open_rows] + k]
        return _folded(rows, np.ones(len(rows), np.int64))


def _folded(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
    return rows[heads], np.add.reduceat(n[order], heads) if len(heads) else n[:0]


def _slices(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[_Slice]:
    for batch in batches:
        for codes, keys in zip(batch.column("codes"), batch.column("keys"), strict=True):
            yield _Slice(codes.as_py(), keys.values.to_numpy(), words)


def suffixes(held: DataFrame, words: DataFrame, salt: int, least: int, leaf: int = LEAF_ROWS) -> tuple[DataFrame, int]:
    """bucket, whole and part: suffixes of two words and more, folded within tasks, dealt into buckets by their leading two
    words; and the number of buckets. A pair of over `leaf` suffixes is dealt by all words, and its parts are not whole. A part
    is a compressed table: five columns of keys (0 behind the end) and one of counts."""
    send = held.sparkSession.sparkContext.broadcast
    keyed = held.select(F.transform("words", lambda w: F.xxhash64(F.col("lang"), w, F.lit(salt))).alias("keys"), "codes")
    word_filter = send(bloom(words.where(F.col("n") >= least)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(batches, word_filter.value):
            found, n = np.unique(x.pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    frequent = common.saved(keyed.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "pairs")
    pair_filter, large_filter = send(bloom(frequent)), send(bloom(frequent.where(F.col("n") > leaf)))
    buckets = max(1, -(-int(frequent.agg(F.sum("n")).first()[0] or 0) // leaf))

    def parts(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lead = pair_key(rows[:, 0], rows[:, 1])
        large = passes(lead, large_filter.value)
        every = lead
        for k in range(2, MOST_WORDS):
            every = pair_key(every, rows[:, k])
        bucket = (np.where(large, every, lead) % np.uint64(buckets)).astype(np.int64) * 2 + ~large
        order = np.argsort(bucket, kind="stable")
        table = np.column_stack((rows.view(np.int64), n))[order]
        heads = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        packed = [zstandard.ZstdCompressor(level=1).compress(np.asfortranarray(t).tobytes(order="F")) for t in np.split(table, heads[1:])] if len(heads) else []
        of = bucket[order][heads]
        return pa.RecordBatch.from_arrays([pa.array((of >> 1).astype(np.int32)), pa.array((of & 1).astype(bool)), pa.array(packed, pa.binary())], ["bucket", "whole", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows = [(np.zeros((0, MOST_WORDS), np.uint64), np.zeros(0, np.int64))]
        for x in _slices(batches, word_filter.value):
            open_rows.append(x.suffixes(pair_filter.value))
            if sum(len(n) for _, n in open_rows) >= FOLDED:
                rows, n = _folded(*map(np.concatenate, zip(*open_rows, strict=True)))
                open_rows = [(rows, n)]
                if len(n) >= FOLDED // 2:  # too few meet again to hold them
                    yield parts(rows, n)
                    open_rows = [(rows[:0], n[:0])]
        yield parts(*_folded(*map(np.concatenate, zip(*open_rows, strict=True))))

    return keyed.mapInArrow(run, "bucket int, whole boolean, part binary"), buckets


# --- multikey quicksort ------------------------------------------------------------------------------------------


def frequent_parts(rows: np.ndarray, n: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place of one suffix, depth, weight) of each prefix of the suffixes whose weight reaches `least`."""
    out = []
    todo = [(np.arange(len(n)), 0)]
    while todo:
        pointers, depth = todo.pop()
        words = rows[pointers, depth]
        pivot = words[len(words) >> 1]
        for part, equal in ((pointers[words < pivot], False), (pointers[words == pivot], True), (pointers[words > pivot], False)):
            if not len(part) or (weight := int(n[part].sum())) < least:
                continue
            if not equal:
                todo.append((part, depth))
            elif pivot:  # 0 is the end of its suffixes
                out.append((int(part[0]), depth + 1, weight))
                if depth + 1 < MOST_WORDS:
                    todo.append((part, depth + 1))
    return out


def all_prefixes(rows: np.ndarray, n: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(words, weight) of every prefix: of a pair that many tasks share, no part can be abandoned here."""
    rows, n = _folded(rows, n)
    out = []
    differs = np.ones(len(rows), bool)
    for depth in range(1, MOST_WORDS + 1):
        differs[1:] = (rows[1:, :depth] != rows[:-1, :depth]).any(axis=1)
        heads = np.flatnonzero(differs)
        weights = np.add.reduceat(n, heads) if len(heads) else n[:0]
        there = rows[heads, depth - 1] != 0
        out += [(tuple(w), a) for w, a in zip(rows[heads[there], :depth].view(np.int64).tolist(), weights[there].tolist(), strict=True)]
    return out


def counted_phrases(parts: DataFrame, buckets: int, least: int) -> DataFrame:
    """words (keys, two and more) and a, the count, of phrases that occur `least` times."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for batch in batches:
            for whole, part in zip(batch.column("whole").to_pylist(), batch.column("part").to_pylist(), strict=True):
                tables[whole].append(np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.int64).reshape(MOST_WORDS + 1, -1).T)
        for whole, found in tables.items():
            if found:
                table = np.concatenate(found)
                rows, n = np.ascontiguousarray(table[:, :MOST_WORDS]).view(np.uint64), np.ascontiguousarray(table[:, MOST_WORDS])
                phrases = [(table[p, :d].tolist(), a) for p, d, a in frequent_parts(rows, n, least)] if whole else all_prefixes(rows, n)
                phrases = [(w, a) for w, a in phrases if len(w) > 1]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in phrases], pa.list_(pa.int64())), pa.array([a for _, a in phrases], pa.int64())], ["words", "a"])

    found = parts.repartition(buckets, "bucket").mapInArrow(sort, "words array<long>, a long")
    return common.saved(found.groupBy("words").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")


# --- scores ------------------------------------------------------------------------------------------------------


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", leaf: int = LEAF_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases."""
    held = common.saved(encoded(docs, lang_col, text_col), "slices")
    words, salt = counted_words(held)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = common.saved(words.where(F.col("n") >= least).select("lang", "word", "n", "key"), "frequent")
    phrases = counted_phrases(*suffixes(held, words, salt, least, leaf), least)

    # dropped: whose words lie in a longer phrase that is as frequent
    size = F.size("words")
    inner = phrases.where(size > 2).select("a", F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))").alias("parts"))
    most = inner.select(F.explode("parts").alias("words"), "a").groupBy("words").agg(F.max("a").alias("longer"))
    alone = phrases.join(most, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a"))).select("words", "a")

    parts = phrases.unionByName(frequent.select(F.array("key").alias("words"), F.col("n").alias("a")))
    side = lambda of, to: parts.select(F.col("words").alias(of), F.col("a").alias(to))
    cuts = alone.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(side("first", "l"), "first").join(side("rest", "r"), "rest")
    # the language is that of any word; totals are a row a language
    cuts = cuts.join(frequent.select("lang", F.col("key").alias("_key")), F.element_at("words", 1) == F.col("_key")).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n"), whole("l") * whole("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "words", "a", "n", "cut.l", "cut.r", "cut.score")
    # words are named where ties may still need it
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = common.saved(best.withColumn("_rank", F.rank().over(ahead)).where(F.col("_rank") <= top).drop("_rank"), "best")
    named = best.select("words", F.posexplode("words").alias("place", "key")).join(frequent.select("key", "word"), "key").groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(named, "words").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), f AS (
  SELECT lang, words[i : i + k - 1] AS p, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(words) >= k)
  GROUP BY ALL HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, p, f AS a, len(p) AS k FROM f WHERE len(p) > 1
), inner_part AS (
  SELECT lang, p[i : i + m - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) r(m) WHERE m < k)
  GROUP BY ALL
), cut AS (
  SELECT c.lang, c.p, c.a, j, x.f AS l, y.f AS r, n, (1000 * c.a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT c.*, unnest(range(1, k)) AS j FROM c ANTI JOIN inner_part i ON i.lang = c.lang AND i.p = c.p AND 100 * i.longer >= 100 * c.a) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : j]
  JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1 :]
  JOIN total t ON t.lang = c.lang
), best AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
