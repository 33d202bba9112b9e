"""Quality rules: measures of a text, and the frequency of its lines across the documents of its host.

Lines are normalised (A-Z in lower case, digits as 0, no white space at the ends) and hashed. For each host, the distinct
documents (distinct texts, so that exact copies count once) that hold a line are counted. A line held by more than
LEAST_DOCS documents and more than SHARE of the host's, or by more than MOST_DOCS, is boilerplate and is removed; a document
is rejected if its base measures fail, or if fewer than LEAST_WORDS words or less than LEAST_LEFT of its words are left.

Counts cover all documents: one row for each distinct line of a document is shuffled, deduplicated by line and document,
and summed with partial aggregation, so that neither a hot host nor a hot line gathers in one task. A host has few lines
over the limit (its lines divided by its limit). They are broadcast once, as hashes of host and line, as long as they are at
most BROADCAST_LINES; beyond that each text meets its own such lines by a join. Both ways give the same rows. Texts are
worked on in slices of a megabyte; a longer text stands alone and takes some 40 bytes of memory for each of its bytes.

Cases: null or empty texts have no words and fail the base rule. A null host is a host of its own. Repeated rows are
judged each, and count as one document. There are no ties: limits are compared with counts alone. An empty table gives no
rows. Other columns are kept where the operator returns documents; those named like a result are replaced by it, and
names that begin with `_lf_` are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 5
LEAST_DOCS, SHARE, MOST_DOCS = 50, 0.05, 10_000
LEAST_WORDS, LEAST_LEFT = 10, 0.3
BROADCAST_LINES = 200_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLD = common.lowered(np.arange(256, dtype=np.uint8))
_FOLD[ord("0") : ord("9") + 1] = ord("0")


class Texts:
    """The words and lines of documents that stand one after the other in data."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.docs = common.word_bounds(data, offsets)
        breaks = np.flatnonzero(data == 10)
        # a line starts at a document's start and after each break
        self.line_start = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
        self.line_end = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
        owner = np.concatenate((np.arange(self.n), np.searchsorted(offsets, breaks, "right") - 1))
        self.line_doc = np.sort(owner, kind="stable")
        # words of each line, by place in the order of words
        self.first = np.searchsorted(self.starts, self.line_start, "left")
        self.last = np.maximum(self.first, np.searchsorted(self.starts, self.line_end, "left"))

    def line_words(self) -> np.ndarray:
        return self.last - self.first

    def folded(self) -> np.ndarray:
        """Hash of each normalised line; 0 where it has no word."""
        some = self.last > self.first
        out = np.zeros(len(self.first), np.uint64)
        out[some] = common.Rolling(_FOLD[self.data], 3).of(self.starts[self.first[some]], self.ends[self.last[some] - 1])
        return out

    def measures(self) -> dict[str, np.ndarray]:
        n, rolling = self.n, common.Rolling(self.data, 2)
        inner = np.flatnonzero((self.data & 0xC0) == 0x80)  # bytes that continue a character
        chars = np.bincount(self.docs, self.ends - self.starts - np.searchsorted(inner, self.ends) + np.searchsorted(inner, self.starts), n)
        symbols = np.diff(np.searchsorted(np.flatnonzero(_SYMBOL[self.data]), self.offsets))
        some = self.last > self.first
        doc, line = self.line_doc[some], rolling.of(self.line_start[some], self.line_end[some])
        _, kinds = _first_of(doc, line)
        dup = np.bincount(doc, minlength=n) - np.bincount(doc[kinds], minlength=n)
        grams, gram_doc, at = common.shingles(rolling.of(self.starts, self.ends), self.docs, WINDOW)
        group, _ = _first_of(gram_doc, grams)
        often = at[np.bincount(group)[group] > 1] if len(group) else at
        size = len(self.starts)
        covered = np.cumsum(np.bincount(often, minlength=size)[:size] - np.bincount(often + WINDOW, minlength=size)[:size]) > 0
        found = (np.bincount(self.docs, minlength=n), chars.astype(np.int64), symbols, dup, np.bincount(self.docs[covered], minlength=n))
        return dict(zip(MEASURES, found, strict=True))


def _first_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the group of equal (a, b) of each place, the first place of each group)."""
    order = np.lexsort((b, a))
    if not len(order):
        return order, order
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def line_hashes(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """host, doc (hash of the text) and line, the hash of each distinct line of each document; line 0 is the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in common.slices(batches, "_text"):
            texts = Texts(*common.bytes_of(batch.column("_text")))
            lines = texts.folded()
            some = np.flatnonzero(texts.last > texts.first)
            some = some[_first_of(texts.line_doc[some], lines[some])[1]]
            owner = pa.array(np.concatenate((np.arange(texts.n), texts.line_doc[some])))
            hashes = np.concatenate((np.zeros(texts.n, np.uint64), lines[some])).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("host").take(owner), batch.column("doc").take(owner), pa.array(hashes)], ["host", "doc", "line"])

    text = common.text_column(docs, text_col)
    return docs.select(F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("doc"), text.alias("_text")).mapInArrow(run, "host string, doc long, line long")


def frequent_lines(seen: DataFrame) -> DataFrame:
    """host and line of the lines over their host's limit, from line_hashes."""
    counts = seen.distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    limit = F.least(F.lit(MOST_DOCS), F.greatest(F.lit(LEAST_DOCS), F.col("n") * SHARE))
    hosts = counts.where("line = 0").select(F.col("host").alias("_host"), limit.alias("most"))
    # a host has one row there
    over = counts.where((F.col("line") != 0) & (F.col("n") > LEAST_DOCS)).join(hosts, F.col("host").eqNullSafe(F.col("_host"))).where("n > most")
    return over.select("host", "line")


def _host_key(host: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(host, F.lit("")), host.isNull())


def _host_line(host: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One hash of a host's key and a line's hash."""
    with np.errstate(over="ignore"):
        return common.mix(common.mix(host, 12) + line, 13)


def judged(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without text_col, with the measures, n_left (words outside removed lines), base_failed, kept, and `cleaned`, the
    text without the removed lines (the text itself where none is removed)."""
    spark = docs.sparkSession
    seen = line_hashes(docs, text_col, host_col)
    over = common.saved(frequent_lines(seen), "lines")
    added = [T.StructField(m, T.LongType()) for m in (*MEASURES, "n_left")] + [T.StructField("cleaned", T.StringType())]
    kept = [c for c in docs.columns if c != text_col and c not in {f.name for f in added} | {"base_failed", "kept"}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *added])
    host = docs[host_col].cast("string")
    source = docs.select(*kept, docs[text_col].cast("string").alias("_lf_text"), _host_key(host).alias("_lf_host"), host.alias("_lf_name"))
    if over.count() <= BROADCAST_LINES:
        pairs = over.select(_host_key(F.col("host")), "line").collect()
        bad = np.sort(_host_line(*(np.array([r[k] for r in pairs], np.int64).view(np.uint64) for k in (0, 1))))
        shared = spark.sparkContext.broadcast(bad)
        joined = source.drop("_lf_name").withColumn("_lf_lines", F.lit(None).cast("array<bigint>"))
    else:
        # each text's own lines that are over the limit, at most as many as it has lines
        shared = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
        own = seen.join(over.select(F.col("host").alias("_host"), F.col("line").alias("_line")), F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")))
        own = own.groupBy(F.col("host").alias("_lf_h"), F.col("doc").alias("_lf_d")).agg(F.collect_set("line").alias("_lf_lines"))
        same = F.col("_lf_name").eqNullSafe(F.col("_lf_h")) & (F.xxhash64(F.coalesce("_lf_text", F.lit(""))) == F.col("_lf_d"))
        joined = source.join(own, same, "left").drop("_lf_name", "_lf_h", "_lf_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_lf_text"):
            texts = Texts(*common.bytes_of(batch.column("_lf_text")))
            found, lines, words = texts.measures(), texts.folded(), texts.line_words()
            drop = _among(_host_line(batch.column("_lf_host").to_numpy().view(np.uint64)[texts.line_doc], lines), shared.value)
            for k in np.flatnonzero(batch.column("_lf_lines").is_valid().to_numpy(zero_copy_only=False)).tolist():
                drop |= (texts.line_doc == k) & np.isin(lines, np.array(batch.column("_lf_lines")[k].as_py(), np.int64).view(np.uint64))
            drop &= words > 0
            left = found["n_words"] - np.bincount(texts.line_doc, words * drop, texts.n).astype(np.int64)
            measured = [*(pa.array(found[m].astype(np.int64)) for m in MEASURES), pa.array(left)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *measured, _without(batch.column("_lf_text"), texts.line_doc, drop)], [*kept, *MEASURES, "n_left", "cleaned"])

    out = joined.mapInArrow(run, schema)
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("n_left") < LEAST_WORDS) | (F.col("n_left") < LEAST_LEFT * F.col("n_words"))
    return out.withColumns({"base_failed": base_failed, "kept": ~base_failed & ~depleted})


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _without(column: pa.Array, line_doc: np.ndarray, drop: np.ndarray) -> pa.Array:
    """The texts without the lines that go; texts that lose none are not touched."""
    cut = np.unique(line_doc[drop])
    if not len(cut):
        return column
    first, last = np.searchsorted(line_doc, cut), np.searchsorted(line_doc, cut, "right")
    texts = []
    for k, a, b in zip(cut.tolist(), first.tolist(), last.tolist(), strict=True):
        texts.append("\n".join(line for line, gone in zip(column[k].as_py().split("\n"), drop[a:b].tolist(), strict=True) if not gone))
    mask = np.zeros(len(column), bool)
    mask[cut] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(texts, column.type))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judged(docs).select("doc_id", *MEASURES, "base_failed", "kept")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum([length(w) FOR w IN words]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols
  FROM d
), line AS (
  SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         regexp_replace(translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS folded
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM line WHERE n > 0 GROUP BY doc_id
), gram AS (
  SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM again, range(5) AS r(j) GROUP BY doc_id
), host AS (
  SELECT source, least({MOST_DOCS}, greatest({LEAST_DOCS}, {SHARE} * count(DISTINCT text))) AS most FROM d GROUP BY source
), over AS (
  SELECT source, folded FROM line JOIN host h USING (source) WHERE n > 0 GROUP BY source, folded, h.most HAVING count(DISTINCT text) > h.most
), remaining AS (
  SELECT doc_id, sum(CASE WHEN o.folded IS NULL THEN n ELSE 0 END) AS n_left
  FROM line LEFT JOIN over o ON o.source = line.source AND o.folded = line.folded AND line.n > 0 GROUP BY doc_id
)
SELECT * EXCLUDE (n_left), NOT base_failed AND n_left >= {LEAST_WORDS} AND n_left >= {LEAST_LEFT} * n_words AS kept
FROM (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed, n_left
  FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) JOIN remaining USING (doc_id)
)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, without the removed lines; n_chars follows the text. A null text is rejected (it has
    no words), repeated rows stay or go together, a null host is a host, other columns stay, and no rows give none."""
    columns = {"text": F.col("cleaned").alias("text"), "n_chars": F.char_length("cleaned").cast("long").alias("n_chars")}
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c not in columns}  # no name of a column is a result's
    out = judged(docs.select(*(F.col(c).alias(name) for c, name in own.items()), "text", F.col("source").alias("_host")), host_col="_host").where("kept")
    return out.select(*(columns[c] if c in columns else F.col(own[c]).alias(c) for c in docs.columns))
