"""Exact set-similarity join of documents on word shingles, with grouped prefixes.

A document's set holds the hashes of its distinct runs of WIDTH words. Two documents link when 100 * intersection >=
PERCENT * union; linked documents share a shingle within their prefixes, the first n - ceil(n * PERCENT / 100) + 1 of a
set's n shingles in one order for all. The order puts rare shingles first, by counts of all documents in a table of hashed
counters (collisions change how good the order is, never a result).

1. A pass over all texts counts shingles. 2. A pass writes one light row a document: set size, fingerprint of the set,
group (prefix and size), prefix, and a parity signature of the set. Documents of one set are one node, nodes of one prefix
and size one group. 3. Groups are laid out by prefix shingle. Along each shingle's list only the pairs of each group with
the list's first and with its neighbour are formed, so that a list of n groups gives 2n pairs. Pairs are filtered by size
and by signature (its bits that differ are at most the symmetric difference), and verified on the texts. 4. Verified
links give components. Only lists that hold several components go on: their groups are expanded into nodes; after
rounds of pairs of neighbours in a list, every pair of nodes from different components is filtered and verified. What is
left out lies within a component already, so that the components are exact.

Only components are produced. The links verified on the way are enough to span them, not all links: the number of links of a
document cannot be had from here.

Cases: null, empty and white-space texts have empty sets and link with nothing; shorter texts than WIDTH words have one
shingle. Ties in the order go by hash. Repeated rows are nodes of one set. A row without an id is linked by its text and
names no component; its component is null where no row of it has an id. Empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH, PERCENT = 5, 80
#: Counters of the shingle counts: COUNTERS_PER_DOC a document, a power of two within these bounds.
COUNTERS_PER_DOC, LEAST_COUNTERS, MOST_COUNTERS = 16, 1 << 16, 1 << 24
_SLICE = 1 << 15
#: Words of the short signature, which joins compare.
_WORDS = 16
#: Rounds of linear pairs along the lists that still hold several components.
ROUNDS = 1
#: Groups of which a task remembers that it has written their prefix.
REMEMBERED = 1_000_000


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each document's distinct shingles, ordered by document and hash."""
    data, offsets = common.bytes_of(texts)
    data = common.lowered(data)
    starts, ends, docs = common.word_bounds(data, offsets)
    h, d, _ = common.shingles(common.Rolling(data, 8).of(starts, ends), docs, WIDTH)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], d[new]


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (n * PERCENT + 99) // 100 + 1


def may_link(a: F.Column, b: F.Column) -> F.Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


# --- passes over the texts ---------------------------------------------------------------------------------------


def counted(source: DataFrame, counters: int) -> np.ndarray:
    """Saturating counts of hashed shingles over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        total = np.zeros(counters, np.int64)
        for batch in common.slices(batches, "_text"):
            h, _ = sets_of(batch.column("_text"))
            np.add.at(total, (h & np.uint64(counters - 1)).astype(np.int64), 1) if len(h) < 1024 else _add(total, h, counters)
        parts = np.minimum(total, 65535).astype("<u2").reshape(-1, _SLICE)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[k] = np.minimum(total.get(k, 0) + np.frombuffer(part, "<u2").astype(np.int64), 65535)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.astype("<u2").tobytes() for t in total.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    out = np.zeros((counters // _SLICE, _SLICE), np.uint16)
    # MOST_COUNTERS bound what comes to the driver, whatever the corpus
    for row in source.select("_text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["counts"], "<u2")
    return out.ravel()


def _add(total: np.ndarray, h: np.ndarray, counters: int) -> None:
    at, n = np.unique((h & np.uint64(counters - 1)).astype(np.int64), return_counts=True)
    total[at] += n


_ROW = "doc_id long, n long, node long, grp long, prefix array<long>, signature binary, bits array<long>"


def sketched(source: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n, node, grp of each document; prefix and signature where the task first meets the group and node."""
    shared = source.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        heavy = shared.value
        groups: set[int] = set()
        nodes: set[int] = set()
        for batch in common.slices(batches, "_text"):
            size = batch.num_rows
            h, d = sets_of(batch.column("_text"))
            n = np.bincount(d, minlength=size)
            order = np.lexsort((h, heavy[(h & np.uint64(len(heavy) - 1)).astype(np.int64)], d))
            h, d = h[order], d[order]
            first = np.concatenate(([0], np.cumsum(n)))
            place = np.arange(len(h)) - first[d]
            short = place < prefix_length(n)[d]
            with np.errstate(over="ignore"):
                ordered = common.mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 21)
                node = common.mix(_sums(common.mix(h, 20), d, size) + n.astype(np.uint64), 22)
                group = common.mix(_sums(np.where(short, ordered, np.uint64(0)), d, size) + n.astype(np.uint64), 23)
            node, group = node.view(np.int64), group.view(np.int64)
            prefixes, signatures, bits = [None] * size, [None] * size, [None] * size
            tokens = h.view(np.int64)
            for k in np.flatnonzero(n).tolist():
                if int(group[k]) not in groups:
                    groups.add(int(group[k]))
                    prefixes[k] = np.append(tokens[first[k] : first[k] + prefix_length(n[k : k + 1])[0]], group[k])
                if int(node[k]) not in nodes:
                    nodes.add(int(node[k]))
                    signatures[k] = _parity(h[first[k] : first[k + 1]], 1 << max(7, (2 * int(n[k]) - 1).bit_length()))
                    bits[k] = np.frombuffer(_parity(h[first[k] : first[k + 1]], 64 * _WORDS), np.int64)
            if len(groups) > REMEMBERED:
                groups.clear()
                nodes.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(node), pa.array(group), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signatures, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n", "node", "grp", "prefix", "signature", "bits"])

    return source.mapInArrow(run, _ROW)


def _sums(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if len(values):
        heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        with np.errstate(over="ignore"):
            out[docs[heads]] = np.add.reduceat(values, heads)
    return out


def _parity(h: np.ndarray, bits: int) -> bytes:
    """Bit b says whether an odd number of the set's hashes end in b. Two to four bits for each hash tell sets well."""
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of the sets. The longer signature is folded to the shorter one's length."""
    if len(a) < len(b):
        a, b = b, a
    x = np.frombuffer(a, np.uint64)
    while len(x) * 8 > len(b):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ np.frombuffer(b, np.uint64)).sum())


def alike(bits_a: F.Column, bits_b: F.Column, n_a: F.Column, n_b: F.Column) -> F.Column:
    """Whether short signatures allow a link: a link's symmetric difference is at most this share of the sizes' sum."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get(bits_a, F.lit(k)).bitwiseXOR(F.get(bits_b, F.lit(k)))) for k in range(_WORDS)])
    return apart * (100 + PERCENT) <= (100 - PERCENT) * (n_a + n_b)


# --- pairs -------------------------------------------------------------------------------------------------------


def verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link. nodes: node, n, signature and doc_id, a row that has the node's set."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    close = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(may_link(F.col("n_a"), F.col("n_b")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            union = [x + y for x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)]
            # intersection i of sets of sum s: 100 i >= PERCENT (s - i), so that the difference s - 2 i is at most this
            keep = [k for k, (x, y) in enumerate(zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)) if differing(x, y) * (100 + PERCENT) <= (100 - PERCENT) * union[k]]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    close = common.saved(close.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(near, "a long, b long"), "close")
    wanted = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", F.col("doc_id").alias("_id")), "node")
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "_text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where an id has several texts: those that have the node's set."""
        for batch in common.slices(batches, "_text"):
            h, d = sets_of(batch.column("_text"))
            n = np.bincount(d, minlength=batch.num_rows)
            with np.errstate(over="ignore"):
                node = common.mix(_sums(common.mix(h, 20), d, batch.num_rows) + n.astype(np.uint64), 22).view(np.int64)
            yield batch.filter(pa.array(node == batch.column("node").to_numpy()))

    texts = common.saved(texts.mapInArrow(own, "node long, _text string").dropDuplicates(["node"]), "texts")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                a, da = sets_of(part.column("t_a"))
                b, db = sets_of(part.column("t_b"))
                na, nb = np.bincount(da, minlength=part.num_rows), np.bincount(db, minlength=part.num_rows)
                h, d = np.concatenate((a, b)), np.concatenate((da, db))
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                both = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=part.num_rows)
                keep.append(100 * both >= PERCENT * (na + nb - both))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep))) if keep else batch.select(["a", "b"])

    text = lambda x: texts.select(F.col("node").alias(x), F.col("_text").alias(f"t_{x}"))
    return close.join(text("a"), "a").join(text("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(exact, "a long, b long")


def _spread(lists: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """token, node, n, label and bits of the lists that hold three nodes or more and several components. A group of
    several nodes is a list of its own."""
    placed = nodes.select("node", "grp", "n").join(labels, "node", "left").select("node", "grp", F.coalesce("label", "node").alias("label"))
    several = placed.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select(F.col("grp").alias("token"), "grp")
    spread = lists.select("token", "grp").distinct().unionByName(several).join(placed, "grp")
    some = spread.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo <> hi AND c > 2").select("token")
    return common.saved(spread.join(some, "token").select("token", "node", "label").join(nodes.select("node", "n", "bits"), "node").select("token", "node", "n", "label", "bits"), "open")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_column(docs, text_col).alias("_text"))
    rows = source.count()
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(1, rows * COUNTERS_PER_DOC - 1).bit_length()))
    light = common.saved(sketched(source, counted(source, counters)), "sets")
    nodes = common.saved(light.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.first("signature", ignorenulls=True).alias("signature"), F.first("bits", ignorenulls=True).alias("bits"), F.min("doc_id").alias("doc_id"), F.min("grp").alias("grp")), "nodes")
    groups = nodes.groupBy("grp").agg(F.min("node").alias("head"))

    # lists: the groups that have a shingle in their prefix; the group itself stands as a shingle of its nodes
    entries = light.where("prefix IS NOT NULL").select(F.explode("prefix").alias("token"), "grp", "n")
    by_token = Window.partitionBy("token")
    shared = entries.select("token", "grp", "n", F.min("grp").over(by_token).alias("least"), F.max("grp").over(by_token).alias("most"), F.lag("grp").over(by_token.orderBy("n", "grp")).alias("before"), F.lag("n").over(by_token.orderBy("n", "grp")).alias("n_before"))
    lists = common.saved(shared.where("least <> most"), "lists")
    first = lists.select(F.col("least").alias("x"), F.col("grp").alias("y")).where("x <> y")
    next_to = lists.where(may_link(F.col("n"), F.col("n_before")) & (F.col("before") != F.col("grp"))).select(F.least("before", "grp").alias("x"), F.greatest("before", "grp").alias("y"))
    pairs = first.unionByName(next_to).distinct()
    head = lambda x, to: groups.select(F.col("grp").alias(x), F.col("head").alias(to))
    pairs = pairs.join(head("x", "a"), "x").join(head("y", "b"), "y").select("a", "b")
    within = nodes.join(groups, "grp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = common.saved(verified(pairs.unionByName(within), nodes, source), "links")
    labels = common.saved(components(links), "labels")

    # what is left: lists with several components, node by node. First a few rounds of pairs of neighbours in a list that
    # stand in different components, which are linear; they leave few components, whose pairs are then all tried
    for _ in range(ROUNDS):
        spread = _spread(lists, nodes, labels)
        if spread.isEmpty():
            break
        orders = [Window.partitionBy("token").orderBy(*o) for o in (("label", "n", "node"), ("n", "node"), (F.xxhash64("node"), "node"))]
        fields = F.struct("node", "n", "label", "bits")
        beside = spread.select("*", *(F.lag(fields).over(o).alias(f"p{k}") for k, o in enumerate(orders))).select("node", "n", "label", "bits", F.explode(F.array("p0", "p1", "p2")).alias("p")).where(F.col("p").isNotNull() & (F.col("p.label") != F.col("label")))
        beside = beside.where(may_link(F.col("n"), F.col("p.n")) & alike(F.col("bits"), F.col("p.bits"), F.col("n"), F.col("p.n")))
        more = common.saved(verified(beside.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")), nodes, source), "links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = common.saved(components(links), "labels")
    spread = _spread(lists, nodes, labels)
    other = spread.select(F.col("token").alias("token_b"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("bits").alias("bits_b"))
    can = (F.col("node") < F.col("b")) & (F.col("label") != F.col("label_b")) & may_link(F.col("n"), F.col("n_b")) & alike(F.col("bits"), F.col("bits_b"), F.col("n"), F.col("n_b"))
    rest = spread.join(other, (F.col("token") == F.col("token_b")) & can).select(F.col("node").alias("a"), "b")
    more = common.saved(verified(rest, nodes, source), "links")
    if not more.isEmpty():
        labels = common.saved(components(links.unionByName(more)), "labels")

    placed = light.join(labels, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
    least = placed.where("label IS NOT NULL").groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("least"))
    return placed.join(least, F.col("label") == F.col("_label"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the least of their component, and those without an id. Rows that repeat an id go together."""
    gone = linked(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, other) AS (
  SELECT a, b FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.other = edge.a
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
