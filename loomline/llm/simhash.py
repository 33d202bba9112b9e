"""Near duplicates by SimHash: fingerprints of 64 bits, linked where few bits differ, found by a trie's self-join.

A fingerprint's bit is set where it is set in over half of the document's shingle hashes. Equal fingerprints are one node, so
that copies cost one row. Of BLOCKS blocks of bits, one more than the bits that may differ, one is equal in each link: rows
are routed by the bits of each block, which is the part of the trie where both nodes of a pair are the same. A task then
goes down the rest of a bucket's trie with pairs of nodes: a pair of nodes splits into pairs of their children, a pair of
unlike children costs one of the bits that may differ, and a pair that has spent more is dropped with all below it. A bucket
over LEAF nodes is routed once more by blocks of the bits that are left; distinct fingerprints that share more and more bits
become few, so that this ends. A link counts in the first bucket that has it alone.

A task gives its links' spanning part and sums of links, both at most a row a node; components come from those of all tasks.

Cases: null, empty and white-space texts have fingerprint zero and link like any other; texts of fewer than WIDTH words
have one shingle. Half of the hashes is not over half, so that ties leave a bit unset. Repeated rows have equal fingerprints
and are linked. A row without an id is linked by its text and names no component, which is null where no row has an id. Very
long texts are read whole, in time linear in their length. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH, SEED, MOST_BITS = 3, 42, 3
BLOCKS = MOST_BITS + 1
#: Nodes of a bucket that one task takes; larger ones are routed by further bits.
LEAF = 1 << 15
#: Hashes whose bits are counted at once, and pairs of nodes or of fingerprints that are held at once.
_AT_ONCE, _PAIRS = 1 << 16, 1 << 18
_ALL = (1 << 64) - 1


# --- fingerprints ------------------------------------------------------------------------------------------------


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint of a text."""
    words = text.encode().lower().split()  # of bytes: A-Z alone, and white space of ASCII alone
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        hashes = [digest(joined[s:e], SEED) for s, e in zip((ends - sizes)[: -WIDTH + 1].tolist(), ends[WIDTH - 1 :].tolist(), strict=True)]
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _AT_ONCE):
        part = np.array(hashes[k : k + _AT_ONCE], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text", 4 << 20):
            found = [fingerprint(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_column(docs, text_col).alias("_text")).mapInArrow(run, "doc_id long, fp long")


# --- routing -----------------------------------------------------------------------------------------------------


class Route:
    """Blocks of bits that a bucket shares, chosen level by level: `mask` holds their bits, `earlier` the masks of the blocks
    before each chosen one. A link belongs to the route on which none of these is equal."""

    def __init__(self, mask: int = 0, earlier: tuple[int, ...] = ()):
        self.mask, self.earlier = mask, earlier

    def deeper(self) -> list[Route]:
        free = [b for b in range(63, -1, -1) if not self.mask >> b & 1]
        cuts = [round(k * len(free) / BLOCKS) for k in range(BLOCKS + 1)]
        blocks = [sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return [Route(self.mask | block, (*self.earlier, *blocks[:k])) for k, block in enumerate(blocks)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_nodes(nodes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(a, b, n) for nodes of distinct fingerprints fp that stand for `copies` rows each: links that span the components
    (n null), and the number n of rows with other fingerprints that link with a (b null), in parts to be summed."""
    routes = [Route()]
    rest, found = nodes.select("fp", "copies", F.lit(0).alias("route")), None
    while True:
        last, routes, children = len(routes), [*routes], {}
        for k in [int(r["route"]) for r in rest.select("route").distinct().collect()]:  # routes that are still open: at most BLOCKS ** level
            children[k] = list(range(len(routes), len(routes) + BLOCKS))
            routes += routes[k].deeper()
        if len(routes) == last:
            break
        step = F.coalesce(*(F.when(F.col("route") == k, F.array(*(F.struct(F.lit(c).alias("route"), F.lit(signed(routes[c].mask)).alias("mask")) for c in to))) for k, to in children.items()))
        spread = rest.select("fp", "copies", F.inline(step)).select("route", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp", "copies")
        sizes = spread.groupBy("route", "bucket").agg(F.count("*").alias("size")).where("size > 1")
        held = common.saved(spread.join(sizes, ["route", "bucket"]), "buckets")
        # routes still to come are not in the closure, so that tasks see those of their rows
        part = held.where(F.col("size") <= leaf).select("route", "bucket", "fp", "copies").repartition("route", "bucket").sortWithinPartitions("route", "bucket").mapInArrow(_joiner(tuple(routes)), "a long, b long, n long")
        found = part if found is None else found.unionByName(part)
        rest = held.where(F.col("size") > leaf).select("fp", "copies", "route")
    return nodes.select(F.col("fp").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("n")).limit(0) if found is None else found


# --- the trie's self-join ----------------------------------------------------------------------------------------


def _joiner(routes: tuple[Route, ...]):
    width = max(1, *(len(r.earlier) for r in routes))
    earlier = np.array([[*r.earlier, *[_ALL] * (width - len(r.earlier))] for r in routes], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("route", "bucket", "fp", "copies")
        open_rows = [np.zeros(0, np.int64) for _ in columns]
        for batch in batches:
            open_rows = [np.concatenate((old, batch.column(c).to_numpy())) for old, c in zip(open_rows, columns, strict=True)]
            if len(open_rows[0]) < LEAF:
                continue
            last = np.flatnonzero((open_rows[0] != open_rows[0][-1]) | (open_rows[1] != open_rows[1][-1]))
            if len(last):  # whole buckets
                yield _answers(*(c[: last[-1] + 1] for c in open_rows), earlier)
                open_rows = [c[last[-1] + 1 :] for c in open_rows]
        if len(open_rows[0]):
            yield _answers(*open_rows, earlier)

    return run


def _answers(route: np.ndarray, bucket: np.ndarray, fp: np.ndarray, copies: np.ndarray, earlier: np.ndarray) -> pa.RecordBatch:
    """Spanning links and numbers of links of some buckets, whose rows follow one another."""
    bits = fp.astype(np.int64).view(np.uint64)
    of = np.cumsum(np.append(0, (route[1:] != route[:-1]) | (bucket[1:] != bucket[:-1])))
    order = np.lexsort((bits, of))
    bits, route, copies, of = bits[order], route[order], copies[order], of[order]
    root, many, spanning = np.arange(len(bits)), np.zeros(len(bits), np.int64), []
    for a, b in near_pairs(bits, of):
        own = ((bits[a] ^ bits[b])[:, None] & earlier[route[a]]).all(axis=1)
        a, b = a[own], b[own]
        many += np.bincount(a, copies[b], len(bits)).astype(np.int64) + np.bincount(b, copies[a], len(bits)).astype(np.int64)
        open_pairs = np.flatnonzero(root[a] != root[b])
        _, first = np.unique(root[a[open_pairs]] * len(bits) + root[b[open_pairs]], return_index=True)
        for x, y in zip(a[open_pairs[first]].tolist(), b[open_pairs[first]].tolist(), strict=True):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                spanning.append((x, y))
        while (root[root] != root).any():
            root = root[root]
    x, y = np.array(spanning, np.int64).reshape(-1, 2).T
    some = np.flatnonzero(many)
    signed_bits = bits.view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((signed_bits[x], signed_bits[some]))), pa.array([*signed_bits[y].tolist(), *[None] * len(some)], pa.int64()), pa.array([*[None] * len(x), *many[some].tolist()], pa.int64())], ["a", "b", "n"]
    )


def near_pairs(bits: np.ndarray, of: np.ndarray, most: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of the pairs of one tree that differ in `most` bits at most. bits ascend within each tree `of`.

    A node is a range of places that share their leading bits; pairs of nodes stand in five columns: two ranges and the bits
    spent. All pairs of nodes of one depth go down a bit together; pairs of small nodes are compared at once."""
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    tails = np.append(heads[1:], len(bits))
    ones: dict[int, np.ndarray] = {}
    todo = [(0, np.stack((heads, tails, heads, tails, np.zeros_like(heads))))]
    while todo:
        depth, pairs = todo.pop()
        size = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        small = (size <= 64) | (depth == 64)
        few = pairs[:, small]
        for part in _portions(few, size[small]):
            yield from _compared(bits, part, most)
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if depth not in ones:
            ones[depth] = np.append(0, np.cumsum(bits >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int64))
        a, a_end, b, b_end, spent = pairs
        a_mid, b_mid = a_end - (ones[depth][a_end] - ones[depth][a]), b_end - (ones[depth][b_end] - ones[depth][b])
        cross = a != b
        children = [np.stack((a, a_mid, b, b_mid, spent)), np.stack((a_mid, a_end, b_mid, b_end, spent)), np.stack((a, a_mid, b_mid, b_end, spent + 1)), np.stack((a_mid, a_end, b, b_mid, spent + 1))[:, cross]]
        below = np.concatenate(children, axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= most)]
        todo += [(depth + 1, below[:, k : k + _PAIRS]) for k in range(0, below.shape[1], _PAIRS)]


def _portions(pairs: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, "right")))
        yield pairs[:, start:stop]
        start = stop


def _compared(bits: np.ndarray, pairs: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a, a_end, b, b_end, _ = pairs
    wide = b_end - b
    size = (a_end - a) * wide
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(wide, size)
    x, y = np.repeat(a, size) + at // wide, np.repeat(b, size) + at % wide
    near = (x < y) & (np.bitwise_count(bits[x] ^ bits[y]) <= most)
    yield x[near], y[near]


# --- documents ---------------------------------------------------------------------------------------------------


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id, and n_links, the number of other rows that each row links with."""
    light = common.saved(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = common.saved(light.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "nodes")
    found = common.saved(linked_nodes(nodes, leaf), "links")
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    many = found.where("b IS NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    placed = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "label").join(many, "fp", "left").select("fp", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return light.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.read(spark, sf_dir, "documents"))
