"""SimHash near duplicates against all pairs."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest
import xxhash

from loomline.llm import queries, simhash

from .brute import LOWER, WORD

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [words] if 0 < len(words) < 3 else [words[k : k + 3] for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(docs):
    """[(doc_id, fingerprint, component_id, n_links)] by all pairs of rows."""
    prints = [plain_fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted(((d, f"{prints[k]:016x}", least.get(root(k)), links[k]) for k, (d, _) in enumerate(docs)), key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "fingerprint", "component_id", "n_links")) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_query(spark):
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{SMALL}/documents.parquet')").fetchall()
    got = rows(queries.queries()["op13_simhash"](spark, SMALL))
    assert got == plain(docs)
    assert len({c for _, _, c, _ in got}) < len(got)


def test_cases(spark):
    chance = random.Random(3)
    words = [chance.choice(["Alpha", "beta", "gamma", "delta", "épsilon", "zeta"]) + str(chance.randrange(9)) for _ in range(60_000)]
    long = " ".join(words)
    texts = [None, "", " \t\n", "one", "One", "one two", "one  two three", "ONE two\x0bthree", "Éa b c", "éa b c", long, long + " tail", long, long[: len(long) // 2]]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "alone of its kind"), (None, long), (3, "a repeated id")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, fp string, component_id int")
    assert rows(simhash.linked(df)) == plain(docs)
    assert rows(simhash.linked(df.limit(0))) == []


@pytest.mark.parametrize("leaf", [simhash.LEAF, 3])
def test_deeper_routes(spark, leaf):
    """Clouds of near fingerprints: large buckets are routed again and lose no link."""
    random_bits = np.random.default_rng(5)
    prints = set(random_bits.integers(0, 1 << 62, 60).tolist())
    for f in list(prints)[:6]:
        for _ in range(40):
            prints.add(f ^ sum({1 << int(b) for b in random_bits.integers(0, 60, 3)}))
    prints = sorted(prints)
    copies = {f: 1 + f % 3 for f in prints}
    near = [(a, b) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 3]
    found = simhash.linked_nodes(spark.createDataFrame(list(copies.items()), "fp long, copies long"), leaf).collect()
    many = dict.fromkeys(prints, 0)
    for a, b in near:
        many[a] += copies[b]
    got = dict.fromkeys(prints, 0)
    for r in found:
        if r["b"] is None:
            got[r["a"]] += r["n"]
        else:
            assert (r["a"] ^ r["b"]).bit_count() <= 3
    assert got == many
    label = {f: f for f in prints}
    for pairs in (near, [(r["a"], r["b"]) for r in found if r["b"] is not None]):
        parent = dict(label)
        for _ in range(len(prints)):
            before = dict(parent)
            for a, b in pairs:
                parent[a] = parent[b] = min(parent[a], parent[b])
            if parent == before:
                break
        label_of = parent
        near_labels = label_of if pairs is near else near_labels
    assert near_labels == label_of
