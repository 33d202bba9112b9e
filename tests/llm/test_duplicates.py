from __future__ import annotations

import hashlib
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomline.llm import bpe, jaccard_join, substring_dedup
from loomline.llm.components import components
from loomline.llm.suffix_array import suffix_array

from . import brute

SMALL = "/root/testdata/sf0.001"


def test_suffix_array():
    r = random.Random(5)
    for _ in range(800):
        s = [r.randrange(r.choice([1, 2, 3, 10])) for _ in range(r.randrange(0, 40))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def passages(seed):
    """Documents that share passages around the limit of 400 bytes, with copies and one passage in many documents."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    hot, docs = text(90), []
    for k in range(40):
        docs.append((k, text(r.randrange(5, 60)) + hot + text(r.randrange(5, 60))))
    shared = text(200)
    for k in range(40, 70):
        a = r.randrange(len(shared) - 460)
        docs.append((k, text(30) + shared[a : a + r.randrange(390, 460)] + text(30)))
    docs += [(70, docs[3][1]), (71, docs[3][1]), (72, "ab" * 600), (73, None), (74, ""), (75, "x" * 399), (76, "x" * 401), (77, docs[3][1][:-1])]
    return docs


@pytest.mark.parametrize("most", [2000, 2])
def test_repeated_substrings(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_CONTEXTS", most)
    docs = passages(most)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in substring_dedup.deduplicated(df).collect()}
    assert got == brute.substrings(docs)
    assert substring_dedup.deduplicated(df.limit(0)).count() == 0


def test_repeated_rows_are_copies(spark):
    row = (1, "q" + "".join(chr(97 + k * k % 23) for k in range(450)))
    got = substring_dedup.deduplicated(spark.createDataFrame([row, row, (2, "z" * 10)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], len(r["kept"])) for r in got) == [(1, 0), (1, 0), (2, 10)]


def near_copies(seed, groups=3, size=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    docs = []
    common = [word() for _ in range(60)]
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(60, 160))]
        for _ in range(size):
            words = base[:]
            for _ in range(r.randrange(0, 6)):
                at = r.randrange(len(words))
                words[at : at + r.randrange(2)] = [word()]
            docs.append(" ".join(words))
    docs += [" ".join([word() for _ in range(r.randrange(3, 30))] + common + [word() for _ in range(r.randrange(3, 30))]) for _ in range(30)]
    docs += [None, "", " \n", "one two", "ONE Two", "one two three four five", docs[0].upper(), docs[0]]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_links(spark, seed):
    docs = near_copies(seed)
    got = jaccard_join.linked(spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, n int, node int").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(docs) and len(got) == len(docs)


def test_links_of_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m"), (None, "solo text of six words here")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 5), (None, 5), (5, 5), (5, 5), (5, 5), (None, None)], key=str)
    assert jaccard_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_graph(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 102), (101, 103), (7, 7), (200, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 200], 0), **dict.fromkeys([100, 101, 102, 103], 100)}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = duckdb.sql(f"select doc_id, text, source from read_parquet('{SMALL}/documents.parquet') order by 1").fetchall()
    kept = [(d, t) for d, (ok, t) in brute.quality(docs).items() if ok]
    gone = brute.lines_removed(kept)
    cut = []
    for d, t in kept:
        drop = {k for part in gone.get(d, ((), ())) for k in part}
        text = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop) if d in gone else t
        if d not in gone or brute.WORD.search(text):
            cut.append((d, text))
    heads = brute.components(cut)
    unique = [(d, t) for d, t in cut if heads[d][1] == d]
    items = [r[0] for r in duckdb.sql(f"select text from read_parquet('{SMALL}/benchmark.parquet')").fetchall()]
    clean = [(d, t) for d, t in unique if not brute.contaminated(t, items)]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.coder(f.read(), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: (len(ids := library.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in clean}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()} == want
